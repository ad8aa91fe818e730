"""The training-data pipeline: five operators, one after the other, over all documents.

Each stage takes what its predecessor kept. All but the last return the columns of documents; the last returns packed
pieces. Between stages run() writes Parquet to the scratch folder that the cluster names and reads it back.

Edge cases: null and empty texts are not toxic, have no language (so the second stage drops them), are copies of each
other, have no tokens to mix, and pack as the end id alone. Rows without an id are kept or dropped like others. Rows that
repeat id and text are one document to the third stage; rows that share an id but not the text are told apart. Further
columns, whatever their names, are carried along and never read. Of empty tables every stage makes an empty one; without
labels nothing is toxic and every document is mixed in once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailspark.llm import langid, mixing, packing, simhash, toxicity
from trailspark.operators.scratch import written
from trailspark.llm.queries import labelled_domains

#: Token shares of the domains told apart by the labels' quality; toxic documents are gone by then.
TARGETS = {"good": 0.9, "poor": 0.1}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; a text without words stays."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, for want of letters or of a clear margin, go."""
    return langid.keep_accepted(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is repeated or left out by its fitted rate; a domain without a labelled document has no share."""
    labels = labelled_domains(_labels(spark, sf_dir)).where("domain <> 'toxic'")
    model = mixing.train(docs, labels)
    members = written(mixing.memberships(docs, model), "memberships")
    rates = mixing.fit_rates(members, model.domains, TARGETS)
    return mixing.resampled(docs, model, rates)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, every window with the sources' shares."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", drop_toxic), ("language_id", known_language), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
