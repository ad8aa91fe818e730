"""What models are fitted on, and most of what is counted, never reaches the driver."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from trailspark.llm import mixing, simhash, toxicity
from trailspark.llm.common import fitted


def test_samples_do_not_reach_the_driver(spark, monkeypatch):
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.concat(F.lit("a river walk "), F.when(F.col("id") % 4 == 0, "idiot").otherwise("bread"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.when(F.col("doc_id") % 2 == 0, "good").otherwise("poor").alias("domain"))
    frame, taken = type(docs), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: taken.extend(self.columns) or collect(self))
    model = toxicity.train(docs, labels)
    assert model.scores(["an idiot walk"])[0] > model.scores(["a bread walk"])[0]
    assert mixing.train(docs, labels.select("doc_id", "domain")).domains == ("good", "poor")
    assert "model" in taken and not {"text", "x"} & set(taken)


def test_fitted_runs_in_a_task_and_without_rows(spark):
    assert fitted(spark.range(5), lambda rows: (sorted(r["id"] for r in rows), os.getpid()))[0] == [0, 1, 2, 3, 4]
    assert fitted(spark.range(5), lambda rows: os.getpid()) != os.getpid()
    assert fitted(spark.range(0), len) == 0


def test_most_frequent_takes_whole_counts_up_to_the_limit(spark):
    counts = spark.createDataFrame([(-1, 9), (2, 9), (3, 7), (4, 5), (5, 5)], "token long, count long")
    assert simhash._most_frequent(counts, 5).tolist() == [-1, 2, 3, 4, 5]
    assert simhash._most_frequent(counts, 4).tolist() == [-1, 2, 3]
    assert simhash._most_frequent(counts, 1).tolist() == []
    assert simhash._most_frequent(counts.limit(0), 4).tolist() == []
