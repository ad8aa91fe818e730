"""Registered queries of the corpus operators: each reads its whole table from sf_dir and returns every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _read(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge(_read(spark, sf_dir, "pages"), urlfilter.RULES)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.build(_read(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


#: Token shares of the domains that `labels` tells apart.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_read(spark, sf_dir, "documents"), labelled_domains(_read(spark, sf_dir, "labels")), TARGETS)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import dac
    from trailspark.operators.scratch import scratch_path

    path = scratch_path(spark, "dac")
    dac.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return dac.read(spark, path)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sketch

    return sketch.fingerprints(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexsearch

    return lexsearch.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pqcodes

    return pqcodes.compress(_read(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _read(spark, sf_dir, "documents")
    return quality.predict(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_url_filters": op3_url_filters,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_packing": op10_packing,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_vector_code_compression": op12_vector_code_compression,
    "op13_quality_classifier": op13_quality_classifier,
}

def _lloyd_sql(rounds: int = 4) -> str:
    """Four codebooks by Lloyd's rounds, written out: c0 is the start, a0 its assignment, c1 the next codebook, and so on."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT row, pos, x, min({{'d': list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c), 'e': entry}}) AS best FROM p JOIN c{r} USING (pos) GROUP BY row, pos, x
        )""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT pos, entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
                    SELECT pos, entry, list(mean ORDER BY k) AS m FROM (
                        SELECT pos, best.e AS entry, k, floor(sum(x[k]) / count(*)) AS mean FROM a{r}, range(1, 17) t(k) GROUP BY ALL
                    ) GROUP BY pos, entry
                ) USING (pos, entry)
            )""")
    last = f"a{rounds}"
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), p AS MATERIALIZED (SELECT row, pos, x[16 * pos + 1 : 16 * pos + 16] AS x FROM v, range(4) t(pos)),
        c0 AS MATERIALIZED (SELECT pos, row - 1 AS entry, x AS c FROM p WHERE row <= 256), {", ".join(steps)},
        f AS (SELECT vec_id, label, string_agg(lpad(format('{{:x}}', best.e), 2, '0'), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM {last} JOIN v USING (row) GROUP BY row, vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY pos, entry)) FROM c{rounds}) AS codebooks_sha256
        FROM f
    """


#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.c, x.c)::BIGINT AS score
            FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_ranked_lexical_search": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
        ), i AS MATERIALIZED (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
        ), n AS (SELECT row, count(*) AS n FROM d GROUP BY 1), c AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
        t AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY row, term),
        w AS (SELECT term, floor(1000 * ln((2 * (SELECT N FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t GROUP BY term),
        s AS (
            SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * (SELECT N FROM c)) // (SELECT L FROM c)))))::BIGINT AS score
            FROM i JOIN t USING (term) JOIN w USING (term) JOIN n USING (row) GROUP BY item_id, row
        ), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
    """,
    "op12_vector_code_compression": _lloyd_sql(),
}
