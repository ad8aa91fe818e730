from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.fixtures import ROWS, documents
from tests.llm.test_classifiers import is_held_out
from trailspark.llm import quality


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_pairs_are_summed_in_linear_time():
    rng = np.random.default_rng(4)
    size = 40
    w, v = rng.normal(0, 1, size), rng.normal(0, 1, (size, quality.RANK))
    model = quality.QualityModel(0.3, w, v, (v * v).sum(axis=1))
    vectors = [(rng.choice(size, n, replace=False).astype(np.int32), rng.normal(0, 1, n)) for n in (1, 2, 7, 40)]
    for (index, x), z in zip(vectors, model.logits(vectors), strict=True):
        pairs = sum(v[i] @ v[j] * a * b for k, (i, a) in enumerate(zip(index, x, strict=True)) for j, b in list(zip(index, x, strict=True))[k + 1 :])
        assert math.isclose(z, 0.3 + w[index] @ x + pairs, rel_tol=1e-9, abs_tol=1e-9)


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    texts, label = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        filler = " ".join(rng.choice([f"f{i}" for i in range(30)], 4))
        texts.append(f"{'red' if a else 'blue'} {'up' if b else 'down'} {filler}".encode())
        label.append(int(a ^ b))
    vectors = [quality.vector(t, ()) for t in texts]
    model = quality.fit(vectors[:500], label[:500], meta=(), epochs=60)
    assert ((model.scores(texts[500:], [()] * 100) >= 0.5) == np.array(label[500:])).mean() > 0.95


def test_long_texts_are_read_whole_in_pieces(monkeypatch):
    raw = ("One line of words, repeated repeated! 12\n" * 500 + "x" * 5000 + " end").encode()
    want = dict(zip(*quality.vector(raw, (3.0,)), strict=True))
    monkeypatch.setattr(quality, "PIECE", 700)
    got = dict(zip(*quality.vector(raw, (3.0,)), strict=True))
    assert want == got
    model = quality.fit([quality.vector(b"plain words here", ()), quality.vector(b"bad bad bad bad", ())] * 20, [1, 0] * 20, meta=())
    assert model.scores([b"plain words here " * 10_000 + b"bad " * 900_000], [()])[0] < model.scores([b"plain words here " * 10_000], [()])[0]


def test_edge_cases(spark):
    docs = documents(spark)
    marked = labels(spark, [(i, int(i % 3 == 0), 0, "z") for i in range(1, 11)] + [(1, 1, 0, "z"), (3, 0, 1, "z"), (None, 1, 0, "z"), (8, None, 0, None), (777, 0, 1, "z")])
    model = quality.train(docs, marked, epochs=2)
    rows = quality.predict(docs, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.7) and r.held_out == is_held_out(r.doc_id)
        if r.doc_id in (4, 5, 9):
            assert r.score == 0.0
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    for nothing in (marked.where("false"), marked.where("quality = 1 and doc_id is not null")):
        assert {r.score for r in quality.predict(docs, quality.train(docs, nothing)).collect()} == {0.0, 0.5}
    assert quality.predict(docs.where("false"), model).count() == 0
    assert quality.predict(docs.drop("n_chars"), model).count() == len(ROWS)


def test_only_learned_rows_and_no_other_columns_matter(spark):
    docs, marked = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, marked, epochs=3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = quality.train(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz")), marked.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(9)), epochs=3)
    assert model.bias == other.bias and (model.weight == other.weight).all() and (model.factor == other.factor).all()


def test_held_out_accuracy(spark):
    docs, marked = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.predict(docs, quality.train(docs, marked)).join(marked, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    plain = [quality.vector(r.text.encode(), (r.n_chars,)) for r in docs.limit(40).collect()]
    model = quality.train(docs, marked)
    want = {r.doc_id: r.score for r in quality.predict(docs, model).collect()}
    for r, x in zip(docs.limit(40).collect(), plain, strict=True):
        dense = np.zeros(len(model.weight))
        dense[x[0]] = x[1]
        at = np.nonzero(dense)[0]
        z = model.bias + model.weight[at] @ dense[at] + sum(model.factor[i] @ model.factor[at[k + 1 :]].T @ dense[at[k + 1 :]] * dense[i] for k, i in enumerate(at))
        assert math.isclose(want[r.doc_id], 1 / (1 + math.exp(-np.clip(z, -50, 50))), rel_tol=1e-6, abs_tol=1e-9)
