from __future__ import annotations

import zlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.fixtures import ROWS, documents
from trailspark.llm import langid, mixing, toxicity
from trailspark.llm.common import first_by_hash


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_language_edge_cases(spark):
    docs = documents(spark)
    model = langid.train(docs)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.held_out == is_held_out(r.doc_id)
        if r.doc_id is not None:
            assert r.lang_pred == "und" if r.doc_id in (4, 5, 6, 9) else r.lang_pred in model.dictionaries
    assert sum(r.lang_pred == "und" for r in rows) == 5
    assert langid.keep_accepted(docs, model).columns == docs.columns
    empty = docs.where("false")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert langid.predict(docs, langid.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_texts_without_letters_are_undetermined(spark):
    model = langid.train(documents(spark))
    for text in ("½ ²³", "①② Ⅳ", "123", "\u0301\u0301", "_ _", "🎉"):
        assert model.predict(text) == ("und", 0.0, 0.0, False), text
    assert langid.normalised("हिन्दी  में, में मेंमें E\u0301t\u0301e 12") == "हिन्दी में मेंमें e\u0301t\u0301e "


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, f"zzz{i} qqq{i} " * 20, "xx", "a") for i in range(40) if is_held_out(i)] + [(i, "plain words here " * 5, "en", "a") for i in range(40) if not is_held_out(i)]
    assert set(langid.train(documents(spark, rows)).dictionaries) == {"en"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.9


def test_language_does_not_read_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    assert sorted(langid.predict(docs, model).collect()) == sorted(langid.predict(other, model).collect())


def toxic_texts():
    rng = np.random.default_rng(0)
    plain = [f"w{i}orld" for i in range(200)]
    bad = ["idiot", "worthless", "pathetic", "moron"]
    texts, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, 60))
        if i % 2:
            words[int(rng.integers(60))] = bad[i // 2 % 4]
        texts.append(" ".join(words))
        labels.append(i % 2)
    return texts, labels


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.fit(*toxic_texts())


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_unseen_spellings_share_the_value_whatever_the_seed(seed):
    model = toxicity.fit(*toxic_texts(), seed=seed)
    clean = " ".join(f"w{i}orld" for i in range(50))
    spellings = ["idiott", "iddiot", "mor0n", "morron", "moronn", "worthles", "worthlesss", "w0rthless", "pathetik", "patheticc"]
    scores = model.scores([clean, *(f"{clean} {word} {clean}" for word in spellings)])
    assert scores[0] < 0.3 and (scores[1:] >= 0.3).all()
    assert np.isfinite(model.bucket_logits).all() and abs(model.bias) < 20


def test_toxicity_scores_are_spread_and_right_on_held_out_rows(spark):
    """On sf0.1: 26 errors of 990 at most, and fewer than half of the scores next to 0 or 1."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.predict(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted != r.toxic for r in rows) <= 26
    assert sum(r.score < 1e-6 or r.score > 1 - 1e-6 for r in rows) < len(rows) / 2


def test_toxicity_separates_and_shares_subwords(toxic_model):
    clean = " ".join(f"w{i}orld" for i in range(50))
    scores = toxic_model.scores([clean + " idiot " + clean, clean, clean + " idiott " + clean, None, "", " \n "])
    assert scores[0] >= 0.3 and scores[2] >= 0.3 and scores[1] < 0.3
    assert list(scores[3:]) == [0.0, 0.0, 0.0]


def test_toxicity_reads_whole_texts(toxic_model):
    filler = " ".join(f"w{i % 150}orld" for i in range(30_000))
    assert toxic_model.scores([filler + " worthless"])[0] >= 0.3 > toxic_model.scores([filler])[0]


def test_toxicity_reads_runs_without_spaces(toxic_model):
    filler = [f"w{i % 150}orld" for i in range(2500)]
    for joint in ("/", "_", "-", ",", "<>"):
        clean, toxic = joint.join(filler), joint.join([*filler, "worthless", *filler[:50]])
        assert toxic_model.scores([toxic])[0] >= 0.3 > toxic_model.scores([clean])[0]
    alone = ["".join(filler), "".join([*filler, "worthless", *filler[:50]])]
    clean, toxic = toxic_model.scores(alone)
    assert toxic > clean


def test_pieces_hold_every_ngram_of_a_run():
    for run in ("日本語" * 30, "x" + "abcdefghij" * 7 + "z", "-" * 50, "q" * 41, "🎉" * 45):
        got = {p[i : i + n] for p in toxicity.words_of(run) for n in range(1, 6) for i in range(len(p) - n + 1)}
        assert got == {run[i : i + n] for n in range(1, 6) for i in range(len(run) - n + 1)}
    for n in range(41, 80):
        run = "".join(chr(97 + i % 26) for i in range(n))
        words = toxicity.words_of(run)
        assert max(map(len, words)) <= toxicity.PIECE and {run[i : i + 5] for i in range(n - 4)} <= {p[i : i + 5] for p in words for i in range(len(p) - 4)}


def test_toxicity_edge_cases(spark, toxic_model):
    docs = documents(spark)
    rows = toxicity.predict(docs, toxic_model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.keep_clean(docs, toxic_model).columns == docs.columns
    labels = spark.createDataFrame([(1, 1, 1, "x"), (1, 0, 0, "x"), (3, 1, 0, "x"), (99, 1, 1, "x"), (None, 1, 1, "x"), (5, 0, None, "x")], "doc_id bigint, quality int, toxic int, text string")
    toxicity.train(docs, labels)
    nothing = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.predict(docs, nothing).collect()} == {0.0}
    assert toxicity.predict(docs.where("false"), toxic_model).count() == 0


def test_long_and_repeated_texts_leave_the_sample_whole(spark):
    ids = [i for i in range(200) if not is_held_out(i)]
    rows = [(i, ("long " * 3000 if i % 2 else "") + f"fine words number {i}" + (" idiot" if i % 4 < 2 else ""), None, None) for i in ids]
    rows += [(ids[0], "idiot " * 3, None, None)] * 30
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in ids], "doc_id bigint, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, found, *a, **k: seen.append((texts, found))
    try:
        for _ in range(2):
            toxicity.train(documents(spark, rows), labels, documents_per_label=20, longest=1000)
    finally:
        toxicity.fit = fit
    assert seen[0] == seen[1] and seen[0][1].count(0) == seen[0][1].count(1) == 20 and max(map(len, seen[0][0])) <= 1000


def test_ngrams_do_not_depend_on_the_batch():
    alone = [toxicity.ngrams([w], 1 << 16)[0].tolist() for w in ("idiot", "a", "Ünïcode", "!!!")]
    flat, size = toxicity.ngrams(["idiot", "a", "Ünïcode", "!!!"], 1 << 16)
    ends = np.cumsum(size)
    assert [sorted(flat[a:b].tolist()) for a, b in zip(ends - size, ends)] == [sorted(x) for x in alone]


def test_mixing_meets_targets(spark):
    members = spark.createDataFrame([(i, 10 + i % 7, [0.9, 0.1] if i % 4 else [0.2, 0.8]) for i in range(400)], "doc_id bigint, n_tokens bigint, posterior array<double>")
    for targets in ({"a": 0.5, "b": 0.5}, {"a": 0.8, "b": 0.2}):
        rates = mixing.fit_rates(members, ("a", "b"), targets)
        rows = mixing.rated(members, rates).collect()
        total = sum(r.n_tokens for r in rows)
        got = sum(r.n_tokens * r.rate * r.posterior[0] for r in rows) / total
        assert got == pytest.approx(targets["a"], abs=1e-4) and min(r.rate for r in rows) >= 0


def test_mixing_infeasible_target_is_the_least_squares_fit(spark):
    data = [(i, 10, [0.7, 0.3] if i % 2 else [0.6, 0.4]) for i in range(50)]
    members = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, posterior array<double>")
    rates = mixing.fit_rates(members, ("a", "b"), {"a": 1.0, "b": 0.0}, most_steps=500)
    p, t = np.array([d[2] for d in data]), np.array([d[1] for d in data], float)
    inverse, wanted = np.linalg.pinv(p.T @ (t[:, None] * p)), np.array([t.sum(), 0.0])
    loss = lambda r: (p.T @ (t * r) - wanted) @ inverse @ (p.T @ (t * r) - wanted)
    grid = [loss(np.where(np.arange(50) % 2, x, y)) for x in np.linspace(0, 4, 81) for y in np.linspace(0, 4, 81)]
    assert loss(rates.of(p)) <= min(grid) * 1.01 + 1e-6


def test_mixing_edge_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, "x"), (3, "y"), (7, "y"), (7, "x"), (None, "x"), (8, None), (99, "z")], "doc_id bigint, domain string")
    rows = mixing.mix(docs, labels, {"x": 0.5, "y": 0.5}).collect()
    assert len(rows) == len(ROWS) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in rows)
    assert {r.rate for r in mixing.mix(docs, labels.where("false"), {"x": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.where("false"), labels, {"x": 1.0}).count() == 0
    model = mixing.train(docs, labels)
    members = mixing.memberships(docs, model)
    with pytest.warns(UserWarning, match="q"):
        rates = mixing.fit_rates(members, model.domains, {"q": 1.0})
    assert {(r.rate, r.copies) for r in mixing.rated(members, rates).collect()} == {(1.0, 1)}
    assert mixing.resampled(docs, model, rates).count() == len(ROWS) and mixing.resampled(docs, model, rates).columns == docs.columns
    for bad in (-1.0, float("nan")):
        with pytest.raises(ValueError):
            mixing.fit_rates(members, model.domains, {"x": bad})


def test_first_by_hash_equals_a_plain_ranking(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("kind"), "id", F.xxhash64(F.col("id").cast("string")).alias("h"))
    often = rows.where("id = 7").crossJoin(spark.range(5000).select(F.lit(1))).select(*rows.columns)
    got = {(r.kind, r.id) for r in first_by_hash(rows.unionByName(rows.where("id < 100")).unionByName(often), "kind", 30).collect()}
    plain: dict = {}
    for r in rows.collect():
        plain.setdefault(r.kind, []).append((r.h, r.id))
    assert got == {(kind, i) for kind, found in plain.items() for _, i in sorted(found)[:30]}
