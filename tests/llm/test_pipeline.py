"""Every stage of the pipeline, and the whole, against plain versions on a small folder of tables."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailspark.llm import langid, mixing, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _key int, row string, domain string"
WORDS = {"en": "the a river house green walks often under morning bread music child stone window".split(), "de": "der die fluss haus grün läuft oft unter morgen brot musik kind stein fenster".split()}


def tables(spark, path, rows, labels):
    made = [(i, t, lang, s, None if t is None else len(t), 0.5, 7, "x", "y") for i, t, lang, s in rows]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.choice([25, 60, 200]))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "worthless"])
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
        labels.append((i, int(i % 3 > 0), int(i % 5 == 0)))
    rows += [(200 + i, rows[2 * i + 1][1] + " more", "en", "s1") for i in range(20)] + [(300, rows[1][1], "en", None), (300, rows[1][1], "en", None), (1, "quite another text about the river and the house and the stone", "en", "s0")]
    rows += [(400, None, "en", "s1"), (401, "", None, None), (402, "123 ½ !!", "en", "s1"), (None, rows[3][1], "en", "s0"), (403, "the green river house " * 3000, "en", "s2")]
    labels += [(1, None, 1), (None, 1, 1), (9999, 1, 0), (2, None, None)]
    return tables(spark, tmp_path_factory.mktemp("tables"), rows, labels)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("nothing"), [], [])


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxicity_stage(spark, folder):
    docs = read(spark, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    want = [tuple(r) for r in rows if model.scores([r.text])[0] < 0.3]
    got = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns and listed(got) == sorted(want, key=str) and 0 < len(want) < len(rows)


def test_language_stage(spark, folder):
    docs = read(spark, folder)
    model = langid.train(docs)
    want = [tuple(r) for r in docs.collect() if model.predict(r.text)[3]]
    got = corpus_pipeline.known_language(spark, docs, folder)
    assert got.columns == docs.columns and listed(got) == sorted(want, key=str)
    assert not {400, 401, 402} & {r[0] for r in want}


def test_near_dedup_stage(spark, folder):
    docs = read(spark, folder)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    words = [(r.text or "").lower().split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i].doc_id)
    got = corpus_pipeline.near_dedup(spark, docs, folder)
    kept = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and sorted(kept, key=str) == sorted((ids[0] for ids in classes.values()), key=str) and len(kept) < len(rows)


def test_mixing_stage(spark, folder):
    docs = read(spark, folder)
    labels = corpus_pipeline.labelled_domains(spark.read.parquet(f"{folder}/labels.parquet")).where("domain <> 'toxic'")
    model = mixing.train(docs, labels)
    rows = docs.collect()
    p = model.posteriors([None if r.text is None else r.text.encode() for r in rows])
    tokens = np.array([len((r.text or "").split()) for r in rows], float)
    # Plain projected gradient over all rows at once.
    inverse, wanted, rates = np.linalg.pinv(p.T @ (tokens[:, None] * p)), tokens.sum() * np.array([corpus_pipeline.TARGETS[d] for d in model.domains]), np.ones(len(rows))
    for _ in range(60):
        rates = np.maximum(0.0, rates - p @ (inverse @ (p.T @ (tokens * rates) - wanted)))
    copies = np.floor(rates + [zlib.crc32(f"mix {r.doc_id}".encode()) / 2**32 for r in rows]).astype(int)
    want = sorted((tuple(r) for r, n in zip(rows, copies) for _ in range(n)), key=str)
    got = corpus_pipeline.mix(spark, docs, folder)
    assert got.columns == docs.columns and listed(got) == want


def test_packing_stage_and_run(spark, folder):
    docs = read(spark, folder)
    sizes = sorted(len(e.ids) + 1 for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([r.text or "" for r in docs.collect()], add_special_tokens=False))
    for pieces, whole in ((corpus_pipeline.pack(spark, docs, folder).collect(), True), (corpus_pipeline.run(spark, folder).collect(), False)):
        assert pieces and (not whole or sum(r.length for r in pieces) == sum(sizes))
        filled = {}
        for r in pieces:
            filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 1024 and at & (at - 1) == 0


def test_stages_of_empty_tables(spark, nothing):
    docs = read(spark, nothing)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, nothing)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns
    assert corpus_pipeline.run(spark, nothing).count() == 0
