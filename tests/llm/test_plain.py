"""Trained operators and sketches against plain single-process versions on the driver's smallest tables."""

from __future__ import annotations

import math
import struct
import unicodedata

import numpy as np
import pytest
import xxhash
import zstandard

from tests.conftest import SF
from tests.llm.fixtures import ROWS, documents
from tests.llm.test_classifiers import is_held_out
from tests.llm.test_exact import plain_neighbours
from trailspark.llm import langid, mixing, queries, sketch, toxicity


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_of(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode(), seed)


def plain_words(text):
    """Runs of letters and marks; a word that repeats the one before it is left out."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    out = []
    for word in kept.split():
        if not out or out[-1] != word:
            out.append(word)
    lead, tail = " " * kept.startswith(" "), " " * kept.endswith(" ")
    return lead + " ".join(out) + tail if out else ""


def test_language_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = docs.collect()
    model = langid.train(docs, documents_per_language=20, dictionary_bytes=8192)
    size, parts = 8192 // 20, {}
    for lang in {r.lang for r in rows}:
        own = sorted({(signed(hash_of(str(r.doc_id))), r.doc_id) for r in rows if r.lang == lang and not is_held_out(r.doc_id)})[:20]
        found = []
        for h, i in own:
            text = min(r.text[h % (max(len(r.text) - size, 0) + 1) :][:size] for r in rows if r.doc_id == i and r.lang == lang)
            found.append((h, plain_words(text).strip()))
        parts[lang] = " ".join(t for _, t in sorted(found) if t).encode()[:8192]
    assert model.dictionaries == {lang: p for lang, p in parts.items() if len(p) >= 8}

    def sizes(text):
        raw = plain_words(text).encode()
        out = {}
        for lang, content in model.dictionaries.items():
            tool = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            out[lang] = sum(len(tool.compress(raw[i : i + 8192])) for i in range(0, len(raw), 8192))
        return out

    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        n = sizes(r.text)
        best = min(n.values())
        near = sorted(lang for lang in n if n[lang] <= best * 1.002 + 2)
        assert got[r.doc_id].lang_pred in near and got[r.doc_id].score == pytest.approx(1 / sum(math.exp(-40 * (s - best) / best) for s in n.values()), abs=0.15)


def plain_grams(word, buckets):
    """Buckets of a marked word's n-grams of 3 to 6 characters, by a polynomial hash."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    marked = "<" + (word.strip(toxicity._EDGES) or word) + ">"

    def bucket(h):
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return (h >> 33) % buckets

    def poly(text):
        h = 0
        for c in text:
            h = (h * base + ord(c)) & mask
        return h

    return [bucket((poly(marked[i : i + n]) * (2 * n + 1)) & mask) for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)]


def test_toxicity_scores_match_a_plain_version():
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(rng.normal(size=1 << 12).astype(np.float32), -0.3)
    for text in ("one two three four five six seven idiot nine", "a b", "word", "Ünïcode !!! " + "x" * 30, "x x x x idiot idiot y"):
        words = [w for i, w in enumerate(text.lower().split()) if not i or w != text.lower().split()[i - 1]]
        values = [float(np.mean([model.bucket_logits[g] for g in plain_grams(w, 1 << 12)])) for w in words]
        wide = min(2, len(values))
        best = max(sum(values[i : i + wide]) / 2 for i in range(len(values) - wide + 1))
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-(best - 0.3))), rel=1e-5), text


def test_toxicity_on_held_out_rows_of_the_tables(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op2_toxicity(spark, folder).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    assert docs.count() == queries.op2_toxicity(spark, folder).count() and len(rows) > 50 and wrong <= 0.12 * len(rows)


def test_mixing_matches_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    named = queries.labelled_domains(labels)
    got = {r.doc_id: r for r in queries.op7_mixing(spark, SF).collect()}
    rows, of = docs.collect(), {r.doc_id: r.domain for r in named.collect() if r.domain}
    domains = sorted({of[r.doc_id] for r in rows if r.doc_id in of})
    taught = sorted((r for r in rows if r.doc_id in of), key=lambda r: str(r.doc_id))
    x = np.stack([mixing.features(r.text.encode()) for r in taught])
    shares = np.array([sum(of[r.doc_id] == d for r in taught) for d in domains], float)
    layer, bias = mixing.fit_softmax(x, np.array([domains.index(of[r.doc_id]) for r in taught]), shares / shares.sum())
    z = np.stack([mixing.features(r.text.encode()) for r in rows]) @ layer + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    tokens = np.array([len(r.text.split()) for r in rows], float)
    wanted = np.array([queries.TARGETS[d] for d in domains])
    wanted *= tokens.sum() / wanted.sum()
    inverse, rates = np.linalg.pinv(p.T @ (tokens[:, None] * p)), np.ones(len(rows))
    for _ in range(200):
        rates = np.maximum(0.0, rates - p @ (inverse @ (p.T @ (tokens * rates) - wanted)))
    assert np.abs(p.T @ (tokens * rates) - wanted).max() < 0.01 * tokens.sum()
    for r, probability, rate in zip(rows, p, rates):
        assert np.allclose(got[r.doc_id].posterior, probability, atol=1e-5) and got[r.doc_id].rate == pytest.approx(rate, abs=1e-3)


def plain_hashes(text):
    """Distinct 60-bit hashes of five-word shingles: word hashes, chained."""
    words = [hash_of(w) for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    out = set()
    for i in range(max(len(words) - 4, 1) if words else 0):
        seed = 42
        for h in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        out.add(seed >> 4)
    return sorted(out)


def plain_sketch(hashes):
    below = sum(h < (1 << 60) // 16 for h in hashes)
    return hashes[: max(min(len(hashes), 32), below)], len(hashes) <= max(32, below)


def plain_likeness(a, b):
    (x, x_all), (y, y_all) = a, b
    if not x and not y:
        return 1.0
    end = min(math.inf if whole else max((1 << 60) // 16, kept[-1] + 1) for kept, whole in (a, b))
    x, y = {h for h in x if h < end}, {h for h in y if h < end}
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def test_fingerprints_and_likeness_match_a_plain_version(spark):
    rows = [r for r in ROWS if r[0] != 10 and (r[1] is None or "\x01" not in r[1])] + [(100 + i, f"some words number {i} of a longer line " * (i * i + 1), None, None) for i in range(24)]
    order = plain_neighbours([(i, t or "") for i, t, _, _ in rows])
    text = lambda s: ("c" if s[1] else "t") + "".join(f"{h:015x}" for h in s[0])
    want = []
    for k, (i, t) in enumerate(order):
        following, n = order[(k + 1) % len(order)][1], len(t)
        own, changed, other = (plain_sketch(plain_hashes(x)) for x in (t, t[: n - n // 3] + following[: n // 3], following))
        want.append((i, text(own), text(changed), round(plain_likeness(own, changed), 9), round(plain_likeness(own, other), 9)))
    got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in sketch.fingerprints(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
