from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from tests.conftest import SF
from tests.llm.fixtures import ROWS, documents
from trailspark.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """(item, rank, doc, score) by scoring every document against every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, words in asked.items():
        found = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            score = 0
            for w in words & set(c):
                df = sum(w in other for _, other in counts)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        rows += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(rows, key=repr)


def answers(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "the QUICK brown fox"), (2, "Katze und Hund"), (2, "lazy dog"), (3, None), (4, ""), (5, "nowhere-to-be-found zzz"), (None, "naïve 日本語 のテキスト word 123"), (6, "lorem the the und"), (6, "lorem the the und"), (7, "English words")]


def asked(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "item_id bigint, text string, doc_id int, score double")


def test_edge_cases_and_blocks_equal_the_plain_form(spark):
    docs = documents(spark)
    want = plain([(r[0], r[1]) for r in ROWS], ITEMS)
    assert any(r[0] is None for r in want) and any(r[2] is None for r in want)
    assert answers(lexsearch.search(docs, asked(spark))) == want
    assert answers(lexsearch.search(docs, asked(spark), pairs=4)) == want
    assert answers(lexsearch.search(docs, asked(spark), k=2)) == plain([(r[0], r[1]) for r in ROWS], ITEMS, 2)


def test_empty_tables(spark):
    docs = documents(spark)
    for found in (lexsearch.search(docs.where("false"), asked(spark)), lexsearch.search(docs, asked(spark).where("false"))):
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_and_many_copies_go_to_the_smallest_ids(spark):
    rows = [(i, "same words here", "en", "a") for i in range(300, 0, -1)] + [(1000, "other text", "en", "a")]
    found = lexsearch.search(documents(spark, rows).repartition(7), asked(spark, [(1, "same")]))
    assert [(r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [(i, i) for i in range(1, 51)]


def test_small_chunks_of_triples(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = docs.limit(60).collect()
    few = spark.createDataFrame(some, docs.schema)
    want = plain([(r.doc_id, r.text) for r in some], [(r.item_id, r.text) for r in items.collect()])
    assert answers(lexsearch.search(few, items)) == want


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    for top in (1, 2, 1 << 16, 1 << 33, 1 << 50):
        keys = rng.integers(0, top, 3000)
        assert (lexsearch.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexsearch.radix_order(np.zeros(0, np.int64))) == 0


def test_terms_are_the_pattern_s_matches():
    for text in ("A-b_C9 z", "ÀÉ naïve x", "\x7fq\x80r", "日本、語", "a b`c{d|e}f~g", ""):
        assert [t.decode() for t in lexsearch.terms_of(text.encode())] == terms(text), text
