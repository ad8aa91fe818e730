"""Operators held against brute force or an exact round trip."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.fixtures import LONG, ROWS, documents
from trailspark.llm import dac, packing, simhash, sketch, tokens, topk, urlfilter
from trailspark.operators.scratch import written

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints, linked):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).where("doc_id is not null").selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in rows]
    root = classes(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, root)}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_grid_join_finds_every_link(spark, bits):
    rng = random.Random(bits)
    values = [rng.getrandbits(64) for _ in range(20)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for v in values for _ in range(6)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), bits).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_simhash_edge_cases(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {4}
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # The null text without an id is a copy of 4; ids 5 and 9 have no words either.
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == [1, 3, 4, 6, 7, 8, 10]
    assert simhash.without_copies(docs.where("false")).count() == 0
    texts = [(1, "a b c d e f"), (3, "a b c d e f"), (3, "another text of its own"), (3, "another text of its own"), (None, "A b  c d e f"), (None, "nobody has this one"), (None, "nobody has this one")]
    clash = spark.createDataFrame([(*r, 0, "x") for r in texts], "doc_id bigint, text string, _key int, row string")
    got = simhash.without_copies(clash)
    assert got.columns == clash.columns
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=str) == [(1, texts[0][1]), (3, texts[2][1]), (None, texts[5][1])]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 30)] + [(900, 901), (901, 902), (902, 900)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(10, 30)]} | {900: 900, 901: 900, 902: 900}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies_are_verified_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, i = [], 0
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([30, 200, 900]))
        for edits in (0, 0, 1, 3, 40):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(edits * len(copy) // 400 + (edits > 0), len(copy))):
                copy[at] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy), "en", "a"))
            i += 1
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _, _ in rows]
    root = classes(shingles, lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    want = {i for i, r in enumerate(root) if i != r}
    assert {r.doc_id for r in simhash.copies(documents(spark, rows)).collect()} == want


def test_copies_of_an_original_in_the_middle_are_found(spark):
    rng = random.Random(5)
    rows = []
    for start, members, length, edits in ((0, 300, 304, (6, 6)), (5000, 100, 304, (4, 6)), (8000, 60, 104, (1, 2)), (9000, 12, 30, (1, 1))):
        words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for i in range(members):
            copy = list(words)
            if i != members // 2:
                for at in rng.sample(range(5, length - 5), rng.randint(*edits)):
                    copy[at] = f"x{rng.randrange(10**9)}"
            rows.append((start + i, " ".join(copy), "en", "a"))
    shingles = [{hash(tuple(t.split()[k : k + 5])) for k in range(len(t.split()) - 4)} for _, t, _, _ in rows]
    root = classes(shingles, lambda a, b: rows[a][0] // 1000 == rows[b][0] // 1000 and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    want = {(rows[i][0], rows[r][0]) for i, r in enumerate(root) if i != r}
    assert {(r.doc_id, r.keeper) for r in simhash.copies(documents(spark, rows)).collect()} == want


@pytest.mark.parametrize(("centres", "sample"), [(0, 10**9), (3, 1)])
def test_exact_join_finds_every_pair(spark, monkeypatch, centres, sample):
    monkeypatch.setattr(simhash, "CENTRES", centres)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rng = random.Random(6)
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 25, 60, 300]))]
        for _ in range(5):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(0, max(2, len(copy) // 20))):
                copy[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), "the common line of all of them . " * (len(rows) % 2) + " ".join(copy), "en", "a"))
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t, _, _ in rows]
    root = classes(shingles, lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    want = {(i, r) for i, r in enumerate(root) if i != r}
    assert {(r.doc_id, r.keeper) for r in simhash.copies(documents(spark, rows)).collect()} == want


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    data += [(300 + i, data[0][1]) for i in range(30)]
    plain = {i: [int(np.floor(256 * x)) for x in v] for i, v in data}
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    plain = {r.vec_id: [int(np.floor(256 * x)) for x in r.embedding] for r in frame.collect()}
    want = []
    for q in (i for i in plain if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(plain[q], v)), i) for i, v in plain.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(frame).collect()) == sorted(want)


def test_top_k_over_several_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    test_top_k_matches_brute_force(spark)


def test_top_k_with_clusters_and_outliers(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 30)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5)) * 3
    data = [(int(i), (centres[i % 6] + rng.normal(size=5) * 0.05).tolist()) for i in range(400)]
    data += [(500, [1e200, -1e308, 0.25, 0.0, 3.0]), (501, [-1e9, 1e9, 0.0, 0.0, 0.0]), (550, [2.0**60, 1.5, 0.0, 0.0, 1.0]), (551, [0.1])]
    plain = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in data}
    want = []
    for q in (i for i in plain if i % 50 == 0):
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(plain[q], v)))), i) for i, v in plain.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    seen = []
    search = topk._search
    monkeypatch.setattr(topk, "_search", lambda rows, asking, k: (seen.append(asking.where("pivot >= 0 and not wide").count()), search(rows, asking, k))[1])
    got = topk.top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    # Most groups can't hold a better vector and are never asked.
    groups = -(-400 // 30)
    assert seen[0] == 8 and seen[1] < 8 * groups


def test_m_tree_pruning_loses_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 400
    x = np.floor(centres[rng.integers(12, size=3000)] + rng.normal(size=(3000, 16)) * 20)
    tree = topk.MTree(x, leaf=16, fanout=6)
    ids = tree.rows
    for q in x[:40]:
        scores, found = tree.search(q, ids, -1, 7)
        every = x @ q
        order = np.lexsort((np.arange(3000), -every))[:7]
        assert found.tolist() == order.tolist() and scores.tolist() == every[order].tolist()


def test_top_k_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [nan, 1.0]), (100, None), (1, [inf, 0.0]), (2, [None, 1.0]), (3, [1.0]), (4, []), (0, [1.0, 2.0]), (None, [3.0, 3.0]), (150, [1e30, 1.0])]
    got = topk.top_k(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, codes string, pivot int")).collect()
    assert {r.query_id for r in got} == {0, 150} and sorted(r["rank"] for r in got if r.query_id == 0) == sorted([1, 2, 3, 4] * 2)
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_url_rules_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "COM", "a.example.COM", "notexample.com", "x.net", "net", "example.net", "b.org", "example.org:80", "", "münchen.com"]
    paths = ["/en/", "/en/7", "/en/78?x=/de/", "/de/8", "/de/9#f", "/es/1", "", "?q", "/EN/1", "/en"]
    urls = [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/en/", "://com/en/", "a?b://net/de/1", "http://com\n/en/1"]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, tokens string"), urlfilter.RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
            path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        row = got[i]
        assert (row.host, row.path, row.rule) == (host, path, max(fits)[1] if fits else None), url
        assert row.verdict == max(fits)[2] if fits else row.verdict in ("allow", "block")


def test_association_rules_match_brute_force(spark):
    sets = [(["h:a", "p:en"], "block")] * 9 + [(["h:a", "p:de"], "allow")] * 8 + [(["h:b", "p:en"], "block")] * 5 + [(["h:b", "p:fr"], "allow")] * 2 + [(["h:b", "p:fr"], "block")] * 2
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in urlfilter.mine(spark.createDataFrame(sets, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    assert got == {(("p:en",), "block"): 1.0, (("p:de",), "allow"): 1.0}


def test_tokens_of_the_same_urls_are_one_item(spark):
    always = [f"p:t{i:02}" for i in range(30)]
    sets = [([*always, "h:a"], "block")] * 20 + [(["h:a", "p:en"], "allow")] * 20
    got = {(tuple(r.tokens), r.verdict) for r in urlfilter.mine(spark.createDataFrame(sets, "tokens array<string>, verdict string")).collect()}
    assert got == {(tuple(always), "block"), (("p:en",), "allow")}


def plain_rules(baskets, support, confidence):
    """(tokens, verdict) -> (confidence, support) by going through every subset; rules that a shorter one covers are left out."""
    found = {}
    for names in {c for b, _ in baskets for n in range(1, len(b) + 1) for c in combinations(sorted(b), n)}:
        of = [v for b, v in baskets if set(names) <= set(b)]
        for v in set(of):
            if of.count(v) >= support * len(baskets) - 1e-9 and of.count(v) / len(of) >= confidence:
                found[names, v] = (of.count(v) / len(of), of.count(v) / len(baskets))
    return {(n, v): x for (n, v), x in found.items() if not any(w == v and len(m) < len(n) and set(m) <= set(n) and y[0] >= x[0] for (m, w), y in found.items())}


def test_open_urls_match_a_plain_search_of_the_rules(spark):
    rng = random.Random(9)
    hosts, words = ["a.com", "b.net", "c.org", "d.info", "example.com"], ["en", "de", "es", "shop", "78", "7", "ñu", "%c3%b1"]
    urls = [f"http://{rng.choice(hosts)}/{'/'.join(rng.choices(words, k=rng.randrange(1, 4)))}/?{rng.choice(['', 'id=5', 'x'])}" for _ in range(300)] + [None, "http://q.info/x", "http://q.info/" + "de/" * 20_000]
    rows = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), urlfilter.RULES, min_support=0.05).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))

    def parts(url):
        host, path, rest = re.fullmatch(r"[^:]*://([^/?#]*)([^?#]*)(.*)", url).groups()
        words = lambda text: re.findall(r"(?:[^\W\d_]|%[0-9a-f]{2})+|[0-9]+", text.lower())
        return {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in words(path)} | {f"n:{x[0]}" for x in re.findall("[0-9]+", path)} | {f"q:{x}" for x in words(rest)}

    sets = {i: parts(u) if u else set() for i, u in enumerate(urls)}
    rules = plain_rules([(sets[r.page_id], r.verdict) for r in rows if r.rule], 0.05, 0.8)
    for r in rows:
        if not r.rule:
            fits = [(c, s, v) for (names, v), (c, s) in rules.items() if set(names) <= sets[r.page_id]]
            best = max((round(c, 9), round(s, 9)) for c, s, _ in fits) if fits else None
            assert r.verdict in ({v for c, s, v in fits if (round(c, 9), round(s, 9)) == best} or {"allow"}), urls[r.page_id]
            assert r.confidence is None if not fits else abs(r.confidence - best[0]) < 1e-9


def test_url_filter_without_decided_urls(spark):
    pages = spark.createDataFrame([(1, "http://q.info/x"), (1, "http://q.info/x"), (None, None)], "page_id bigint, url string")
    rows = urlfilter.judge(pages, urlfilter.RULES).collect()
    assert len(rows) == 3 and {r.verdict for r in rows} == {"allow"}
    assert urlfilter.judge(pages.where("false"), urlfilter.RULES).count() == 0


ODD = ["a  b", "  lead", "trail ", "x\n\ny", " \n z", "don't I'LL 's", "a\x1cb c", "naïve Ångström İstanbul ẞtraße", "<|endoftext|> hi", "foo<|endoftext|>bar", "tab\tsep \t x", "日本語 テキスト", "e\u0301 x\u0301", "123 4,567.89", "", "\n", " ", "end\n", "word.\nNext,\n", "Foo!!\nBar?? 'tis", "x\u0085y\u00a0z", "emoji 👍🏽 ok", "Σας ΟΔΟΣ", LONG]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_tokenizer(path):
    rng = random.Random(4)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'", "s", "é", "Ñ", ".", "!", "1", "\x1d", "\u00a0", "ß", "İ", "\u0301", "日", "-", "'ll"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 14))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = tokens.Encoder(tokens.read_file(path)).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_dac_round_trip():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, 5000).astype(np.uint32)
    file = dac.DacFile(dac.build([5, None, 9], [2000, 0, 3000], ids))
    assert file.doc_ids == [5, None, 9] and (file.run(0, 5000) == ids).all() and all(file.access(i) == ids[i] for i in range(0, 5000, 7))
    assert (file.document(0) == ids[:2000]).all() and not len(file.document(1)) and (file.document(2) == ids[2000:]).all()
    assert (dac.DacFile(dac.build([1], [3], np.array([1, 2, 3], np.uint32))).run(0, 3) == [1, 2, 3]).all()


def test_token_files_match_plain_encoding(spark, tmp_path):
    docs = documents(spark)
    dac.write(docs, f"file://{tmp_path}/dac", WORD, file_ids=50)
    got = sorted((tuple(r) for r in dac.read(spark, f"file://{tmp_path}/dac").collect()), key=lambda r: r[1])
    plain = sorted(((-1 if i is None else i, t or "") for i, t, _, _ in ROWS))
    want, start = [], 0
    for (i, _), e in zip(plain, Tokenizer.from_file(WORD).encode_batch([t for _, t in plain], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want.append((None if i == -1 else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    dac.write(docs.where("false"), f"file://{tmp_path}/none", WORD)
    assert dac.read(spark, f"file://{tmp_path}/none").count() == 0


def test_token_files_split_an_id_that_many_rows_share(spark, tmp_path):
    rows = [(7, "one text", None, None)] * 600 + [(7, f"text {i}", None, None) for i in range(400)] + [(8, "last", None, None), (None, "first", None, None)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dac.write(documents(spark, rows), f"file://{tmp_path}/dac", WORD)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert spark.read.parquet(f"file://{tmp_path}/dac").select("pid").distinct().count() > 1
    got = dac.read(spark, f"file://{tmp_path}/dac").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] + [7] * 1000 + [8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    tool = Tokenizer.from_file(WORD)
    plain = sorted(zlib.crc32(np.array([*tool.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t, _, _ in rows)
    assert sorted(r.ids_crc32 for r in got) == plain


def plain_neighbours(rows):
    """Rows in descending id order, null last, ties by the text's hash, then the text."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))


def test_fingerprints_match_plain_python(spark):
    rows = ROWS[:10] + [(100 + i, t, None, None) for i, (_, t, _, _) in enumerate(ROWS[10:])] + [(20 + i, f"one two three {i} " * (i + 1), None, None) for i in range(30)]
    got = sketch.fingerprints(documents(spark, rows)).collect()
    order = plain_neighbours([(i, t or "") for i, t, _, _ in rows])
    want = []
    for at, (i, text) in enumerate(order):
        following, n = order[(at + 1) % len(order)][1], len(text)
        want.append((i, n, hashlib.sha256((text[: n - n // 3] + following[: n // 3]).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sketch.fingerprints(documents(spark).where("false")).count() == 0


def test_neighbours_across_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET", 3)
    rows = [(i * i * 7 % 1009, f"text number {i} of the table", None, None) for i in range(60)]
    got = {r.doc_id: r.next_text for r in sketch.with_next(documents(spark, rows)).collect()}
    order = sorted({i: t for i, t, _, _ in rows}.items(), reverse=True)
    assert got == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


@pytest.mark.parametrize(("bucket", "quantiles"), [(3, 16), (5, 4096), (2, 4), (100, 9)])
def test_neighbours_with_outlying_repeated_and_null_ids(spark, monkeypatch, bucket, quantiles):
    monkeypatch.setattr(sketch, "BUCKET", bucket)
    monkeypatch.setattr(sketch, "QUANTILES", quantiles)
    rng = random.Random(bucket)
    ids = [*range(80), *[7] * 60, *[None] * 50, *[12, 12, 13], 9 * 10**18, -(9 * 10**18)]
    rows = [(i, f"text {rng.randrange(10**6)}", None, None) for i in ids]
    got = sketch.with_next(documents(spark, rows)).select("doc_id", "text", "next_text").collect()
    order = plain_neighbours([(i, t) for i, t, _, _ in rows])
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    sizes = [r["count"] for r in sketch._buckets(spark.createDataFrame([(i or 0, rng.getrandbits(64) - (1 << 63), "x") for i in ids], "key bigint, h bigint, text string")).groupBy("bucket").count().collect()]
    assert bucket == 100 or quantiles < 16 or max(sizes) <= 8 * bucket


def test_sketch_estimates_containment(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    pairs = [(" ".join(words), " ".join(words)), (" ".join(words[:1500]), " ".join(words)), (" ".join(words[:3000]), " ".join(words[3000:])), ("a b", "a b"), ("", ""), ("", "x")]
    frame = spark.createDataFrame(pairs, "a string, b string").select(sketch.sketch(sketch.hashes("a")).alias("a"), sketch.sketch(sketch.hashes("b")).alias("b"))
    got = [r[0] for r in frame.select(sketch.likeness(frame.a, frame.b)).collect()]
    assert got == [1.0, 1.0, 0.0, 1.0, 1.0, 0.0]


def plain_order(mixture):
    due = [(Fraction(2 * j + 1, 2 * w), q, j) for q, (total, w) in enumerate(zip(mixture.totals.tolist(), mixture.weights.tolist())) for j in range(total)]
    return [(q, j) for _, q, j in sorted(due)]


@pytest.mark.parametrize("seed", range(12))
def test_packing_order_matches_plain_round_robin(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 5))
    totals = rng.integers(1, 120, k).tolist()
    mixture = packing.Mixture.of(totals, None if seed % 2 else rng.random(k).tolist(), 8, 2)
    order = plain_order(mixture)
    place = {}
    for w in range(0, len(order), 16):
        place.update({e: w + i for i, e in enumerate(sorted(order[w : w + 16]))})
    queue, start, length = [], [], []
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(int(rng.integers(1, 30)), total - at)
            queue.append(q), start.append(at), length.append(n)
            at += n
    got, filled = {}, {}
    for d, low, n, seq, offset in zip(*packing.pieces(mixture, np.array(queue), np.array(start), np.array(length))):
        for t in range(n):
            got[queue[d], start[d] + low + t] = (seq, offset + t)
            filled.setdefault(seq, []).append(offset + t)
    tail = len(order) - len(order) % 8
    assert len(got) == len(order) and all(s * 8 + o == place[e] for e, (s, o) in got.items() if place[e] < tail)
    assert all(sorted(v) == list(range(len(v))) and len(v) & (len(v) - 1) == 0 for v in filled.values())


def test_packing_covers_every_id(spark):
    rows = packing.pack(documents(spark), BYTE, targets={"a": 0.5, "b": 0.5}, sequence=64, window=2, with_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc.setdefault((r.doc_id, r.doc_tokens, r.source), []).append((r.start, r.ids))
    want = [[*e.ids, 0] for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for _, t, _, _ in ROWS], add_special_tokens=False)]
    assert sum(r.length for r in rows) == sum(map(len, want))
    single = {i: ids for (i, _, _, _), ids in zip(ROWS, want) if i not in (3, None)}
    for (i, _, _), parts in by_doc.items():
        if i in single:
            assert [x for _, ids in sorted(parts) for x in ids] == single[i]
    filled: dict = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(documents(spark).where("false"), BYTE).count() == 0


def test_grid_join_is_by_shuffle_whatever_the_files_size(spark, capsys):
    """Spark takes the grid points, up to 33 a fingerprint, for no larger than the fingerprints' files."""
    prints = written(spark.range(1000).select(F.xxhash64("id").alias("fp")), "prints")
    simhash.links(prints).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
