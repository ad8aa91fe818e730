from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from trailspark.llm import pqcodes

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error int"


def whole(x):
    return math.floor(x * 1024) if abs(x) < 2.0**53 else 1024 * int(x)


def plain(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds with every distance computed, in Python's whole numbers."""
    kept = [(i, [whole(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    x = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for v in x:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), v in zip(kept, x, strict=True):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    most = (1 << 63) - 1
    return sorted(((i, c, min(e, most), min(by_label[label], most), digest) for i, c, e, label in out), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)


def got(found):
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_equals_every_distance_on_clustered_and_repeated_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(int(i), [float(x) for x in centres[rng.integers(12)] + rng.normal(0, 0.02, 16)], int(i) % 3 if i % 4 else None) for i in rng.permutation(420)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(80)] + [rows[1], rows[1]]
    assert got(pqcodes.compress(table(spark, rows))) == plain(rows)


def test_edge_cases(spark):
    rows = [(3, [0.5, -0.25, 0.1], 1), (None, [1.0] * 9, None), (None, [0.0], None), (4, [], 1), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan")], 2), (8, [float("inf")], 2), (3, [0.5, -0.25, 0.1], 1), (2, [-1e-9] * 5, 2)]
    assert got(pqcodes.compress(table(spark, rows))) == plain(rows)
    only_empty = [(1, [], 1), (2, [], None)]
    assert [r[1:4] for r in got(pqcodes.compress(table(spark, only_empty)))] == [("00000000", 0, 0)] * 2
    empty = pqcodes.compress(table(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_are_exact_whole_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** (i % 12), 8)], i % 2) for i in range(30)] + [(40, [1e300, -1e300, 3.5, 0.0], 5), (41, [2.0**60, 1.0], 5)]
    assert got(pqcodes.compress(table(spark, rows), entries=8)) == plain(rows, entries=8)


def test_filtering_assigns_subtrees_and_keeps_ties(spark):
    rng = np.random.default_rng(3)
    for spread in (0.01, 1.0):
        x = np.floor(np.repeat(rng.normal(0, 40, (6, 3)), 400, axis=0) + rng.normal(0, spread * 20, (2400, 3)))
        book = np.floor(np.concatenate((x[::40], x[:1], x[:1])))
        tree = pqcodes.KDTree(x)
        walk = pqcodes.Walk(tree, book)
        distance = ((tree.x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (walk.entry == distance.argmin(axis=1)).all()
        assert (walk.counts == np.bincount(walk.entry, minlength=len(book))).all()
        assert (walk.sums == np.stack([tree.x[walk.entry == e].sum(axis=0) for e in range(len(book))])).all()
        assert walk.distances < len(x) * len(book) / (1.5 if spread == 1.0 else 10)


@pytest.mark.parametrize("n", [1, 2, 24, 25, 100])
def test_trees_hold_every_row_once(n):
    rng = np.random.default_rng(n)
    tree = pqcodes.KDTree(np.floor(rng.normal(0, 3, (n, 2))))
    assert sorted(tree.order.tolist()) == list(range(n)) and tuple(tree.spans[0]) == (0, n)
    for (start, end), low, high, total in zip(tree.spans, tree.lows, tree.highs, tree.sums, strict=True):
        rows = tree.x[start:end]
        assert (rows.min(axis=0) == low).all() and (rows.max(axis=0) == high).all() and (rows.sum(axis=0) == total).all()
