"""Relational and window operators against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailspark.functions import scores
from trailspark.operators import relations, windows


def plain_best(rows, width, least, cap):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(((us, i, item) for k, us, i, item in rows if k == key))
        best = None
        for n, (us, i, _) in enumerate(own):
            seen = [e for e in own[: n + 1] if e[0] >= us - width]
            items = [e[2] for e in seen]
            if len(set(items)) >= least and (cap is None or max(map(items.count, items)) <= cap) and (best is None or len(set(items)) > best[0]):
                best = (len(set(items)), len(seen), seen[0][0], us, sorted(set(items)), [e[1] for e in seen])
        if best:
            out[key] = best
    return out


def plain_burst(rows, width, least):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((us, i) for k, us, i, _ in rows if k == key)
        for n, (us, _) in enumerate(own):
            inside = [e for e in own[n:] if e[0] <= us + width]
            if len(inside) >= least:
                out[key] = (len(inside), us, inside[-1][0], [i for _, i in inside])
                break
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(1)
    rows = [(rng.choice("abc") if i % 3 else "hot", rng.randrange(-400, 2500), i, f"x{rng.randrange(9)}") for i in range(700)]
    rows += [("tie", 50, 1000 + i, f"x{i % 4}") for i in range(12)] + [("edge", 100 * i, 2000 + i, f"x{i}") for i in range(6)]
    return rows


@pytest.mark.parametrize(("width", "least", "cap"), [(100, 4, None), (100, 5, 2), (37, 3, 1), (1, 2, 3)])
def test_best_window_matches_plain_python(spark, events, width, least, cap):
    frame = spark.createDataFrame([*events, ("null", None, 1, "x"), ("null", 5, 2, None), (None, 5, 3, "x")], "k string, us bigint, id bigint, item string")
    got = {r.k: (r.n, r["size"], r.start_us, r.end_us, r["items"], r.ids) for r in windows.best_window(frame, ["k"], "us", "id", "item", width, least, cap).collect()}
    assert got == plain_best(events, width, least, cap)


@pytest.mark.parametrize(("width", "least"), [(100, 9), (40, 4), (0, 1), (3, 3)])
def test_first_burst_matches_plain_python(spark, events, width, least):
    frame = spark.createDataFrame([*events, ("null", None, 1, "x")], "k string, us bigint, id bigint, item string")
    got = {r.k: (r["size"], r.start_us, r.end_us, r.ids) for r in windows.first_burst(frame, ["k"], "us", "id", max(width, 1), least).collect()}
    assert got == plain_burst(events, max(width, 1), least)


@pytest.mark.parametrize(("width", "least", "cap"), [(100, 3, None), (20, 2, 3)])
def test_windows_count_rows_of_equal_ids_one_by_one(spark, width, least, cap):
    rng = random.Random(4)
    rows = [("k", rng.randrange(12) * 10, rng.randrange(6), f"x{rng.randrange(5)}") for _ in range(60)]
    rows += [("end", 0, 1, "a"), ("end", 5, 2, "b"), ("end", 5, 2, "c"), ("end", 5, 2, "c"), ("end", 5, 2, "c")]
    frame = spark.createDataFrame(rows, "k string, us bigint, id bigint, item string").repartition(3)
    got = {r.k: (r.n, r["size"], r.start_us, r.end_us, r["items"], r.ids) for r in windows.best_window(frame, ["k"], "us", "id", "item", width, least, cap).collect()}
    assert got == plain_best(rows, width, least, cap)
    bursts = {r.k: (r["size"], r.start_us, r.end_us, r.ids) for r in windows.first_burst(frame, ["k"], "us", "id", width, 4).collect()}
    assert bursts == plain_burst(rows, width, 4)


def test_previous_reaches_over_empty_slices_and_spreads_a_busy_key(spark):
    rng = random.Random(7)
    rows = [(k, u, i, rng.choice(["a", None])) for i, (k, u) in enumerate([(rng.choice(["hot", "hot", None, "x"]), rng.randrange(-5000, 5000)) for _ in range(500)])]
    rows += [("late", 900_000, 1000, "z"), ("late", -900_000, 1001, "y"), ("none", None, 1002, "q"), ("none", 3, 1003, "r")]
    frame = spark.createDataFrame(rows, "k string, us bigint, id bigint, item string").repartition(5)
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {row[2]: before and (before[2], before[3]) for before, row in zip([None, *own], own)}
    for width in (1, 100, 10**9):
        found = windows.previous(frame, ["k"], F.col("us"), "id", F.struct("id", "item"), "before", width)
        assert found.columns == ["k", "us", "id", "item", "before"]
        assert {r.id: r.before and tuple(r.before) for r in found.collect()} == want
    # One key's rows are sorted in many tasks.
    hot = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 1000).alias("us"), "id")
    spread = windows.previous(hot, ["k"], F.col("us"), "id", F.col("id"), "before", 100_000)
    assert spread.select(F.spark_partition_id()).distinct().count() > 1 and spread.where("id > 0 and before <> id - 1 or before is null").count() == 1


def test_windows_of_nothing(spark):
    frame = spark.createDataFrame([], "k string, us bigint, id bigint, item string")
    assert windows.best_window(frame, ["k"], "us", "id", "item", 10, 2).count() == 0
    assert windows.first_burst(frame, ["k"], "us", "id", 10, 2).count() == 0


def test_components_of_chains_stars_and_loners(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(10, 20)] + [(900, 901), (901, 902), (902, 900), (7, 7), (None, 3)]
    nodes = [*range(100, 131), 5, *range(10, 20), 900, 901, 902, 7, 3]
    got = {r.id: r.component for r in relations.components(spark.createDataFrame([(n,) for n in nodes], "id bigint"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {i: 5 for i in [5, *range(10, 20)]} | {900: 900, 901: 900, 902: 900, 7: 7, 3: 3}


def test_robust_z_and_variation(spark):
    rows = [(10.0, 5, 4.0, 2.0, 5.0, 3.0), (10.0, 5, 4.0, 0.0, 5.0, 2.0), (10.0, 5, 4.0, 0.0, 5.0, 0.0), (10.0, 2, 4.0, 2.0, 5.0, 3.0), (10.0, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "value double, n int, median double, mad double, mean double, dev double")
    got = [r[0] for r in frame.select(scores.robust_z(*[frame[c] for c in frame.columns])).collect()]
    assert got[:4] == [pytest.approx(0.6745 * 3), 2.5, 0.0, 0.0] and got[4] in (None, 0.0)
    pairs = spark.createDataFrame([(60.0, 0.0, 3), (60.0, 10.0, 2), (60.0, 0.0, 1), (0.0, 1.0, 5), (None, None, 0)], "mean double, dev double, n int")
    assert [r[0] for r in pairs.select(scores.variation(pairs.mean, pairs.dev, pairs.n)).collect()] == [0.0, pytest.approx(1 / 6), float("inf"), float("inf"), float("inf")]


def test_suppression_and_first_wins(spark):
    found = spark.createDataFrame([("a", "x", ["host:1", "user:u"]), ("b", "y", ["host:1"]), ("c", "x", []), ("d", "x", None)], "id string, hunt string, entities array<string>")
    rules = spark.createDataFrame([("x", "host:1"), ("*", "user:v"), ("z", "host:1")], "hunt string, entity string")
    assert sorted(r.id for r in relations.unsuppressed(found, rules).collect()) == ["b", "c", "d"]
    assert relations.unsuppressed(found, rules.where("false")).count() == 4
    rows = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (None, 1, "null"), (None, 0, "first")], "k int, seq int, what string")
    assert sorted(r.what for r in relations.first_by(rows, "k", ["seq"]).collect()) == ["early", "first"]


@pytest.mark.parametrize("heavy_rows", [30, 10**6])
def test_components_with_heavy_nodes(spark, heavy_rows):
    rng = random.Random(3)
    edges = [(0, n) for n in range(1, 400)] + [(9000, n) for n in range(1000, 1400)] + [(9000, 9000), (None, 5), (1000, 399), (1000, 399)]
    edges += [(n, n + 1) for n in range(2000, 2020)] + [(5000, rng.randrange(4000, 5000)) for _ in range(200)] + [(rng.randrange(6000, 6050), rng.randrange(6000, 6050)) for _ in range(60)]
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.u: r.v for r in relations.stars(spark.createDataFrame(edges, "a bigint, b bigint"), heavy_rows).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
