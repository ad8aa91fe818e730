"""Relational building blocks: first-wins dedup, suppression, linking and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import BROADCAST_ROWS, removed, small, spread, written, written_and_seen
from trailspark.operators.windows import previous


def first_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Ids of findings that a rule (hunt or `*`, entity as `kind:value`) matches; findings: (id, hunt, entities)."""
    named = findings.select("id", "hunt", F.explode("entities").alias("entity"))
    rules = rules.select(F.col("hunt").alias("rule_hunt"), F.col("entity").alias("rule_entity"))
    return named.join(small(rules), (F.col("entity") == F.col("rule_entity")) & ((F.col("rule_hunt") == "*") | (F.col("rule_hunt") == F.col("hunt")))).select("id").distinct()


def unsuppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    return findings.join(spread(suppressed(findings, rules)), "id", "left_anti")


def consecutive_links(findings: DataFrame, gap_us: int) -> DataFrame:
    """(a, b) of findings that follow each other for one entity, at most gap_us between the end and the next start.

    findings: (id, first_us, last_us, entities)."""
    rows = findings.select("id", "first_us", "last_us", F.explode("entities").alias("entity"))
    rows = previous(rows, ["entity"], F.col("first_us"), "id", F.struct("id", "last_us"), "before")
    near = rows.where(F.col("first_us") - F.col("before.last_us") <= gap_us)
    return near.select(F.col("before.id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


#: Rows of one node that a task may join; in large graphs, a thousandth of all rows.
HEAVY_ROWS = 1_000_000
MOST_HEAVY = 1000


def _with_least(rows: DataFrame, least: DataFrame, total: int, heavy_rows: int, made: list[DataFrame]) -> DataFrame:
    """rows (u, v) with m, from least (u, m, n). Rows of a node with more than its share are joined where they lie, since at
    most MOST_HEAVY nodes can have so many: those are broadcast. The others meet by node. made: gets the scratch table of this."""
    most = max(heavy_rows, total // MOST_HEAVY)
    if total <= most:
        return rows.join(least.drop("n") if total <= BROADCAST_ROWS else spread(least.drop("n")), "u")
    least = written(least, "least")
    made.append(least)
    heavy = F.broadcast(least.where(F.col("n") > most).drop("n"))
    light = rows.join(heavy.select("u"), "u", "left_anti").join(spread(least.where(F.col("n") <= most).drop("n")), "u")
    return rows.join(heavy, "u").unionByName(light)


def stars(edges: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(u, v) for every node u of the undirected edges (a, b) but the smallest of its component, which is v.

    Alternating large-star and small-star steps until a round changes nothing. Each round is a table in the shared
    scratch folder, so a lost executor costs no more than a round; the table before it is deleted. Nodes and edges stay
    in Spark: only a count and a hash reach the driver. Null ends and loops are no edges. The rows of a node with more
    than heavy_rows neighbours stay spread over tasks.
    """
    smallest = F.min("v").alias("m"), F.count("*").alias("n")
    state = {"rows": F.count("*"), "digest": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    at, seen = written_and_seen(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct(), "edges", **state)
    while True:
        made, size = [at], seen["rows"]
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(*smallest).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, 2 * size, heavy_rows, made).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if 2 * size > heavy_rows:
            large = written(large, "large")
            made.append(large)
        # A large-star step gives no more rows than the table has edges.
        least = large.groupBy("u").agg(*smallest)
        small = _with_least(large, least, size, heavy_rows, made).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at, then = written_and_seen(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", **state)
        for table in made:
            removed(table)
        if then == seen:
            return at
        seen = then


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every id of nodes: the smallest id reachable over edges (a, b), itself included."""
    roots = stars(edges).select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
