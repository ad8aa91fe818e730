"""Joins whose sides grow with the events are by shuffle, however small Spark takes their files for."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from trailspark.hunts import identity
from trailspark.hunts.context import Context
from trailspark.operators.relations import suppressed
from trailspark.operators.scratch import small, written
from trailspark.schema import EVENT_SCHEMA, HuntConfig


def test_hunts_broadcast_no_events(spark, capsys):
    given = {"id": F.col("id").cast("string"), "time": F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)), "kind": F.lit("auth"), "user": F.concat(F.lit("u"), F.col("id") % 9), "src_ip": F.lit("198.51.100.1"), "outcome": F.lit("failure")}
    fields = [part.split(" ") for part in EVENT_SCHEMA.split(", ")]
    events = written(spark.range(1000).select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in fields]), "events")
    for plan in (identity.spray, identity.brute_force):
        plan(Context(events, events.where("false"), HuntConfig())).explain()
        out = capsys.readouterr().out
        assert "SortMergeJoin" in out and "BroadcastExchange" not in out


def test_findings_meet_rules_where_they_lie(spark, capsys):
    found = written(spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("h").alias("hunt"), F.array(F.lit("user:u")).alias("entities")), "found")
    suppressed(found, spark.createDataFrame([("*", "user:u")], "hunt string, entity string")).explain()
    assert "BuildRight" in capsys.readouterr().out


def test_more_rows_than_small_allows_are_not_broadcast(spark, capsys):
    """Not even where the files are smaller than Spark's own limit."""
    rows = written(spark.range(100), "rows")
    rows.join(small(rows, most=10), "id").explain()
    out = capsys.readouterr().out
    assert "SortMergeJoin" in out and "Broadcast" not in out
