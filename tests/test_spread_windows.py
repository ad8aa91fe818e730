"""The tasks of the windows grow in number with the events, not in size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailspark.operators import windows


@pytest.mark.parametrize("n", [1000, 4000])
def test_tasks_grow_in_number(spark, monkeypatch, n):
    monkeypatch.setattr(windows, "TASK_ROWS", 500, raising=False)
    asked = []
    deal = windows._dealt

    def seen(*args):
        rows, part = deal(*args)
        asked.append(rows.rdd.getNumPartitions())
        return rows, part

    monkeypatch.setattr(windows, "_dealt", seen)
    events = spark.range(n).select((F.col("id") % 50).alias("k"), (F.col("id") * 1000).alias("us"), "id", (F.col("id") % 7).alias("item"))
    best = windows.best_window(events, ["k"], "us", "id", "item", 1_000_000, 3).select("n", "size").collect()
    assert len(best) == 50 and asked == [2 * n // 500]
