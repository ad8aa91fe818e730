"""Event-time windows that anchor at events: the best trailing window and the first forward burst.

Time is cut into blocks as wide as the window, and each event is dealt to its block and the one beside it, so a window
never reaches beyond the rows of its block and a busy key is spread over its blocks. Inside a block everything is a
running sum or an offset over sorted rows: no list is gathered but that of a key's chosen window.

Events without a time, a key or an item take part in no window. Ties in time are ordered by the event's id, and equal
ids by their item; rows that repeat all three are counted one by one.

previous() gives every event the one before it of its key. A key's events are cut into slices of time, so that a busy key
is spread over tasks; what a slice's first event needs comes from the last events of the slices before, one row a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import spread, written

#: Width of a slice of previous(): a key's events of these ten minutes are sorted in one task.
SLICE_US = 600_000_000
#: Rows that a task sorts, unless one block has more: memory of a task follows this and not the size of the input.
TASK_ROWS = 400_000


def previous(events: DataFrame, keys: Sequence[str], time_us: Column, event_id: str, value: Column, name: str, slice_us: int = SLICE_US) -> DataFrame:
    """events with `name`: the value of the key's event before, by time and id; null for a key's first. Null keys are a key
    like others; events without a time come first. Spark sorts each slice once, and meets one row a slice and key again."""
    cut = events.withColumns({"_us": time_us, "_value": F.struct(value.alias("v"))}).withColumn("_slice", F.coalesce(F.floor(F.col("_us") / slice_us), F.lit(-(1 << 62))))
    part = [*keys, "_slice"]
    last = cut.groupBy(*part).agg(F.max_by("_value", F.struct("_us", event_id)).alias("_last"))
    carried = last.withColumn("_value", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))).where("_value is not null").drop("_last")
    # What is carried into a slice stands before its events.
    rows = cut.withColumn("_carried", F.lit(1)).unionByName(carried.withColumn("_carried", F.lit(0)), allowMissingColumns=True)
    before = F.lag("_value").over(Window.partitionBy(*part).orderBy("_carried", "_us", event_id))
    return rows.withColumn("_before", before).where("_carried = 1").select(*events.columns, F.col("_before.v").alias(name))


def _busy(events: DataFrame, keys: Sequence[str], item: str, least: int) -> DataFrame:
    """The events of keys that reach the threshold over all time: nothing else can reach it in a window."""
    enough = events.groupBy(*keys).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return events.join(spread(enough), list(keys), "left_semi")


def _block(us: Column, width_us: int) -> Column:
    """The start of the block that holds a time."""
    return us - F.pmod(us, F.lit(width_us))


def _dealt(events: DataFrame, keys: Sequence[str], width_us: int, beside: int) -> tuple[DataFrame, list[str]]:
    """The events of each block and of the neighbour to which `beside` (1 or -1) leads, with `_own`; and the block's keys.
    events: a scratch table, so that counting its rows reads no more than its footers."""
    own = _block(F.col("_us"), width_us)
    rows = events.withColumn("_block", F.explode(F.array(own, own + beside * width_us))).withColumn("_own", F.col("_block") == own)
    part = [*keys, "_block"]
    return rows.repartition(max(1, -(-2 * events.count() // TASK_ROWS)), *part), part


def _window_rows(events: DataFrame, chosen: DataFrame, keys: Sequence[str], width_us: int) -> DataFrame:
    """The events of each key's chosen window (keys, _first, _last in time, other columns), looked up by key and block."""
    places = chosen.withColumn("_block", F.explode(F.array_distinct(F.array(_block(F.col("_first"), width_us), _block(F.col("_last"), width_us)))))
    inside = events.withColumn("_block", _block(F.col("_us"), width_us)).join(spread(places), [*keys, "_block"])
    return inside.where(F.col("_us").between(F.col("_first"), F.col("_last"))).drop("_block")


def best_window(events: DataFrame, keys: Sequence[str], time_us: str, event_id: str, item: str, width_us: int, least: int, cap: int | None = None) -> DataFrame:
    """One row for each key with a qualifying window: (keys, n, size, start_us, end_us, items, ids).

    A window ends at an event and reaches back width_us, inclusive. It qualifies with `least` distinct items and at most
    `cap` events of any one item. The window of most distinct items is returned, the first of several.

    An item enters with an event that follows no other of it within the width, and leaves a width after one that none
    follows; it is over the cap from an event to a width after the one `cap` places before. The sums of what entered and
    left count the items of every window and those over the cap.
    """
    events = events.select(*keys, F.col(time_us).alias("_us"), F.col(event_id).alias("_id"), F.col(item).alias("_item")).where(F.col("_us").isNotNull() & F.col("_item").isNotNull())
    events = written(_busy(events, keys, "_item", least), "busy")
    rows, part = _dealt(events, keys, width_us, 1)
    # Rows of one time, numbered: the chosen window ends at one of them.
    rows = rows.withColumn("_tie", F.row_number().over(Window.partitionBy(*part, "_us").orderBy("_id", "_item")))
    same = Window.partitionBy(*part, "_item").orderBy("_us", "_tie")
    enters = F.coalesce(F.col("_us") - F.lag("_us").over(same) > width_us, F.lit(True))
    leaves = F.coalesce(F.lead("_us").over(same) - F.col("_us") > width_us, F.lit(True))
    early = F.lag("_us", cap).over(same) if cap else F.lit(None).cast("long")
    rows = rows.withColumns({"_enters": enters, "_leaves": leaves, "_early": early})
    over = F.coalesce(F.col("_us") - F.col("_early") <= width_us, F.lit(False))

    def change(at: Column, anchor: Column, items: Column, over: Column) -> Column:
        return F.struct(at.alias("at"), anchor.alias("anchor"), items.alias("items"), over.alias("over"))

    no, width = F.lit(0), F.lit(width_us + 1).cast("long")
    changes = F.array_compact(F.array(
        change(F.col("_us"), F.lit(1), F.col("_enters").cast("int"), over.cast("int")),
        F.when(F.col("_leaves"), change(F.col("_us") + width, no, F.lit(-1), no)),
        F.when(over, change(F.col("_early") + width, no, no, F.lit(-1))),
    ))
    rows = rows.select(*part, "_us", "_tie", "_own", F.explode(changes).alias("_change")).select(*part, "_us", "_tie", "_own", "_change.*")
    so_far = Window.partitionBy(*part).orderBy("at", "anchor", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_n", F.sum("items").over(so_far)).withColumn("_over", F.sum("over").over(so_far))
    fits = F.col("_own") & (F.col("anchor") == 1) & (F.col("_n") >= least) & (F.col("_over") == 0)
    best = counted.where(fits).groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_us", "_tie")).alias("_best"))
    best = best.select(*keys, (F.col("_best._us") - width_us).alias("_first"), F.col("_best._us").alias("_last"), F.col("_best._tie").alias("_tie"))
    inside = _window_rows(events, best, keys, width_us)
    found = inside.groupBy(*keys).agg((F.count_if(F.col("_us") < F.col("_last")) + F.first("_tie")).cast("int").alias("size"), F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.array_sort(F.collect_list(F.struct("_us", "_id", "_item"))).alias("_rows"))
    # Of the window's last moment, only the rows up to the chosen one.
    found = found.withColumn("_rows", F.slice("_rows", F.lit(1), F.col("size"))).withColumn("items", F.array_sort(F.array_distinct(F.transform("_rows", lambda x: x["_item"]))))
    return found.select(*keys, F.size("items").alias("n"), "size", "start_us", "end_us", "items", F.transform("_rows", lambda x: x["_id"]).alias("ids"))


def first_burst(events: DataFrame, keys: Sequence[str], time_us: str, event_id: str, width_us: int, least: int) -> DataFrame:
    """One row for each key: the first event with `least` events from it on within width_us, inclusive: (keys, size,
    start_us, end_us, ids). Events before it at the same microsecond are not counted."""
    events = events.select(*keys, F.col(time_us).alias("_us"), F.col(event_id).alias("_id")).where(F.col("_us").isNotNull())
    events = written(events, "timed")
    rows, part = _dealt(events, keys, width_us, -1)
    reach = F.lead("_us", least - 1).over(Window.partitionBy(*part).orderBy("_us", "_id"))
    starts = rows.withColumn("_reach", reach).where(F.col("_own") & (F.col("_reach") - F.col("_us") <= width_us))
    first = starts.groupBy(*keys).agg(F.min(F.struct("_us", "_id")).alias("_start"))
    first = first.select(*keys, F.col("_start._us").alias("_first"), (F.col("_start._us") + width_us).alias("_last"), F.col("_start._id").alias("_from"))
    inside = _window_rows(events, first, keys, width_us).where((F.col("_us") > F.col("_first")) | (F.col("_id") >= F.col("_from")))
    found = inside.groupBy(*keys).agg(F.count("*").cast("int").alias("size"), F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.array_sort(F.collect_list(F.struct("_us", "_id"))).alias("_ids"))
    return found.select(*keys, "size", "start_us", "end_us", F.transform("_ids", lambda x: x["_id"]).alias("ids"))
