"""What the hunts know of the days before a window: small tables of a row for each day and key.

Counts and sums of a day add up, so tables of parts of the events merge into those of all events. A Baseline keeps them as
Parquet by day and batch: each batch of new events is summarised once, and a hunt reads the days before its window instead
of the events of history.

Events without a time belong to no day and are left out. A batch that is added again replaces its own days; late events of
a day that is stored are a further batch. A day whose events all vanish from a batch must be removed by hand.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import text

_SIGNED_IN = "kind = 'auth' and outcome = 'success' and user <> ''"

#: Keys of each table.
KEYS = {
    "kinds": ("kind",),
    "flows": ("host", "dst_ip"),
    "origins": ("user", "src_ip"),
    "reached": ("user", "host"),
    "programs": ("image",),
    "callers": ("user", "src_ip"),
}


def summaries(events: DataFrame) -> dict[str, DataFrame]:
    """(day, keys, n, volume) for each table of KEYS: events and outbound bytes a day."""
    events = events.where("time is not null").withColumn("day", F.to_date("time"))
    rows = {
        "kinds": events,
        "flows": events.where("kind = 'flow' and dst_ip <> ''"),
        "origins": events.where(f"{_SIGNED_IN} and src_ip <> ''"),
        "reached": events.where(f"{_SIGNED_IN} and host <> ''"),
        "programs": events.where("kind = 'process'").withColumn("image", text.image(F.col("process"))),
        "callers": events.where("kind = 'cloud' and src_ip <> ''"),
    }
    sums = F.count("*").alias("n"), F.sum(F.coalesce("bytes_out", F.lit(0))).alias("volume")
    return {name: rows[name].groupBy("day", *keys).agg(*sums) for name, keys in KEYS.items()}


def merged(table: DataFrame, name: str) -> DataFrame:
    """One row a day and key from the rows of several batches."""
    return table.groupBy("day", *KEYS[name]).agg(F.sum("n").alias("n"), F.sum("volume").alias("volume"))


def _utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def _midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def _within(table: DataFrame, since: datetime | None, until: datetime) -> DataFrame:
    rows = table.where(F.col("day") < F.lit(until.date()))
    return rows if since is None else rows.where(F.col("day") >= F.lit(since.date()))


@dataclass(frozen=True)
class Baseline:
    """Tables of KEYS in a folder; days are UTC, as in a session whose time zone is UTC."""

    spark: SparkSession
    path: str
    files_a_day: int = 8

    def add(self, events: DataFrame, batch: str) -> None:
        """Summarise a batch of events. The batch's own rows of these days are replaced, so a retry counts nothing twice."""
        for name, rows in summaries(events).items():
            part = F.pmod(F.xxhash64(*KEYS[name]), F.lit(self.files_a_day))
            out = rows.withColumn("batch", F.lit(batch)).repartition("day", part).write.partitionBy("day", "batch")
            out.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """(day, keys, n, volume), a row for each batch; a filter on the day prunes files."""
        fields = ", ".join(f"{key} string" for key in KEYS[name])
        rows = self.spark.read.schema(f"{fields}, n bigint, volume bigint, day date, batch string").parquet(f"{self.path}/{name}")
        return rows.select("day", *KEYS[name], "n", "volume")

    def before(self, start: datetime, since: datetime | None, events: DataFrame) -> dict[str, DataFrame]:
        """The tables over [since, start): whole days as stored, and the cut days at either end from the events."""
        start, since = _utc(start), None if since is None else _utc(since)
        # The first and the last midnight of the span.
        first = None if since is None else _midnight(since + timedelta(days=1) - timedelta(microseconds=1))
        last = _midnight(start)
        if first is not None and first > last:
            # The whole span lies within a day.
            return summaries(events.where((F.col("time") >= F.lit(since)) & (F.col("time") < F.lit(start))))
        cut = (F.col("time") >= F.lit(last)) & (F.col("time") < F.lit(start))
        if since is not None:
            cut |= (F.col("time") >= F.lit(since)) & (F.col("time") < F.lit(first))
        edges = summaries(events.where(cut))
        return {name: _within(self.table(name), first, last).unionByName(edges[name]) for name in KEYS}
