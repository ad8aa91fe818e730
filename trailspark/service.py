"""The library in one object: configuration, loading, hunting and coverage over one Spark session."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark import config as configuration
from trailspark.errors import HuntError
from trailspark.plans.engine import HuntResult, coverage, hunt
from trailspark.schema import HuntConfig
from trailspark.sources import ingest

FILES = ("thresholds", "iocs", "allowlist", "geo", "suppressions")


@dataclass
class HuntService:
    spark: SparkSession
    settings: configuration.Settings
    config: HuntConfig

    def load(self, inputs: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[dict]]:
        """Events of (format, path) inputs, and a report for each."""
        return ingest.load(self.spark, inputs, self.settings.max_line_bytes, self.settings.max_events)

    def hunt(self, events: DataFrame, window: timedelta = timedelta(hours=24), start: datetime | None = None, baseline_days: int | None = None, only: Sequence[str] | None = None, **options) -> HuntResult:
        """Hunt in a window from start on, or in the one that ends a second after the newest event."""
        if start is None:
            newest = events.agg(F.unix_micros(F.max("time"))).first()[0]
            if newest is None:
                raise HuntError("no events were loaded")
            start = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=newest) + timedelta(seconds=1) - window
        return hunt(events, self.config, start, start + window, start - timedelta(days=baseline_days) if baseline_days else None, only, **options)

    def coverage(self, events: DataFrame) -> tuple[dict[str, int], dict]:
        """Events by kind, and what hunts over them cover."""
        kinds = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
        return kinds, coverage(kinds, bool(self.config.geo))


def build_service(spark: SparkSession | None = None, settings: configuration.Settings | None = None, **files: str | None) -> HuntService:
    """files: paths by name (thresholds, iocs, allowlist, geo, suppressions); what is not given comes from the settings."""
    if unknown := sorted(set(files) - set(FILES)):
        raise TypeError(f"unknown configuration files {unknown}")
    settings = settings or configuration.Settings.read()
    config = configuration.load(**{f"{name}_file": files.get(name) or getattr(settings, f"{name}_file") or None for name in FILES})
    spark = spark or SparkSession.builder.appName("trailspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return HuntService(spark, settings, config)
