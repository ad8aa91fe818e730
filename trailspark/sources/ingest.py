"""JSON Lines to canonical events: text scan, one parse a line, rejects as a column, first-wins dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailspark.errors import IngestError
from trailspark.operators.relations import first_by
from trailspark.operators.scratch import removed, written
from trailspark.schema import EVENT_SCHEMA
from trailspark.sources.adapters import ADAPTERS, FIELDS, events

MOST_BYTES, MOST_LINES, SHOWN_ERRORS = 200_000, 2_000_000, 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, place): non-blank lines; place orders the lines of a file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    return rows.where(F.trim("value") != "")


def adapted(rows: DataFrame, source: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file, place, reason, event fields): reason is empty for events."""
    fits = F.octet_length("value") <= most_bytes
    # A null record is no JSON; one that isn't an object has no fields.
    parsed = rows.withColumn("record", F.when(fits, F.try_parse_json("value"))).withColumn("is_object", F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")))
    why = F.when(~fits, f"line exceeds {most_bytes} bytes").when(F.col("record").isNull(), "not valid JSON").when(~F.col("is_object"), "not a JSON object").otherwise(F.col("wrong"))
    return events(parsed, source).select("file", "place", why.alias("reason"), *FIELDS)


def load(spark: SparkSession, inputs: Sequence[tuple[str, str]], most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> tuple[DataFrame, list[dict]]:
    """Events of (format, path) inputs, one an id, the first input's first line; and a report for each input.

    The input is read once: adapted lines are a table in the shared scratch folder, counted while it is written, so that
    reports and hunts don't parse them again. An input with a file of more than most_lines lines is refused.
    """
    for source, _ in inputs:
        if source not in ADAPTERS:
            raise IngestError(f"unknown source format {source!r}; choose from {', '.join(sorted(ADAPTERS))}")
    parts, reports = [], []
    for number, (source, path) in enumerate(inputs):
        seen = Observation("lines")
        counts = F.count("*").alias("lines"), F.count_if(F.col("reason") != "").alias("rejected")
        rows = written(adapted(lines(spark, path), source, most_bytes).observe(seen, *counts), "events")
        longest = rows.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 if seen.get["lines"] > most_lines else 0
        if longest > most_lines:
            removed(rows)
            raise IngestError(f"a file exceeds the limit of {most_lines} records")
        accepted = rows.where("reason = ''").select("id").distinct().count()
        errors = rows.where("reason <> ''").orderBy("file", "place").limit(SHOWN_ERRORS).select("reason").collect() if seen.get["rejected"] else []
        reports.append({"source": source, **seen.get, "accepted": accepted, "errors": [r.reason for r in errors]})
        parts.append(rows.where("reason = ''").withColumn("input", F.lit(number)))
    if not parts:
        return spark.createDataFrame([], EVENT_SCHEMA), reports
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return first_by(every, "id", ["input", "file", "place"]).drop("input", "file", "place", "reason"), reports


def write_lines(rows: DataFrame, path: str) -> None:
    """Canonical events as JSON Lines that the generic format reads back."""
    keep = rows.select(*[F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("time") if n == "time" else F.col(n) for n in FIELDS])
    keep.select(F.to_json(F.struct(*FIELDS)).alias("value")).write.mode("overwrite").text(path)
