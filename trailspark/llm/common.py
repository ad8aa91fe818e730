"""Shared helpers of the corpus operators: splits, bounded samples and fixed-size batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import small

#: Texts handed to one vectorised step at a time, in characters; a longer text goes alone.
STEP_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 4, is 2. A null id counts as the empty text: not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def first_by_hash(rows: DataFrame, group: str, n: int, hash_col: str = "h", id_col: str = "id") -> DataFrame:
    """At most n distinct rows of each group, the first by a hash that spreads over all longs, ties by id.

    Hashes well beyond the n-th smallest are cut by an estimate of the group's distinct hashes before anything is ranked
    (it is within a tenth, and the cut leaves a third to spare), so a task ranks some 1.5 n rows of a group, however
    large the group is and however often its rows repeat.
    """
    sizes = rows.groupBy(F.col(group).alias("_of")).agg(F.approx_count_distinct(hash_col, 0.02).alias("_size"))
    share = F.col(hash_col) / 2.0**64 + 0.5
    near = rows.join(small(sizes), F.col(group) == F.col("_of")).where(share * F.col("_size") <= 1.3 * n + 6 * n**0.5 + 64).select(*rows.columns).distinct()
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(hash_col, id_col))).where(F.col("_r") <= n).drop("_r")


def fitted(sample: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """fit of a bounded sample's rows, run in a task: the driver gets neither the sample nor the memory that fitting takes,
    only the model, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([row for batch in batches for row in batch.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # Spark may cut a plan without rows down to no task.
    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([])


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of some rows, so that the Python objects of a whole Arrow batch never stand in memory at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def in_steps(texts: list, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters, so that working memory does not follow the batch size."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
