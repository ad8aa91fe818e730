"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of the tokens of its documents. A window of some sequences is filled source after source; a
source's quantum in a window is its target weight, and what rounding withholds is carried as its deficit into the next
window. Served with weight w, a source is due w * t tokens at virtual time t, so its token number j falls due at
(2 j + 1) / (2 w): the order of those times over all sources is the order in which round-robin with carried deficits
serves tokens. A queue that runs dry leaves its share to the others. The place of any token in that order is a sum
over sources, so each task computes windows, offsets and deficits for its own documents and nothing has to be
walked from the first window on: deficits carry across windows and partitions alike.

All windows are full. The tokens left for the last sequence are cut into sequences whose lengths are powers of two,
which need no padding, so nothing is padded at all.

Edge cases: a null text counts as empty and gives the end id alone. A null source is a source like any other. Sources
beyond MOST_QUEUES share queues, so that neither the driver nor a task grows with their number. Repeated ids and null
ids keep one row's tokens each. A text of any length is cut into as many pieces as it needs. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import small, written

from .common import parts
from .tokens import encoder, read_file

SEQUENCE = 1024
#: Sequences in a window.
WINDOW = 32
#: Target weights are whole numbers up to this, so that products of weights and places stay within 64 bits.
FINEST = 1 << 16
#: Queues without a target of their own, at most.
MOST_QUEUES = 64


@dataclass(frozen=True)
class Mixture:
    """Token totals and whole weights of the queues, in the order in which a window is filled."""

    totals: np.ndarray
    weights: np.ndarray
    sequence: int = SEQUENCE
    window: int = WINDOW

    @classmethod
    def of(cls, totals: list[int], targets: list[float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW) -> Mixture:
        """Targets are shares of tokens; without any, the queues' own shares, so that all run dry together."""
        shares = np.array(targets if targets is not None else totals, np.float64)
        largest = shares.max(initial=0.0) or 1.0
        return cls(np.array(totals, np.int64), np.maximum(1, np.rint(shares / largest * FINEST)).astype(np.int64), sequence, window)

    def served(self, queue: int, place: np.ndarray) -> np.ndarray:
        """For each place of a queue, the tokens of every queue (a column) that are served before it."""
        w = self.weights
        due = 2 * place[:, None].astype(np.int64) + 1
        # Token i of queue t comes first if (2 i + 1) w_q < (2 j + 1) w_t, or on a tie if t stands before q.
        whole, rest = np.divmod(due * w[None, :], 2 * w[queue])
        twice = 2 * rest
        before = whole + (twice > 2 * w[queue]) + ((twice == 2 * w[queue]) & (np.arange(len(w)) < queue)[None, :])
        before[:, queue] = place
        return np.minimum(before, self.totals[None, :])

    def rank(self, queue: int, place: np.ndarray) -> np.ndarray:
        """The number of tokens of all queues served before each place of a queue."""
        return self.served(queue, place).sum(axis=1)

    def first_in(self, queue: int, rank: np.ndarray) -> np.ndarray:
        """The first place of a queue whose rank is at least the given one (its total, if there is none)."""
        low, high = np.zeros(len(rank), np.int64), np.full(len(rank), self.totals[queue], np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            short = (self.rank(queue, middle) < rank) & (low < high)
            low, high = np.where(short, middle + 1, low), np.where(short | (low >= high), high, middle)
        return low

    def layout(self, windows: np.ndarray) -> np.ndarray:
        """For each window (a row), every queue's first place in it."""
        at = windows.astype(np.int64) * self.sequence * self.window
        # Between two tokens of the queue of most weight stand few others: step back from its first token in the window.
        lead = int(np.argmax(np.where(self.totals > 0, self.weights, 0)))
        first = self.first_in(lead, at)
        places = self.served(lead, first)
        dry = first == self.totals[lead]  # that queue has run dry before the window
        for q in range(len(self.totals)):
            if dry.any():
                places[dry, q] = self.first_in(q, at[dry])
            while True:
                late = places[:, q] > 0
                late[late] = self.rank(q, places[late, q] - 1) >= at[late]
                if not late.any():
                    break
                places[late, q] -= 1
        return places


def pieces(mixture: Mixture, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut documents, given by queue, first place in it and length, into (document, start, length, sequence, offset)."""
    size = mixture.sequence * mixture.window
    total = int(mixture.totals.sum())
    out: list[tuple[np.ndarray, ...]] = []
    spans = []
    for q in np.unique(queue):
        docs = np.nonzero((queue == q) & (length > 0))[0]
        begin, end = start[docs], start[docs] + length[docs]
        first, last = mixture.rank(q, begin) // size, mixture.rank(q, end - 1) // size
        spans += [np.arange(a, b + 2) for a, b in zip(first, last, strict=True)]
    # The windows of these documents and every queue's bounds in them.
    bounds = np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)
    places = mixture.layout(bounds)
    for q in np.unique(queue):
        docs = np.nonzero((queue == q) & (length > 0))[0]
        if not len(docs):
            continue
        begin, end = start[docs], start[docs] + length[docs]
        first, last = mixture.rank(q, begin) // size, mixture.rank(q, end - 1) // size
        count = last - first + 1
        doc = np.repeat(docs, count)
        window = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row = np.searchsorted(bounds, window)
        inside = (places[row + 1] - places[row])[:, :q].sum(axis=1)
        low = np.maximum(np.repeat(begin, count), places[row, q])
        high = np.minimum(np.repeat(end, count), places[row + 1, q])
        position = window * size + inside + low - places[row, q]
        out.append((doc, low - start[doc], high - low, position))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc, low, n, position = (np.concatenate(x) for x in zip(*out, strict=True))
    doc, low, n, position = (x[n > 0] for x in (doc, low, n, position))
    # Cut at the ends of sequences, and the last, partial one at powers of two.
    tail = total - total % mixture.sequence
    marks = [tail]
    for bit in range(mixture.sequence.bit_length() - 1, -1, -1):
        if (total - tail) >> bit & 1:
            marks.append(marks[-1] + (1 << bit))
    starts = np.array(marks[:-1] or [tail], np.int64)

    def sequence_of(at: np.ndarray) -> np.ndarray:
        return np.where(at < tail, at // mixture.sequence, tail // mixture.sequence + np.searchsorted(starts, at, side="right") - 1)

    first, last = sequence_of(position), sequence_of(position + n - 1)
    count = last - first + 1
    again = np.repeat(np.arange(len(doc)), count)
    sequence = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    full = tail // mixture.sequence
    opens = np.where(sequence < full, sequence * mixture.sequence, starts[np.clip(sequence - full, 0, len(starts) - 1)])
    lengths = np.diff(np.append(starts, total))
    closes = opens + np.where(sequence < full, mixture.sequence, lengths[np.clip(sequence - full, 0, len(starts) - 1)])
    begin = np.maximum(position[again], opens)
    end = np.minimum(position[again] + n[again], closes)
    return doc[again], low[again] + begin - position[again], end - begin, sequence, begin - opens


def queue_of(docs: DataFrame, source_col: str, named: list[str | None], most: int = MOST_QUEUES) -> Column:
    """The queue of each row: its source, null included, while there are at most `most` of them; beyond that the sources
    without a target share that many queues, by hash. Every row is in exactly one queue either way."""
    source = F.col(source_col).cast("string")
    if docs.select(source.alias("source")).distinct().limit(most + 1).count() <= most:
        return source
    own = F.when(source.isNull(), F.lit(None in named)).otherwise(source.isin(*[n for n in named if n is not None]))
    shared = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(source), F.lit(most)).cast("string"))
    return F.when(own, source).otherwise(shared)


def tokenised(docs: DataFrame, queue: Column, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, queue, pid, start, n, ids) in a scratch table: ids with the end id, narrowed; start: the tokens
    of the same queue that the same task wrote before."""
    content = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), {}
        with encoder(content.value) as tool:
            for part in parts(batches, 256):
                blobs = [ids + last for ids in tool.encode(part.column(3).to_pylist())]
                starts = []
                for name, blob in zip(part.column(2).to_pylist(), blobs, strict=True):
                    starts.append(seen.get(name, 0))
                    seen[name] = starts[-1] + len(blob) // 4
                lengths = pa.array([len(b) // 4 for b in blobs], pa.int64())
                columns = [*part.columns[:3], pa.array([pid] * len(blobs), pa.int32()), pa.array(starts, pa.int64()), lengths, pa.array([narrowed(b) for b in blobs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "queue", "pid", "start", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), queue.alias("queue"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, source string, queue string, pid int, start long, n long, ids binary"), "tokens")


def narrowed(blob: bytes) -> bytes:
    """Ids as two bytes each where all fit, after a byte that tells the width."""
    ids = np.frombuffer(blob, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\x04" + blob


def widened(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, targets: Mapping[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sequence: int = SEQUENCE, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source) of every piece; with_ids adds `ids`.

    targets: shares of tokens by source, of any scale; a source without one weighs next to nothing. Without targets, the
    corpus's own shares. Beyond MOST_QUEUES sources, those without a target share queues.
    """
    named = list(targets or ())
    table = tokenised(docs, queue_of(docs, source_col, named), tokenizer_path, end_id, id_col, text_col, source_col)
    # One row a task and queue: that bounds the window, whose groups are the queues; the broadcast is checked.
    tasks = written(table.groupBy("queue", "pid").agg(F.sum("n").alias("tokens")), "tasks")
    before = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.select(F.col("queue").alias("of"), F.col("pid").alias("task"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    totals = {r.queue: r.tokens for r in tasks.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s))
    shares = None if targets is None else [float(targets.get(s, 0.0)) for s in names]
    mixture, number = Mixture.of([totals[s] for s in names], shares, sequence, window), {s: i for i, s in enumerate(names)}
    placed = table.join(small(bases), F.col("queue").eqNullSafe(F.col("of")) & (F.col("pid") == F.col("task")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("start")).alias("start"), "n", "ids", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            queue = np.array([number[s] for s in batch.column(1).to_pylist()], np.int64)
            start, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            doc, low, length, seq, offset = pieces(mixture, queue, start, n)
            ids = [widened(b) for b in batch.column(4).to_pylist()]
            cut = [ids[d][a : a + m] for d, a, m in zip(doc.tolist(), low.tolist(), length.tolist(), strict=True)]
            pick = pa.array(doc, pa.int64())
            columns = [batch.column(0).take(pick), pa.array(low), pa.array(length), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(offset), batch.column(5).take(pick)]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in cut], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names_out)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<long>" * with_ids
    names_out = [x.split()[0] for x in schema.split(", ")]
    return placed.mapInArrow(run, schema)
