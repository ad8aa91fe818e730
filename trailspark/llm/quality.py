"""Document quality by a factorisation machine.

A text becomes a sparse vector: its words, lower-cased and hashed to buckets, with a logarithm of their counts and norm 1;
the share of each punctuation mark; statistics of its structure and given metadata, each spread over two of BINS places,
so that the machine learns a curve of every one. With weights w and a vector v of RANK numbers for every place, the
score's logit is w0 + sum w_i x_i + sum of v_i.v_j x_i x_j over all pairs, and the pairs are summed in linear time as
half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. It is fitted in numpy, by AdaGrad with decay, on a bounded sample of
labelled texts whose vectors Spark's tasks make; each label weighs as much as it has labelled documents, so scores are
probabilities. Scoring is one pass without a shuffle, and texts are read whole, in pieces of PIECE bytes.

Edge cases: a text that is null, empty or without words scores 0. Without labels of both kinds nothing can be learned,
and texts with words score 0.5. Labels whose document is missing, null labels and null ids are ignored; a document that
is labelled twice is good only if every label says so. Of rows that repeat a labelled id, the text that sorts first
teaches. Metadata that is null, or a column that the documents don't have, adds nothing. Repeated rows score alike. Other
columns are never read, whatever their names.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.scratch import small, written

from .common import first_by_hash, held_out, in_steps, parts

THRESHOLD = 0.7
BUCKETS, RANK, BINS = 1 << 16, 8, 12
#: Bytes of a long text that are split into words at once.
PIECE = 1 << 20
META = ("n_chars",)
_MARKS = np.frombuffer(string.punctuation.encode(), np.uint8)
_BLANK = re.compile(rb"\s")
_STATS = 12


def places(buckets: int, meta: int) -> int:
    return buckets + len(_MARKS) + (_STATS + meta) * BINS


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that end at white space; a longer run without any is a piece of its own."""
    start = 0
    while start < len(raw):
        blank = _BLANK.search(raw, start + PIECE)
        end = blank.start() if blank else len(raw)
        yield raw[start:end]
        start = end


def vector(raw: bytes | None, meta: Sequence[float | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's sparse vector, in linear time; both empty without words."""
    raw = raw or b""
    times: dict[int, int] = {}
    n_words = repeated = long_words = 0
    before, lines, line, filled = None, [], 0, False
    for piece in _pieces(raw):
        words = piece.lower().split()
        hashes = np.array([crc32(w) for w in words], np.int64)
        if len(hashes):
            repeated += int((hashes[1:] == hashes[:-1]).sum()) + (before == hashes[0])
            before = hashes[-1]
            n_words += len(hashes)
            found, each = np.unique(hashes % buckets, return_counts=True)
            for b, n in zip(found.tolist(), each.tolist(), strict=True) if times else ():
                times[b] = times.get(b, 0) + n
            times = times or dict(zip(found.tolist(), each.tolist(), strict=True))
            long_words += sum(len(w) > 20 for w in words)
        first, *others = piece.split(b"\n")
        line, filled = crc32(first, line), filled or bool(first.strip())
        for rest in others:
            if filled:
                lines.append(line)
            line, filled = crc32(rest), bool(rest.strip())
    if filled:
        lines.append(line)
    if not n_words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = bytes_of[65:91].sum(), bytes_of[97:123].sum(), bytes_of[48:58].sum()
    marks, blank = bytes_of[_MARKS], bytes_of[[9, 10, 11, 12, 13, 32]].sum()
    some = np.fromiter(times, np.int32, len(times))
    counts = np.fromiter(times.values(), np.float64, len(times))
    damped = np.log1p(counts)
    stats = [
        upper / max(1, upper + lower),
        math.sqrt(marks.sum() / len(raw)),
        math.sqrt(digits / len(raw)),
        blank / len(raw),
        math.sqrt(repeated / n_words),
        len(some) / n_words,
        math.sqrt(counts.max() / n_words),
        min(1.0, (len(raw) - blank) / n_words / 20),
        math.sqrt(long_words / n_words),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, math.log1p(n_words / max(1, len(lines))) / 8),
        min(1.0, math.log1p(n_words) / 16),
    ]
    known = [(i, s) for i, s in enumerate([*stats, *(None if m is None else min(1.0, math.log1p(max(0.0, m)) / 20) for m in meta)]) if s is not None]
    at = np.array([i * BINS for i, _ in known]) + buckets + len(_MARKS)
    where = np.array([s for _, s in known]) * (BINS - 1)
    low = np.minimum(where.astype(np.int64), BINS - 2)
    present = np.nonzero(marks)[0]
    index = np.concatenate((some, buckets + present, at + low, at + low + 1))
    value = np.concatenate((damped / np.sqrt((damped * damped).sum()), np.sqrt(marks[present] / len(raw)), 1 - (where - low), where - low))
    kept = value != 0
    return index[kept].astype(np.int32), value[kept].astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """bias, one weight and RANK factors for every place of a vector; square: the factors' squares, summed."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    square: np.ndarray
    buckets: int = BUCKETS
    meta: tuple[str, ...] = META

    def logits(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of vectors that aren't empty."""
        index, value = (np.concatenate(x) for x in zip(*vectors, strict=True))
        first = np.cumsum([0] + [len(i) for i, _ in vectors[:-1]])
        linear = np.add.reduceat(self.weight[index] * value - 0.5 * self.square[index] * value * value, first)
        sums = np.add.reduceat(self.factor[index] * value[:, None], first, axis=0)
        return self.bias + linear + 0.5 * (sums * sums).sum(axis=1)

    def scores(self, texts: list[bytes | None], meta: list[tuple]) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, end in in_steps([t or b"" for t in texts], 1 << 20):
            vectors = [vector(t, m, self.buckets) for t, m in zip(texts[start:end], meta[start:end], strict=True)]
            some = [i for i, (index, _) in enumerate(vectors) if len(index)]
            if some:
                z = self.logits([vectors[i] for i in some]) if len(self.weight) else np.zeros(len(some))
                out[[start + i for i in some]] = 1.0 / (1.0 + np.exp(-np.clip(z, -50.0, 50.0)))
        return out


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], shares: dict[int, float] | None = None, buckets: int = BUCKETS, meta: tuple[str, ...] = META, epochs: int = 30, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> QualityModel:
    """Train on the vectors of labelled texts. shares: what part of all labelled documents has each label."""
    size = places(buckets, len(meta))
    rng = np.random.default_rng(seed)
    label = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return QualityModel(0.0, np.zeros(0), np.zeros((0, RANK)), np.zeros(0), buckets, meta)
    mean = {k: float((label == k).mean()) for k in (0, 1)}
    importance = np.where(label == 1, (shares or mean)[1] / mean[1], (shares or mean)[0] / mean[0])
    good = float((importance * label).sum() / importance.sum())
    bias, weight, factor = math.log(good / (1 - good)), np.zeros(size), rng.normal(0.0, 0.05, (size, RANK))
    seen, seen_bias = np.full((size, RANK + 1), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            index, value = (np.concatenate(x).astype(kind) for x, kind in zip(zip(*(vectors[r] for r in rows), strict=True), (np.int64, np.float64), strict=True))
            first = np.cumsum([0] + [len(vectors[r][0]) for r in rows[:-1]])
            of = np.repeat(np.arange(len(rows)), [len(vectors[r][0]) for r in rows])
            used, inner = np.unique(index, return_inverse=True)
            w, v = weight[used], factor[used]
            moved = v[inner] * value[:, None]
            sums = np.add.reduceat(moved, first, axis=0)
            z = bias + np.add.reduceat(w[inner] * value, first) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((moved * moved).sum(axis=1), first))
            slope = importance[rows] * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - label[rows]) / len(rows)
            g = slope[of] * value
            to_v = g[:, None] * (sums[of] - moved)
            grad = np.stack([np.bincount(inner, g, len(used)), *(np.bincount(inner, column, len(used)) for column in to_v.T)], axis=1)
            grad += decay * np.concatenate((w[:, None], v), axis=1)
            seen[used] += grad * grad
            step = rate * grad / np.sqrt(seen[used])
            weight[used] -= step[:, 0]
            factor[used] -= step[:, 1:]
            seen_bias += slope.sum() ** 2
            bias -= rate * slope.sum() / math.sqrt(seen_bias)
    return QualityModel(bias, weight, factor, (factor * factor).sum(axis=1), buckets, meta)


def _meta(docs: DataFrame, meta: Sequence[str]) -> list:
    return [(F.col(c).cast("double") if c in docs.columns else F.lit(None).cast("double")).alias(f"meta{i}") for i, c in enumerate(meta)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = META, documents_per_label: int = 2000, longest: int = 20_000, buckets: int = BUCKETS, **options) -> QualityModel:
    """Fit on at most documents_per_label texts of each label, the first by a hash of the id, of up to longest characters.

    Held-out rows are never read. The driver gets the vectors of these texts, not the texts."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_meta(docs, meta)).where(F.length("text").between(1, longest))
    marked = marked.join(texts.select("id"), "id", "left_semi").withColumn("h", F.xxhash64(F.col("id").cast("string")))
    marked = written(marked, "marked")
    total = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    chosen = written(first_by_hash(marked, "label", documents_per_label).select("id", "label"), "chosen")
    columns = ["text", *(f"meta{i}" for i in range(len(meta)))]
    sample = texts.join(small(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(*columns)).alias("first")).select("id", "label", F.col("first.text").cast("binary").alias("text"), *(f"first.{c}" for c in columns[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            made = [vector(raw, m, buckets) for raw, *m in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32()))], ["id", "label", "place", "value"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = [r for r in sample.mapInArrow(run, f"id {kind}, label int, place array<int>, value array<float>").collect() if r.place]
    rows.sort(key=lambda r: r.id)
    shares = {k: n / sum(total.values()) for k, n in total.items()} if len(total) == 2 else None
    return fit([(np.array(r.place, np.int32), np.array(r.value, np.float32)) for r in rows], [r.label for r in rows], shares, buckets, meta, **options)


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            raw, *meta = (c.to_pylist() for c in part.columns[2:])
            scores = model.scores(raw, list(zip(*meta, strict=True)) if meta else [()] * len(raw))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"), *_meta(docs, model.meta))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
