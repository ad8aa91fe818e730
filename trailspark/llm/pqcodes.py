"""Vector codes from four codebooks, trained by Lloyd's iteration with filtering.

Vectors become whole numbers and are cut into equal parts. Every partition gathers its rows into chunks and builds a
kd-tree over each part of a chunk: a node holds the bounding box of its parts, their sum and their count. The trees are
written once and serve all rounds. A round walks them with the current codebook: at a node, the entry nearest to the
box's middle is kept, and an entry that is nowhere in the box nearer than it is dropped; when one entry is left, the
node's whole subtree is assigned at once, by its cached sum and count. Whether an entry can win in a box is the minimum
of an affine function over the box, in whole numbers, with ties to the lower index, so filtering changes no result. Only
a sum and a count of each entry reach the driver. The last pass returns every vector's code and error.

Edge cases: a vector that is null or holds a null or non-finite component takes no part. Shorter vectors count as padded
with zeros, up to the longest length, rounded up to a multiple of the parts (4 at least). Repeated rows all count; of the
first vec_ids, equal ones go by the vector, and null ids come last. With fewer vectors than entries, the codebooks have
as many entries as there are vectors. Components too large for exact doubles are computed as Python's whole numbers, by
the same code; errors beyond a long saturate. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.scratch import removed, small, written

from .common import parts as slices

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of one chunk, and those that a leaf of its trees holds at most.
CHUNK, LEAF = 2048, 24
LONG = (1 << 63) - 1


def whole(vectors: list[list[float]], width: int, wide: bool) -> np.ndarray:
    """floor(1024 x) of every component, padded with zeros: whole doubles, or Python's whole numbers if wide."""
    out = np.zeros((len(vectors), width), object if wide else np.float64)
    for i, v in enumerate(vectors):
        if wide:
            out[i, : len(v)] = [1024 * int(x) if abs(x) >= 2.0**53 else math.floor(1024 * x) for x in v]
        else:
            out[i, : len(v)] = np.floor(1024.0 * np.array(v, np.float64))
    return out


class KDTree:
    """Nodes in preorder over the rows of x: lows, highs and sums of their rows, the rows (a slice of `order`), and the
    node that follows when a subtree is done."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        lows, highs, sums, spans, after = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            start, end, closes = todo.pop()
            if start < 0:
                after[closes] = len(spans)
                continue
            rows = x[self.order[start:end]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(spans)
            lows.append(low), highs.append(high), sums.append(rows.sum(axis=0)), spans.append((start, end)), after.append(0)
            todo.append((-1, 0, node))
            spread = high - low
            if end - start > leaf and (spread > 0).any():
                # Cut at the middle of the widest side; equal parts stay together only if they fill a whole node.
                by = rows[:, int(np.argmax(spread))]
                middle = len(rows) // 2
                self.order[start:end] = self.order[start:end][np.argsort(by, kind="stable")]
                todo += [(start + middle, end, -1), (start, start + middle, -1)]
        self.x = x[self.order]
        self.lows, self.highs, self.sums = np.array(lows), np.array(highs), np.array(sums)
        self.spans, self.after = np.array(spans, np.int64), np.array(after, np.int64)


class Walk:
    """What a codebook makes of a tree: each row's entry (in the tree's order), and every entry's sum and count."""

    def __init__(self, tree: KDTree, book: np.ndarray):
        self.entry = np.zeros(len(tree.x), np.int64)
        self.sums, self.counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        #: Distances that were computed between a row and an entry; without filtering it is rows times entries.
        self.distances = 0
        square = (book * book).sum(axis=1)
        # Candidates of the nodes on the way: a node's own come from its nearest ancestor's.
        path: list[tuple[int, np.ndarray]] = []
        node = 0
        while node < len(tree.spans):
            while path and path[-1][0] <= node:
                path.pop()
            start, end = tree.spans[node]
            some = self._nearer(path[-1][1] if path else np.arange(len(book)), book, square, tree.lows[node], tree.highs[node])
            if len(some) == 1:
                self.entry[start:end] = some[0]
                self.sums[some[0]] += tree.sums[node]
                self.counts[some[0]] += end - start
                node = tree.after[node]
                continue
            if tree.after[node] == node + 1:
                rows = tree.x[start:end]
                self.distances += len(rows) * len(some)
                # The row's own square is the same for all entries.
                nearest = some[np.argmin(square[some][None, :] - 2 * (rows @ book[some].T), axis=1)]
                self.entry[start:end] = nearest
                np.add.at(self.sums, nearest, rows)
                np.add.at(self.counts, nearest, 1)
            else:
                path.append((tree.after[node], some))
            node += 1

    @staticmethod
    def _nearer(some: np.ndarray, book: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entries of some that are nearest to a place of the box, ascending; maybe a few more."""
        centre = low + high
        best = some[int(np.argmin(2 * square[some] - 2 * (book[some] @ centre)))]
        apart = book[some] - book[best]
        # The least of |z|^2 - |best|^2 - 2 x.(z - best) over all x of the box.
        least = square[some] - square[best] - 2 * (np.where(apart > 0, apart, 0) @ high + np.where(apart < 0, apart, 0) @ low)
        return some[(least < 0) | ((least == 0) & (some <= best))]


def _dump(rows: np.ndarray, wide: bool) -> bytes:
    return "\n".join(" ".join(map(str, row)) for row in rows.tolist()).encode() if wide else rows.astype("<f8").tobytes()


def _load(raw: bytes, width: int, wide: bool) -> np.ndarray:
    if wide:
        return np.array([[int(x) for x in line.split()] for line in raw.decode().split("\n")], object).reshape(-1, width)
    return np.frombuffer(raw, "<f8").reshape(-1, width)


_FIELDS = ("points", "lows", "highs", "sums", "spans", "after", "rows")


def plant(vectors: DataFrame, width: int, wide: bool, parts: int = PARTS) -> DataFrame:
    """A row for every chunk of vectors (vec_id, label, v): their ids and labels, and of each part's tree the arrays."""
    chunk = min(CHUNK, max(64, (1 << 17) // (parts * width)))
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.binary())] * len(_FIELDS)]

    def packed(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        trees = [KDTree(x[:, p * width : (p + 1) * width]) for p in range(parts)]
        arrays = [[_dump(a, wide) for a in (t.x, t.lows, t.highs, t.sums)] + [a.astype("<i8").tobytes() for a in (t.spans, t.after, t.order)] for t in trees]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((ids, labels, *map(list, zip(*arrays, strict=True))), kinds, strict=True)], ["ids", "labels", *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in slices(batches, chunk // 2):
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            held.append(whole(batch.column(2).to_pylist(), parts * width, wide))
            if len(ids) >= chunk // 2:
                yield packed(ids, labels, np.concatenate(held))
                ids, labels, held = [], [], []
        if ids:
            yield packed(ids, labels, np.concatenate(held))

    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"ids array<long>, labels array<int>, {', '.join(f'{name} array<binary>' for name in _FIELDS)}")


def _trees(batches: Iterator[pa.RecordBatch], width: int, wide: bool) -> Iterator[tuple[dict, list[KDTree]]]:
    """The rows of a table of trees, one at a time, and their trees, part by part."""
    for one in slices(batches, 1):
        row, trees = one.to_pylist()[0], []
        for points, lows, highs, sums, spans, after, rows in zip(*(row[name] for name in _FIELDS), strict=True):
            tree = object.__new__(KDTree)
            tree.x, tree.lows, tree.highs, tree.sums = (_load(raw, width, wide) for raw in (points, lows, highs, sums))
            tree.spans, tree.after, tree.order = np.frombuffer(spans, "<i8").reshape(-1, 2), np.frombuffer(after, "<i8"), np.frombuffer(rows, "<i8")
            trees.append(tree)
        yield row, trees


def _round(trees: DataFrame, books: list[np.ndarray], wide: bool) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts nearest to each entry, by (part, entry)."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, planted in _trees(batches, width, wide):
            for p, tree in enumerate(planted):
                walk = Walk(tree, books[p])
                sums[p] = sums[p] + walk.sums
                counts[p] += walk.counts
        found = [(p, e, int(n), [str(int(x)) for x in sums[p][e]]) for p in range(len(books)) for e, n in enumerate(counts[p]) if n]
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], ["part", "entry", "n", "total"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = [str(sum(map(int, column))) for column in zip(*rows["total"].to_pylist(), strict=True)]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [sum(rows["n"].to_pylist())], [total]], names=["part", "entry", "n", "total"]).cast(rows.schema)

    made = trees.select(*_FIELDS).mapInArrow(run, "part int, entry int, n long, total array<string>")
    if wide:
        made = made.groupBy("part", "entry").applyInArrow(add, made.schema)
    else:
        sums = [F.sum(F.col("total")[i].cast("long")).cast("string") for i in range(width)]
        made = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("total"))
    return {(r.part, r.entry): (r.n, [int(x) for x in r.total]) for r in made.collect()}


def assign(trees: DataFrame, books: list[np.ndarray], wide: bool) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the trees."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, planted in _trees(batches, width, wide):
            codes, errors = np.zeros((len(row["ids"]), len(books)), np.int64), 0
            for p, (tree, book) in enumerate(zip(planted, books, strict=True)):
                entry = Walk(tree, book).entry
                apart = (tree.x - book[entry]) ** 2
                codes[tree.order, p] = entry
                error = np.zeros(len(entry), apart.dtype)
                error[tree.order] = apart.sum(axis=1)
                errors = errors + error
            text = ["".join(f"{e:02x}" for e in code) for code in codes.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int32()), pa.array(text, pa.string()), pa.array([min(int(e), LONG) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, "vec_id long, label int, code string, error long")


def train(trees: DataFrame, books: list[np.ndarray], wide: bool, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after the rounds; entries that nothing is nearest to stay."""
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for (part, entry), (n, total) in _round(trees, books, wide).items():
            books[part][entry] = [x // n for x in total]
    return books


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(x)) for book in books for entry in book for x in entry)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the vectors that hold finite numbers only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    The driver holds the codebooks, and once the first `entries` vectors."""
    rows = usable(vectors, id_col, vector_col, label_col)
    longest, largest = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // parts))
    # Squares, products and their sums stay exact in doubles.
    wide = 8 * width * (1024 * int(largest or 0) + 1024) ** 2 >= 1 << 52
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = whole([r.v for r in first], parts * width, wide)
    trees = written(plant(rows, width, wide, parts), "trees")
    books = train(trees, [start[:, p * width : (p + 1) * width] for p in range(parts)], wide, rounds)
    found = written(assign(trees, books, wide), "codes")
    removed(trees)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = found.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return found.join(small(totals), F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
