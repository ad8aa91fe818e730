"""Exact top-k by integer inner product with M-trees.

Vectors are quantised to integer codes and dealt to pivots; a pivot with more rows than one task should hold is salted
into groups. A task bulk-loads an M-tree of paged nodes over its group and answers a block of queries best-first. With
M the largest norm of the group, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), the squared distance of q' and x' is
|q|^2 + M^2 - 2 q.x, so nearest neighbours of q' are the largest inner products. Nodes hold covering radii and
distances to their parent's routing object, and the triangle inequality on those skips subtrees and single entries
without computing a distance. Scores come from the integer codes; bounds only decide what may be skipped, with slack
for rounding.

The pivots are the tree's upper page: a query first searches one group of its most promising pivot, and goes on to the
pivots whose covering radius or largest norm lets them beat the score found there. Only those groups get it, and only
groups that some query still asks are read again.

Codes too large for exact sums in doubles are kept apart, as vectors: their scores are computed in whole numbers, against
every row, without touching the tree of the others.

Edge cases: a vector that is null or holds a null or non-finite component takes no part, neither as query nor as
candidate. Shorter vectors count as padded with zeros; an empty one scores 0 with everything. Rows that share the
query's id are its own and no candidates, since an id stands for one vector; repeated query rows are answered one by one.
A null id is never a query; as a candidate it loses every tie. Scores beyond a long saturate. Empty tables give an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import written

from .common import parts

GROUP_ROWS = 8192
QUERY_BLOCK = 4096
MOST_PIVOTS = 256
NO_ID = (1 << 63) - 1
#: The pivot of vectors whose codes are too large for the tree.
WIDE = -1


def codes(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole doubles."""
    return np.floor(256.0 * values.astype(np.float64))


def matrix(raws: list[bytes], width: int) -> np.ndarray:
    """Codes from bytes, padded with zeros to the width."""
    out = np.zeros((len(raws), width))
    for i, raw in enumerate(raws):
        row = np.frombuffer(raw, "<i4")
        out[i, : len(row)] = row
    return out


def whole_codes(raw: bytes, wide: bool) -> list[int]:
    """Codes as whole numbers, from codes or from the components of a wide vector."""
    if not wide:
        return np.frombuffer(raw, "<i4").tolist()
    return [256 * int(x) if abs(x) >= 2.0**60 else math.floor(256 * x) for x in np.frombuffer(raw, "<f8").tolist()]


class MTree:
    """An M-tree over the rows of x. Rows are reordered so that a leaf page is a slice of them."""

    def __init__(self, x: np.ndarray, leaf: int = 128, fanout: int = 16, seed: int = 1):
        self.leaf, self.fanout, self.rng = leaf, fanout, np.random.default_rng(seed)
        squared = (x * x).sum(axis=1)
        self.most = float(squared.max(initial=0.0))
        self.x, self.lift = x, np.sqrt(np.maximum(self.most - squared, 0.0))
        self.order: list[np.ndarray] = []
        self.filled = 0
        self.root = self._page(np.arange(len(x)), None)
        rows = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        self.rows, self.x = rows, np.ascontiguousarray(x[rows])

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        flat = self.x[rows] - self.x[to]
        lift = self.lift[rows] - self.lift[to]
        return np.sqrt((flat * flat).sum(axis=1) + lift * lift)

    def _page(self, rows: np.ndarray, parent: int | None) -> tuple:
        """("leaf", start, end, parent distances) or ("node", routing vectors, radii, parent distances, children)."""
        if len(rows) <= self.leaf:
            start, self.filled = self.filled, self.filled + len(rows)
            self.order.append(rows)
            return "leaf", start, self.filled, self._distances(rows, parent) if parent is not None else None
        routing = self.rng.choice(rows, min(self.fanout, -(-len(rows) // self.leaf)), replace=False)
        nearest = np.argmin(np.stack([self._distances(rows, o) for o in routing]), axis=0)
        parts = [(o, rows[nearest == i]) for i, o in enumerate(routing)]
        parts = [(o, part) for o, part in parts if len(part)]
        if len(parts) == 1:  # one point many times: any cut is as good
            parts = [(parts[0][0], part) for part in np.array_split(rows, len(routing))]
        radii = np.array([self._distances(part, o).max() for o, part in parts])
        chosen = np.array([o for o, _ in parts])
        own = self._distances(chosen, parent) if parent is not None else None
        return "node", self.x[chosen], radii, own, [self._page(part, o) for o, part in parts]

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) for the query; ids: of the rows in self.rows order; own: the id to leave out."""
        base = float(q @ q) + self.most
        slack = 1e-9 * (1.0 + math.sqrt(base))
        best_scores, best_ids, reach = np.zeros(0), np.zeros(0, np.int64), math.inf
        queue, number = [(0.0, 0, self.root, None)], 0
        while queue:
            bound, _, page, from_parent = heapq.heappop(queue)
            if bound > reach + slack:
                break
            if page[0] == "leaf":
                _, start, end, parent = page
                x, some = self.x[start:end], ids[start:end]
                if parent is not None and math.isfinite(reach):
                    near = np.abs(parent - from_parent) <= reach + slack
                    if not near.all():
                        x, some = x[near], some[near]
                scores = x @ q
                useful = some != own
                if len(best_scores) == k:
                    useful &= scores >= best_scores[-1]
                if useful.any():
                    all_scores, all_ids = np.concatenate((best_scores, scores[useful])), np.concatenate((best_ids, some[useful]))
                    first = np.lexsort((all_ids, -all_scores))[:k]
                    best_scores, best_ids = all_scores[first], all_ids[first]
                    if len(best_scores) == k:
                        reach = math.sqrt(max(base - 2.0 * best_scores[-1], 0.0))
                continue
            _, routing, radii, parent, children = page
            maybe = np.arange(len(children))
            if parent is not None and math.isfinite(reach):
                maybe = np.nonzero(np.abs(parent - from_parent) - radii <= reach + slack)[0]
                routing = routing[maybe]
            distances = np.sqrt(np.maximum(base - 2.0 * (routing @ q), 0.0))
            for i, distance in zip(maybe.tolist(), distances.tolist(), strict=True):
                least = max(distance - radii[i], 0.0)
                if least <= reach + slack:
                    number += 1
                    heapq.heappush(queue, (least, number, children[i], distance))
        return best_scores, best_ids


def _every_pair(rows: list[list[int]], ids: list[int], q: list[int], own: int, k: int) -> tuple[list[int], list[int]]:
    """Whole-number arithmetic on every row; what a long can't hold saturates, and ties there too go to the smaller id."""
    scores = (max(-(1 << 63), min((1 << 63) - 1, sum(map(mul, q, row)))) for row in rows)
    best = heapq.nsmallest(k, ((-s, i) for s, i in zip(scores, ids, strict=True) if i != own))
    return [-s for s, _ in best], [i for _, i in best]


def _answer(k: int):
    """Searches a group for a block of queries: with the tree, unless the rows or a query are wide."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def add(own: int, number: int, scores, found) -> None:
            out[0].extend([own] * len(found))
            out[1].extend([number] * len(found))
            out[2].extend(int(i) for i in found)
            out[3].extend(int(s) for s in scores)

        if len(rows) and len(queries):
            raws, ids, wide = rows["codes"].to_pylist(), rows["vec_id"].to_numpy(), rows["pivot"][0].as_py() == WIDE
            asked = list(zip(queries["codes"].to_pylist(), queries["vec_id"].to_pylist(), queries["number"].to_pylist(), queries["wide"].to_pylist(), strict=True))
            plain = [a for a in asked if not (wide or a[3])]
            if plain:
                width = max(1, max(map(len, raws + [a[0] for a in plain])) // 4)
                tree = MTree(matrix(raws, width))
                tree_ids = ids[tree.rows]
                for raw, own, number, _ in plain:
                    add(own, number, *tree.search(matrix([raw], width)[0], tree_ids, own, k))
            if len(plain) < len(asked):
                every = [whole_codes(raw, wide) for raw in raws]
                for raw, own, number, is_wide in asked:
                    if wide or is_wide:
                        add(own, number, *_every_pair(every, ids.tolist(), whole_codes(raw, is_wide), own, k))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["query_id", "number", "vec_id", "score"])

    return run


def _search(rows: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, number, vec_id, score) of asking (pivot, salt, vec_id, number, codes, wide) in the rows of that group.

    Queries of a pivot are dealt to blocks, and its rows to each block; rows of a pivot that nobody asks go nowhere. At
    most MOST_PIVOTS counts come to the driver."""
    demand = {r["pivot"]: -(-r["n"] // QUERY_BLOCK) for r in asking.groupBy("pivot").agg(F.count_distinct("vec_id", "number").alias("n")).collect()}
    if not demand:
        return asking.sparkSession.createDataFrame([], _FOUND)
    blocks = F.create_map(*[F.lit(x) for pair in demand.items() for x in pair])
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id", "number"), blocks[F.col("pivot")]).cast("int"))
    rows = rows.where(F.col("pivot").isin(*demand)).join(asking.select("pivot", "salt").distinct(), ["pivot", "salt"], "left_semi")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("pivot")] - 1)))
    key = ("pivot", "salt", "block")
    return rows.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(_answer(k), _FOUND)


_FOUND = "query_id long, number int, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k largest inner products."""
    usable = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = usable.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n, width = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    # Codes up to this have exact sums of products in doubles.
    largest = math.isqrt((1 << 52) // max(1, width or 1))
    wanted = min(MOST_PIVOTS, max(1, -(-n // GROUP_ROWS)))
    # Pivots: a bounded sample, the first by a hash of the id.
    plain = usable.where(F.forall("v", lambda x: F.abs(x) < largest / 256 - 1))
    sample = [codes(np.array(r.v, np.float64)).astype("<i4").tobytes() for r in plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()] or [b""]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2048):
            vectors = [np.array(v, np.float64) for v in batch.column(1).to_pylist()]
            small = [bool((np.abs(v) < largest / 256 - 1).all()) for v in vectors]
            raws = [codes(v).astype("<i4").tobytes() if ok else v.astype("<f8").tobytes() for v, ok in zip(vectors, small, strict=True)]
            some = [raw if ok else b"" for raw, ok in zip(raws, small, strict=True)]
            x, p = matrix(some, max(1, width)), matrix(sample, max(1, width))
            product = x @ p.T
            squared, norms = (x * x).sum(axis=1), (p * p).sum(axis=1)
            pivot = (norms[None, :] - 2.0 * product).argmin(axis=1)
            far = np.sqrt(np.maximum(squared + norms[pivot] - 2.0 * product[np.arange(len(x)), pivot], 0.0))
            where = np.where(small, pivot, WIDE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary()), pa.array(where), pa.array(far), pa.array(np.sqrt(squared)), pa.array(product.argmax(axis=1).astype(np.int32))], ["vec_id", "codes", "pivot", "far", "norm", "best"])

    dealt = written(usable.mapInArrow(deal, "vec_id long, codes binary, pivot int, far double, norm double, best int"), "codes")
    found = {r["pivot"]: r for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect()}
    if not found:
        return usable.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    salts = F.create_map(*[F.lit(x) for pivot, r in found.items() for x in (pivot, -(-r["n"] // GROUP_ROWS))])
    rows = dealt.select("vec_id", "codes", "pivot", F.pmod(F.xxhash64("vec_id", "codes"), salts[F.col("pivot")].cast("long")).cast("int").alias("salt"))
    asking = dealt.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))
    number = F.row_number().over(Window.partitionBy("vec_id").orderBy("codes"))
    asking = asking.select("vec_id", "codes", "norm", "best", number.alias("number"), (F.col("pivot") == WIDE).alias("wide"))
    near = asking.where(~F.col("wide") & F.col("best").isin(*found)).withColumn("pivot", F.col("best")).withColumn("salt", F.lit(0))
    first = written(_search(rows, written(near, "near"), k), "first")
    reached = first.groupBy(F.col("query_id").alias("vec_id"), "number").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    asking = asking.join(reached, ["vec_id", "number"], "left")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sorted(p for p in found if p != WIDE)
        centre = matrix([sample[p] for p in place], max(1, width))
        radius, norm = (np.array([found[p][name] for p in place]) for name in ("radius", "norm"))
        for batch in parts(batches, 2048):
            wide, own = np.array(batch.column(4).to_pylist(), bool), batch.column(2).to_numpy()
            least = np.array([-np.inf if s is None else s for s in batch.column(5).to_pylist()], float)
            q = matrix([b"" if w else c for c, w in zip(batch.column(1).to_pylist(), wide, strict=True)], max(1, width))
            most = np.minimum(q @ centre.T + own[:, None] * radius[None, :], own[:, None] * norm[None, :])
            go = (most * (1 + 1e-9 * np.sign(most)) + 1.0 >= least[:, None]) | wide[:, None]
            lists = [[p for p, yes in zip(place, row, strict=True) if yes] + [WIDE] * (WIDE in found) for row in go]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(6), batch.column(4), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "codes", "best", "number", "wide", "pivots"])

    then = asking.select("vec_id", "codes", "norm", "best", "wide", "least", "number").mapInArrow(spread, "vec_id long, codes binary, best int, number int, wide boolean, pivots array<int>")
    then = then.select("vec_id", "codes", "best", "number", "wide", F.explode("pivots").alias("pivot"))
    then = then.withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("pivot")] - 1)))
    then = written(then.where(F.col("wide") | (F.col("pivot") != F.col("best")) | (F.col("salt") > 0)).drop("best"), "asking")
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(_search(rows, then, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
