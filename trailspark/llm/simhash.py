"""SimHash near-duplicate detection by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 16 segments of 4 bits. The vector of their bit counts is a point of a small
integer grid, and the Manhattan distance of two points never exceeds the Hamming distance of the fingerprints. Two
points at distance r share a grid point that lies within ceil(r/2) of one and floor(r/2) of the other, so the range
join is an equi-join on grid points; the exact Hamming distance is verified in the join condition.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other. Rows that
repeat a doc_id stay rows of their own. A null doc_id takes part; the component id is the smallest non-null id.
An empty table gives an empty result. Other columns of the input are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.relations import stars
from trailspark.operators.scratch import small, spread, written

from .common import parts

SEED = 42
SEGMENTS = 16
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; A-Z is lower-cased, words are split at ASCII white space."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_digest
    while True:
        raw = b"".join([digest(s, SEED) for s, _ in zip(shingles, range(_CHUNK), strict=False)])
        if not raw:
            break
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int(np.packbits(2 * ones > total).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the signed fingerprint of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            prints = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit count of each 4-bit segment, packed into one long: the grid point of a fingerprint."""
    lowest = F.lit(0x1111111111111111)
    bits = [F.shiftrightunsigned(fp, i).bitwiseAND(lowest) for i in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _around(point: Column) -> Column:
    """The grid point and those one step away in one segment, within 0 to 4."""
    steps = []
    for i in range(SEGMENTS):
        count = F.shiftrightunsigned(point, 4 * i).bitwiseAND(F.lit(15).cast("long"))
        one = F.lit(1 << (4 * i)).cast("long")
        steps += [F.when(count < 4, point + one), F.when(count > 0, point - one)]
    return F.array_compact(F.array(point, *steps))


def _cells(prints: DataFrame, radius: int) -> DataFrame:
    cells = prints.select("fp", segment_counts(F.col("fp")).alias("cell"))
    for i in range(radius):
        cells = cells.select("fp", F.explode(_around(F.col("cell"))).alias("cell"))
        if i:
            cells = cells.distinct()
    return cells


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b), a < b: every pair of different fingerprints at most max_bits apart, once."""
    left = spread(_cells(prints, (max_bits + 1) // 2).select(F.col("fp").alias("a"), "cell"))
    right = _cells(prints, max_bits // 2).select(F.col("fp").alias("b"), "cell")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    if max_bits % 2 == 0:
        return left.join(right, (left.cell == right.cell) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    both = left.join(right, (left.cell == right.cell) & (F.col("a") != F.col("b")) & near)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node reachable. Edges with a null
    end, loops and repeated edges add nothing; without edges there is no node."""
    linked = stars(edges)
    return linked.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(linked.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest doc_id reachable over links."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(distinct.select("fp"), max_bits))
    grouped = joined.withColumnRenamed("node", "fp").join(spread(distinct), "fp")
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = joined.join(spread(ids), "root").select(F.col("node").alias("fp"), "component_id")
    classes = distinct.join(spread(moved), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(spread(classes), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: One document in SAMPLE is read for common shingles; COMMON of those at most come last in every prefix.
SAMPLE, COMMON = 32, 50_000
#: Bins of the counts that bound a distance from below.
BINS = 128
#: Centres that a text is compared with before the exact join.
CENTRES = 3


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """The hashes of a text's word shingles in order, repeats included; a text without words has none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), ">u8").astype(np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The signed SimHash of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def _most_frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The tokens of counts (token, count) whose counts are so high that at most `most` tokens have them. A sort with a limit
    would send that many rows of every partition to the driver; this sends a row for each count and the tokens."""
    least, total = None, 0
    for row in sorted(counts.groupBy("count").agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["count"]):
        total += row.tokens
        if total > most:
            break
        least = row["count"]
    chosen = [] if least is None else counts.where(F.col("count") >= least).select("token").collect()
    return np.sort(np.array([r.token for r in chosen], np.int64))


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """Shingle hashes that several documents of a sample hold. Which count as common changes the cost only, no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["token"])

    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary"))
    counts = written(sample.mapInArrow(run, "token long").groupBy("token").count().where("count > 2"), "counts")
    return _most_frequent(counts, COMMON)


def _described(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(row, doc_id, key, whole, fp, n, counts, rare, common) of (doc_id, key, text), in a scratch table.

    row: a number of the row's own; whole: a digest of the shingle set; n: its size; counts: how many of its hashes lie
    in each of BINS bins; rare and common: its prefix. A set of n that is like another holds ceil(similarity n) of its
    hashes, so under any common order the first n - ceil(similarity n) + 1 hold one that both have. The order is by hash,
    common ones last.
    """
    late = _common(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in parts(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, words)
                found = np.unique(hashes)
                n, some = len(found), found.view(np.int64)
                is_late = late[np.minimum(np.searchsorted(late, some), len(late) - 1)] == some if len(late) else np.zeros(n, bool)
                rare, common = some[~is_late], some[is_late]
                size = n - int(np.ceil(similarity * n - 1e-6)) + 1 if n else 0
                counts = np.minimum(np.bincount((found % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)
                for column, value in zip(out, (xxhash.xxh3_128_digest(found.tobytes()), _majority(hashes), n, counts.tobytes(), rare[:size], common[: max(0, size - len(rare))]), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["row", "doc_id", "key", "whole", "fp", "n", "counts", "rare", "common"])

    described = rows.select("doc_id", "key", F.col("text").cast("binary").alias("text"))
    return written(described.mapInArrow(run, "row long, doc_id long, key binary, whole binary, fp long, n int, counts binary, rare array<long>, common array<long>"), "described")


def _classes(rows: DataFrame, words: int, similarity: float, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """_described(rows), and (node, root) for the rows that are like another, over any number of links."""
    table = _described(rows, words, similarity)
    same = written(table.groupBy("whole").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"), "equal")
    exact = written(table.select("row", "whole").join(small(same), "whole").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")), "same")
    texts = table.join(small(exact.select(F.col("a").alias("row"))), "row", "left_anti")

    by_print = written(texts.groupBy("fp").agg(F.min("row").alias("first")), "prints")
    equal = texts.select("row", "fp").join(spread(by_print), "fp").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    linked = links(by_print.select("fp"), max_bits)
    linked = linked.join(spread(by_print.select(F.col("fp").alias("a"), F.col("first").alias("x"))), "a").join(spread(by_print.select(F.col("fp").alias("b"), F.col("first").alias("y"))), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    shared = _shared(texts)
    first = written(equal.unionByName(linked).unionByName(_central(shared)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    classes = written(components(_verified(rows, table, first, words, similarity)), "classes")
    rest = _verified(rows, table, _crossing(shared, classes, similarity), words, similarity)
    known = classes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return table, components(exact.unionByName(known).unionByName(rest))


def _shared(texts: DataFrame) -> DataFrame:
    """(token, row, n, place, common, weight): the prefix hashes that several texts have, in a scratch table; weight: the
    texts that share the row's hashes, over all of them. Common hashes are too many rows for one task each, and few
    enough to broadcast: no window is over them."""
    rare = texts.select("row", "n", F.posexplode("rare").alias("place", "token")).withColumn("texts", F.count("*").over(Window.partitionBy("token"))).where("texts > 1")
    common = texts.select("row", "n", F.size("rare").alias("before"), F.posexplode("common").alias("at", "token"))
    sizes = common.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    common = common.join(F.broadcast(sizes), "token").withColumn("place", F.col("before") + F.col("at"))
    columns = ["token", "row", "n", "place", "texts"]
    both = rare.select(*columns, F.lit(False).alias("common")).unionByName(common.select(*columns, F.lit(True).alias("common")))
    return written(both.withColumn("weight", F.sum("texts").over(Window.partitionBy("row"))).drop("texts"), "shared")


def _per_token(shared: DataFrame, **found) -> DataFrame:
    """shared with aggregates of each token: by a window, or a broadcast join for the common ones, COMMON at most."""
    window = Window.partitionBy("token")
    rare = shared.where("not common").withColumns({name: c.over(window) for name, c in found.items()})
    sums = shared.where("common").groupBy("token").agg(*[c.alias(name) for name, c in found.items()])
    return rare.unionByName(shared.where("common").join(F.broadcast(sums), "token").select(*rare.columns))


def _central(shared: DataFrame) -> DataFrame:
    """(a, b): each text and the CENTRES heaviest texts that share most of its hashes.

    The original of a class whose copies are only like it shares most, wherever its id lies, and a class of any size
    costs some rows a member. What this leaves out is left to the exact join.
    """
    near = _per_token(shared, centre=F.max(F.struct("weight", "row", "n"))).where("row <> centre.row and least(n, centre.n) >= 0.5 * greatest(n, centre.n)")
    votes = near.groupBy(F.col("row").alias("a"), F.col("centre.row").alias("b")).count()
    order = Window.partitionBy("a").orderBy(F.desc("count"), "b")
    return votes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= CENTRES).select("a", "b")


def _crossing(shared: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of different classes that can be of the given similarity, by shared prefixes, sizes and places.

    Every pair of two classes in a bucket has a member outside the bucket's largest class, so only those are joined with
    the rest, and a large class costs one row a member.
    """
    sizes = classes.groupBy("root").agg(F.count("*").alias("members"))
    sized = classes.join(spread(sizes), "root").select(F.col("node").alias("row"), "root", "members")
    named = shared.select("token", "row", "n", "place", "common").join(spread(sized), "row", "left")
    named = named.select("token", "row", "n", "place", "common", F.coalesce("root", "row").alias("class"), F.coalesce("members", F.lit(1)).alias("members"))
    mixed = _per_token(written(named, "named"), least=F.min("class"), most=F.max("class"), largest=F.max(F.struct("members", "class"))).where("least <> most")
    mixed = written(mixed.select("token", "row", "n", "place", "class", F.col("largest.class").alias("largest")), "mixed")
    x, y = mixed.where("class <> largest").alias("x"), mixed.alias("y")
    least = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    # The first shared hash of two like sets leaves enough hashes behind it in both.
    fits = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= least
    once = (F.col("y.class") == F.col("y.largest")) | (F.col("x.row") < F.col("y.row"))
    pairs = x.join(spread(y), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") != F.col("y.class")) & once & fits)
    return written(pairs.select(F.greatest("x.row", "y.row").alias("a"), F.least("x.row", "y.row").alias("b")).distinct(), "crossing")


def _verified(rows: DataFrame, table: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are of the given similarity.

    The Manhattan distance of two texts' bin counts is never more than the number of hashes that only one of them has, so
    most pairs are told apart by BINS bytes a text; the others are compared on their texts.
    """
    apart = (1 - similarity) / (1 + similarity)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in (2, 3))
            near = np.abs(x - y).sum(axis=1) <= apart * batch.column(4).to_numpy() + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(near))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, np.zeros(0, np.uint64)
        for batch in parts(batches):
            keep = []
            for text, number, second in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if number != last:  # neighbours often share it
                    last, other = number, np.unique(shingle_hashes(second, words))
                own = np.unique(shingle_hashes(text, words))
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both >= similarity * (len(own) + len(other) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    facts = table.select("row", "n", "counts")
    both = small(pairs).join(facts.toDF("a", "n_a", "counts_a"), "a").join(spread(facts.toDF("b", "n_b", "counts_b")), "b")
    likely = written(both.select("a", "b", "counts_a", "counts_b", (F.col("n_a") + F.col("n_b")).cast("double")).mapInArrow(bounded, "a long, b long"), "likely")
    wanted = likely.select(F.col("a").alias("row")).unionByName(likely.select(F.col("b").alias("row"))).distinct()
    keys = written(small(written(wanted, "asked")).join(table.select("row", "key"), "row"), "wanted")
    texts = rows.join(small(keys.select("key").distinct()), "key", "left_semi").select("key", F.col("text").cast("binary").alias("text")).dropDuplicates(["key"])
    texts = written(texts.join(small(keys), "key").select("row", "text"), "texts")
    whole = likely.join(spread(texts.toDF("a", "text_a")), "a").join(spread(texts.toDF("b", "text_b")), "b").select("a", "b", "text_a", "text_b")
    return written(whole.mapInArrow(compared, "a long, b long"), "verified")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): key is a digest of id and text, so rows that repeat an id are told apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(id_col, text_col).alias("key"), text.alias("text"))


def _key(id_col: str, text_col: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """(doc_id, key, keeper) for every row that is a copy of another: equal, or of the given shingle similarity, over any
    number of links. The keeper is the class's smallest id, null last; of rows that repeat that id one text stays.

    A single 64-bit fingerprint a few bits apart tells only the closest copies, so candidates come from three places:
    equal shingle sets, fingerprints linked by the grid join, and shared prefixes of shingle hashes. Texts are first
    compared with the centres of their prefixes; then an exact join finds every other pair that can link two classes.
    All candidates but equal sets are verified, by a lower bound of their distance and then on their whole texts.
    """
    return _copies(*_classes(_keyed(docs, id_col, text_col), words, similarity, max_bits))


def _copies(table: DataFrame, classes: DataFrame) -> DataFrame:
    members = written(table.select("row", "doc_id", "key").join(spread(classes.withColumnRenamed("node", "row")), "row"), "members")
    keepers = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("keeper"))
    gone = members.join(small(keepers), "root").where("key <> keeper.key")
    return gone.select("doc_id", "key", F.col("keeper.doc_id").alias("keeper")).distinct()


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """The rows of docs, all columns, without copies(). Of rows that repeat id and text one stays. Null texts count as
    empty; rows without an id are copies like others. Only rows that repeat are shuffled, unless the copies are too many
    to broadcast."""
    table, classes = _classes(_keyed(docs, id_col, text_col), words, similarity, max_bits)
    gone = written(_copies(table, classes).select("key").distinct(), "gone")
    twice = written(table.groupBy("key").count().where("count > 1").select("key").join(small(gone), "key", "left_anti"), "twice")
    mark = "_key" + "_" * sum(c.startswith("_key") for c in docs.columns)
    keyed = docs.withColumn(mark, _key(id_col, text_col))
    out = keyed.join(small(gone.unionByName(twice).withColumnRenamed("key", mark)), mark, "left_anti")
    again = keyed.join(small(twice.withColumnRenamed("key", mark)), mark, "left_semi").dropDuplicates([mark])
    return out.unionByName(again).select(*docs.columns)
