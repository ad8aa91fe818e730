"""Ranked lexical search by sort-based accumulation.

Items are asked in blocks of a bounded number of (item, term) pairs. For a block, one reading of the documents leaves a
table of postings: of each document its length and the counts of those terms that the block asks for. The corpus counts
come from it, and then every task turns its postings into three arrays, item, document and impact, sorts them by a packed
(item, document) key with a radix sort of 16-bit digits, and adds up runs of equal keys. A document lies in one task, so
its sums are whole there and no impact is shuffled. A task keeps a heap of the best documents of each item; the heaps'
rows are dealt to ranges of (item, document), where heaps select again, so that an item's candidates from any number of
tasks never meet in one place before few are left.

All scores are whole numbers; see score() in tests/llm/test_lexsearch.py for the plain form. Counts and weights cover all
documents.

Edge cases: a null text has no terms; without any term in the documents nothing is found. Items without terms, or whose
terms occur nowhere, have no rows. Rows that share an item's id are one item with the terms of all; a null item id is an
item like others. Every row of the documents counts and is ranked, also when ids repeat; equal scores go by the id, a
null id last. Texts of any length are read whole; invalid UTF-8 is a term character. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import removed, written

#: (item, term) pairs asked in one reading of the documents.
PAIRS = 200_000
#: Triples of item, document and impact that are sorted at once.
TRIPLES = 1 << 20
#: Bytes that separate terms become spaces, A-Z lower case; every byte of a character beyond ASCII is kept.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TABLE).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): each term of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(raw))) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every row with a term: n of all its terms, the others of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, offsets, terms, counts = [], [], [0], [], []
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(raw.as_py())
                if not words:
                    continue
                known, times = np.unique(np.array([vocabulary[w] for w in words if w in vocabulary], np.int32), return_counts=True)
                ids.append(doc_id.as_py())
                lengths.append(len(words))
                offsets.append(offsets[-1] + len(known))
                terms.append(known)
                counts.append(times)
            starts = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))) for x, kind in ((terms, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of a batch of postings, and the first place of each row and the end."""
    terms, counts = batch.column("terms"), batch.column("counts")
    starts = terms.offsets.to_numpy().astype(np.int64)
    return terms.flatten().to_numpy(), counts.flatten().to_numpy(), starts - starts[0]


def corpus_counts(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the vocabulary's `size` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch)[0], minlength=size)
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "df"])

    documents, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for row in table.select("terms", "counts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    return documents, length, df


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys: one counting sort for each 16-bit digit that the largest of them has."""
    order = np.arange(len(keys))
    for shift in range(0, int(keys.max(initial=0)).bit_length(), 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class _Best:
    """A heap of the k best (score, id) of each item; of equal scores the smaller id is better, and a null id is worst."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, item, score: int, doc_id: int | None) -> None:
        heap, entry = self.heaps.setdefault(item, []), (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        rows = [(item, -number if known else None, score) for item, heap in self.heaps.items() for score, known, number in heap]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])


def accumulate(table: DataFrame, weights: np.ndarray, asking: list[np.ndarray], documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item within every task. asking: the items' numbers, by term."""
    size = np.array([len(a) for a in asking], np.int64)
    first, flat = np.cumsum(size) - size, np.concatenate(asking).astype(np.int64)
    n_items = int(flat.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = _Best(k), np.ones(n_items, np.int64)
        for batch in batches:
            term, times, starts = _flat(batch)
            ids = batch.column("doc_id").to_pylist()
            slow = np.array([20 * (50 + (50 * n * documents) // length) for n in batch.column("n").to_pylist()], np.int64)
            impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + np.repeat(slow, np.diff(starts))))
            made = np.concatenate(([0], np.cumsum(size[term])))
            at = 0
            while at < len(ids):
                # As many documents as make TRIPLES triples, and one at least: it makes no more than PAIRS.
                end = max(at + 1, int(np.searchsorted(made[starts], made[starts[at]] + TRIPLES, "right")) - 1)
                t = term[starts[at] : starts[end]]
                each = size[t]
                place = np.repeat(first[t] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                doc = np.repeat(np.repeat(np.arange(end - at), np.diff(starts[at : end + 1])), each)
                keys, impacts = flat[place] * (end - at) + doc, np.repeat(impact[starts[at] : starts[end]], each)
                if len(keys):
                    order = radix_order(keys)
                    keys, impacts = keys[order], impacts[order]
                    runs = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
                    sums, item, doc = np.add.reduceat(impacts, runs), *np.divmod(keys[runs], end - at)
                    for i in np.nonzero(sums >= floor[item])[0].tolist():
                        best.add(int(item[i]), int(sums[i]), ids[at + doc[i]])
                    for i in np.unique(item).tolist():
                        if len(heap := best.heaps.get(i, ())) == k:
                            floor[i] = heap[0][0]
                at = end
        yield best.batch(pa.int32())

    return table.mapInArrow(run, "item int, doc_id long, score long")


def select_best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows (item, doc_id, score) of every item, with rank. Ranges of (item, doc_id) select first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for item, doc_id, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best.add(item, score, doc_id)
        yield best.batch(pa.int32())

    near = rows.repartitionByRange("item", "doc_id").mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0.

    Items are dealt to blocks by a hash of their id. What the driver holds of a block are its pairs, some `pairs` of them
    unless one item alone has more, and what a task holds are the block's pairs and k rows an item.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items, item_col, item_text_col), "asked")
    blocks = max(1, -(-asked.count() // pairs))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("item_id", "term").collect()
        vocabulary: dict[bytes, int] = {}
        number: dict[object, int] = {}
        asking: list[list[int]] = []
        for row in rows:
            term = vocabulary.setdefault(bytes(row.term), len(vocabulary))
            if term == len(asking):
                asking.append([])
            asking[term].append(number.setdefault(row.item_id, len(number)))
        if not vocabulary:
            continue
        table = written(postings(docs, vocabulary, id_col, text_col), "postings")
        documents, length, df = corpus_counts(table, len(vocabulary))
        if documents:
            weights = np.array([math.floor(1000.0 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
            best = written(accumulate(table, weights, [np.array(a) for a in asking], documents, length, k), "best")
            named = spark.createDataFrame([(i, item) for item, i in number.items()], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
            part = written(select_best(best, k).join(named, "item").select("item_id", "rank", "doc_id", "score"), "found")
            found = part if found is None else found.unionByName(part)
            removed(best)
        removed(table)
    kind = asked.schema["item_id"].dataType.simpleString()
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
