"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so sketches of documents of any length can
be compared and merged: the hashes below the threshold of a union are the union of those hashes. So that short texts
can be compared too, at least `floor` of the smallest hashes are kept; a sketch knows whether it holds all of its
text's hashes, and two sketches are compared below the point up to which both are complete.

Edge cases: a null text counts as empty. A text without words has an empty sketch, like only to another empty one. A
text of fewer words than a shingle is one shingle. Rows of one doc_id are ordered by the text's hash, then the text; null
ids come last, in the same order. In a table of one row the next document is the row itself; an empty table gives an empty result. Only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import small, written

WORDS = 5
#: One hash in SCALE is kept, and the FLOOR smallest at least.
SCALE = 16
FLOOR = 32
_SPACE = 1 << 59
#: Rows in one bucket of neighbours, about.
BUCKET = 2048
#: Quantiles of the ids along which rows are dealt, a square number; more buckets than that are parts of equal width.
QUANTILES = 4096
#: Stands for a null id: the last in descending order.
NO_ID = -(1 << 63)


def hashes(text: Column, words: int = WORDS) -> Column:
    """The distinct hashes (60 bits, not negative) of a text's word shingles, ascending; letters are lower-cased."""
    parts = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    each = F.transform(parts, lambda w: F.xxhash64(w))

    def of(array: Column) -> Column:
        shingles = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(array) - words, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(array, i + k) for k in range(words)]), 4),
        )
        return F.when(F.size(array) > 0, F.array_sort(F.array_distinct(shingles))).otherwise(F.array().cast("array<bigint>"))

    # The word hashes are bound once: a one-element transform is the expression language's `let`.
    return F.transform(F.array(each), of)[0]


def sketch(found: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """struct(kept, complete) of ascending distinct hashes."""

    def of(all_: Column) -> Column:
        below = F.size(F.filter(all_, lambda h: h < 2 * _SPACE // scale))
        kept = F.slice(all_, 1, F.greatest(F.least(F.size(all_), F.lit(floor)), below))
        return F.struct(kept.alias("kept"), (F.size(all_) <= F.greatest(F.lit(floor), below)).alias("complete"))

    return F.transform(F.array(found), of)[0]


def as_text(own: Column) -> Column:
    """A sketch as one string: a letter for complete or thresholded, then 15 hex digits a hash."""
    digits = F.array_join(F.transform(own["kept"], lambda h: F.lpad(F.lower(F.hex(h)), 15, "0")), "")
    return F.concat(F.when(own["complete"], F.lit("c")).otherwise(F.lit("t")), digits)


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated containment of the smaller hash set in the larger, from hashes below the point where both are complete."""

    def end(s: Column) -> Column:
        return F.when(s["complete"], F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(2 * _SPACE // scale), F.element_at(s["kept"], -1) + 1))

    both = F.array(F.struct(a["kept"].alias("a"), b["kept"].alias("b"), F.least(end(a), end(b)).alias("end")))
    cut = F.transform(both, lambda x: F.struct(F.filter(x["a"], lambda h: h < x["end"]).alias("a"), F.filter(x["b"], lambda h: h < x["end"]).alias("b")))
    share = F.transform(cut, lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), F.size(F.array_intersect(x["a"], x["b"])) / F.least(F.size(x["a"]), F.size(x["b"]))).otherwise(F.lit(0.0)))[0]
    return F.when((F.size(a["kept"]) == 0) & (F.size(b["kept"]) == 0), F.lit(1.0)).otherwise(share)


def _buckets(rows: DataFrame) -> DataFrame:
    """rows (key, h, text) with `bucket`: ranges of (key, h descending) that hold about BUCKET rows each.

    The bounds are quantiles of the keys, so outlying keys don't widen them; they are found along a two-level directory.
    A key that repeats over several quantiles is dealt to as many buckets by its rows' hashes. Where quantiles hold more
    than BUCKET rows, the keys between two of them are cut into parts of equal width.
    """
    n = rows.count()
    side = int(QUANTILES**0.5)
    wanted = max(1, min(side * side, -(-n // BUCKET)))
    inner = max(1, -(-n // (wanted * BUCKET)))
    shares = [i / wanted for i in range(1, wanted)]
    bounds, least, most = rows.agg(F.percentile_approx("key", shares, 100_000), F.min("key"), F.max("key")).first() if shares else ([], 0, 0)
    chunks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    if not bounds:
        below = at = F.lit(0)
    else:
        heads = F.array(*[F.lit(c[0]).cast("long") for c in chunks])
        directory = F.array(*[F.array(*[F.lit(b).cast("long") for b in c]) for c in chunks])

        def count(fits) -> Column:
            """Bounds of which that is true; it is for the first ones only."""
            chunk = F.size(F.filter(heads, fits)) - 1
            return F.when(chunk < 0, 0).otherwise(side * chunk + F.size(F.filter(F.get(directory, chunk), fits)))

        below, at = count(lambda b: b < F.col("key")), count(lambda b: b <= F.col("key"))
    # From 0 on, descending in h within a key, as buckets are walked from the last to the first.
    spread = F.lit(0.5) - F.col("h") / 2.0**64
    dealt = rows.withColumn("_below", below).withColumn("_at", at)
    # Keys on a bound that repeats hold whole quantiles, up to where the keys behind that bound begin.
    parts = (F.col("_at") - F.col("_below") - 1) * inner + 1
    repeated = F.least(F.floor(spread * parts), parts - 1)
    if inner > 1:
        edges = F.array(*[F.lit(float(b)) for b in [least, *bounds, most]])
        low, high = F.get(edges, F.col("_at")), F.get(edges, F.col("_at") + 1)
        part = F.when(high > low, F.greatest(F.least(F.floor((F.col("key").cast("double") - low) / (high - low) * inner), F.lit(inner - 1)), F.lit(0))).otherwise(0)
    else:
        part = F.lit(0)
    wide = F.col("_at") - F.col("_below") > 1
    place = F.when(wide, F.col("_below") * inner + inner + repeated).otherwise(F.col("_at") * inner + part)
    return dealt.withColumn("bucket", place.cast("long")).drop("_below", "_at")


def _next_bucket(buckets: DataFrame, width: int) -> DataFrame:
    """(bucket, follower) for distinct buckets in descending order; the last is followed by the first.

    Buckets of `width` buckets keep every window small: the single-task window sees at most some thousand rows.
    """
    if buckets.count() <= 8192:
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return buckets.select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole)).alias("follower"))
    nested = buckets.withColumn("outer", F.expr(f"bucket div {width}"))
    order = Window.partitionBy("outer").orderBy(F.desc("bucket"))
    nested = nested.withColumn("follower", F.lead("bucket").over(order)).withColumn("n", F.row_number().over(order))
    heads = nested.where("n = 1").select(F.col("outer").alias("follows"), F.col("bucket").alias("head"))
    chain = _next_bucket(nested.select(F.col("outer").alias("bucket")).distinct(), width).select(F.col("bucket").alias("outer_"), F.col("follower").alias("outer_next"))
    ends = nested.where("follower is null").join(chain, F.col("outer") == F.col("outer_")).join(heads, F.col("outer_next") == F.col("follows")).select("bucket", F.col("head").alias("follower"))
    return nested.where("follower is not null").select("bucket", "follower").unionByName(ends)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, own, next_text, next_own): each row with its sketch and the next row's, in descending id order.

    Rows are dealt to buckets of neighbouring ids, and a window inside each finds the next row. Only a bucket's last row
    looks further, to the first row of the following bucket: those, one in BUCKET, are found from ids and hashes alone
    and joined in. The whole texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _buckets(rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("h"), "text"))
    # The first row of a bucket: the greatest key, then the least hash; rows that are alike in both are told apart by text.
    tops = rows.groupBy("bucket").agg(F.max(F.struct("key", F.bitwise_not("h").alias("back"))).alias("top"))
    tops = written(tops.select("bucket", F.col("top.key").alias("key"), F.bitwise_not("top.back").alias("h")), "heads")
    first = rows.join(small(tops), ["bucket", "key", "h"], "left_semi").groupBy("bucket").agg(F.min("text").alias("head_text"))
    chain = _next_bucket(tops.select("bucket"), BUCKET).select(F.col("bucket").alias("at"), F.col("follower").alias("bucket"))
    heads = chain.join(first, "bucket").select("at", "head_text", sketch(hashes(F.col("head_text"))).alias("head_own"))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "h", "text")
    rows = rows.withColumn("own", sketch(hashes(F.col("text"))))
    # Texts are never null here, so a null next text marks a bucket's last row.
    placed = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order))
    joined = placed.join(heads, (F.col("bucket") == F.col("at")) & F.col("next_text").isNull(), "left")
    return joined.select("doc_id", "text", "own", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_own", "head_own").alias("next_own"))


def edited(text: Column, following: Column) -> Column:
    """The last third (rounded down) of the text's code points replaced by the first as many, or all, of the following."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - third), F.left(following, third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    rows = with_next(docs, id_col, text_col)
    changed = rows.select("doc_id", F.length("text").alias("n_chars"), "own", "next_own", edited(F.col("text"), F.col("next_text")).alias("edited"))
    changed = changed.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", sketch(hashes(F.col("edited"))).alias("edited"))
    return changed.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
