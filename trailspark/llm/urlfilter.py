"""URL filtering with host and path rules, and association rules mined from what those rules decide.

Every url is cut into tokens. Urls that a rule decides are the labelled transactions; FP-growth mines token
combinations with their verdicts, rules short of the support or confidence are pruned, and so is a rule that a more
general one of the same verdict makes superfluous. A url that no rule decides takes the verdict of its strongest
association rule, found through an index from each rule's rarest token to the rule; without a match it is allowed.

Tokens that stand in exactly the same labelled urls are one item to FP-growth, which would otherwise mine every subset of
them, and a rule over that item wants them all.

Edge cases: a null url, or one without `://`, has empty host and path, no rule and no token, and is allowed. Rows that
repeat, and null page ids, each keep their row. Of rules as long, the name that sorts last wins (the fixed ones have no
such tie); of association rules, the one of most confidence, then support, then tokens, then the name that sorts last. A
url of any length is read whole. An empty table, or one where no rule decides a url, mines nothing and allows the rest.
Only the id and url columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    # What follows the first `://`, up to a query or fragment.
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name (host and path) and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    # The last `when` built stands outermost, so longer rules come later.
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens: host labels, the words and numbers of the path and of what follows it (`rest`), letters of any
    script, percent escapes kept; and a number's first digit besides, since rules end inside numbers. Sorted, so equal
    sets are equal."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.when(x != "", F.concat(F.lit("h:"), x)))

    def words(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"((?:[\p{L}\p{M}]|%[0-9a-f]{2})+|[0-9]+)"))
        return F.transform(found, lambda x: F.concat(F.lit(kind), x))

    first = F.transform(F.regexp_extract_all(path, F.lit(r"(?<![0-9])([0-9])")), lambda x: F.concat(F.lit("n:"), x))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(labels, words(path, "p:"), first, words(rest, "q:")))))


def _items(urls: DataFrame, min_support: float) -> DataFrame:
    """(token, item): for tokens of enough urls, the token that stands for all with exactly the same urls."""
    rows = urls.select("tokens", F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    least = F.lit(max(1.0, min_support * urls.count()))
    # Equal counts and equal sums of two hashes a row: equal sets of rows.
    marks = rows.select(F.explode("tokens").alias("token"), "row").groupBy("token").agg(F.count("*").alias("freq"), F.sum(F.col("row").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    marks = marks.where(F.col("freq") >= least - 1e-6)
    return marks.withColumn("item", F.min("token").over(Window.partitionBy("freq", "s", "t"))).select("token", "item", "freq")


def mine(urls: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """(rule_id, tokens, anchor, verdict, confidence, support) from (tokens, verdict) rows with a verdict.

    The support bounds the number of frequent tokens, whatever the number of urls: there are at most a url's mean number
    of tokens, divided by the support.
    """
    urls = written(urls, "labelled")
    items = written(_items(urls, min_support), "items")
    standing = [r.item for r in items.select("item").distinct().collect()]
    baskets = urls.select(F.concat(F.array_intersect("tokens", F.lit(standing).cast("array<string>")), F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & F.startswith(F.col("consequent")[0], F.lit(VERDICT)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(VERDICT))))
    rules = found.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], len(VERDICT) + 1, 99).alias("verdict"), "confidence", "support")
    rules = written(rules.withColumn("rule_id", F.concat_ws(" ", "items", "verdict")), "rules")
    # A rule goes if a shorter one among its items says the same at least as confidently.
    parts = rules.select("rule_id", "verdict", F.size("items").alias("n"), "confidence", F.explode("items").alias("item"))
    short, long = parts.alias("s"), parts.alias("l")
    pairs = short.join(long, (F.col("s.item") == F.col("l.item")) & (F.col("s.verdict") == F.col("l.verdict")) & (F.col("s.n") < F.col("l.n")) & (F.col("s.confidence") >= F.col("l.confidence")))
    covered = pairs.groupBy(F.col("s.rule_id").alias("by"), F.col("l.rule_id").alias("rule_id"), F.col("s.n").alias("n")).count().where("count = n").select("rule_id").distinct()
    kept = rules.join(covered, "rule_id", "left_anti").select("rule_id", "verdict", "confidence", "support", F.explode("items").alias("item"))
    whole = kept.join(items, "item").groupBy("rule_id", "verdict", "confidence", "support")
    return whole.agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.min_by("token", F.struct("freq", "token")).alias("anchor"))


#: Token sets with a verdict that are broadcast at most.
BROADCAST_SETS = 50_000


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched, confidence) for every row; matched: the association rule's tokens."""
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^?#]*(.*)$", 1)
    split = split.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))
    mined = written(mine(ruled.where("ruled is not null").select("tokens", F.col("ruled").alias("verdict")), min_support, min_confidence), "mined")
    # An open url needs no more of its tokens than rules know of, and those are few: so are the sets that they form.
    known = [r.token for r in mined.select(F.explode("tokens").alias("token")).distinct().collect()]
    open_rows = ruled.where("rule is null").withColumn("key", F.array_intersect("tokens", F.lit(known).cast("array<string>")))
    index = mined.select("anchor", F.col("tokens").alias("wanted"), "verdict", "confidence", "support")
    hits = open_rows.select("key").distinct().select("key", F.explode("key").alias("anchor")).join(index, "anchor").where(F.size(F.array_except("wanted", "key")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("wanted").alias("n"), F.array_join("wanted", " ").alias("matched"), "verdict"))
    decided = written(hits.groupBy("key").agg(best.alias("best")), "decided")
    judged = open_rows.join(small(decided, BROADCAST_SETS), "key", "left").select("page_id", "host", "path", "rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.col("best.matched").alias("matched"), F.col("best.confidence").alias("confidence"))
    settled = ruled.where("rule is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("string").alias("matched"), F.lit(None).cast("double").alias("confidence"))
    return settled.unionByName(judged)
