"""Hunt-shaped queries over the driver's tables: each puts the engine's operators on a projection of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions import scores, text
from trailspark.operators import relations, windows
from trailspark.plans import hunt_queries

DAY_US = 86_400_000_000


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("us", scores.micros(F.col("ts")))


def beacon_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular connections: gaps between a pair's events, their variation and a score."""
    pair = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    gaps = _events(spark, sf_dir).select("user_id", "event_type", "us", ((F.col("us") - F.lag("us").over(pair)) / 1_000_000).alias("gap"))
    found = gaps.groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("connections"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("dev"), F.count("gap").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    found = found.withColumn("jitter", scores.variation(F.col("mean"), F.col("dev"), F.col("n"))).where("connections >= 4 and jitter <= 0.8")
    score = 50 + scores.truncated(25 * (1 - F.col("jitter") / 0.8)) + F.least(F.lit(15), F.floor((F.col("connections") - 4) / 2)).cast("int")
    return found.select("user_id", "event_type", "connections", F.round("mean", 1).alias("mean_interval"), F.round("jitter", 3).alias("jitter"), scores.clamped(score).alias("score"), "first_us", "last_us")


_BEACONS = """
    SELECT user_id, event_type, connections, round(mean, 1) AS mean_interval, round(jitter, 3) AS jitter,
           (50 + trunc(25 * (1 - jitter / 0.8)) + least(15, (connections - 4) // 2))::INT AS score, first_us, last_us
    FROM (
        SELECT user_id, event_type, count(*)::INT AS connections, avg(gap) AS mean, stddev_pop(gap) / avg(gap) AS jitter, min(us) AS first_us, max(us) AS last_us
        FROM (SELECT user_id, event_type, epoch_us(ts) AS us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1000000.0 AS gap FROM events)
        GROUP BY user_id, event_type
    ) WHERE connections >= 4 AND mean > 0 AND jitter <= 0.8
"""


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'error'").withColumn("source_key", F.get_json_object("props", "$.k"))


def best_window_spray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of many accounts from one source within seven days, at most three an account."""
    found = windows.best_window(_failures(spark, sf_dir), ["source_key"], "us", "event_id", "user_id", 7 * DAY_US, 4, cap=3)
    return found.select("source_key", F.col("n").alias("accounts"), F.col("size").alias("failures"), "start_us", "end_us", F.array_join("items", ",").alias("users"))


def _best_window_sql(rows: str, key: str, width_us: int, least: int, cap: int | None) -> str:
    return f"""
        WITH e AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, id) AS rn FROM e),
        p AS (SELECT a.k, a.rn, a.us AS end_us, b.us, b.item FROM r a JOIN r b ON a.k = b.k AND b.us BETWEEN a.us - {width_us} AND a.us AND b.rn <= a.rn),
        i AS (SELECT k, rn, end_us, item, count(*) AS times, min(us) AS us FROM p GROUP BY ALL),
        w AS (SELECT k, rn, end_us, count(*) AS n, sum(times) AS size, max(times) AS most, min(us) AS start_us, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM i GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, rn) AS place FROM w WHERE n >= {least} {f'AND most <= {cap}' if cap else ''})
        SELECT k AS {key}, n::INT AS n, size::INT AS size, start_us, end_us, items FROM b WHERE place = 1
    """


def first_burst_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first burst of failures, and whether a purchase follows its end within a day."""
    bursts = windows.first_burst(_failures(spark, sf_dir), ["user_id"], "us", "event_id", 2 * DAY_US, 3)
    wins = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("winner"), F.col("us").alias("won_us"))
    after = (F.col("winner") == F.col("user_id")) & F.col("won_us").between(F.col("end_us"), F.col("end_us") + DAY_US)
    won = bursts.join(wins, after, "left_semi").select("user_id", F.lit(True).alias("won"))
    return bursts.join(won, "user_id", "left").select("user_id", F.col("size").alias("failures"), "start_us", "end_us", F.coalesce("won", F.lit(False)).alias("followed_by_success"))


def fanout_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that reach many suppliers within ninety days."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", scores.micros(F.col("o_orderdate")).alias("us"))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("id"))
    reached = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = windows.best_window(reached, ["o_custkey"], "us", "id", "l_suppkey", 90 * DAY_US, 8)
    return found.select("o_custkey", F.col("n").alias("suppliers"), F.col("size").alias("lines"), "start_us", "end_us")


def enumeration_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that show many kinds of events within two days."""
    found = windows.best_window(_events(spark, sf_dir), ["user_id"], "us", "event_id", "event_type", 2 * DAY_US, 4)
    return found.select("user_id", F.col("n").alias("kinds"), F.col("size").alias("events"), "start_us", "end_us", F.array_join("items", ",").alias("items"))


def travel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user from different regions within three hours."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("country"))
    seen = _events(spark, sf_dir).withColumn("n_nationkey", (F.get_json_object("props", "$.k").cast("int") % 25)).join(places, "n_nationkey")
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    seen = seen.withColumn("prev", F.lag(F.struct("country", "us")).over(order))
    gap = F.col("us") - F.col("prev.us")
    return seen.where((F.col("prev.country") != F.col("country")) & (gap <= 3 * 3_600_000_000)).select("user_id", "event_id", F.col("prev.country").alias("from_country"), "country", F.round(gap / 3_600_000_000, 4).alias("hours_apart"))


def exfil_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's daily spending from 2001 on against its earlier days."""
    daily = _read(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    early, late = daily.where("day < '2001-01-01'"), daily.where("day >= '2001-01-01'")
    centre = early.groupBy("o_custkey").agg(F.count("*").alias("n"), F.median("total").alias("median"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("dev"))
    spread = early.join(centre.select("o_custkey", "median"), "o_custkey").groupBy("o_custkey").agg(F.median(F.abs(F.col("total") - F.col("median"))).alias("mad"))
    now = late.groupBy("o_custkey").agg(F.avg("total").alias("value"))
    joined = now.join(centre, "o_custkey").join(spread, "o_custkey")
    z = scores.robust_z(*[F.col(c) for c in ("value", "n", "median", "mad", "mean", "dev")])
    return joined.select("o_custkey", "n", F.round("median", 0).alias("median"), F.round("mad", 0).alias("mad"), F.round(z, 3).alias("zscore"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    hosts = _read(spark, sf_dir, "pages").select(host.alias("host")).where("host <> ''")
    return hosts.withColumn("registered", text.registered_domain(F.col("host")))


def dns_subdomain_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subdomains of a registered domain, their mean entropy and length."""
    subs = _hosts(spark, sf_dir).select("registered", text.subdomain(F.col("host"), F.col("registered")).alias("sub")).where("sub <> ''").distinct()
    plain = subs.withColumn("plain", F.replace("sub", F.lit("."), F.lit("")))
    return plain.groupBy("registered").agg(F.count("*").alias("subdomains"), F.round(F.avg(text.entropy(F.col("plain"))), 6).alias("mean_entropy"), F.round(F.avg(F.length("plain")), 4).alias("mean_length"))


def dga_label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct first labels by registered domain, their mean entropy, and the first five in order."""
    labels = _hosts(spark, sf_dir).select("registered", F.substring_index("host", ".", 1).alias("label")).distinct()
    return labels.groupBy("registered").agg(F.count("*").alias("labels"), F.round(F.avg(text.entropy(F.col("label"))), 6).alias("mean_entropy"), F.array_join(F.slice(F.array_sort(F.collect_set("label")), 1, 5), ",").alias("first_labels"))


#: (rule, table, pattern) of rule_matches.
RULES = (("token_assignment", "documents", r"token\s*="), ("licence", "documents", r"(licensed under|copyright|all rights reserved)"), ("tracker", "pages", r"track\("))


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pattern rules match; a row may match several."""
    found = []
    for table, column in (("documents", "text"), ("pages", "html")):
        hits = F.array_compact(F.array(*[F.when(F.lower(column).rlike(p), F.lit(rule)) for rule, where, p in RULES if where == table]))
        found.append(_read(spark, sf_dir, table).select(F.explode(hits).alias("rule")))
    return found[0].unionByName(found[1]).groupBy("rule").agg(F.count("*").alias("matches"))


def rare_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of few brands, with the first well-known name within two edits."""
    parts = _read(spark, sf_dir, "part")
    by_name = parts.groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands"), F.count("*").alias("parts"))
    common = [r.p_name for r in by_name.orderBy(F.desc("parts"), "p_name").limit(10).collect()]
    near = F.coalesce(*[F.when((F.col("p_name") != n) & F.levenshtein("p_name", F.lit(n), 2).between(0, 2), F.lit(n)) for n in common], F.lit(""))
    return by_name.where("brands <= 20").select("p_name", "brands", "parts", near.alias("lookalike_of"))


def new_destination_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier pairs of 2001 on that never met before."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pairs = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    early = pairs.where("o_orderdate < '2001-01-01'").select("o_custkey", "l_suppkey")
    return pairs.where("o_orderdate >= '2001-01-01'").select("o_custkey", "l_suppkey").distinct().join(early, ["o_custkey", "l_suppkey"], "left_anti")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping slices of the events, one row an id, the first slice's."""
    events = _read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    slices = events.where("event_id % 3 = 0").withColumn("seq", F.lit(0)).unionByName(events.where("event_id % 2 = 0").withColumn("seq", F.lit(1)))
    return relations.first_by(slices, "event_id", ["seq"])


def _beacon_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beacon_regularity(spark, sf_dir)
    return found.select(F.concat_ws(":", F.lit("beacon"), "user_id", "event_type").alias("id"), F.lit("beaconing").alias("hunt"), "score", "first_us", "last_us", F.array(F.concat(F.lit("user:"), F.col("user_id"))).alias("entities"), "user_id", "event_type")


def suppress_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no reviewed suppression covers."""
    rules = spark.createDataFrame([("beaconing", "user:1"), ("*", "user:2"), ("dga", "user:3")], "hunt string, entity string")
    return relations.unsuppressed(_beacon_findings(spark, sf_dir), rules).select("user_id", "event_type", "score")


def lead_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two hunts grouped into leads over shared users, and each lead's size and score."""
    bursts = enumeration_burst(spark, sf_dir).select(F.concat(F.lit("enum:"), F.col("user_id")).alias("id"), F.lit(60).alias("score"), F.col("start_us").alias("first_us"), F.col("end_us").alias("last_us"), F.array(F.concat(F.lit("user:"), F.col("user_id"))).alias("entities"))
    findings = _beacon_findings(spark, sf_dir).select("id", "score", "first_us", "last_us", "entities").unionByName(bursts)
    links = relations.consecutive_links(findings, 2 * DAY_US)
    leads = relations.components(findings, links).join(findings, "id")
    return leads.groupBy("component").agg(F.count("*").alias("findings"), F.max("score").alias("score"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beacon_regularity(spark, sf_dir)
    return found.groupBy(scores.severity(F.col("score")).alias("severity")).agg(F.count("*").alias("findings"))


def off_hours_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = scores.off_hours(F.hour("ts"))
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(F.when(off, 1.0).otherwise(0.0)), 6).alias("off_hours_share"), F.count("*").alias("events"))


def evidence_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of each user and kind."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    first = _read(spark, sf_dir, "events").withColumn("n", F.row_number().over(order)).where("n <= 3")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"])
    return first.groupBy("user_id", "event_type").agg(F.array_join(ids, ",").alias("event_ids"))


_HOSTS = r"(SELECT h AS host, CASE WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','net.au','co.jp','co.nz','com.br','co.in','co.za','com.cn','com.mx') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS registered FROM (SELECT h, string_split(rtrim(h, '.'), '.') AS l FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM pages) WHERE h <> ''))"
_ENTROPY = "(SELECT t, -sum(c / n * log2(c / n)) AS bits FROM (SELECT t, ch, count(*)::DOUBLE AS c, any_value(length(t))::DOUBLE AS n FROM (SELECT t, unnest(string_split(t, '')) AS ch FROM (SELECT DISTINCT {t} AS t FROM {rows})) GROUP BY t, ch) GROUP BY t)"
_SUBS = f"(SELECT DISTINCT registered, rtrim(substr(host, 1, length(host) - length(registered)), '.') AS sub FROM {_HOSTS} WHERE host <> registered)"
_ENUM = _best_window_sql("SELECT user_id AS k, epoch_us(ts) AS us, event_id AS id, event_type AS item FROM events", "user_id", 2 * DAY_US, 4, None)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = hunt_queries.QUERIES | {
    f.__name__: f
    for f in (
        beacon_regularity, best_window_spray, first_burst_bruteforce, fanout_best_window, enumeration_burst, travel_pairs, exfil_robust_z,
        dns_subdomain_entropy, dga_label_entropy, rule_matches, rare_stack, new_destination_anti, dedup_first,
        suppress_anti, lead_components, severity_rollup, off_hours_share, evidence_top_k,
    )
}

ORACLE_SQL: dict[str, str] = hunt_queries.ORACLE_SQL | {
    "beacon_regularity": _BEACONS,
    "best_window_spray": "SELECT source_key, n AS accounts, size AS failures, start_us, end_us, items AS users FROM (" + _best_window_sql("SELECT json_extract_string(props, '$.k') AS k, epoch_us(ts) AS us, event_id AS id, user_id AS item FROM events WHERE event_type = 'error'", "source_key", 7 * DAY_US, 4, 3) + ")",
    "first_burst_bruteforce": f"""
        WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
        p AS (SELECT a.user_id, a.rn, a.us AS start_us, count(*) AS failures, max(b.us) AS end_us FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn >= a.rn AND b.us <= a.us + {2 * DAY_US} GROUP BY ALL HAVING count(*) >= 3),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn) = 1)
        SELECT user_id, failures::INT AS failures, start_us, end_us, EXISTS (SELECT 1 FROM events w WHERE w.event_type = 'purchase' AND w.user_id = f.user_id AND epoch_us(w.ts) BETWEEN f.end_us AND f.end_us + {DAY_US}) AS followed_by_success FROM f
    """,
    "fanout_best_window": "SELECT o_custkey, n AS suppliers, size AS lines, start_us, end_us FROM (" + _best_window_sql("SELECT o_custkey AS k, epoch_us(o_orderdate) AS us, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS id, l_suppkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "o_custkey", 90 * DAY_US, 8, None) + ")",
    "enumeration_burst": f"SELECT user_id, n AS kinds, size AS events, start_us, end_us, items FROM ({_ENUM})",
    "travel_pairs": """
        WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, r_name AS country FROM events JOIN nation ON n_nationkey = json_extract_string(props, '$.k')::INT % 25 JOIN region ON n_regionkey = r_regionkey),
        p AS (SELECT *, lag(country) OVER w AS from_country, us - lag(us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
        SELECT user_id, event_id, from_country, country, round(gap / 3600000000, 4) AS hours_apart FROM p WHERE from_country <> country AND gap <= 10800000000
    """,
    "exfil_robust_z": """
        WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
        c AS (SELECT o_custkey, count(*) AS n, median(total) AS median, avg(total) AS mean, stddev_pop(total) AS dev FROM d WHERE day < DATE '2001-01-01' GROUP BY 1),
        m AS (SELECT d.o_custkey, median(abs(total - median)) AS mad FROM d JOIN c USING (o_custkey) WHERE day < DATE '2001-01-01' GROUP BY 1),
        l AS (SELECT o_custkey, avg(total) AS value FROM d WHERE day >= DATE '2001-01-01' GROUP BY 1)
        SELECT o_custkey, n, round(median, 0) AS median, round(mad, 0) AS mad,
               round(CASE WHEN n < 3 THEN 0.0 WHEN mad > 0 THEN 0.6745 * (value - median) / mad WHEN dev > 0 THEN (value - mean) / dev ELSE 0.0 END, 3) AS zscore
        FROM l JOIN c USING (o_custkey) JOIN m USING (o_custkey)
    """,
    "dns_subdomain_entropy": f"""
        SELECT registered, count(*) AS subdomains, round(avg(bits), 6) AS mean_entropy, round(avg(length(plain)), 4) AS mean_length
        FROM (SELECT registered, replace(sub, '.', '') AS plain FROM {_SUBS} WHERE sub <> '') JOIN {_ENTROPY.format(t="replace(sub, '.', '')", rows=_SUBS)} ON plain = t GROUP BY registered
    """,
    "dga_label_entropy": f"""
        WITH l AS (SELECT DISTINCT registered, string_split(host, '.')[1] AS label FROM {_HOSTS})
        SELECT registered, count(*) AS labels, round(avg(bits), 6) AS mean_entropy, array_to_string(list_sort(list(label))[:5], ',') AS first_labels FROM l JOIN {_ENTROPY.format(t="label", rows="l")} ON label = t GROUP BY registered
    """,
    "rule_matches": " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS matches FROM {table} WHERE regexp_matches(lower({'text' if table == 'documents' else 'html'}), '{p}') HAVING count(*) > 0" for rule, table, p in RULES),
    "rare_stack": """
        WITH b AS (SELECT p_name, count(DISTINCT p_brand) AS brands, count(*) AS parts FROM part GROUP BY 1),
        c AS (SELECT p_name AS common, row_number() OVER (ORDER BY parts DESC, p_name) AS place FROM b QUALIFY place <= 10)
        SELECT p_name, brands, parts, coalesce((SELECT arg_min(common, place) FROM c WHERE common <> p_name AND levenshtein(common, p_name) <= 2), '') AS lookalike_of FROM b WHERE brands <= 20
    """,
    "new_destination_anti": """
        WITH p AS (SELECT o_custkey, l_suppkey, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT o_custkey, l_suppkey FROM p GROUP BY ALL HAVING min(d) >= TIMESTAMP '2001-01-01'
    """,
    "dedup_first": "SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS seq FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0",
    "suppress_anti": f"SELECT user_id, event_type, score FROM ({_BEACONS}) WHERE user_id NOT IN (1, 2)",
    "lead_components": f"""
        WITH RECURSIVE f AS (
            SELECT 'beacon:' || user_id || ':' || event_type AS id, score, first_us, last_us, user_id FROM ({_BEACONS})
            UNION ALL SELECT 'enum:' || user_id, 60, start_us, end_us, user_id FROM ({_ENUM})
        ), l AS (SELECT id, first_us, lag(id) OVER w AS pid, lag(last_us) OVER w AS plast FROM f WINDOW w AS (PARTITION BY user_id ORDER BY first_us, id)),
        e AS (SELECT id AS a, pid AS b FROM l WHERE first_us - plast <= {2 * DAY_US}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT id, id AS other FROM f UNION SELECT r.id, u.b FROM r JOIN u ON r.other = u.a), c AS (SELECT id, min(other) AS component FROM r GROUP BY id)
        SELECT component, count(*) AS findings, max(score) AS score, min(first_us) AS first_us, max(last_us) AS last_us FROM c JOIN f USING (id) GROUP BY component
    """,
    "severity_rollup": f"SELECT CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS severity, count(*) AS findings FROM ({_BEACONS}) GROUP BY 1",
    "off_hours_share": "SELECT user_id, round(avg(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 1.0 ELSE 0.0 END), 6) AS off_hours_share, count(*) AS events FROM events GROUP BY 1",
    "evidence_top_k": "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY n) AS event_ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3 GROUP BY 1, 2",
}
