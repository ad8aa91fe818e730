"""Hunts as Spark SQL that finds what the DataFrame plans find.

A statement reads views that register() makes of a context: hunt_window (events), hunt_flows, hunt_origins, hunt_reached,
hunt_programs and hunt_callers (the baseline's days), hunt_addresses (facts of addresses) and hunt_listed (what, value: the
configuration's lists). Thresholds stand in the text; lists don't, so a statement is as long for any feed.

It returns id, hunt, title, score, severity, tactic, hosts, users, ips, domains, first_seen, last_seen and ioc_match of each
finding. Best windows and bursts deal a key's events to blocks of time, like operators/windows.py; the event before is a plain
lag, so a busy key is sorted in one task there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.sql import entropy, literal, registered_domain
from trailspark.hunts.cloud import DISCOVERY_PREFIXES, EVASION_APIS, PRIVILEGE_APIS
from trailspark.hunts.context import IOC_BONUS, Context
from trailspark.hunts.endpoint import EXECUTION_RULES, PERSISTENCE_RULES, SYSTEM_NAMES, WRITABLE_PATHS, ProcessRule
from trailspark.hunts.identity import HOUR_US, MINUTE_US, NETWORK_LOGONS
from trailspark.schema import HuntConfig, Thresholds

#: Named subqueries in order, and the selects whose rows are findings.
Parts = tuple[dict[str, str], list[str]]

COLUMNS = ("id", "hunt", "title", "score", "severity", "tactic", "hosts", "users", "ips", "domains", "first_seen", "last_seen", "ioc_match")


def register(ctx: Context, prefix: str = "hunt") -> None:
    """The views that statements of the same prefix read."""
    spark = ctx.window.sparkSession
    views = {"window": ctx.window, "addresses": ctx.addresses, "listed": _listed(spark, ctx.config)}
    views |= {name: ctx.baseline[name] for name in ("flows", "origins", "reached", "programs", "callers")}
    for name, rows in views.items():
        rows.createOrReplaceTempView(f"{prefix}_{name}")


def _listed(spark: SparkSession, config: HuntConfig) -> DataFrame:
    lists = {
        "known": [f"ip:{v}" for v in config.ioc_ips] + [f"domain:{v}" for v in config.ioc_domains], "hash": config.ioc_hashes, "allowed": config.allow_domains,
        "scanner": config.scanner_ips, "noisy": config.noisy_users, "trusted": config.trusted_processes,
    }
    return spark.createDataFrame([(what, v) for what, values in lists.items() for v in values], "what string, value string").distinct()


def _some(values: Sequence[str]) -> str:
    return "(" + ", ".join(map(literal, values)) + ")"


def _unlisted(column: str, what: str) -> str:
    """Of rows with the alias e; without it, `user` in a subquery is the session's user."""
    return f"NOT EXISTS (SELECT 1 FROM hunt_listed l WHERE l.what = '{what}' AND l.value = e.{column})"


def _names(*arrays: str) -> str:
    return f"array_sort(filter(array_distinct(concat({', '.join(arrays)})), x -> x <> ''))" if arrays else "CAST(array() AS ARRAY<STRING>)"


def _row(source: str, title: str, base: str, tactic: str, hosts: str = "", users: str = "", ips: str = "", domains: str = "") -> str:
    """A select of findings; source: rows with first_seen, last_seen and known."""
    lists = ", ".join(f"{_names(*([given] if given else []))} AS {name}" for name, given in (("hosts", hosts), ("users", users), ("ips", ips), ("domains", domains)))
    return f"SELECT {title} AS title, CAST({base} AS INT) AS base, {tactic} AS tactic, {lists}, first_seen, last_seen, known FROM {source}"


_SEEN = "min(time) AS first_seen, max(time) AS last_seen, bool_or(known) AS known"
_W = "(SELECT *, unix_micros(time) AS us FROM events)"
_OUTBOUND = f"SELECT w.* FROM {_W} w JOIN hunt_addresses a ON w.dst_ip = a.ip WHERE w.kind = 'flow' AND w.dst_ip <> '' AND NOT a.internal AND NOT a.allowed"
_KNOWN_FLOWS = "SELECT f.host, f.dst_ip, f.day, f.volume FROM hunt_flows f JOIN hunt_addresses a ON f.dst_ip = a.ip WHERE NOT a.internal"
_DESTINATIONS = "SELECT DISTINCT host, dst_ip FROM known_flows"
_SIGN_INS = "(kind = 'auth' OR (kind = 'cloud' AND api = 'ConsoleLogin'))"
_BACK = "'\\\\'"
_IMAGE = f"lower(substring_index(translate({{}}, {_BACK}, '/'), '/', -1))"


def _best_window(keys: str, width: int, least: int, cap: int | None = None) -> dict[str, str]:
    """chosen: the events of each key's best window, of rows `raw` (keys, item, us, id, ...)."""
    same = f"(PARTITION BY {keys}, block, item ORDER BY us, tie)"
    early = f"lag(us, {cap}) OVER {same}" if cap else "CAST(NULL AS BIGINT)"
    change = "named_struct('at', {}, 'anchor', {}, 'items', {}, 'excess', {})"
    later = f"CAST({width + 1} AS BIGINT)"
    changes = ", ".join((
        change.format("us", 1, "int(enters)", "int(excess)"),
        f"CASE WHEN leaves THEN {change.format(f'us + {later}', 0, -1, 0)} END",
        f"CASE WHEN excess THEN {change.format(f'early + {later}', 0, 0, -1)} END",
    ))
    return {
        "busy": f"SELECT {keys} FROM raw GROUP BY {keys} HAVING count(DISTINCT item) >= {least}",
        "dealt": f"SELECT *, us - pmod(us, {width}) AS own, explode(array(us - pmod(us, {width}), us - pmod(us, {width}) + {width})) AS block FROM (SELECT r.* FROM raw r LEFT SEMI JOIN busy USING ({keys}))",
        "tied": f"SELECT *, row_number() OVER (PARTITION BY {keys}, block, us ORDER BY id, item) AS tie FROM dealt",
        "turns": f"SELECT *, coalesce(us - early <= {width}, false) AS excess FROM (SELECT *, coalesce(us - lag(us) OVER {same} > {width}, true) AS enters, coalesce(lead(us) OVER {same} - us > {width}, true) AS leaves, {early} AS early FROM tied)",
        "changes": f"SELECT {keys}, block, own, us, tie, inline(array_compact(array({changes}))) FROM turns",
        "counted": f"SELECT *, sum(items) OVER so_far AS n, sum(excess) OVER so_far AS beyond FROM changes WINDOW so_far AS (PARTITION BY {keys}, block ORDER BY at, anchor, tie ROWS UNBOUNDED PRECEDING)",
        "best": f"SELECT {keys}, min(struct(-n, us, tie)) AS best FROM (SELECT {keys}, n, us, tie FROM counted WHERE own = block AND anchor = 1 AND n >= {least} AND beyond = 0) GROUP BY {keys}",
        "chosen": f"SELECT t.* FROM (SELECT * FROM tied WHERE own = block) t JOIN best USING ({keys}) WHERE t.us BETWEEN best.us - {width} AND best.us AND (t.us < best.us OR t.tie <= best.tie)",
    }


def _beaconing(t: Thresholds) -> Parts:
    keys = "host, dst_ip, dst_port"
    ctes = {
        "flows": _OUTBOUND,
        "known_flows": _KNOWN_FLOWS,
        "gaps": f"SELECT *, (us - lag(us) OVER (PARTITION BY {keys} ORDER BY us, id)) / 1000000 AS gap FROM flows",
        "timed": f"SELECT {keys}, count(*) AS n, avg(gap) AS mean, CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE double('infinity') END AS jitter, {_SEEN} FROM gaps GROUP BY {keys}",
        "regular": f"SELECT t.*, d.host IS NULL AS new FROM timed t LEFT JOIN ({_DESTINATIONS}) d ON t.host = d.host AND t.dst_ip = d.dst_ip WHERE n >= {t.beacon_min_connections} AND mean >= {t.beacon_min_interval_seconds} AND jitter <= {t.beacon_max_jitter}D",
    }
    base = f"50 + int(25 * (1 - jitter / {t.beacon_max_jitter}D)) + least(15, floor((n - {t.beacon_min_connections}) / 2)) + if(new, 10, 0)"
    title = "concat('Regular connections from ', host, ' to ', dst_ip, ':', coalesce(string(dst_port), 'None'))"
    return ctes, [_row("regular", title, base, "'Command and Control'", hosts="array(host)", ips="array(dst_ip)")]


def _lookups(where: str) -> dict[str, str]:
    """lookups: DNS events with their registered domain, without allowed domains and what lies below them."""
    above = "transform(sequence(1, size(split(domain, '[.]'))), i -> array_join(slice(split(domain, '[.]'), i, size(split(domain, '[.]'))), '.'))"
    return {
        "asked": f"SELECT * FROM events WHERE kind = 'dns' AND domain <> '' AND {where}",
        "allowed": f"SELECT DISTINCT domain FROM (SELECT domain, explode({above}) AS value FROM (SELECT DISTINCT domain FROM asked)) LEFT SEMI JOIN (SELECT value FROM hunt_listed WHERE what = 'allowed') USING (value)",
        "lookups": f"SELECT *, {registered_domain('domain')} AS zone FROM asked LEFT ANTI JOIN allowed USING (domain)",
    }


def _dns_tunnel(t: Thresholds) -> Parts:
    ctes = _lookups("true") | {
        "names": "SELECT *, rtrim('.', substr(domain, 1, length(domain) - length(zone))) AS sub FROM lookups WHERE domain <> zone",
        "subs": f"SELECT host, zone, count(*) AS n, avg({entropy('plain')}) AS bits, avg(length(plain)) AS width FROM (SELECT DISTINCT host, zone, sub, replace(sub, '.', '') AS plain FROM names) GROUP BY host, zone",
        "used": f"SELECT host, zone, avg(if(query_type IN ('TXT', 'NULL', 'CNAME'), 1D, 0D)) AS share, {_SEEN} FROM names GROUP BY host, zone",
        "tunnels": f"SELECT * FROM used JOIN subs USING (host, zone) WHERE n >= {t.dns_min_subdomains} AND bits >= {t.dns_min_entropy}D AND width >= {t.dns_min_label_length}",
    }
    base = f"55 + least(20, floor((n - {t.dns_min_subdomains}) / 5)) + int(10 * least(1D, bits - {t.dns_min_entropy}D)) + if(share >= 0.5, 10, 0)"
    return ctes, [_row("tunnels", "concat('Possible DNS tunnel from ', host, ' via ', zone)", base, "'Command and Control'", hosts="array(host)", domains="array(zone)")]


def _dga(t: Thresholds) -> Parts:
    ctes = _lookups("outcome = 'failure'") | {
        "zones": f"SELECT host, count(*) AS n, avg({entropy('label')}) AS bits, slice(array_sort(collect_set(zone)), 1, 5) AS first FROM (SELECT DISTINCT host, zone, substring_index(zone, '.', 1) AS label FROM lookups) GROUP BY host",
        "random": f"SELECT * FROM zones JOIN (SELECT host, {_SEEN} FROM lookups GROUP BY host) USING (host) WHERE n >= {t.dga_min_nxdomain} AND bits >= {t.dns_min_entropy - 0.4!r}D",
    }
    base = f"50 + least(25, floor((n - {t.dga_min_nxdomain}) / 3)) + int(10 * least(1D, greatest(0D, bits - 3)))"
    return ctes, [_row("random", "concat(host, ' looked up ', n, ' random-looking domains that do not exist')", base, "'Command and Control'", hosts="array(host)", domains="first")]


def _exfiltration(t: Thresholds) -> Parts:
    off = "hour(time) >= {0} {2} hour(time) < {1}".format(t.off_hours_start, t.off_hours_end, "OR" if t.off_hours_start > t.off_hours_end else "AND")
    raw = "CASE WHEN days_seen IS NULL OR days_seen < 3 THEN 0D WHEN mad > 0 THEN 0.6745D * (per_day - median) / mad WHEN dev > 0 THEN (per_day - mean) / dev ELSE 0D END"
    ctes = {
        "flows": f"SELECT * FROM ({_OUTBOUND}) WHERE bytes_out > 0",
        "known_flows": _KNOWN_FLOWS,
        "daily": "SELECT host, day, double(sum(volume)) AS total FROM known_flows GROUP BY host, day",
        "centre": "SELECT host, count(*) AS days_seen, median(total) AS median, avg(total) AS mean, stddev_pop(total) AS dev FROM daily GROUP BY host",
        "spread": "SELECT d.host, median(abs(total - median)) AS mad FROM daily d JOIN centre c ON d.host = c.host GROUP BY d.host",
        "sent": f"SELECT host, sum(bytes_out) / (SELECT greatest(1D, (max(us) - min(us)) / 86400000000) FROM {_W}) AS per_day FROM flows GROUP BY host",
        "usual": f"SELECT *, {raw} AS raw FROM sent LEFT JOIN centre USING (host) LEFT JOIN spread USING (host)",
        "hosts": f"SELECT host, CASE WHEN days_seen IS NOT NULL AND per_day < 2 * median THEN least(raw, {t.exfil_min_zscore - 0.01!r}D) ELSE raw END AS z FROM usual",
        "volumes": f"SELECT host, dst_ip, sum(bytes_out) AS volume, avg(if({off}, 1D, 0D)) AS off, {_SEEN} FROM flows GROUP BY host, dst_ip HAVING sum(bytes_out) >= {t.exfil_min_bytes}",
        "moved": f"SELECT * FROM (SELECT v.*, z, d.host IS NULL AS new FROM volumes v JOIN hosts h ON v.host = h.host LEFT JOIN ({_DESTINATIONS}) d ON v.host = d.host AND v.dst_ip = d.dst_ip) WHERE new OR z >= {t.exfil_min_zscore}D",
    }
    base = f"50 + if(new, 15, 0) + if(z >= {t.exfil_min_zscore}D, 15, 0) + if(off >= 0.5, 10, 0) + least(10, int(10 * log10(volume / {t.exfil_min_bytes} + 1)))"
    return ctes, [_row("moved", "concat(host, ' sent ', format_string('%.0f', volume / 1000000), ' MB to ', dst_ip)", base, "'Exfiltration'", hosts="array(host)", ips="array(dst_ip)")]


def _spray(t: Thresholds) -> Parts:
    ctes = {
        "attempts": f"SELECT * FROM {_W} e WHERE {_SIGN_INS} AND src_ip <> '' AND {_unlisted('src_ip', 'scanner')}",
        "raw": "SELECT src_ip, user AS item, us, id, time, known FROM attempts WHERE outcome = 'failure'",
        **_best_window("src_ip", t.spray_window_minutes * MINUTE_US, t.spray_min_users, t.spray_max_attempts_per_user),
        "failed": "SELECT src_ip, array_sort(collect_set(item)) AS items, min(us) AS start_us FROM chosen GROUP BY src_ip",
        "won": "SELECT f.src_ip, a.user, a.time, a.known FROM failed f JOIN attempts a ON f.src_ip = a.src_ip AND a.us >= f.start_us AND array_contains(f.items, a.user) WHERE a.outcome <> 'failure'",
        "both": f"SELECT src_ip, collect_set(winner) AS winners, {_SEEN} FROM (SELECT src_ip, CAST(NULL AS STRING) AS winner, time, known FROM chosen UNION ALL SELECT * FROM won) GROUP BY src_ip",
        "sprays": "SELECT *, size(items) AS n FROM both JOIN failed USING (src_ip)",
    }
    title = "concat('Password spray from ', src_ip, ' against ', n, ' accounts', if(size(winners) > 0, ' with a successful sign-in', ''))"
    base = f"55 + least(15, 2 * (n - {t.spray_min_users})) + if(size(winners) > 0, 25, 0)"
    return ctes, [_row("sprays", title, base, "'Credential Access'", users="items, winners", ips="array(src_ip)")]


def _brute_force(t: Thresholds) -> Parts:
    width = 10 * MINUTE_US
    ctes = {
        "attempts": f"SELECT * FROM {_W} e WHERE {_SIGN_INS} AND user <> '' AND {_unlisted('user', 'noisy')} AND {_unlisted('src_ip', 'scanner')}",
        "failures": "SELECT * FROM attempts WHERE outcome = 'failure'",
        "dealt": f"SELECT user, us, id, us - pmod(us, {width}) AS own, explode(array(us - pmod(us, {width}), us - pmod(us, {width}) - {width})) AS block FROM failures",
        "ahead": f"SELECT *, lead(us, {t.bruteforce_min_failures - 1}) OVER (PARTITION BY user, block ORDER BY us, id) AS reach FROM dealt",
        "starts": f"SELECT user, min(struct(us, id)) AS start FROM ahead WHERE own = block AND reach - us <= {width} GROUP BY user",
        "inside": f"SELECT f.* FROM failures f JOIN starts s ON f.user = s.user WHERE f.us BETWEEN s.start.us AND s.start.us + {width} AND (f.us > s.start.us OR f.id >= s.start.id)",
        "sized": "SELECT user, count(*) AS n, max(us) AS end_us FROM inside GROUP BY user",
        "won": f"SELECT a.* FROM attempts a JOIN sized s ON a.user = s.user AND a.us BETWEEN s.end_us AND s.end_us + {width} WHERE a.outcome = 'success'",
        "both": f"SELECT user, bool_or(success) AS success, collect_set(src_ip) AS origins, {_SEEN} FROM (SELECT user, false AS success, src_ip, time, known FROM inside UNION ALL SELECT user, true, src_ip, time, known FROM won) GROUP BY user",
        "bursts": "SELECT * FROM both JOIN sized USING (user)",
    }
    title = "concat(n, ' failed sign-ins for ', user, ' in 10 minutes', if(success, ', then a success', ''))"
    return ctes, [_row("bursts", title, f"50 + least(20, n - {t.bruteforce_min_failures}) + if(success, 25, 0)", "'Credential Access'", users="array(user)", ips="origins")]


def _impossible_travel(t: Thresholds) -> Parts:
    ctes = {
        "seen": f"SELECT w.user, w.id, w.us, w.time, w.src_ip, a.country FROM {_W} w JOIN hunt_addresses a ON w.src_ip = a.ip WHERE {_SIGN_INS} AND outcome = 'success' AND user <> '' AND src_ip <> '' AND NOT allowed AND country <> ''",
        "steps": "SELECT *, lag(struct(us, time, src_ip, country)) OVER (PARTITION BY user ORDER BY us, id) AS before FROM seen",
        "origins": "SELECT o.user, collect_set(a.country) AS countries FROM hunt_origins o JOIN hunt_addresses a ON o.src_ip = a.ip WHERE a.country <> '' GROUP BY o.user",
        "pairs": f"""SELECT s.user, s.src_ip, s.country, before.country AS from_country, before.src_ip AS from_ip, (us - before.us) / {HOUR_US} AS gap, coalesce(NOT array_contains(countries, s.country), false) AS new,
            before.time AS first_seen, s.time AS last_seen, false AS known FROM steps s LEFT JOIN origins o ON s.user = o.user WHERE before.country <> s.country AND (us - before.us) / {HOUR_US} <= {t.travel_window_hours}D""",
    }
    title = "concat(user, ' signed in from ', from_country, ' and ', country, ' within ', format_string('%.1f', gap), ' hours')"
    return ctes, [_row("pairs", title, f"55 + if(new, 15, 0) + int(15 * (1 - gap / {t.travel_window_hours}D))", "'Initial Access'", users="array(user)", ips="array(from_ip, src_ip)")]


def _lateral_fanout(t: Thresholds) -> Parts:
    attr = "coalesce(try_element_at(attrs, '{}'), '')".format
    ctes = {
        "logons": f"SELECT *, if({attr('src_host')} <> '', {attr('src_host')}, src_ip) AS origin FROM {_W} e WHERE kind = 'auth' AND outcome = 'success' AND lower({attr('logon_type')}) IN {_some(NETWORK_LOGONS)} AND {_unlisted('user', 'noisy')}",
        "raw": "SELECT user, origin, host AS item, us, id, time, known FROM logons WHERE origin <> '' AND user <> '' AND host <> ''",
        **_best_window("user, origin", t.fanout_window_minutes * MINUTE_US, t.fanout_min_hosts),
        "reached": f"SELECT user, origin, array_sort(collect_set(item)) AS items, {_SEEN} FROM chosen GROUP BY user, origin",
        "old": "SELECT DISTINCT user, host AS item FROM hunt_reached",
        "fresh": "SELECT r.user, r.origin, int(count_if(o.user IS NULL)) AS fresh FROM (SELECT user, origin, explode(items) AS item FROM reached) r LEFT JOIN old o ON r.user = o.user AND r.item = o.item GROUP BY r.user, r.origin",
        "fans": "SELECT *, size(items) AS n, EXISTS (SELECT 1 FROM old) AS any_known, origin RLIKE r'^[0-9.]*[0-9][0-9.]*$' OR contains(origin, ':') AS is_ip FROM reached JOIN fresh USING (user, origin)",
        "wide": "SELECT * FROM fans WHERE NOT any_known OR 2 * fresh >= n",
    }
    title = f"concat(user, ' reached ', n, ' hosts from ', origin, ' in {t.fanout_window_minutes} minutes')"
    base = f"55 + least(20, 4 * (n - {t.fanout_min_hosts})) + if(any_known AND fresh = n, 10, 0)"
    return ctes, [_row("wide", title, base, "'Lateral Movement'", hosts="items, array(if(is_ip, '', origin))", users="array(user)", ips="array(if(is_ip, origin, ''))")]


_STARTS = f"SELECT * FROM (SELECT *, {_IMAGE.format('process')} AS image FROM events WHERE kind = 'process') e WHERE {_unlisted('image', 'trusted')}"


def _rules(rules: Sequence[ProcessRule]) -> Callable[[Thresholds], Parts]:
    def test(r: ProcessRule) -> str:
        tests = [f"{_IMAGE.format('parent')} IN {_some(r.parents)}"] * bool(r.parents) + [f"image IN {_some(r.images)}"] * bool(r.images)
        return " AND ".join(tests + [f"concat_ws(' ', process, cmdline) RLIKE {literal('(?iuUd)' + r.pattern)}"] * bool(r.pattern))

    def hit(r: ProcessRule) -> str:
        return f"CASE WHEN {test(r)} THEN named_struct('rule', '{r.id}', 'what', {literal(r.title)}, 'points', {r.score}, 'tactic', {literal(r.tactic)}) END"

    ctes = {
        "starts": _STARTS,
        "hits": f"SELECT *, inline(array_compact(array({', '.join(map(hit, rules))}))) FROM starts",
        "matched": f"SELECT rule, host, user, what, points, tactic, count(*) AS n, {_SEEN} FROM hits GROUP BY rule, host, user, what, points, tactic",
    }
    return lambda t: (ctes, [_row("matched", "concat(what, ' on ', host)", "points + least(10, 2 * (n - 1))", "tactic", hosts="array(host)", users="array(user)")])


def _rare_process(t: Thresholds) -> Parts:
    near = " OR ".join(f"(image <> '{n}' AND levenshtein(image, '{n}') <= 2)" for n in SYSTEM_NAMES)
    writable = " OR ".join(f"contains(lower(translate(path, {_BACK}, '/')), '{p}')" for p in WRITABLE_PATHS)
    ctes = {
        "starts": f"SELECT * FROM ({_STARTS}) WHERE image <> ''",
        "unseen": "SELECT * FROM starts LEFT ANTI JOIN hunt_programs USING (image)",
        "few": f"SELECT image FROM unseen GROUP BY image HAVING count(DISTINCT host) <= {t.rare_max_hosts}",
        "rare": f"SELECT image, count(DISTINCT host) AS n, collect_set(host) AS found_on, collect_set(user) AS run_by, min_by(process, struct(time, id)) AS path, {_SEEN} FROM unseen LEFT SEMI JOIN few USING (image) GROUP BY image",
    }
    base = f"35 + if({writable}, 20, 0) + if(length(image) >= 6 AND ({near}), 30, 0)"
    return ctes, [_row("rare", "concat('Rare process ', image, ' on ', n, ' host(s)')", base, "'Defense Evasion'", hosts="found_on", users="run_by")]


def _cloud_abuse(t: Thresholds) -> Parts:
    looks = " OR ".join(f"startswith(api, '{p}')" for p in DISCOVERY_PREFIXES)
    ctes = {
        "calls": f"SELECT * FROM {_W} e WHERE kind = 'cloud' AND {_unlisted('user', 'noisy')}",
        "raw": f"SELECT user, src_ip, api AS item, us, id, time, known FROM calls WHERE ({looks}) AND src_ip <> ''",
        **_best_window("user, src_ip", t.enumeration_window_minutes * MINUTE_US, t.enumeration_min_apis),
        "listed": f"SELECT user, src_ip, count(DISTINCT item) AS n, {_SEEN} FROM chosen GROUP BY user, src_ip",
        "enumerated": "SELECT l.*, c.user IS NULL AS new FROM listed l LEFT JOIN (SELECT DISTINCT user, src_ip FROM hunt_callers) c ON l.user = c.user AND l.src_ip = c.src_ip",
    }

    def by_user(where: str) -> str:
        return f"(SELECT user, count(*) AS n, collect_set(src_ip) AS origins, {_SEEN} FROM calls WHERE {where} GROUP BY user)"

    own = {"users": "array(user)", "ips": "origins"}
    return ctes, [
        _row(by_user("user = 'root' AND outcome = 'success'"), "concat('Root account used ', n, ' time(s)')", "70", "'Initial Access'", **own),
        _row(by_user(f"api IN {_some(PRIVILEGE_APIS)} AND outcome = 'success' AND mfa = false"), "concat(user, ' changed permissions or credentials without MFA')", "65 + least(10, 3 * (n - 1))", "'Persistence'", **own),
        _row(by_user(f"api IN {_some(EVASION_APIS)}"), "concat(user, ' tried to weaken cloud logging or detection')", "85", "'Defense Evasion'", **own),
        _row("enumerated", "concat(user, ' enumerated the environment from ', src_ip)", f"50 + if(new, 15, 0) + least(10, n - {t.enumeration_min_apis})", "'Discovery'", users="array(user)", ips="array(src_ip)"),
    ]


#: Each hunt's plans, of which a statement is the union.
SQL: dict[str, tuple[Callable[[Thresholds], Parts], ...]] = {
    "beaconing": (_beaconing,), "dns_tunnel": (_dns_tunnel,), "dga": (_dga,), "exfiltration": (_exfiltration,), "password_attacks": (_spray, _brute_force), "impossible_travel": (_impossible_travel,),
    "lateral_fanout": (_lateral_fanout,), "process_chains": (_rules(EXECUTION_RULES),), "persistence": (_rules(PERSISTENCE_RULES),), "rare_process": (_rare_process,), "cloud_abuse": (_cloud_abuse,),
}


def _findings(hunt: str, parts: Parts) -> str:
    """What every finding has: id, indicators, clamped score and severity."""
    ctes, selects = parts
    moment = "concat(date_format(first_seen, \"yyyy-MM-dd'T'HH:mm:ss\"), if(date_format(first_seen, 'SSSSSS') <> '000000', concat('.', date_format(first_seen, 'SSSSSS')), ''), '+00:00')"
    named = ", ".join((
        "transform(ips, x -> concat('ip:', x))",
        "transform(domains, x -> concat('domain:', x))",
        f"transform(domains, x -> concat('domain:', {registered_domain('x')}))",
    ))
    hashed = "regexp_replace(lower(coalesce(try_element_at(e.attrs, 'sha256'), '')), '^sha256=', '')"
    ctes = {"events": f"SELECT e.*, h.value IS NOT NULL AS known FROM hunt_window e LEFT JOIN (SELECT value FROM hunt_listed WHERE what = 'hash') h ON h.value = {hashed}"} | ctes | {
        "found": "\nUNION ALL ".join(selects),
        "keyed": f"SELECT *, concat('F-', upper(substr(sha2(array_join(concat(array('{hunt}', title), hosts, users, ips, domains, array({moment})), '|'), 256), 1, 10))) AS id FROM found",
        "flagged": f"SELECT DISTINCT id, true AS met FROM (SELECT id, explode(concat({named})) AS value FROM keyed) LEFT SEMI JOIN (SELECT value FROM hunt_listed WHERE what = 'known') USING (value)",
        "scored": f"SELECT k.*, f.met IS NOT NULL OR known AS ioc_match, int(greatest(0, least(100, base + if(f.met IS NOT NULL OR known, {IOC_BONUS}, 0)))) AS score FROM keyed k LEFT JOIN flagged f ON k.id = f.id",
    }
    severity = "CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END"
    body = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    return f"WITH {body}\nSELECT id, '{hunt}' AS hunt, title, score, {severity} AS severity, tactic, hosts, users, ips, domains, first_seen, last_seen, ioc_match FROM scored"


def _statements(hunt: str, thresholds: Thresholds) -> Iterator[str]:
    for plan in SQL[hunt]:
        yield _findings(hunt, plan(thresholds))


def statement(hunt: str, thresholds: Thresholds, prefix: str = "hunt") -> str:
    """A hunt as one Spark SQL statement over the views that register() makes."""
    text = "\nUNION ALL\n".join(f"SELECT * FROM ({s})" for s in _statements(hunt, thresholds))
    if prefix != "hunt":
        for view in ("window", "addresses", "listed", "flows", "origins", "reached", "programs", "callers"):
            text = text.replace(f"hunt_{view}", f"{prefix}_{view}")
    return text


def run(ctx: Context, hunt: str, prefix: str = "hunt") -> DataFrame:
    """The findings of a hunt's statement over a context."""
    register(ctx, prefix)
    return ctx.window.sparkSession.sql(statement(hunt, ctx.config.thresholds, prefix)).select(*[F.col(c) for c in COLUMNS])
