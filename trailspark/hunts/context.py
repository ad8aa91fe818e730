"""What the hunts share: the split events, the address dimension, and the finding constructor."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions import addresses, scores, text
from trailspark.hunts.baseline import summaries
from trailspark.operators.scratch import BROADCAST_ROWS, small, spread, written
from trailspark.schema import HuntConfig

MAX_EVIDENCE = 50
IOC_BONUS = 15

# Networks that count as internal; documentation ranges don't.
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")

FINDING_COLUMNS = ("id", "hunt", "title", "score", "severity", "tactic", "techniques", "hosts", "users", "ips", "domains", "first_seen", "last_seen", "event_ids", "details", "explanation", "ioc_match")


def _networks(config: HuntConfig) -> list[tuple]:
    """(key, what, bits, place, country) of every network; networks are told apart by their key."""
    rows: dict = {}
    listed = [("internal", n, "") for n in INTERNAL] + [("allowed", n, "") for n in config.allow_networks] + [("country", n, c) for n, c in config.geo]
    for place, (what, name, country) in enumerate(listed):
        network = ipaddress.ip_network(name, strict=False)
        key = addresses.network_key(network)
        rows.setdefault((key, what), (key, what, network.prefixlen, -place, country, network.version))
    return list(rows.values())


def address_facts(ips: DataFrame, config: HuntConfig) -> DataFrame:
    """(ip, internal, allowed, country) for distinct addresses. The country is the longest matching network's, the first
    of equally long ones; an invalid address is external, not allowed, and of no country.

    A network is an equality of prefixes, so an address meets the networks in a hash join, with a key for each length in use."""
    networks = _networks(config)
    lengths = {version: sorted({r[2] for r in networks if r[5] == version}) for version in (4, 6)}
    known = ips.sparkSession.createDataFrame([r[:5] for r in networks], "key string, what string, bits int, place int, value string")
    if len(networks) > IN_PLAN:
        known = written(known, "networks")
    if len(networks) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    asked = ips.select("ip", addresses.digits(F.col("ip")).alias("digits"))
    keys = {version: F.array(*[addresses.prefix_key(F.col("digits"), version, bits) for bits in lengths[version]]).cast("array<string>") for version in (4, 6)}
    asked = asked.select("ip", F.explode_outer(F.when(F.length("digits") == 8, keys[4]).when(F.length("digits") == 32, keys[6])).alias("key"))
    has = lambda what: F.max(F.coalesce(F.col("what") == what, F.lit(False))).alias(what)
    place = F.max(F.when(F.col("what") == "country", F.struct("bits", "place", "value")))["value"]
    return asked.join(known, "key", "left").groupBy("ip").agg(has("internal"), has("allowed"), F.coalesce(place, F.lit("")).alias("country"))


#: Values of a configuration that stay in the plan; longer lists become a table, so that plans don't grow with them.
IN_PLAN = 1000


def _relation(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """(value): the distinct values of a list of the configuration."""
    rows = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "value string")
    return rows if len(values) <= IN_PLAN else written(rows, name)


def suffixes(name: Column) -> Column:
    """A domain and everything after each of its dots."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def flagged(rows: DataFrame, key: str, values: Column, listed: Sequence[str], name: str) -> DataFrame:
    """rows (one a key) with `name`: whether one of their values is listed. A long list is joined by value."""
    if len(listed) <= IN_PLAN:
        return rows.withColumn(name, F.exists(values, lambda x: x.isin(*listed)) if listed else F.lit(False))
    row = F.struct(*[c for c in rows.columns if c != key])
    asked = rows.select(key, row.alias("_row"), F.explode_outer(F.array_distinct(values)).alias("value"))
    met = asked.join(small(_relation(rows.sparkSession, listed, "listed")).withColumn("_met", F.lit(True)), "value", "left")
    found = met.groupBy(key).agg(F.first("_row").alias("_row"), F.max(F.coalesce("_met", F.lit(False))).alias(name))
    return found.select(key, "_row.*", name)


@dataclass
class Context:
    """Window events of the canonical schema, and what is known of the time before: its events, or the tables of
    hunts/baseline.py where they are stored."""

    window: DataFrame
    history: DataFrame
    config: HuntConfig
    stored: dict[str, DataFrame] | None = None
    known: dict = field(default_factory=dict)

    def kind(self, kind: str) -> DataFrame:
        return self.window.where(F.col("kind") == kind)

    @cached_property
    def baseline(self) -> dict[str, DataFrame]:
        """The tables of hunts/baseline.py over the time before the window."""
        return summaries(self.history) if self.stored is None else self.stored

    @cached_property
    def addresses(self) -> DataFrame:
        """Facts of every distinct address of either side: a dimension that is written once, so that network arithmetic runs
        once an address and the plans of all hunts start from a table."""
        sides = F.explode(F.array("src_ip", "dst_ip")).alias("ip")
        ips = self.window.select(sides).unionByName(self.baseline["flows"].select(F.col("dst_ip").alias("ip"))).unionByName(self.baseline["origins"].select(F.col("src_ip").alias("ip")))
        return small(written(address_facts(ips.where("ip <> ''").distinct(), self.config), "addresses"))

    def with_address(self, events: DataFrame, column: str) -> DataFrame:
        return events.join(self.addresses.withColumnRenamed("ip", column), column)

    def outbound(self, events: DataFrame) -> DataFrame:
        """Flows to external addresses that are not allowed."""
        return self.with_address(events.where("kind = 'flow' and dst_ip <> ''"), "dst_ip").where("not internal and not allowed")

    @cached_property
    def known_flows(self) -> DataFrame:
        """The baseline's flows to external addresses, allowed or not."""
        return self.with_address(self.baseline["flows"], "dst_ip").where("not internal")

    def without_allowed(self, events: DataFrame) -> DataFrame:
        """The events whose domain is neither an allowed one nor below one."""
        if not self.config.allow_domains:
            return events
        if len(self.config.allow_domains) <= IN_PLAN:
            return events.where(~F.exists(suffixes(F.col("domain")), lambda x: x.isin(*self.config.allow_domains)))
        # Distinct names meet the list by their suffixes.
        every = events.select("domain").distinct().select("domain", F.explode(suffixes(F.col("domain"))).alias("value"))
        allowed = every.join(small(_relation(events.sparkSession, self.config.allow_domains, "allowed")), "value", "left_semi").select("domain").distinct()
        return events.join(allowed, "domain", "left_anti")

    @cached_property
    def indicators(self) -> list[str]:
        """`ip:` and `domain:` with every value."""
        return [f"ip:{v}" for v in self.config.ioc_ips] + [f"domain:{v}" for v in self.config.ioc_domains]

    def sign_ins(self, events: DataFrame) -> DataFrame:
        return events.where("kind = 'auth' or (kind = 'cloud' and api = 'ConsoleLogin')")


def us(column: str = "time") -> Column:
    return F.unix_micros(column)


def gathered(events: DataFrame, keys: list[str], ctx: Context, *sums: Column) -> DataFrame:
    """(keys, sums, evidence, first_seen, last_seen, hash_hit) for each group of events.

    evidence is (time, id) of the group's first MAX_EVIDENCE events: Spark limits the ranks below the shuffle, so a busy
    group is not sorted whole. hash_hit tells whether a known digest is among all of its events."""
    sha, hashes = F.regexp_replace(F.lower(F.coalesce(F.try_element_at("attrs", F.lit("sha256")), F.lit(""))), "^sha256=", ""), ctx.config.ioc_hashes
    hit = F.coalesce(sha.isin(*hashes), F.lit(False)) if 0 < len(hashes) <= IN_PLAN else F.lit(False)
    rows = events.groupBy(*keys).agg(*sums, F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.max(hit).alias("hash_hit"))
    if len(hashes) > IN_PLAN:
        known = small(_relation(events.sparkSession, hashes, "hashes"))
        hits = events.select(*[F.col(k).alias(f"_hit_{k}") for k in keys], sha.alias("value")).where("value <> ''").join(known, "value", "left_semi").drop("value").distinct().withColumn("_hit", F.lit(True))
        rows = rows.join(hits, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_hit_{k}")) for k in keys]), "left")
        rows = rows.withColumn("hash_hit", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_hit_{k}" for k in keys])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("time", "id"))
    first = events.select(*keys, "time", "id").withColumn("_n", place).where(F.col("_n") <= MAX_EVIDENCE)
    first = first.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("time", "id"))).alias("evidence"))
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(spread(first), match).drop(*[f"_of_{k}" for k in keys])


def benign(*causes: str) -> Callable:
    """Gives a hunt's findings the harmless causes to think of first."""

    def wrap(plan: Callable) -> Callable:
        @wraps(plan)
        def run(ctx: Context) -> DataFrame:
            return plan(ctx).withColumn("benign_causes", F.array(*map(F.lit, causes)))

        return run

    return wrap


def names(*columns: Column | str) -> Column:
    """Sorted distinct non-empty names."""
    parts = [F.array(c) if isinstance(c, str) else c for c in columns]
    return F.array_sort(F.filter(F.array_distinct(F.concat(*parts)), lambda x: x.isNotNull() & (x != "")))


def none() -> Column:
    return F.array().cast("array<string>")


def findings(rows: DataFrame, ctx: Context, hunt: str, title: Column, score: Column, tactic: Column | str, techniques: Column | tuple[str, ...], explanation: Column, details: dict[str, Column], hosts: Column | None = None, users: Column | None = None, ips: Column | None = None, domains: Column | None = None) -> DataFrame:
    """Findings of rows that gathered() gave: entities, known indicators, clamped score, severity and a stable id."""
    rows = rows.select(
        F.lit(hunt).alias("hunt"), title.alias("title"), score.cast("int").alias("base"), (F.lit(tactic) if isinstance(tactic, str) else tactic).alias("tactic"),
        (F.array(*map(F.lit, techniques)) if isinstance(techniques, tuple) else techniques).alias("techniques"),
        *[(none() if c is None else names(c)).alias(n) for n, c in (("hosts", hosts), ("users", users), ("ips", ips), ("domains", domains))],
        "first_seen", "last_seen", F.slice(F.transform("evidence", lambda x: x["id"]), 1, MAX_EVIDENCE).alias("event_ids"),
        F.to_json(F.struct(*[c.alias(n) for n, c in details.items()])).alias("details"), explanation.alias("explanation"), "hash_hit",
    )

    micro = F.date_format("first_seen", "SSSSSS")
    moment = F.concat(F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("+00:00"))
    key = F.array_join(F.concat(F.array("hunt", "title"), "hosts", "users", "ips", "domains", F.array(moment)), "|")
    rows = rows.withColumn("id", F.concat(F.lit("F-"), F.upper(F.substring(F.sha2(key, 256), 1, 10))))
    registered = F.transform("domains", text.registered_domain)
    named = F.concat(F.transform("ips", lambda x: F.concat(F.lit("ip:"), x)), *[F.transform(c, lambda x: F.concat(F.lit("domain:"), x)) for c in (F.col("domains"), registered)])
    rows = flagged(rows, "id", named, ctx.indicators, "_known").withColumn("ioc_match", F.col("_known") | F.col("hash_hit"))
    rows = rows.withColumn("score", scores.clamped(F.col("base") + F.when(F.col("ioc_match"), IOC_BONUS).otherwise(0)))
    return rows.withColumn("severity", scores.severity(F.col("score"))).select(*FINDING_COLUMNS)
