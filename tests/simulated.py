"""A simulated week of telemetry with planted attacks and harmless look-alikes, as canonical events.

Background activity is generated by Spark from a range of (day, host, step); the planted cases are a few literal rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.schema import EVENT_SCHEMA, HuntConfig

HOSTS, USERS, BASELINE_DAYS = 10, 12, 7
_TEXTS = ("source", "host", "user", "process", "parent", "cmdline", "outcome", "src_ip", "dst_ip", "domain", "query_type", "api")


def _canonical(rows: DataFrame) -> DataFrame:
    """All columns of the event schema, absent texts as '', and an id from the content."""
    have = set(rows.columns)
    rows = rows.select("*", *[F.lit("").alias(c) for c in _TEXTS if c not in have])
    for name, kind in (("dst_port", "int"), ("bytes_out", "bigint"), ("mfa", "boolean"), ("attrs", "map<string,string>")):
        if name not in have:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("attrs", F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    text = F.to_json(F.struct("time", "kind", *_TEXTS, "dst_port", "bytes_out"))
    rows = rows.withColumn("id", F.concat(F.col("kind"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 14)))
    return rows.select(*[x.split()[0] for x in EVENT_SCHEMA.split(", ")])


def _at(start: datetime, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(start)) + (seconds * 1_000_000).cast("bigint"))


def background(spark: SparkSession, hunt_start: datetime) -> DataFrame:
    """Seven baseline days and the hunt day of ordinary work."""
    first = hunt_start - timedelta(days=BASELINE_DAYS)
    grid = spark.range((BASELINE_DAYS + 1) * HOSTS * 18).select((F.col("id") % 18).alias("step"), ((F.col("id") / 18).cast("int") % HOSTS).alias("n"), F.floor(F.col("id") / (18 * HOSTS)).alias("day"), F.abs(F.xxhash64("id")).alias("luck"))
    host, user = F.format_string("ws-%03d", F.col("n") + 1), F.format_string("user%02d", F.col("n") % USERS)
    second = F.col("day") * 86_400 + 8 * 3_600 + F.col("step") * 1_800 + F.col("luck") % 1_700
    base = grid.withColumn("time", _at(first, second)).withColumn("host", host).withColumn("user", user)
    flow = base.select("time", F.lit("flow").alias("kind"), "host", F.lit("10.0.0.5").alias("src_ip"), F.concat(F.lit("93.184.216."), (F.col("n") % 5 + 1).cast("string")).alias("dst_ip"), F.lit(443).alias("dst_port"), (F.col("luck") % 400_000).alias("bytes_out"))
    dns = base.select("time", F.lit("dns").alias("kind"), "host", F.concat(F.lit("www.site"), (F.col("luck") % 9).cast("string"), F.lit(".example")).alias("domain"), F.lit("A").alias("query_type"), F.lit("success").alias("outcome"))
    process = base.where("step < 6").select("time", F.lit("process").alias("kind"), "host", "user", F.element_at(F.array(F.lit("C:\\Windows\\explorer.exe"), F.lit("C:\\Program Files\\chrome.exe"), F.lit("C:\\Windows\\System32\\svchost.exe")), (F.col("step") % 3 + 1).cast("int")).alias("process"), F.lit("C:\\Windows\\explorer.exe").alias("parent"))
    auth = base.where("step = 1").select("time", F.lit("auth").alias("kind"), "host", "user", F.lit("192.0.2.10").alias("src_ip"), F.lit("success").alias("outcome"), F.create_map(F.lit("logon_type"), F.lit("2")).alias("attrs"))
    cloud = base.where("step = 2 and n < 4").select("time", F.lit("cloud").alias("kind"), "user", F.lit("192.0.2.10").alias("src_ip"), F.lit("GetObject").alias("api"), F.lit("success").alias("outcome"), F.lit(True).alias("mfa"))
    out = _canonical(flow)
    for part in (dns, process, auth, cloud):
        out = out.unionByName(_canonical(part))
    return out


def attacks(spark: SparkSession, start: datetime) -> DataFrame:
    """The hunt day's planted cases, and look-alikes that allow lists or suppressions cover."""
    rows: list[dict] = []

    def add(hours: float, kind: str, **more) -> None:
        rows.append({"time": start + timedelta(seconds=round(hours * 3600)), "kind": kind} | more)

    for i in range(120):
        add(3 + i / 60, "flow", host="ws-003", dst_ip="203.0.113.66", dst_port=443, bytes_out=512)
    for i in range(60):
        label = "".join("abcdefghijklmnopqrstuvwxyz234567"[(i * 7 + j * 11 + i * j) % 32] for j in range(32))
        add(4 + i / 240, "dns", host="ws-004", domain=f"{label}.tunnel-zone.net", query_type="TXT", outcome="success")
    for i in range(20):
        label = "".join("abcdefghijklmnopqrstuvwxyz"[(i * 5 + j * 7) % 26] for j in range(14))
        add(5 + i / 120, "dns", host="ws-006", domain=f"{label}.com", query_type="A", outcome="failure")
    for i in range(12):
        add(6 + i / 60, "auth", host="vpn", user=f"user{i:02d}", src_ip="198.51.100.7", outcome="failure")
    add(6.4, "auth", host="vpn", user="user05", src_ip="198.51.100.7", outcome="success")
    add(9, "auth", host="vpn", user="user01", src_ip="192.0.2.44", outcome="success")
    add(10, "auth", host="vpn", user="user01", src_ip="203.0.113.9", outcome="success")
    for i in range(6):
        add(2 + i / 30, "flow", host="ws-007", dst_ip="203.0.113.200", dst_port=443, bytes_out=30_000_000)
    for i in range(7):
        add(11 + i / 35, "auth", host=f"srv-{i}", user="user08", src_ip="10.0.0.8", outcome="success", attrs={"logon_type": "3", "src_host": "ws-008"})
    add(8, "process", host="ws-003", user="user03", process="C:\\Windows\\System32\\WindowsPowerShell\\powershell.exe", parent="C:\\Office\\WINWORD.EXE", cmdline="powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA")
    add(8.1, "process", host="ws-003", user="user03", process="C:\\Windows\\System32\\schtasks.exe", parent="powershell.exe", cmdline="schtasks /create /tn upd /tr c:\\temp\\svch0st.exe")
    add(8.2, "process", host="ws-003", user="user03", process="C:\\Users\\Public\\svch0st.exe", parent="powershell.exe", cmdline="svch0st.exe")
    add(12, "cloud", user="user02", api="StopLogging", src_ip="203.0.113.5", outcome="success", mfa=False)
    add(12.1, "cloud", user="user02", api="CreateAccessKey", src_ip="203.0.113.5", outcome="success", mfa=False)
    for i, api in enumerate(("ListBuckets", "ListUsers", "DescribeInstances", "GetAccountSummary", "ListRoles", "DescribeVpcs", "GetCallerIdentity", "ListKeys", "DescribeTrails")):
        add(12.2 + i / 120, "cloud", user="user02", api=api, src_ip="203.0.113.5", outcome="success", mfa=False)
    add(13, "cloud", user="root", api="ConsoleLogin", src_ip="203.0.113.5", outcome="success", mfa=False)
    for i in range(100):
        add(1 + i / 60, "flow", host="srv-backup", dst_ip="198.51.100.200", dst_port=443, bytes_out=2_000_000)
    kinds = {"dst_port": "int", "bytes_out": "bigint", "mfa": "boolean", "attrs": "map<string,string>", "time": "timestamp"}
    names = ["time", "kind", "host", "user", "process", "parent", "cmdline", "outcome", "src_ip", "dst_ip", "domain", "query_type", "api", *[k for k in kinds if k != "time"]]
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    table = spark.createDataFrame([tuple(r.get(n, None if n in kinds else "") for n in names) for r in rows], schema)
    return _canonical(table)


def week(spark: SparkSession, hunt_start: datetime) -> DataFrame:
    return background(spark, hunt_start).unionByName(attacks(spark, hunt_start))


def example_config(**changes) -> HuntConfig:
    settings = {"allow_networks": ("198.51.100.192/28",), "geo": (("192.0.2.0/24", "US"), ("198.51.100.0/24", "RO"), ("203.0.113.0/24", "BR")), "ioc_ips": ("203.0.113.66",)}
    return HuntConfig(**(settings | changes))
