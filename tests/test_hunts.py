"""The hunts on a simulated week, and the report, searches and command line around them."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import random
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from functools import reduce

import pytest
import yaml

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests import simulated
from trailspark import cli, config, logs
from trailspark.functions import text
from trailspark.hunts import HUNTS, Hunt
from trailspark.hunts import baseline as days
from trailspark.hunts.context import Context, address_facts, findings, gathered
from trailspark.operators.scratch import written
from trailspark.plans import detections, report, spark_sql
from trailspark.plans.engine import coverage, hunt
from trailspark.schema import Suppression, Thresholds
from trailspark.sources import ingest

DAY = datetime(2026, 9, 18, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def week(spark):
    return simulated.week(spark, DAY).persist()


@pytest.fixture(scope="module")
def found(week):
    rule = Suppression("dga", "host", "WS-006", "a retired name still in use", "reviewer", date(2026, 12, 1))
    old = Suppression("*", "host", "ws-003", "a reason that has run out", "reviewer", date(2026, 1, 1))
    result = hunt(week, simulated.example_config(suppressions=(rule, old)), DAY, DAY + timedelta(days=1))
    return report.collect(result)


def test_every_planted_case_is_found(found):
    findings = list(found.findings.values())
    by_hunt = Counter(f["hunt"] for f in findings)
    assert set(by_hunt) == set(HUNTS) - {"dga"} and found.facts["suppressed"] == 1 and len(found.expired) == 1
    assert by_hunt["beaconing"] == by_hunt["dns_tunnel"] == by_hunt["exfiltration"] == by_hunt["password_attacks"] == by_hunt["lateral_fanout"] == by_hunt["persistence"] == 1
    assert by_hunt["process_chains"] == 2 and by_hunt["rare_process"] == 3 and by_hunt["cloud_abuse"] == 4
    assert not any("198.51.100.200" in f["ips"] for f in findings)
    beacon = next(f for f in findings if f["hunt"] == "beaconing")
    assert beacon["title"] == "Regular connections from ws-003 to 203.0.113.66:443" and beacon["ioc_match"] and len(beacon["event_ids"]) == 50 and beacon["benign_causes"]
    assert json.loads(beacon["details"])["connections"] == 120
    assert found.facts["findings"] == len(findings) == sum(found.facts[s] for s in ("critical", "high", "medium", "low"))


def test_leads_are_ranked_and_cover_every_finding(found):
    assert [x["score"] for x in found.leads] == sorted((x["score"] for x in found.leads), reverse=True)
    assert sorted(i for x in found.leads for i in x["finding_ids"]) == sorted(found.findings)
    assert found.leads[0]["score"] == 100 and all(x["next_steps"] for x in found.leads)


def test_an_ordinary_day_is_quiet(week):
    start = DAY - timedelta(days=2)
    result = hunt(week, simulated.example_config(), start, start + timedelta(days=1))
    assert result.findings.count() == 0 and result.leads.count() == 0


def test_gates_and_errors(week):
    with pytest.raises(ValueError):
        hunt(week, simulated.example_config(), DAY, DAY)
    with pytest.raises(ValueError):
        hunt(week, simulated.example_config(), DAY, DAY + timedelta(hours=1), only=["nothing"])
    result = hunt(week.where("kind = 'dns'"), simulated.example_config(geo=()), DAY, DAY + timedelta(days=1), only=["dga", "beaconing", "dga"])
    assert result.ran == ["dga"] and list(result.skipped) == ["beaconing"]
    empty = hunt(week.where("false"), simulated.example_config(), DAY, DAY + timedelta(days=1))
    assert empty.findings.count() == 0 and len(empty.skipped) == len(HUNTS) and len(empty.warnings) == 2


def test_report_files(found, tmp_path):
    paths = report.write(found, str(tmp_path / "out"), Thresholds())
    names = {p.split("/out/")[1] for p in paths}
    assert {"hunt-report.md", "hunt-report.json", "findings.csv", "queries/beaconing.spl", "sigma/process_chains.yml"} <= names and "queries/dga.spl" not in names
    body = json.loads((tmp_path / "out/hunt-report.json").read_text())
    inside = [f for lead in body["leads"] for f in lead["findings"]]
    assert len(inside) == len(found.findings) and all([e["id"] for e in f["timeline"]] == f["event_ids"][: report.SHOWN_EVENTS] for f in inside)
    assert (tmp_path / "out/findings.csv").read_text().count("\n") == len(found.findings) + 1
    assert "203.0.113.66" in (tmp_path / "out/hunt-report.md").read_text()
    with pytest.raises(ValueError):
        report.write(found, str(tmp_path), Thresholds(), ["xml"])


def test_whole_result_as_tables_views_and_functions(spark, week, tmp_path):
    result = hunt(week, simulated.example_config(), DAY, DAY + timedelta(days=1), only=["beaconing", "dga"])
    report.tables(result, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t/findings")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "t/findings_csv")).columns == list(report.CSV_COLUMNS)
    result.register()
    assert spark.sql("SELECT count(*) FROM hunt_findings WHERE score >= 50").first()[0] == 2
    again = spark.sql(detections.render("dga", "sql", Thresholds()))
    assert [r.id for r in again.collect()] == [r.id for r in spark.sql("SELECT id FROM hunt_findings WHERE hunt = 'dga'").collect()]
    texts = spark.createDataFrame([("a.b.co.uk", "x --password hunter22 sk-ant-abcdefghijklmnopqrst"), ("", ""), ("Www.Example.COM.", "it's 'quoted' token: 'abcdef'"), (None, None)], "name string, line string")
    texts.createOrReplaceTempView("texts")
    got = spark.sql("SELECT text_entropy(name), registered_domain(name), redact_secrets(line) FROM texts").collect()
    want = texts.select(text.entropy(texts.name), text.registered_domain(texts.name), text.redact(texts.line)).collect()
    assert [(round(r[0] or 0, 9), r[1], r[2]) for r in got] == [(round(r[0] or 0, 9), r[1], r[2]) for r in want]


def test_spark_sql_reads_lists_and_digests(spark, week):
    settings = simulated.example_config(noisy_users=("user02",), trusted_processes=("svch0st.exe",), scanner_ips=("198.51.100.7",), allow_domains=("tunnel-zone.net",), ioc_hashes=("ab" * 32,))
    digest = F.create_map(F.lit("sha256"), F.lit("SHA256=" + "AB" * 32))
    marked = written(week.withColumn("attrs", F.when(F.col("kind") == "process", digest).otherwise(F.col("attrs"))), "week")
    ctx = Context(marked.where(F.col("time") >= F.lit(DAY)), marked.where(F.col("time") < F.lit(DAY)), settings)
    spark_sql.register(ctx)
    found = {}
    for name in ("dns_tunnel", "password_attacks", "process_chains", "rare_process", "cloud_abuse"):
        found[name] = spark.sql(detections.render(name, "sql", settings.thresholds)).select(*spark_sql.COLUMNS).orderBy("id").collect()
        assert found[name] == HUNTS[name].plan(ctx).select(*spark_sql.COLUMNS).orderBy("id").collect(), name
    assert {name: len(rows) for name, rows in found.items() if name != "rare_process"} == {"dns_tunnel": 0, "password_attacks": 0, "process_chains": 2, "cloud_abuse": 1}
    assert all(r.ioc_match for r in found["process_chains"])


def test_own_hunts(week):
    def plan(ctx):
        rows = gathered(ctx.kind("dns"), ["host"], ctx, F.count("*").alias("n"))
        return findings(rows, ctx, "talkers", F.concat("host", F.lit(" talks")), F.lit(50), "Discovery", ("T1",), F.lit("why"), {"n": F.col("n")}, hosts=F.array("host")).withColumn("benign_causes", F.array(F.lit("none")))

    own = {"talkers": Hunt("Discovery", ("dns",), ("T1",), plan), "never": Hunt("Discovery", ("dns",), ("T2",), plan, lambda ctx: "not today")}
    result = hunt(week, simulated.example_config(), DAY, DAY + timedelta(days=1), hunts=own)
    assert result.ran == ["talkers"] and result.skipped == {"never": "not today"} and result.findings.count() > 0
    assert {r["hunt"] for r in coverage({"dns": 1}, hunts=own)["rows"]} == set(own)


def _country(ip, nets):
    return max(((n.prefixlen, -i, c) for i, (n, c) in enumerate(nets) if ip.version == n.version and ip in n), default=(0, 0, ""))[2]


def test_addresses_meet_networks_by_their_prefixes(spark):
    rng = random.Random(4)
    nets = [(ipaddress.ip_network((rng.getrandbits(32), rng.randrange(0, 33)), strict=False), f"c{i}") for i in range(150)] + [(ipaddress.ip_network("0.0.0.0/0"), "all")]
    nets += [(ipaddress.ip_network((rng.getrandbits(128), rng.randrange(0, 129)), strict=False), f"w{i}") for i in range(150)]
    nets += [(n, "again") for n, _ in nets[:50]]
    texts = {"", "junk", "1.2.3", "01.2.3.4", "256.1.1.1", "1.2.3.4\n", " 1.2.3.4", "1.2.3.4/8", "::", "::1", "1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "1:::2", "1::2::3"}
    texts |= {"::ffff:1.2.3.4", "64:ff9b::203.0.113.9", "::1.2.3", "1.2.3.4::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "fe80::1%a/b", "FE80::ABCD", "12345::", "g::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "10.1.2.3%x", "::\u0661", "\u0661.1.1.1"}
    for net, _ in nets:
        for step in (-1, 0, 1):
            n = min(max(int(net[0]) + step, 0), (1 << net.max_prefixlen) - 1)
            ip = ipaddress.ip_address(n) if net.version == 4 else ipaddress.IPv6Address(n)
            texts |= {str(ip), ip.exploded}
    asked = spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "ip string")
    settings = simulated.example_config(geo=tuple((str(n), c) for n, c in nets), allow_networks=("192.0.0.0/3", "8000::/2"))
    found = address_facts(asked, settings)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.ip: (r.internal, r.allowed, r.country) for r in found.collect()}
    assert len(got) == len(texts) + 1 and got.pop(None) == (False, False, "")
    inside = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")]
    for t, facts in got.items():
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            assert facts == (False, False, ""), t
            continue
        allowed = any(ip.version == n.version and ip in n for n in map(ipaddress.ip_network, settings.allow_networks))
        assert facts == (any(ip.version == n.version and ip in n for n in inside), allowed, _country(ip, nets)), t


def test_stored_days_tell_hunts_the_same_as_events(spark, week, tmp_path):
    store, settings = days.Baseline(spark, str(tmp_path / "b"), 2), simulated.example_config()
    noon = DAY + timedelta(hours=9, minutes=30)
    # Two batches that share days, one of them retried; the window's own day is stored too.
    for n in (0, 1, 1):
        store.add(week.where(F.pmod(F.xxhash64("id"), F.lit(2)) == n), f"b{n}")
    shown = lambda rows: sorted(map(tuple, rows.collect()))
    for start, since in ((noon, DAY - timedelta(days=3, hours=5)), (DAY, None), (noon, noon - timedelta(hours=2))):
        span = week.where(F.col("time") < F.lit(start)).where(F.lit(True) if since is None else F.col("time") >= F.lit(since))
        want, got = days.summaries(span), store.before(start, since, week)
        flat = lambda tables: reduce(DataFrame.unionByName, [days.merged(t, n).select(F.lit(n).alias("name"), "day", F.array(*days.KEYS[n]).alias("key"), "n", "volume") for n, t in tables.items()])
        assert shown(flat(got)) == shown(flat(want)), (start, since)
    plan = store.before(DAY, DAY - timedelta(days=2), week)["flows"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    # Events before the window are not read but for cut days.
    late = week.where(F.col("time") >= F.lit(DAY))
    only = ["exfiltration", "impossible_travel", "rare_process"]
    stored, plain = hunt(late, settings, DAY, DAY + timedelta(days=1), only=only, baseline=store), hunt(week, settings, DAY, DAY + timedelta(days=1), only=only)
    columns = [c for c in plain.findings.columns if c not in ("details", "benign_causes")]
    assert shown(stored.findings.select(columns)) == shown(plain.findings.select(columns))
    assert (stored.baseline_days, stored.baseline_events, stored.counts) == (plain.baseline_days, plain.baseline_events, plain.counts)
    empty = days.Baseline(spark, str(tmp_path / "none"))
    empty.add(week.where("false"), "b")
    assert all(t.count() == 0 for t in empty.before(DAY, None, week.where("false")).values())


def test_log_lines(capsys):
    logs.configure("INFO", as_json=True).info("token sk-ant-abcdefghijklmnopqrst seen")
    assert json.loads(capsys.readouterr().err)["text"] == "token [REDACTED] seen"
    logs.configure("INFO").warning("plain")
    assert "WARNING trailspark: plain" in capsys.readouterr().err


def test_hostile_text_stays_inside_its_cell():
    assert "|" not in report.code("a`b|c\nd") and report.cell("a|<b>") == "a\\|\\<b\\>"
    assert report.csv_safe("=1+1") == "'=1+1" and report.csv_safe("plain") == "plain"


def test_summaries_bring_no_new_numbers(found):
    assert report.grounded(lambda facts: f"{facts['findings']} findings")(found.facts) == f"{found.facts['findings']} findings"
    for bad in ("98765 findings", "", "x" * 2000):
        assert report.grounded(lambda facts, bad=bad: bad)(found.facts) == report.template_summary(found.facts)


@pytest.mark.parametrize("name", HUNTS)
def test_every_hunt_has_searches(name):
    t = Thresholds()
    assert detections.render(name, "spl", t) and detections.render(name, "kql", t) and detections.render(name, "sql", t)
    if name in detections.SIGMA:
        assert all(r["detection"]["condition"] == "selection" for r in yaml.safe_load_all(detections.render(name, "sigma", t)))
    else:
        with pytest.raises(ValueError):
            detections.render(name, "sigma", t)


def test_coverage_lists_blind_techniques():
    c = coverage({"flow": 3})
    assert {r["hunt"] for r in c["rows"] if r["runnable"]} == {"beaconing", "exfiltration"} and "T1071" in c["covered"] and "T1568.002" in c["blind"]


def test_configuration_files(tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    found = config.load(
        file("t.yaml", "beacon_min_connections: 20\n"), file("i.json", '{"ips": ["203.0.113.9", "junk"], "hashes": [" ABC "]}'), file("a.yaml", "destination_ips: [198.51.100.1/24]\n"),
        file("g.yaml", "- {cidr: 192.0.2.0/24, country: US}\n"), file("s.yaml", "suppressions:\n- {hunt: dga, entity: host, value: a, reason: long enough reason, approved_by: me, expires: 2027-01-01}\n"),
    )
    assert found.thresholds.beacon_min_connections == 20 and found.ioc_ips == ("203.0.113.9",) and found.ioc_hashes == ("abc",) and found.allow_networks == ("198.51.100.0/24",)
    assert found.geo == (("192.0.2.0/24", "US"),) and found.suppressions[0].expires == date(2027, 1, 1)
    for bad in ("beacon_min_connections: 1", "beacon_min_connections: x", "nothing: 1", "- a", ": ["):
        with pytest.raises(config.ConfigurationError):
            config.load(thresholds_file=file("bad.yaml", bad))
    with pytest.raises(config.ConfigurationError):
        config.load(geo_file=file("bad.yaml", "- {cidr: 192.0.2.0/99, country: US}"))
    assert config.duration("90m") == timedelta(minutes=90)
    for bad in ("0h", "5", "h", "1.5h"):
        with pytest.raises(config.ConfigurationError):
            config.duration(bad)
    assert config.Settings.read({"TRAILSPARK_MAX_EVENTS": "5"}).max_events == 5


LINES = {
    "sysmon": ['{"EventID": 1, "UtcTime": "2026-09-18T10:00:00Z", "Computer": "CORP\\\\WS-1", "Image": "C:\\\\a.exe", "CommandLine": "x --password hunter22"}', '{"EventID": 9, "UtcTime": "2026-09-18T10:00:00Z"}'],
    "auth": ['{"timestamp": 1789725600, "user": "Bob@x.org", "result": "OK", "src_ip": "192.0.2.1"}', '{"timestamp": 1789725600, "result": "maybe"}', "not json", "[1]", "", '{"timestamp": 1789725600, "user": "Bob@x.org", "result": "OK", "src_ip": "192.0.2.1"}'],
    "cloudtrail": ['{"eventTime": "2026-09-18T10:00:00Z", "eventName": "StopLogging", "userIdentity": {"type": "Root"}, "additionalEventData": {"MFAUsed": "No"}}'],
}


def test_ingest_accepts_rejects_and_keeps_the_first(spark, tmp_path):
    inputs = []
    for source, lines in LINES.items():
        (tmp_path / source).write_text("\n".join(lines) + "\n")
        inputs.append((source, str(tmp_path / source)))
    events, reports = ingest.load(spark, inputs)
    assert [(r["accepted"], r["rejected"], r["lines"]) for r in reports] == [(1, 1, 2), (1, 3, 5), (1, 0, 1)]
    rows = {r.source: r for r in events.collect()}
    assert rows["sysmon"].id.startswith("sysmon:") and rows["sysmon"].host == "ws-1" and "hunter22" not in rows["sysmon"].cmdline
    assert rows["auth"].user == "bob" and rows["auth"].outcome == "success" and rows["cloudtrail"].user == "root" and rows["cloudtrail"].mfa is False
    with pytest.raises(ingest.IngestError):
        ingest.load(spark, [("nothing", "x")])


def test_event_ids_are_digests_of_sorted_json(spark):
    lines = ['{"timestamp": 1789725600, "result": "ok", "user": "a"}', '{"result": "ok", "timestamp": 1.50, "user": "Ünï\u00e9"}', '{"timestamp": 1e3, "result": "ok", "x": [1.0, -0, {"b": null, "a": "\\t"}]}', '{ "z": true,\t"timestamp": "2026-09-18", "result": "failed", "ip": "192.0.2.1" }']
    rows = spark.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "value string, file string, place bigint")
    got = {r.place: r.id for r in ingest.adapted(rows, "auth").collect()}
    for i, line in enumerate(lines):
        plain = json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"))
        assert got[i] == "auth:" + hashlib.sha256(plain.encode()).hexdigest()[:14], line


ODD = [
    ("auth", '{"timestamp": true, "result": "ok"}', "no usable time"),
    ("auth", '{"timestamp": "yesterday", "result": "ok"}', "no usable time"),
    ("auth", '{"timestamp": "2026-02-30", "result": "ok"}', "no usable time"),
    ("dns", '{"timestamp": 5, "query": "no spaces here"}', "no usable query name"),
    ("flow", '{"timestamp": 5, "dst_ip": "192.0.2.01"}', "no usable destination address"),
    ("cloudtrail", '{"eventTime": 5}', "no event name"),
    ("sysmon", '{"EventID": 7, "UtcTime": 5}', "event id without an adapter"),
    ("generic", '{"time": 5, "kind": "flow", "dst_port": "80"}', "not a canonical event"),
    ("generic", '{"time": 5, "kind": "flow", "dst_port": 70000}', "not a canonical event"),
    ("generic", '{"time": 5, "kind": "flow", "other": 1}', "not a canonical event"),
    ("generic", '{"time": 5, "kind": "flow", "attrs": {"a": 1}}', "not a canonical event"),
    ("auth", '["a"]', "not a JSON object"),
    ("auth", "{", "not valid JSON"),
    ("auth", '{"timestamp": 5, "result": "ok", "pad": "' + "x" * 200 + '"}', "line exceeds 150 bytes"),
]


def test_rejects_and_their_reasons(spark):
    for source in sorted({s for s, _, _ in ODD}):
        mine = [(line, reason) for s, line, reason in ODD if s == source]
        rows = spark.createDataFrame([(line, "f", i) for i, (line, _) in enumerate(mine)], "value string, file string, place bigint")
        assert [r.reason for r in ingest.adapted(rows, source, 150).orderBy("place").collect()] == [reason for _, reason in mine]


def test_fields_of_every_format(spark):
    cases = {
        "sysmon": ('{"EventID": "3", "UtcTime": "2026-09-18 10:00:00.250", "Computer": "CORP\\\\Ws-1", "EventData": {"SourceIp": "FE80:0::1", "DestinationIp": "[192.0.2.1]", "DestinationPort": "443", "BytesSent": 12.7}}', {"kind": "flow", "host": "ws-1", "src_ip": "fe80::1", "dst_ip": "192.0.2.1", "dst_port": 443, "bytes_out": 12}),
        "auth": ('{"@timestamp": "2026-09-18T10:00:00+0200", "time": "", "account": "Eve@x.org", "status": "Denied", "client_ip": "junk", "logon_type": 3}', {"user": "eve", "outcome": "failure", "src_ip": "", "attrs": {"logon_type": "3"}}),
        "dns": ('{"time": 1789725600123, "qname": "A.Example.COM.", "qtype": "txt", "rcode": "nxdomain"}', {"domain": "a.example.com", "query_type": "TXT", "outcome": "failure"}),
        "flow": ('{"start": 1789725600, "destination_ip": "2001:DB8::0:1", "orig_bytes": "1e3", "dst_port": 99999, "protocol": "tcp"}', {"dst_ip": "2001:db8::1", "bytes_out": 1000, "dst_port": None, "attrs": {"proto": "tcp"}}),
        "cloudtrail": ('{"eventTime": 5, "eventName": "X", "errorCode": "Denied", "userIdentity": {"principalId": "P1", "sessionContext": {"attributes": {"mfaAuthenticated": "true"}}}}', {"user": "p1", "mfa": True, "outcome": "failure", "api": "X"}),
        "generic": ('{"time": 5, "kind": "process", "host": "WS-1", "cmdline": "x --password hunter22", "id": "own"}', {"id": "own", "host": "WS-1", "cmdline": "x --password [REDACTED]"}),
    }
    for source, (line, want) in cases.items():
        row = ingest.adapted(spark.createDataFrame([(line, "f", 0)], "value string, file string, place bigint"), source).first()
        assert row.reason == "" and {k: row[k] for k in want} == want, source


def test_command_line(spark, week, tmp_path, capsys):
    assert cli.main(["hunts"]) == 0 and cli.main(["query", "dga", "--lang", "kql"]) == 0 and cli.main(["coverage", "--kinds", "dns"]) == 0
    assert cli.main(["query", "dga", "--lang", "sigma"]) == 2
    ingest.write_lines(week.where(week.time >= DAY - timedelta(days=4)), str(tmp_path / "in"))
    common = ["hunt", "-i", f"generic={tmp_path}/in", "--hunt-start", "2026-09-18T00:00:00Z", "--only", "beaconing"]
    assert cli.main([*common, "--out", str(tmp_path / "out"), "--fail-on-lead", "medium"], spark) == 1
    assert "beaconing" in (tmp_path / "out/findings.csv").read_text()
    assert cli.main(["baseline", "-i", f"generic={tmp_path}/in", "--into", str(tmp_path / "days"), "--batch", "one"], spark) == 0
    assert cli.main([*common, "--baseline", str(tmp_path / "days"), "--fail-on-lead", "medium"], spark) == 1
    assert cli.main(["hunt", "-i", f"nothing={tmp_path}/in"], spark) == 2
    assert cli.main(["hunt", "-i", f"generic={tmp_path}/absent"], spark) == 2
    assert "error:" in capsys.readouterr().err
