"""Command line: hunts, hunt, baseline, coverage, query. Exit codes: 0, 1 for a lead beyond --fail-on-lead, 2 for errors."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from trailspark import config as configuration
from trailspark import logs
from trailspark.functions.scores import SEVERITIES
from trailspark.functions.text import redacted
from trailspark.hunts import HUNTS
from trailspark.hunts.baseline import Baseline
from trailspark.plans import detections, report
from trailspark.plans.engine import coverage
from trailspark.schema import KINDS
from trailspark.service import FILES, HuntService, build_service

LOG = logging.getLogger("trailspark.cli")


def _input(text: str) -> tuple[str, str]:
    source, mark, path = text.partition("=")
    if not mark or not path:
        raise argparse.ArgumentTypeError("use FORMAT=PATH")
    return source, path


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="trailspark", description=__doc__)
    parser.add_argument("--log-level", default="WARNING", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    parser.add_argument("--log-json", action="store_true", help="log lines as JSON")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("hunts", help="list the hunts")
    run = commands.add_parser("hunt", help="hunt in telemetry")
    run.add_argument("--input", "-i", type=_input, action="append", required=True, metavar="FORMAT=PATH")
    for name in FILES:
        run.add_argument(f"--{name}")
    run.add_argument("--window", default="24h")
    run.add_argument("--hunt-start", help="default: the window ends just after the newest event")
    run.add_argument("--baseline-days", type=int)
    run.add_argument("--baseline", metavar="DIR", help="read the days before from these stored tables")
    run.add_argument("--only", action="append", metavar="HUNT")
    run.add_argument("--out", help="folder for the report, findings, searches and rules")
    run.add_argument("--format", default="md,json")
    run.add_argument("--tables", help="folder for the whole result, written by Spark")
    run.add_argument("--no-rules", action="store_true", help="no searches beside the report")
    run.add_argument("--fail-on-lead", choices=SEVERITIES)
    store = commands.add_parser("baseline", help="summarise telemetry into stored tables of days")
    store.add_argument("--input", "-i", type=_input, action="append", required=True, metavar="FORMAT=PATH")
    store.add_argument("--into", required=True, metavar="DIR")
    store.add_argument("--batch", required=True, help="name of these inputs; adding it again replaces it")
    cover = commands.add_parser("coverage", help="which hunts have their data")
    cover.add_argument("--input", "-i", type=_input, action="append", metavar="FORMAT=PATH")
    cover.add_argument("--kinds", default="", help=f"comma list instead of files: {','.join(KINDS)}")
    query = commands.add_parser("query", help="a hunt as SPL, KQL, Sigma rules or Spark SQL")
    query.add_argument("hunt")
    query.add_argument("--lang", choices=detections.LANGUAGES, default="spl")
    query.add_argument("--thresholds")
    return parser


def _load(service: HuntService, inputs: Sequence[tuple[str, str]]) -> DataFrame:
    events, reports = service.load(inputs)
    for r in reports:
        LOG.info("loaded %d %s events, %d rejected: %s", r["accepted"], r["source"], r["rejected"], "; ".join(r["errors"]))
    return events


def _hunt(args: argparse.Namespace, service: HuntService) -> int:
    start = configuration.moment(args.hunt_start) if args.hunt_start else None
    result = service.hunt(_load(service, args.input), configuration.duration(args.window), start, args.baseline_days, args.only, baseline=Baseline(service.spark, args.baseline) if args.baseline else None)
    if args.tables:
        report.tables(result, args.tables)
    found = report.collect(result)
    formats = [f.strip() for f in args.format.split(",") if f.strip()]
    if args.out:
        for path in report.write(found, args.out, service.config.thresholds, formats, not args.no_rules):
            print(f"wrote {path}")
        print(found.summary)
    else:
        print(report.as_json(found) if formats == ["json"] else report.markdown(found))
    if args.fail_on_lead:
        serious = SEVERITIES[: SEVERITIES.index(args.fail_on_lead) + 1]
        return int(any(lead["severity"] in serious for lead in found.leads))
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    logs.configure(args.log_level, args.log_json)
    try:
        if args.command == "hunts":
            for name, h in HUNTS.items():
                print(f"{name:<18} {h.tactic:<22} {','.join(h.needs):<9} {', '.join(h.techniques)}")
            return 0
        settings = configuration.Settings.read()
        if args.command == "query":
            print(detections.render(args.hunt, args.lang, configuration.thresholds(args.thresholds or settings.thresholds_file or None)))
            return 0
        if args.command == "coverage" and not args.input:
            kinds = {k.strip(): 1 for k in args.kinds.split(",") if k.strip()}
            print(report.coverage_text(kinds, coverage(kinds)))
            return 0
        if args.command == "baseline":
            service = build_service(spark, settings)
            Baseline(service.spark, args.into).add(_load(service, args.input), args.batch)
            return 0
        if args.command == "coverage":
            service = build_service(spark, settings)
            kinds, found = service.coverage(_load(service, args.input))
            print(report.coverage_text(kinds, found))
            return 0
        return _hunt(args, build_service(spark, settings, **{n: getattr(args, n) for n in FILES}))
    except (ValueError, PySparkException) as e:
        print(f"error: {redacted(str(e))}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
