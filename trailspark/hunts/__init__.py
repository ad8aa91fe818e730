"""The hunts: each turns a context of window and baseline events into a DataFrame of findings.

To add one, write a plan that ends in context.findings(), wrap it in a Hunt, and pass `{**HUNTS, name: Hunt(...)}` as
`hunts` to engine.hunt(); searches for it are optional (plans/detections.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from trailspark.hunts import cloud, endpoint, identity, network
from trailspark.hunts.context import Context


@dataclass(frozen=True)
class Hunt:
    """A plan, the event kinds that it can't do without, and what its findings are about."""

    tactic: str
    needs: tuple[str, ...]
    techniques: tuple[str, ...]
    plan: Callable[[Context], DataFrame]
    #: Why the hunt can't run although its events are there, else an empty text.
    unavailable: Callable[[Context], str] = lambda ctx: ""


def _techniques(rules: tuple[endpoint.ProcessRule, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for rule in rules for t in rule.techniques))


def _no_geo(ctx: Context) -> str:
    return "" if ctx.config.geo else "no geolocation ranges configured"


def _no_process_history(ctx: Context) -> str:
    return "no baseline process events" if ctx.baseline["programs"].isEmpty() else ""


HUNTS = {
    "beaconing": Hunt("Command and Control", ("flow",), ("T1071", "T1573"), network.beaconing),
    "dns_tunnel": Hunt("Command and Control", ("dns",), ("T1071.004", "T1048.003"), network.dns_tunnel),
    "dga": Hunt("Command and Control", ("dns",), ("T1568.002",), network.dga),
    "exfiltration": Hunt("Exfiltration", ("flow",), ("T1041", "T1048"), network.exfiltration),
    "password_attacks": Hunt("Credential Access", ("auth",), ("T1110.003", "T1110.001"), identity.password_attacks),
    "impossible_travel": Hunt("Initial Access", ("auth",), ("T1078",), identity.impossible_travel, _no_geo),
    "lateral_fanout": Hunt("Lateral Movement", ("auth",), ("T1021.001", "T1021.002", "T1078"), identity.lateral_fanout),
    "process_chains": Hunt("Execution", ("process",), _techniques(endpoint.EXECUTION_RULES), endpoint.process_chains),
    "persistence": Hunt("Persistence", ("process",), _techniques(endpoint.PERSISTENCE_RULES), endpoint.persistence),
    "rare_process": Hunt("Defense Evasion", ("process",), ("T1036", "T1204"), endpoint.rare_process, _no_process_history),
    "cloud_abuse": Hunt("Persistence", ("cloud",), ("T1078.004", "T1098", "T1136.003", "T1562.008", "T1526", "T1580"), cloud.cloud_abuse),
}
