"""The canonical event, thresholds and fixed orders."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import date

EVENT_SCHEMA = (
    "id string, time timestamp, kind string, source string, host string, user string, process string, parent string, cmdline string, "
    "outcome string, src_ip string, dst_ip string, dst_port int, bytes_out bigint, domain string, query_type string, api string, mfa boolean, attrs map<string,string>"
)
KINDS = ("process", "auth", "dns", "flow", "cloud")

# The order of tactics along an intrusion.
TACTICS = ("Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact")


@dataclass(frozen=True)
class Thresholds:
    beacon_min_connections: int = 12
    beacon_max_jitter: float = 0.2
    beacon_min_interval_seconds: int = 20
    dns_min_subdomains: int = 25
    dns_min_entropy: float = 3.4
    dns_min_label_length: int = 18
    dga_min_nxdomain: int = 15
    spray_min_users: int = 8
    spray_window_minutes: int = 30
    spray_max_attempts_per_user: int = 3
    bruteforce_min_failures: int = 10
    travel_window_hours: float = 3.0
    fanout_min_hosts: int = 5
    fanout_window_minutes: int = 30
    exfil_min_bytes: int = 50_000_000
    exfil_min_zscore: float = 3.0
    rare_max_hosts: int = 2
    enumeration_min_apis: int = 6
    enumeration_window_minutes: int = 10
    off_hours_start: int = 22
    off_hours_end: int = 6
    lead_window_hours: int = 24

    #: The least value of each threshold, where it is not merely above zero.
    LEAST = {"beacon_min_connections": 3, "dns_min_subdomains": 2, "dns_min_label_length": 4, "dga_min_nxdomain": 2, "spray_min_users": 2, "bruteforce_min_failures": 3, "fanout_min_hosts": 2, "enumeration_min_apis": 2}

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.startswith("off_hours"):
                ok = 0 <= value <= 23
            else:
                ok = value >= self.LEAST[f.name] if f.name in self.LEAST else value > 0
            if not ok:
                raise ValueError(f"threshold {f.name} is out of range")


@dataclass(frozen=True)
class Suppression:
    """A reviewed reason to leave out findings of a hunt (or `*`) about an entity, through a date."""

    hunt: str
    entity: str
    value: str
    reason: str
    approved_by: str
    expires: date

    def __post_init__(self) -> None:
        if not 10 <= len(self.reason) <= 300 or not 1 <= len(self.approved_by) <= 100:
            raise ValueError("a suppression needs a reason of 10 to 300 characters and an approver")


@dataclass(frozen=True)
class HuntConfig:
    thresholds: Thresholds = field(default_factory=Thresholds)
    ioc_ips: tuple[str, ...] = ()
    ioc_domains: tuple[str, ...] = ()
    ioc_hashes: tuple[str, ...] = ()
    allow_networks: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    scanner_ips: tuple[str, ...] = ()
    trusted_processes: tuple[str, ...] = ()
    noisy_users: tuple[str, ...] = ()
    #: (network, two-letter country)
    geo: tuple[tuple[str, str], ...] = ()
    suppressions: tuple[Suppression, ...] = ()
