"""Configuration files, settings from the environment, and durations."""

from __future__ import annotations

import ipaddress
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import date, datetime, timedelta, timezone
from typing import Any

import yaml

from trailspark.errors import ConfigurationError
from trailspark.functions.text import DOMAIN
from trailspark.schema import HuntConfig, Suppression, Thresholds
from trailspark.sources.ingest import MOST_BYTES, MOST_LINES

MOST_FILE_BYTES = 2_000_000
PREFIX = "TRAILSPARK_"
_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


@dataclass(frozen=True)
class Settings:
    """Defaults that the environment may set, e.g. TRAILSPARK_IOCS_FILE."""

    thresholds_file: str = ""
    iocs_file: str = ""
    allowlist_file: str = ""
    geo_file: str = ""
    suppressions_file: str = ""
    max_line_bytes: int = MOST_BYTES
    max_events: int = MOST_LINES

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            value = env.get(PREFIX + f.name.upper(), "")
            if value:
                try:
                    found[f.name] = int(value) if isinstance(f.default, int) else value
                except ValueError:
                    raise ConfigurationError(f"{PREFIX}{f.name.upper()} must be a whole number") from None
        return cls(**found)


def duration(text: str) -> timedelta:
    """90m, 24h, 7d; zero is none."""
    found = re.fullmatch(r"([1-9][0-9]*)([mhd])", text.strip())
    if not found:
        raise ConfigurationError(f"{text!r} is no duration; write a number and m, h or d, such as 24h")
    return timedelta(**{_UNITS[found[2]]: int(found[1])})


def _document(path: str) -> Any:
    """JSON is read as YAML too."""
    name = os.path.basename(path)
    try:
        if os.path.getsize(path) > MOST_FILE_BYTES:
            raise ConfigurationError(f"{name} is larger than {MOST_FILE_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigurationError(f"cannot read {name}: {e}") from e


def _fields(path: str | None, allowed: tuple[str, ...]) -> dict[str, Any]:
    """A mapping of known names."""
    if not path:
        return {}
    found = _document(path)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigurationError(f"{os.path.basename(path)} must hold a mapping")
    if unknown := set(found) - set(allowed):
        raise ConfigurationError(f"{os.path.basename(path)} has unknown fields {sorted(map(str, unknown))}")
    return found


def _texts(found: dict[str, Any], name: str) -> list[str]:
    values = found.get(name) or []
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise ConfigurationError(f"{name} must be a list of texts")
    return values


def _entries(path: str | None, name: str) -> list[dict]:
    """A list of mappings, bare or under a name."""
    if not path:
        return []
    found = _document(path)
    found = found.get(name) if isinstance(found, dict) else found
    if not isinstance(found or [], list) or not all(isinstance(e, dict) for e in found or []):
        raise ConfigurationError(f"{os.path.basename(path)} must hold a list of {name}")
    return found or []


def _address(value: str) -> str:
    """The canonical form, empty for what is no address."""
    try:
        return str(ipaddress.ip_address(value.strip().strip("[]")))
    except ValueError:
        return ""


def _domain(value: str) -> str:
    plain = value.strip().lower().rstrip(".")
    return plain if re.match(DOMAIN, plain) else ""


def moment(value: str) -> datetime:
    """The UTC time of an ISO text, which is in UTC unless it names a zone."""
    try:
        at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ConfigurationError(f"invalid time {value!r}") from e
    return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _network(text: Any) -> str:
    try:
        return str(ipaddress.ip_network(str(text).strip(), strict=False))
    except ValueError:
        raise ConfigurationError(f"{text!r} is neither an address nor a network") from None


def thresholds(path: str | None) -> Thresholds:
    kinds = {f.name: type(f.default) for f in fields(Thresholds)}
    found = _fields(path, tuple(kinds))
    for name, value in found.items():
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        if isinstance(value, bool) or not isinstance(value, (int, float)) or kinds[name] is int and not whole:
            raise ConfigurationError(f"threshold {name} must be a {'whole ' * (kinds[name] is int)}number")
    try:
        return Thresholds(**{n: kinds[n](v) for n, v in found.items()})
    except ValueError as e:
        raise ConfigurationError(str(e)) from e


def _suppression(entry: dict) -> Suppression:
    try:
        expires = entry["expires"]
        expires = expires if isinstance(expires, date) else date.fromisoformat(str(expires))
        if entry["entity"] not in ("host", "user", "ip", "domain"):
            raise ValueError("entity must be host, user, ip or domain")
        return Suppression(str(entry.get("hunt", "*")), entry["entity"], str(entry["value"]), str(entry["reason"]), str(entry["approved_by"]), expires)
    except KeyError as e:
        raise ConfigurationError(f"a suppression lacks {e.args[0]}") from None
    except ValueError as e:
        raise ConfigurationError(f"invalid suppression: {e}") from e


def load(thresholds_file: str | None = None, iocs_file: str | None = None, allowlist_file: str | None = None, geo_file: str | None = None, suppressions_file: str | None = None) -> HuntConfig:
    """Every file is optional. Indicators that are no address or name are left out; a bad network or field is an error."""
    iocs = _fields(iocs_file, ("ips", "domains", "hashes"))
    allow = _fields(allowlist_file, ("destination_ips", "destination_domains", "scanner_ips", "trusted_processes", "noisy_users"))
    geo = []
    for entry in _entries(geo_file, "ranges"):
        if not re.fullmatch("[A-Z]{2}", str(entry.get("country"))):
            raise ConfigurationError("a country must be two capital letters")
        geo.append((_network(entry.get("cidr")), entry["country"]))
    return HuntConfig(
        thresholds=thresholds(thresholds_file),
        ioc_ips=tuple(ip for v in _texts(iocs, "ips") if (ip := _address(v))),
        ioc_domains=tuple(d for v in _texts(iocs, "domains") if (d := _domain(v))),
        ioc_hashes=tuple(h for v in _texts(iocs, "hashes") if (h := v.strip().lower())),
        allow_networks=tuple(map(_network, _texts(allow, "destination_ips"))),
        allow_domains=tuple(d.lower().lstrip(".") for d in _texts(allow, "destination_domains")),
        scanner_ips=tuple(ip for v in _texts(allow, "scanner_ips") if (ip := _address(v))),
        trusted_processes=tuple(p.lower() for p in _texts(allow, "trusted_processes")),
        noisy_users=tuple(u.lower() for u in _texts(allow, "noisy_users")),
        geo=tuple(geo),
        suppressions=tuple(map(_suppression, _entries(suppressions_file, "suppressions"))),
    )
