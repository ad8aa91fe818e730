"""Column functions that read fields of raw JSON records held as variants."""

from __future__ import annotations

import hashlib
import ipaddress
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailspark.functions import text

MOST_ATTR, MOST_TEXT = 200, 4000
_MOST_LONG = float(1 << 63)
_NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?\s*$"


def path(name: str) -> str:
    """The variant path of a dotted name, of the record itself for an empty one; a part may hold any character but a dot or a quote."""
    return "$" + "".join(f"['{part}']" for part in name.split(".") if part)


def moment(value: Column) -> Column:
    """The time of epoch seconds, of epoch milliseconds (numbers above 1e11), or of an ISO date or time; UTC without a zone."""
    number = F.when(value.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), value.try_cast("double"))
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    # Up to the year 9999.
    from_number = F.when(seconds < 253_402_300_800, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
    plain = F.regexp_replace(F.trim(value), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    is_time = plain.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ][0-9]{2}:[0-9]{2}.*)?$")
    zoned = F.when(F.length(plain) == 10, F.concat(plain, F.lit("T00:00:00Z"))).when(plain.rlike(r"(Z|z|[+-][0-9]{2}:[0-9]{2})$"), F.upper(plain)).otherwise(F.concat(F.upper(plain), F.lit("Z")))
    return F.when(number.isNotNull(), from_number).when(is_time, zoned.try_cast("timestamp"))


@F.pandas_udf(StringType())
def _canonical_ipv6(values: pd.Series) -> pd.Series:
    """The short form of IPv6 addresses: their zero runs are beyond column functions. Null for anything else."""

    def short(value: str) -> str | None:
        try:
            return str(ipaddress.IPv6Address(value))
        except ValueError:
            return None

    return values.map(short, na_action="ignore")


#: What Python's sorted, compact, ASCII-only JSON writes otherwise than Spark: characters beyond printable ASCII, escapes,
#: and numbers with a point, an exponent or a negative zero.
_ODD_JSON = r"[^ -~]|\\|[:\[,]\s*-?[0-9]+[.eE]|[:\[,]\s*-0"


@F.pandas_udf(StringType())
def _python_digest(lines: pd.Series) -> pd.Series:
    def of(line: str) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(line), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except (ValueError, RecursionError):
            return None

    return lines.map(of, na_action="ignore")


def digest(line: Column, record: Column) -> Column:
    """SHA-256 of a record's sorted, compact, ASCII-only JSON, in hex. Spark writes that text for most records; the lines
    that it would write differently go through Python."""
    odd = _python_digest(F.when(line.rlike(_ODD_JSON), line))
    return F.coalesce(odd, F.sha2(F.to_json(record), 256))


def address(value: Column) -> Column:
    """A valid address in its canonical form, else an empty text."""
    plain = F.regexp_replace(F.trim(value), r"^\[+|\]+$", "")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    wide = _canonical_ipv6(F.when(F.contains(plain, F.lit(":")), plain))
    return F.coalesce(F.when(plain.rlike(rf"^({octet}\.){{3}}{octet}$"), plain), wide, F.lit(""))


def _whole(value: Column, below: float) -> Column:
    number = F.when(value.rlike(_NUMBER), value.try_cast("double"))
    return F.when((number >= 0) & (number < below), F.coalesce(value.try_cast("bigint"), number.cast("bigint")))


def read(value: Column, how: str) -> Column:
    """A text as a field of the kind `how`; texts default to an empty one, numbers to null."""
    known = F.coalesce(value, F.lit(""))
    match how:
        case "time":
            return moment(value)
        case "name":
            return text.normal_name(known)
        case "address":
            return address(value)
        case "domain":
            return F.coalesce(text.normal_domain(value), F.lit(""))
        case "port":
            return _whole(value, 65536.0).cast("int")
        case "count":
            return _whole(value, _MOST_LONG)
        case "program":
            return F.substring(text.redact(known), 1, 500)
        case "command":
            return F.substring(text.redact(known), 1, MOST_TEXT)
        case "upper":
            return F.upper(known)
        case "plain":
            return known
    raise ValueError(f"unknown kind of field {how!r}")


def attributes(values: Mapping[str, Column]) -> Column:
    """A map of the values that are there, cut at MOST_ATTR characters."""
    if not values:
        return F.create_map().cast("map<string,string>")
    every = F.create_map(*[x for key, value in values.items() for x in (F.lit(key), F.substring(value, 1, MOST_ATTR))])
    return F.map_filter(every, lambda _, v: v.isNotNull())
