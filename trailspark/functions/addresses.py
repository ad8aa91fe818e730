"""Column functions over IP addresses of both versions: what Python's ipaddress accepts, without Python."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"({OCTET}\.){{3}}{OCTET}"
_GROUPS = r"^([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?\z"
HEX = "0123456789abcdef"


def _ipv4_digits(value: Column) -> Column:
    return F.array_join(F.transform(F.split(value, r"\."), lambda octet: F.lpad(F.lower(F.hex(octet.try_cast("int"))), 2, "0")), "")


def digits(value: Column) -> Column:
    """The hexadecimal digits of an address, 8 or 32, without a scope; null for anything else."""
    plain = F.when(value.rlike(r"^[^%/]*(%[^%/]+)?\z"), F.substring_index(value, "%", 1))
    # An IPv4 tail is two groups.
    tail = _ipv4_digits(F.regexp_extract(plain, rf":({IPV4})\z", 1))
    plain = F.when(plain.rlike(rf":{IPV4}\z"), F.concat(F.regexp_replace(plain, r"[0-9.]+\z", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(plain)
    sides = F.split(plain, "::")
    groups = F.transform(sides, lambda side: F.filter(F.split(side, ":"), lambda x: x != ""))
    count = F.size(F.flatten(groups))
    fits = F.forall(sides, lambda side: side.rlike(_GROUPS)) & (((F.size(sides) == 1) & (count == 8)) | ((F.size(sides) == 2) & (count <= 7)))
    texts = F.transform(groups, lambda side: F.array_join(F.transform(side, lambda x: F.lpad(F.lower(x), 4, "0")), ""))
    wide = F.concat(texts[0], F.repeat(F.lit("0000"), 8 - count), F.coalesce(F.try_element_at(texts, F.lit(2)), F.lit("")))
    return F.when(value.rlike(rf"^{IPV4}\z"), _ipv4_digits(value)).when(F.contains(value, F.lit(":")) & fits, wide)


def network_key(network: ipaddress.IPv4Network | ipaddress.IPv6Network) -> str:
    """The key that addresses of a network have under prefix_key() for its version and length."""
    whole = f"{int(network.network_address):0{network.max_prefixlen // 4}x}"
    return f"{network.version}/{network.prefixlen}:{whole[: -(-network.prefixlen // 4)]}"


def prefix_key(of: Column, version: int, length: int) -> Column:
    """A key that the addresses of one network of this length share, from their digits()."""
    whole, part = divmod(length, 4)
    key = [F.lit(f"{version}/{length}:"), F.substring(of, 1, whole)]
    if part:
        kept = "".join(f"{i & (16 - (1 << (4 - part))):x}" for i in range(16))
        key.append(F.translate(F.substring(of, whole + 1, 1), HEX, kept))
    return F.concat(*key)
