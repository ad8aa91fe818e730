"""Column functions over names, domains and free text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes under which names are registered one level deeper.
TWO_LEVEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")

# Patterns of credentials that are replaced whole, in this order.
SECRET_PATTERNS = (
    r"sk-ant-[A-Za-z0-9_\-]{16,}",
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}",
    r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
)
# A command-line flag with its secret, and a key with its value.
FLAG_SECRET = r"(?iuUd)((?:--?)(?:password|passwd|pwd|pass|token|secret|apikey|api-key))([\s=:]+)((?!\[REDACTED\])[^\s'\"]+)"
KEY_SECRET = r"(?iuUd)((?:^|[\s\"'/-])(?:password|passwd|pwd|secret|api[_-]?key|token)\b\s*[:=])\s*['\"]?(?!\[REDACTED\])[^\s'\",;]{4,}"
DOMAIN = r"^(?=.{1,253}$)([a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?\.)+[a-z0-9-]{2,63}$"


def entropy(text: Column) -> Column:
    """Shannon entropy of a text in bits a character; 0 for an empty one."""
    chars = F.split(text, "")
    n = F.length(text)
    terms = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def registered_domain(name: Column) -> Column:
    """The registrable part: the last two labels, or three under a two-level suffix."""
    labels = F.split(F.rtrim(F.lower(name), F.lit(".")), r"\.")
    count = F.size(labels)
    last_two = F.array_join(F.slice(labels, F.greatest(count - 1, F.lit(1)), 2), ".")
    last_three = F.array_join(F.slice(labels, F.greatest(count - 2, F.lit(1)), 3), ".")
    return F.when((count >= 3) & last_two.isin(*TWO_LEVEL_SUFFIXES), last_three).otherwise(last_two)


def subdomain(name: Column, registered: Column) -> Column:
    """What stands before the registered part, without the dot between."""
    return F.rtrim(F.substring(name, F.lit(1), F.length(name) - F.length(registered)), F.lit("."))


def redact(text: Column) -> Column:
    """Credential-shaped substrings replaced; flags and keys keep their name."""
    text = F.regexp_replace(text, FLAG_SECRET, "$1$2[REDACTED]")
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return F.regexp_replace(text, KEY_SECRET, "$1 [REDACTED]")


def redacted(value: str) -> str:
    """The same for a text of the driver, such as an error message."""
    value = re.sub(FLAG_SECRET.replace("(?iuUd)", "(?i)"), r"\1\2[REDACTED]", value)
    for pattern in SECRET_PATTERNS:
        value = re.sub(pattern, "[REDACTED]", value)
    return re.sub(KEY_SECRET.replace("(?iuUd)", "(?i)"), r"\1 [REDACTED]", value)


def image(process: Column) -> Column:
    """The lower-case file name of a program path."""
    return F.lower(F.substring_index(F.translate(process, "\\", "/"), "/", -1))


def normal_domain(name: Column) -> Column:
    """Lower case without trailing dots; null if it isn't a plausible name."""
    plain = F.rtrim(F.lower(F.trim(name)), F.lit("."))
    return F.when(plain.rlike(DOMAIN), plain)


def normal_name(name: Column) -> Column:
    """A host or user name without domain prefix or mail suffix, lower-case."""
    return F.substring_index(F.substring_index(F.lower(F.trim(name)), "\\", -1), "@", 1)


def describe() -> Column:
    """One line about a canonical event, by its kind."""
    source = F.when(F.col("src_ip") == "", "unknown").otherwise(F.col("src_ip"))
    size = F.when(F.col("bytes_out").isNull(), "").otherwise(F.concat(F.lit(" "), F.col("bytes_out").cast("string"), F.lit(" bytes")))
    logon = F.coalesce(F.try_element_at("attrs", F.lit("logon_type")), F.lit(""))
    line = (
        F.when(F.col("kind") == "process", F.substring(F.trim(F.concat_ws(" ", image(F.col("process")), "cmdline")), 1, 200))
        .when(F.col("kind") == "flow", F.concat(F.lit("connect "), "dst_ip", F.lit(":"), F.coalesce(F.col("dst_port").cast("string"), F.lit("None")), size))
        .when(F.col("kind") == "dns", F.concat_ws(" ", F.lit("query"), "domain", "query_type", F.when(F.col("outcome") == "failure", "NXDOMAIN").otherwise("")))
        .when(F.col("kind") == "auth", F.concat_ws(" ", F.lit("sign-in"), "outcome", F.lit("from"), source, F.lit("logon"), logon))
    )
    mfa = F.initcap(F.coalesce(F.col("mfa").cast("string"), F.lit("None")))
    return F.trim(F.coalesce(line, F.concat(F.col("api"), F.lit(" "), F.col("outcome"), F.lit(" from "), source, F.lit(" mfa="), mfa)))


def csv_safe(text: Column) -> Column:
    """A leading quote for cells that a spreadsheet would run."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def slug(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", "item").otherwise(plain)
