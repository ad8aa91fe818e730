"""The library's functions for SQL users: the same definitions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trailspark.functions.text import FLAG_SECRET, KEY_SECRET, SECRET_PATTERNS, TWO_LEVEL_SUFFIXES


def literal(text: str) -> str:
    """A text as an SQL string."""
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _redact(column: str) -> str:
    out = f"regexp_replace({column}, {literal(FLAG_SECRET)}, '$1$2[REDACTED]')"
    for pattern in SECRET_PATTERNS:
        out = f"regexp_replace({out}, {literal(pattern)}, '[REDACTED]')"
    return f"regexp_replace({out}, {literal(KEY_SECRET)}, '$1 [REDACTED]')"


_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LEVEL_SUFFIXES)


def entropy(value: str) -> str:
    """text.entropy() as an SQL expression."""
    return f"CASE WHEN length({value}) > 0 THEN aggregate(transform(array_sort(array_distinct(split({value}, ''))), c -> size(filter(split({value}, ''), x -> x = c)) / length({value})), 0D, (sum, p) -> sum - p * log2(p)) ELSE 0D END"


def registered_domain(name: str) -> str:
    """text.registered_domain() as an SQL expression."""
    plain = f"rtrim('.', lower({name}))"
    return f"CASE WHEN size(split({plain}, '[.]')) >= 3 AND substring_index({plain}, '.', -2) IN ({_SUFFIXES}) THEN substring_index({plain}, '.', -3) ELSE substring_index({plain}, '.', -2) END"


FUNCTIONS = {
    "text_entropy(value STRING) RETURNS DOUBLE": entropy("value"),
    "registered_domain(name STRING) RETURNS STRING": registered_domain("name"),
    "redact_secrets(value STRING) RETURNS STRING": _redact("value"),
}


def register(spark: SparkSession) -> None:
    """text_entropy(value), registered_domain(name) and redact_secrets(value) as temporary functions."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
