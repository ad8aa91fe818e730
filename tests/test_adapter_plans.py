"""Records are read through a map of each object, with the values that single paths give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailspark.functions import records
from trailspark.sources import adapters, ingest

ODD = ['{"a":{"b":null,"c":[1,{"d":2}],"e":1.50,"f":""},"g":true}', '{"a":"text","g":null}', '{"a":[1],"g":{"x":{}}}', '{"a":{},"g":-0}', "{}", "[1]", '"s"', "null", "no JSON"]


def test_values_and_kinds_are_those_of_single_paths(spark):
    rows = spark.createDataFrame([(v,) for v in ODD], "value string").withColumn("record", F.try_parse_json("value"))
    reader = adapters.Reader()
    names = ("a", "a.b", "a.c", "a.e", "a.f", "a.x", "g", "g.x", "missing", "g.x.y")
    got = [reader.text(n) for n in names] + [reader.kind(n) for n in names]
    one = [F.try_variant_get("record", records.path(n), "string") for n in names] + [F.schema_of_variant(F.try_variant_get("record", records.path(n), "variant")) for n in names]
    for row in reader.onto(rows).select("value", F.array(got).alias("got"), F.array(one).alias("one")).collect():
        assert row.got == row.one, row.value


@pytest.mark.parametrize(("source", "most"), [("sysmon", 2), ("dns", 1), ("generic", 3), ("cloudtrail", 5)])
def test_each_object_is_opened_once(spark, capsys, source, most):
    lines = spark.range(3).select(F.concat(F.lit('{"a":'), "id", F.lit("}")).alias("value"), F.lit("f").alias("file"), F.col("id").alias("place"))
    ingest.adapted(lines, source).explain()
    assert 0 < capsys.readouterr().out.count("try_variant_get(") <= most
