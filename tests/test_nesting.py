"""Statements and checks nested deeper than any fixed number of rounds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.generate import recognize_checks
from fleetlens.operators.statements import statement_class, where_terms
from fleetlens.sources.capture import parse_capture_lines


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 40])
def test_any_depth(spark, depth):
    left, right = "(" * depth, ")" * depth
    row = spark.range(1).select(
        statement_class(F.lit(f"with a as (select {left}1{right} ) insert into t select 1")).alias("kind"),
        where_terms(F.lit(f"select 1 from t where {left}a = $1{right} and c = $2")).alias("terms"),
        where_terms(F.lit(f"select 1 from t where {left}a = $1 or b = $2{right} and c = $3")).alias("others"),
    )
    kind, terms, others = row.first()
    assert kind == "write" and terms == ["a = $1", "c = $2"]
    assert [t for t in others if t.startswith("c")] == ["c = $3"] and not any(t[0] in "ab" for t in others)
    checks = [f"({left}qty{right} > 3)", f"{left}qty > 3{right}", f"{left}(qty >= 1) AND (qty <= 5){right}"]
    found = recognize_checks(spark.createDataFrame([(c,) for c in checks], "expression string")).collect()
    assert [(r.check_column, r.check_kind) for r in found] == [("qty", "range")] * 3


def test_blank_lines_are_not_malformed(spark):
    lines = spark.createDataFrame([("",), ("  ",), ("\t",), (" ",), ("{",)], "value string")
    assert [r.value for r in parse_capture_lines(lines).collect()] == ["{"]
