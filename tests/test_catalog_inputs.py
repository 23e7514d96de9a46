"""What Spark builds in place of an input's text has the rows of that text."""

from __future__ import annotations

import pytest
from pyspark.testing import assertDataFrameEqual

import fleetlens.registry.catalog  # noqa: F401
from fleetlens.registry import inputs

ROWS = [
    # order, part, supplier, line, quantity, discount, tax, return flag, line status
    *((o, p, s, n, q, 0.09, 0.005, rf, ls) for o, p, s, n, q, rf, ls in [
        (1, 5, 1, 1, 2.0, "A", "O"), (98, 5, 1, 1, 50.0, "A", "F"), (1, 0, 1, 2, 8.0, "A", "O"), (1, 6, 1, 7, 46.0, "N", "O"),
        (-3, -1, 2, 3, 41.0, "N", "F"), (-100, -7, 2, 3, 49.0, "N", "F"), (4, 4, -2, 6, 46.0, "R", "O"), (4, 10, -2, 6, 1.0, "R", "O"),
    ]),
    (None, 3, 1, 1, 5.0, 0.01, 0.0, "A", "F"), (2, None, 1, 2, 5.0, 0.01, 0.0, "A", "O"), (2, None, 1, 2, None, None, 0.02, "A", "O"),
    (3, 3, None, 4, 5.0, 0.01, 0.07, "N", "F"), (3, 3, None, 4, 6.0, 0.06, 0.07, "N", "F"), (3, 5, 3, None, 6.0, 0.06, 0.01, "N", "F"),
    (3, 5, 3, 5, 6.0, 0.06, 0.01, None, None), (3, 5, 3, 5, 6.0, 0.06, None, "R", "O"),
]


@pytest.mark.parametrize("name", sorted(inputs._BUILT))
def test_built_rows_are_those_of_the_text(spark, name):
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus".split()
    kinds = "bigint bigint bigint int double double double string string".split()
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    known = {"lineitem": spark.createDataFrame(ROWS, schema)}

    def read(name: str, built: bool):
        if name not in known:
            text = inputs.INPUTS[name]
            if built:
                text = inputs._BUILT[name]
            return spark.sql(text, **{ref: read(ref, False) for ref in inputs._references(text)})
        return known[name]

    expected, found = read(name, False), read(name, True)
    assert found.dtypes == expected.dtypes
    assertDataFrameEqual(found, expected)
    assert expected.count() > 0


@pytest.mark.parametrize("name", sorted(inputs._BUILT))
def test_no_text_is_grouped(spark, name):
    """Texts are written after the shuffle, so that only numbers go through it."""
    assert not any(part.strip().startswith(("app_id", "table_id")) for part in inputs._BUILT[name].split("GROUP BY")[1:])
