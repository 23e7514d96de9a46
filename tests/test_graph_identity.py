"""What the identity of a schema graph covers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.registry import catalog

NODES = [
    ("app", "schema:public", "schema", "public", {}),
    ("app", "table:public.t", "table", "t", {"schema": "public"}),
    ("app", "column:public.t.c", "column", "c", {"data_type": "bigint", "nullable": "true"}),
]
EDGES = [("app", "e", "contains", "table:public.t", "column:public.t.c", None)]


def identity(spark, sf_dir, monkeypatch, nodes):
    frames = (
        spark.createDataFrame(nodes, "app_id string, node_id string, kind string, label string, attributes map<string,string>"),
        spark.createDataFrame(EDGES, "app_id string, edge_id string, kind string, source string, target string, label string"),
    )
    monkeypatch.setattr(catalog, "graph", lambda *_: frames)
    return entry.queries()["k11_graph_identity"](spark, sf_dir).select(F.col("identity")).first()[0]


@pytest.mark.parametrize(
    "other",
    [
        NODES[:2],
        [*NODES[:2], (*NODES[2][:4], {"data_type": "text", "nullable": "true"})],
        [NODES[0], (*NODES[1][:3], "u", NODES[1][4]), NODES[2]],
        NODES[1:],
    ],
)
def test_every_node_and_attribute_is_part_of_the_identity(spark, sf_dir, monkeypatch, other):
    assert identity(spark, sf_dir, monkeypatch, other) != identity(spark, sf_dir, monkeypatch, NODES)
