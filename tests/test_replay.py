"""Schema replay against a plain walk over the same operation log."""

from __future__ import annotations

from collections import defaultdict

import pytest

from fleetlens.operators import replay
from fleetlens.registry.migrations import operations


def walk(rows):
    """Final tables, columns and additions to unknown tables, operation by operation."""
    tables: dict[str, dict[str, dict[str, dict]]] = defaultdict(dict)
    created: dict[str, dict[str, int]] = defaultdict(dict)
    unknown = []
    order = {"create_table": 0, "create_column": 1}
    for op in sorted(rows, key=lambda r: (r["app_id"], r["pos"], order.get(r["kind"], 2))):
        app, name, kind = op["app_id"], op["table_name"], op["kind"]
        mine = tables[app]
        spec = {
            "id_table": name,
            "type": op["new_type"],
            "nullable": op["nullable"],
            "default": op["server_default"],
        }
        if kind == "create_table":
            mine[name] = {}
            created[app][name] = op["pos"]
        elif kind == "create_column":
            mine[name][op["object_name"]] = spec
        elif kind == "drop_table":
            mine.pop(name, None)
            created[app].pop(name, None)
        elif kind == "rename_table":
            if name in mine:
                moved, at = mine.pop(name), created[app].pop(name)
                mine[op["new_name"]], created[app][op["new_name"]] = moved, at
        elif kind == "add_column":
            if name not in mine:
                unknown.append((app, op["pos"]))
            else:
                mine[name][op["object_name"]] = spec
        elif kind == "drop_column":
            mine.get(name, {}).pop(op["object_name"], None)
        elif kind == "alter_column" and op["object_name"] in mine.get(name, {}):
            old = mine[name].pop(op["object_name"])
            fresh = {
                "id_table": name,
                "type": old["type"] if spec["type"] is None else spec["type"],
                "nullable": old["nullable"] if spec["nullable"] is None else spec["nullable"],
                "default": old["default"] if spec["default"] is None else spec["default"],
            }
            mine[name][op["new_name"] or op["object_name"]] = fresh
    found_tables = {(a, t, created[a][t]) for a, ts in tables.items() for t in ts}
    columns = {
        (a, t, c, f"public.{s['id_table']}.{c}", s["type"], s["nullable"], s["default"])
        for a, ts in tables.items()
        for t, cs in ts.items()
        for c, s in cs.items()
    }
    return found_tables, columns, set(unknown)


@pytest.mark.parametrize("width", [1 << 20, 100_000_000])
def test_replay_equals_a_walk(spark, sf_dir, width):
    log = operations(spark, sf_dir).cache()
    # Rename to its own name is a plain alter; the log holds such rows too.
    tables, columns, unknown = walk([r.asDict() for r in log.collect()])
    lifetimes = replay.table_lifetimes(log, width)
    got_tables = {
        (r.app_id, r.table_name, r.first_pos) for r in replay.replay_tables(lifetimes).collect()
    }
    assert got_tables == tables
    got_unknown = {
        (r.app_id, r.pos) for r in replay.unknown_table_operations(log, lifetimes).collect()
    }
    assert got_unknown == unknown
    got_columns = {tuple(r) for r in replay.replay_columns(log, lifetimes).collect()}
    assert got_columns == columns
    log.unpersist()
