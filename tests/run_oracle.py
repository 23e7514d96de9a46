"""Run the checks by hand: python tests/run_oracle.py [sf] [name part ...]."""

from __future__ import annotations

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
import oracle

from fleetlens.session import build_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(spark__sql__shuffle__partitions="8")
    con = oracle.connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if parts and not any(name.startswith(part) for part in parts):
            continue
        try:
            ok, message, rows, took = oracle.compare(spark, con, sf_dir, query, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message, rows, took = False, "".join(traceback.format_exception_only(error))[:900], -1, 0
        bad += not ok
        flag = "ok  " if ok and rows else ("ZERO" if ok else "FAIL")
        print(f"{flag} {name} rows={rows} {took:.1f}s {'' if message == 'equal' else message}", flush=True)
    print("bad", bad)
