"""Operator inputs derived from the given tables.

Each entry is plain SQL in the subset that Spark SQL and the checking database share, over
the given tables and earlier entries. `frame` binds it to Spark tables; `with_inputs` writes
the same text as a WITH prefix for the checking SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.scratch import materialize

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

INPUTS: dict[str, str] = {}
_SNAPSHOTS: set[str] = set()
# Texts that Spark runs in place of those of `INPUTS`.
_BUILT: dict[str, str] = {}
# Frames of the running session: (session, data folder, name) to a lazy DataFrame.
_FRAMES: dict[tuple[int, str, str], tuple[SparkSession, DataFrame]] = {}


def define(name: str, text: str, snapshot: bool = False, built: str | None = None) -> None:
    """Add a derived input.

    A snapshot is written once per session as a table and then only read, the way catalogs of
    a fleet are kept; every other input is derived inside the query that reads it. `built` gives
    the rows of `text` in a way that costs Spark less; the checking SQL keeps `text`.
    """
    INPUTS[name] = text.strip()
    if snapshot:
        _SNAPSHOTS.add(name)
    if built is not None:
        _BUILT[name] = built.strip()


def _references(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input `name` (or a given table) as a DataFrame."""
    key = (id(spark), sf_dir, name)
    known = _FRAMES.get(key)
    if known is not None and known[0] is spark:
        return known[1]
    if name in INPUTS:
        text = _BUILT.get(name, INPUTS[name])
        bound = {ref: frame(spark, sf_dir, ref) for ref in _references(text)}
        df = spark.sql(text, **bound)
        if name in _SNAPSHOTS:
            df = materialize(df, f"snapshot-{name}")
    else:
        df = table(spark, sf_dir, name)
    _FRAMES[key] = (spark, df)
    return df


def _closure(names: list[str], seen: list[str]) -> None:
    for name in names:
        if name in INPUTS and name not in seen:
            _closure(_references(INPUTS[name]), seen)
            seen.append(name)


def with_inputs(names: str, body: str) -> str:
    """Prefix `body` with the derived inputs it reads, named as in `INPUTS`."""
    needed: list[str] = []
    _closure(names.split(), needed)
    plain = {name: name for name in (*INPUTS, *TABLES)}
    parts = [f"{name} AS (\n{INPUTS[name].format(**plain)}\n)" for name in needed]
    body = body.strip()
    recursive = "RECURSIVE " if body[:15].upper().startswith("WITH RECURSIVE") else ""
    if body[:4].upper() == "WITH":
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.IGNORECASE)
        return f"WITH {recursive}" + ",\n".join(parts) + (",\n" if parts else "") + body
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# The capture log: one user is one test node, one event is one cursor execution. The bind of
# a view is constant, so that plain repetition occurs beside amplification.
define(
    "capture",
    """
SELECT concat('app-', user_id % 10) AS app_id, 'run-1' AS run_id, event_id AS sequence,
  CAST(round(value * 1000) AS BIGINT) AS duration_us, event_type AS query_id,
  CASE event_type
    WHEN 'view' THEN concat('SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ',
      user_id, ' AND o_orderstatus = ''P''')
    WHEN 'click' THEN concat('select  L_QUANTITY from public.lineitem where l_orderkey=%s AND l_quantity > ',
      k, ' LIMIT 20')
    WHEN 'purchase' THEN concat('INSERT INTO orders (o_orderkey, o_custkey) VALUES (%(key)s, ', user_id, ')')
    WHEN 'signup' THEN concat('UPDATE customer SET c_name = ''O''''Brien ', k,
      ''', c_acctbal = NULL WHERE c_custkey = %(id)s::bigint')
    ELSE CASE k % 4 WHEN 0 THEN 'SELEC 1' WHEN 1 THEN 'SELECT 1; SELECT 2'
      WHEN 2 THEN concat('SELECT s_name FROM supplier, nation n, missing WHERE s_nationkey = n_nationkey AND 5 <= s_acctbal -- id ', k)
      ELSE concat('SELECT c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE (o.o_totalprice > ',
        k, ' OR c.c_acctbal < 5) AND o.o_orderdate >= ''1997-01-01'' AND c.c_name IS NOT NULL') END
  END AS statement,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS statement_class,
  CASE WHEN event_type = 'view' THEN 'fixed' WHEN k = 13 THEN NULL ELSE props END AS bind,
  k AS rowcount, concat(user_id, '/', CAST(CAST(ts AS DATE) AS STRING)) AS transaction_id,
  concat('test_', user_id) AS node_id, 'call' AS phase,
  CASE WHEN k % 5 > 0 THEN concat('app/mod', k % 7, '.py') END AS site_path, k AS site_line,
  concat('handler_', k % 4) AS site_symbol, ts, user_id
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}) e
""",
)


def trie_sql(keys: str, levels: int = 5) -> str:
    """CTEs that take hashes g of rows r (`keys`, g) to their trie; trie0 holds the root's digest x."""
    parts = [
        f"trie_rows AS (SELECT {keys}, g, count(*) AS c FROM r GROUP BY ALL)",
        f"trie_depths AS (SELECT {keys}, length(to_hex(count(*) - 1)) - 1 AS d FROM trie_rows GROUP BY ALL)",
    ]
    for at in range(levels, -1, -1):
        leaf = f"""SELECT {keys}, substr(g, 1, {at}) AS p, sha256(string_agg(concat(g, ':', c), ',' ORDER BY g)) AS x
          FROM trie_rows JOIN trie_depths USING ({keys}) WHERE d = {at} GROUP BY {keys}, substr(g, 1, {at})"""
        inner = f"""SELECT {keys}, substr(p, 1, {at}) AS p, sha256(string_agg(concat(p[{at + 1}], ':', x), ',' ORDER BY p)) AS x
          FROM trie{at + 1} GROUP BY {keys}, substr(p, 1, {at})"""
        parts.append(f"trie{at} AS ({leaf}{f' UNION ALL {inner}' if at < levels else ''})")
    return ", ".join(parts)
