"""Compressed vectors: whole-number parts, each named by the nearest entry of its codebook.

Nearest entries come from an equal-average search: the entries of a codebook are sorted by the sum
of their components, and the search starts at a part's own sum and takes the nearer side again and
again. By Cauchy and Schwarz no entry whose sum lies g away is nearer than g * g / dimension, so a
part is done when that strictly exceeds its best distance; entries of equal distance are still seen,
and the lower index wins.

Every round is one pass over the vectors. A task sends the sums and counts of its entries, at most
one row for each component of the codebooks, however many vectors it saw; the codebooks themselves
have `entries` times the dimension of numbers and go out with the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that one search looks at together.
BLOCK = 8192


def farthest(dimension: int, parts: int = PARTS) -> int:
    """The bound at which components are held, so that no distance of a vector leaves 64 bits."""
    return isqrt(2**62 // (4 * max(dimension, (dimension // parts) ** 2)))


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of `entries` to each of `vectors`, whole numbers."""
    size, dimension = entries.shape
    totals = entries.sum(axis=1)
    order = np.argsort(totals, kind="stable")
    totals, laid = totals[order], entries[order]
    index, best = np.full(len(vectors), size), np.zeros(len(vectors), dtype=np.int64)
    never = np.iinfo(np.int64).max
    rows, own = np.arange(len(vectors)), vectors.sum(axis=1)
    part, high = vectors, np.searchsorted(totals, own)
    low = high - 1
    found, least = index, best
    while rows.size:
        below = np.where(low >= 0, own - totals[np.maximum(low, 0)], never)
        above = np.where(high < size, totals[np.minimum(high, size - 1)] - own, never)
        gap = np.minimum(below, above)
        done = (gap == never) | ((found < size) & (gap * gap > dimension * least))
        if done.any():
            index[rows[done]], best[rows[done]] = found[done], least[done]
            rows, own, part, low, high, found, least, below, above = (
                x[~done] for x in (rows, own, part, low, high, found, least, below, above)
            )
        up = above < below
        at = np.where(up, high, low)
        apart = part - laid[at]
        distance = np.einsum("ij,ij->i", apart, apart)
        name = order[at]
        better = (found == size) | (distance < least) | ((distance == least) & (name < found))
        found, least = np.where(better, name, found), np.where(better, distance, least)
        low, high = low - ~up, high + up
    return index, best


def _assigned(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part position, index, squared distance) for all rows of `vectors`."""
    width = books.shape[2]
    for p in range(books.shape[0]):
        own = vectors[:, p * width : (p + 1) * width]
        pieces = [nearest(own[i : i + BLOCK], books[p]) for i in range(0, len(own), BLOCK)]
        yield p, np.concatenate([i for i, _ in pieces]), np.concatenate([d for _, d in pieces])


def _whole_numbers(column: pa.Array, dimension: int, bound: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -bound, bound).astype(np.int64)


def _usable(vector: Column, parts: int) -> Column:
    """Whether `vector` is an array without nulls, NaN and infinities that has equal parts."""
    n = F.size(vector)
    finite = (F.array_max(vector) < float("inf")) & (F.array_min(vector) > float("-inf"))
    return vector.isNotNull() & (n > 0) & (n % parts == 0) & (F.size(F.array_compact(vector)) == n) & finite


class Codebooks:
    """`books[part, entry, position]`: whole numbers."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that are kept, and their dimension, 0 if there are none."""
    given = df.select(
        F.col(f"`{id_col}`").alias("vec_id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).where(_usable(F.col("vector"), parts))
    first = given.select("vec_id", F.size("vector").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1)
    dimension = next((r.n for r in first.collect()), 0)
    return given.where(F.size("vector") == dimension), dimension


def train_codebooks(
    vectors: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks:
    """Codebooks from the rows of least vec_id, moved `rounds` times to the floors of the means.

    What comes to the driver is `entries` rows at first and then one sum for each component of the
    codebooks.
    """
    bound = farthest(dimension, parts)
    width = dimension // parts
    taken = vectors.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries)
    # The sort before the limit does not hold for what is collected from it.
    seeds = taken.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").collect()
    first = _whole_numbers(pa.array([r.vector for r in seeds], pa.list_(pa.float64())), dimension, bound, scale)
    books = np.ascontiguousarray(first.reshape(-1, parts, width).transpose(1, 0, 2))

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, members = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                own = _whole_numbers(batch.column(0), dimension, bound, scale)
                for p, index, _distance in _assigned(own, books):
                    np.add.at(total[p], index, own[:, p * width : (p + 1) * width])
                    members[p] += np.bincount(index, minlength=books.shape[1])
            part, entry = np.nonzero(members)
            if part.size:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part, width).astype(np.int32)),
                        pa.array(np.repeat(entry, width).astype(np.int32)),
                        pa.array(np.tile(np.arange(width, dtype=np.int32), part.size)),
                        pa.array(total[part, entry].ravel()),
                        pa.array(np.repeat(members[part, entry], width)),
                    ],
                    names=["part", "entry", "position", "total", "members"],
                )

        moved = (
            vectors.select("vector")
            .mapInArrow(sums, "part int, entry int, position int, total long, members long")
            .groupBy("part", "entry", "position")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members"))
            .collect()
        )
        books = books.copy()
        for r in moved:
            books[r.part, r.entry, r.position] = int(r.total) // r.members
    return Codebooks(books)


def encode_vectors(vectors: DataFrame, dimension: int, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of all rows of `vectors`."""
    books, bound = codebooks.books, farthest(dimension, len(codebooks.books))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _whole_numbers(batch.column("vector"), dimension, bound, scale)
            indexes, errors = np.zeros((len(own), len(books)), dtype=np.uint8), np.zeros(len(own), dtype=np.int64)
            for p, index, distance in _assigned(own, books):
                indexes[:, p] = index
                errors += distance
            code = [row.tobytes().hex() for row in indexes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(errors)],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return vectors.select("vec_id", "label", "vector").mapInArrow(coded, schema)


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row.

    Rows whose vector is null, empty, or holds nulls, NaN or infinities are dropped, and so are
    those whose length is no multiple of `parts` or differs from that of the kept row of least id
    (the shortest, if that id is repeated).
    Null ids come after all others; equal ids go by their vectors. With fewer rows than `entries`
    the codebooks are as short. Repeated rows count each. Components beyond `farthest` are held at
    it. `label_error` is null where the sum does not fit into a long. An empty table gives no rows.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits")
    vectors, dimension = usable_vectors(df, id_col, vector_col, label_col, parts)
    if not dimension:
        return vectors.selectExpr(
            "vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256"
        ).where(F.lit(False))
    codebooks = train_codebooks(vectors, dimension, parts, entries, rounds, scale)
    coded = materialize(encode_vectors(vectors, dimension, codebooks, scale), "codes")
    # Both written, so that a label of very many rows can be split in the join.
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = materialize(sums.withColumnRenamed("label", "_label"), "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256")
    )


def _code_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Brute-force nearest entries, for a table without null or repeated ids, all of one dimension."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT r, part, min({{'d': list_sum(list_transform(range(1, len(p.s) + 1), lambda k: (p.s[k] - b.s[k]) * (p.s[k] - b.s[k]))),
    'e': entry}}) AS best FROM p JOIN b{i} b USING (part) GROUP BY r, part)""")
        if i < rounds:
            steps.append(f"""
c{i} AS (
  SELECT part, best.e AS entry, k, sum(s[k]) AS total, count(*) AS n
  FROM a{i} JOIN p USING (r, part), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k) GROUP BY ALL
), m{i} AS (
  SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY k) AS s FROM c{i} GROUP BY part, entry
), b{i + 1} AS (
  SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS s
  FROM v, range({parts}) t(part)
), b0 AS (SELECT part, r - 1 AS entry, s FROM p WHERE r <= {entries}),
{",".join(steps)},
h AS (
  SELECT sha256(string_agg(CAST(s[k] AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256
  FROM b{rounds}, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k)
), e AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(best.e AS INT))), '' ORDER BY part) AS code, sum(best.d) AS error
  FROM a{rounds} GROUP BY r)
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM e JOIN v USING (r), h
"""


CODE_SQL = _code_sql()
