"""How filters overlap: what each of five filters removes alone, first, and after the others.

Filters A to D are expressions over one text. Filter E, "equal to a document of smaller id", is an
existential self-join: a left-semi join on hash, exact text and smaller id. Its right side holds
one row for each repeated text (the least id of its copies, combined before the shuffle), which
marks the same rows as all copies would, so a group of any size meets one row. The ids that E marks
are put beside the failures of the other filters, the bits of each document are merged, and all that
is left of the corpus is a count for each combination of bits: 32 rows for a part. Every order of
the filters is read off these counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize

FILTERS = "ABCDE"
#: Bounds of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = "[#$%&*|]"
#: White space but for the blank, which takes its place.
_OTHER_SPACE = "\t\n\x0b\x0c\r"


def failed_bits(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for what a text fails of A to D."""
    words = F.array_remove(F.split(F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE)), " "), "")

    def tests(own: Column) -> Column:
        n = F.size(own).cast("long")
        return F.when(n < LEAST_WORDS, 1).otherwise(0) + F.when(
            100 * F.size(F.array_distinct(own)) < DISTINCT_PERCENT * n, 2
        ).otherwise(0)

    # One element, so that the words are cut once for both tests.
    of_words = F.get(F.transform(F.array(words), tests), F.lit(0))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return (
        of_words
        + F.when(capitals > CAPITAL_PERCENT * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    )


def copies_of_smaller(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, k1, ...) whose text a row of smaller doc_id has too."""
    least = (
        docs.groupBy("k1", "text")
        .agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
        .where("_least < _most")
        .drop("_most")
    )
    # Written, so that both sides of the join are plain shuffles and a hot text can be split.
    first = materialize(least, "first-copies").alias("first")
    own = docs.alias("own")
    smaller = F.col("first._least") < F.col("own.doc_id")
    same = (F.col("own.k1") == F.col("first.k1")) & (F.col("own.text") == F.col("first.text"))
    return own.join(first, same & smaller, "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part for each combination of failures."""
    given = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    given = given.withColumn("k1", F.xxhash64("text"))
    # Rows of one id may differ in text, so a document is named by its id, its part and two hashes.
    name = ["doc_id", "part", "k1", F.xxhash64(F.lit(7), "text").alias("k2")]
    alone = given.select(*name, failed_bits(F.col("text")).alias("bits"), F.lit(1).cast("long").alias("n"))
    copies = copies_of_smaller(given).select(*name, F.lit(16).alias("bits"), F.lit(0).cast("long").alias("n"))
    merged = alone.unionAll(copies).groupBy("doc_id", "part", "k1", "k2").agg(
        F.bit_or("bits").alias("bits"), F.sum("n").alias("n")
    )
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic")
    )
    counted = merged.join(marks.where("_good or _toxic"), merged["doc_id"] == F.col("_id"), "left")

    def of(mark: str) -> Column:
        return F.sum(F.when(F.col(mark), F.col("n")).otherwise(0))

    return counted.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), of("_good").alias("good"), of("_toxic").alias("toxic")
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley), counts as long. A null text is empty; a null part is the empty string and is one part
    with it. A null id is not smaller than any, nor has any smaller one; rows that repeat an id
    count each, and equal ids are no copies of each other. Of several labels of an id one with
    quality 1 makes it good and one with toxic 1 makes it toxic; null labels make nothing. An empty
    table has no parts, so no rows.
    """
    counts = combinations(docs, labels, id_col, text_col, part_col)
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    every = counts.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", steps)
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}

    def fails(place: Column) -> Column:
        letter = F.substring("filter_order", place, F.lit(1))
        out = F.lit(False)
        for name, value in bit.items():
            out = out | ((letter == name) & (F.col("bits").bitwiseAND(F.lit(value)) != 0))
        return out

    failing = fails(F.col("step"))
    before = F.exists(F.sequence(F.lit(0), F.col("step") - 1), lambda k: (k > 0) & fails(k))
    n_failed = F.bit_count("bits")

    def count(held: Column, what: str = "n") -> Column:
        return F.sum(F.when(held, F.col(what)).otherwise(0)).cast("long")

    first = F.col("_fails") & ~F.col("_before")
    # A document goes to each of its failed filters in an equal share of the orders, a whole number.
    share = F.col("n") * F.floor(F.lit(len(orders)) / F.col("_n_failed"))
    return (
        every.withColumn("_fails", failing)
        .withColumn("_before", before)
        .withColumn("_n_failed", n_failed)
        .groupBy("part", "filter_order", "step")
        .agg(
            count(~F.col("_fails") & ~F.col("_before")).alias("kept"),
            count(first).alias("removed"),
            count(F.col("_fails") & F.col("_before")).alias("redundant"),
            count(F.col("_fails") & (F.col("_n_failed") == 1)).alias("unique_fails"),
            count(first, "good").alias("good_lost"),
            count(first, "toxic").alias("toxic_lost"),
            F.sum(F.when(F.col("_fails"), share).otherwise(0)).cast("long").alias("shapley"),
        )
    )


#: The same rows from window sums over every document's flags.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY text) AS least FROM d
), f AS (
  SELECT w.doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least < w.doc_id THEN 16 ELSE 0 END AS bits,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
      max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS order_bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), combos AS (
  SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits
), steps AS (
  SELECT part, filter_order, unnest([1, 2, 3, 4, 5]) AS step, order_bits, bits, n, good, toxic
  FROM combos, orders
), placed AS (
  SELECT *, bits & order_bits[step] > 0 AS fails,
    len(list_filter(order_bits[1:step - 1], lambda b: bits & b > 0)) > 0 AS earlier FROM steps
), counted AS (
  SELECT part, filter_order, step,
    sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = order_bits[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM counted
"""
