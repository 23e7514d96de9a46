"""Near-duplicate documents: Jaccard similarity of word shingles, found by a MinHash LSH forest.

Each text has a signature for each tree, and texts that share a prefix of it meet. The prefix starts
at its full depth and is shortened, by the formula alone and before any row is read, until the chance
that a pair right at the threshold meets in some tree reaches the target recall; so all texts have
prefixes of one length, as in banding, and no trie is walked up for single texts. Meeting is
kept as a star around the least text of a prefix, not as pairs; the stars' connected components
hold all texts that can be similar. Inside a component every pair is verified by exact
intersection, in blocks, and only counts and links of a spanning forest leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, components, text_keys
from fleetlens.llm.hashing import mix, shingles
from fleetlens.sources.scratch import materialize

SIZE = 5
SIMILARITY = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
#: Texts of a block; two blocks of a component are compared in one task.
BLOCK = 128
#: Shingles compared at once within a block.
COLUMNS = 4096


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from `depth` down, whose matches in `trees` tries reach `recall`."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def prefixes(texts: list[bytes], size: int, trees: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a text, hash of its prefix) for each tree and each text with a word."""
    random = np.random.Generator(np.random.PCG64(9))
    factors = random.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    masks = random.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    for first, hashes, counts in shingles(texts, size):
        own = np.flatnonzero(counts)
        if not own.size:
            continue
        begins = np.concatenate(([0], np.cumsum(counts[own])[:-1]))
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for tree in range(trees):
            prefix = np.full(own.size, np.uint64(tree + 1))
            for i in range(tree * depth, (tree + 1) * depth):
                least = np.minimum.reduceat((short ^ masks[i]) * factors[i], begins)
                prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + least)
            yield own + first, prefix


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many shingles each text of `one` shares with each of `two` (sorted, without repeats)."""
    left = np.concatenate([np.unique(np.concatenate(one))])
    values = np.intersect1d(left, np.unique(np.concatenate(two)), assume_unique=True)
    counts = np.zeros((len(one), len(two)), dtype=np.float32)
    if not values.size:
        return counts
    places = [
        [(at := np.searchsorted(values, s))[(at < values.size) & (values[np.minimum(at, values.size - 1)] == s)] for s in side]
        for side in (one, two)
    ]
    for low in range(0, values.size, COLUMNS):
        marks = []
        for side in places:
            mark = np.zeros((len(side), COLUMNS), dtype=np.float32)
            for i, at in enumerate(side):
                begin, end = np.searchsorted(at, (low, low + COLUMNS))
                mark[i, at[begin:end] - low] = 1
            marks.append(mark)
        counts += marks[0] @ marks[1].T
    return counts


def similar(one: list[np.ndarray], two: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which texts of `one` and `two` have at least this Jaccard similarity; exact."""
    ratio = Fraction(similarity).limit_denominator(10**6)
    common = _common(one, two).astype(np.int64)
    total = np.array([s.size for s in one])[:, None] + np.array([s.size for s in two])[None, :]
    return (common > 0) & (ratio.denominator * common >= ratio.numerator * (total - common))


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each row's connected component in a symmetric matrix of links."""
    label = np.arange(linked.shape[0])
    while True:
        near = np.where(linked, label[None, :], linked.shape[0]).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_texts(
    docs: DataFrame,
    size: int = SIZE,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(k1, k2, n, first_id, class_id, component, links): each different text with a word, once.

    `n` counts its documents and `first_id` is their least id; `links` counts the documents of
    other texts that are similar to it; `class_id` is the least id in its connected component, and
    `component` names that by its texts, so that classes of equal or of null ids stay apart.
    """
    depth = prefix_depth(similarity, trees, depth, recall)
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).where(F.col("text").rlike(WORD))
    keyed = keyed.select("doc_id", "text", *text_keys(F.col("text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for text, prefix in prefixes(batch.column(0).cast(pa.binary()).to_pylist(), size, trees, depth):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.view(np.int64)), pa.array(keys[text])], names=["prefix", "k1"]
                )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[bytes] = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for _, hashes, counts in shingles(texts, size):
                ends = np.cumsum(counts)
                data += [np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends, counts, strict=True)]
            names = ["k1", "k2", "n", "component", "blocks"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(data, pa.binary())], names=[*names, "shingles"]
            )

    def verified(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        block, k1, k2, n = (group.column(c).to_numpy() for c in ("block", "k1", "k2", "n"))
        sets_of = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        linked = np.zeros((block.size, block.size), dtype=bool)
        if one.size and two.size:
            found = similar([sets_of[i] for i in one], [sets_of[i] for i in two], similarity)
            linked[np.ix_(one, two)] = found
            linked |= linked.T
        np.fill_diagonal(linked, False)
        root = _roots(linked)
        own = np.flatnonzero(linked.any(axis=1))
        return pa.table({
            "k1": k1[own], "k2": k2[own], "links": (linked[own].astype(np.int64) @ n),
            "r1": k1[root[own]], "r2": k2[root[own]],
        })

    met = materialize(keyed.select("text", "k1").mapInArrow(rows, "prefix long, k1 long"), "prefixes")
    shared = (
        met.groupBy("prefix")
        .agg(F.min("k1").alias("least"), F.max("k1").alias("_most"))
        .where("least <> _most")
        .select("prefix", "least")
    )
    stars = met.join(shared, "prefix").select(F.col("k1").alias("u"), F.col("least").alias("v")).distinct()
    groups = components(stars, "near").withColumnRenamed("node", "k1")
    texts = materialize(
        keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "texts"
    )
    sizes = groups.groupBy("component").agg(F.count("*").alias("_size"))
    grouped = texts.join(groups.join(sizes, "component"), "k1").select(
        "k1", "k2", "n", "component", F.ceil(F.col("_size") / BLOCK).cast("int").alias("blocks")
    )
    whole = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(grouped, ["k1", "k2"])
    blocked = (
        whole.mapInArrow(sets, "k1 long, k2 long, n long, component long, blocks int, shingles binary")
        .withColumn("block", F.pmod("k2", "blocks").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "_other"))
        .withColumn("high", F.greatest("block", "_other"))
        .drop("blocks", "_other")
    )
    found = materialize(
        blocked.groupBy("component", "low", "high").applyInArrow(
            verified, "k1 long, k2 long, links long, r1 long, r2 long"
        ),
        "links",
    )

    def node(one: str, two: str):
        return F.concat_ws(":", one, two)

    forest = found.select(node("k1", "k2").alias("u"), node("r1", "r2").alias("v")).where("u <> v").distinct()
    classes = components(forest, "class")
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    named = texts.withColumn("node", node("k1", "k2"))
    members = classes.join(named, "node")
    least = members.groupBy("component").agg(F.min("first_id").alias("class_id"))
    in_class = members.join(least, "component").join(links, ["k1", "k2"]).select(
        "k1", "k2", "class_id", "component", "links"
    )
    return texts.join(in_class, ["k1", "k2"], "left").select(
        "k1", "k2", "n", "first_id",
        F.coalesce("class_id", "first_id").alias("class_id"),
        F.coalesce("component", node("k1", "k2")).alias("component"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    Words are runs other than white space; a text of one to four words is one shingle. `n_links`
    counts the other documents of similarity 0.8 or more, copies among them; `class_id` is the
    least doc_id of all that links connect. A document without a word (null or empty text too) has
    no links and its own id as class. Null ids count as documents and come last as class ids.
    Repeated rows are copies of each other. An empty table gives no rows.
    """
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")
    )
    keyed = keyed.select("doc_id", *text_keys(F.col("_text")))
    # Written, so that the join below has two plain shuffles and a text of many copies can be split.
    texts = materialize(linked_texts(docs, id_col=id_col, text_col=text_col, **options), "classes")
    return keyed.join(texts, ["k1", "k2"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, same columns, with the document of least id of each class, and all without words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    k1, k2 = text_keys(text)
    keyed = docs.select(whole, text.rlike(WORD).alias("_words"), k1, k2)
    own_id = F.col(f"_row.`{id_col}`")
    first = F.struct(own_id.isNull(), own_id, F.xxhash64("_row"))
    copies = keyed.where("_words").groupBy("k1", "k2").agg(F.min_by("_row", first).alias("_row"))
    texts = linked_texts(docs, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("k1"), F.col("k2"))
    # Equal ids of different texts in a class are told apart by their keys.
    linked = texts.where("links > 0").groupBy("component").agg(F.min(order).alias("_least"))
    kept = texts.where("links = 0").select("k1", "k2").unionAll(linked.select("_least.k1", "_least.k2"))
    return (
        copies.join(kept, ["k1", "k2"], "left_semi")
        .select("_row.*")
        .unionAll(keyed.where("not _words").select("_row.*"))
    )
