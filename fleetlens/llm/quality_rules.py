"""Quality rules: a learned decision list over statistics of a text, in Spark expressions alone.

Statistics are columns of built-in functions. Sequential covering learns from labelled rows: a
rule is a conjunction of thresholds that grows while it gains purity on one part of the sample,
is pruned on the other part, and is kept if it is precise there; rows it covers go, and the next
rule is learned from the rest. The list comes out as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD

#: Labelled rows to learn from, at most: those with the least hash of their id.
SAMPLE = 20_000
#: A rule may be wrong on this share of what it covers in the pruning part, and covers so many.
PRECISION = 0.95
LEAST_COVER = 5
#: Conditions in a rule, rules in a list, thresholds tried for a feature (quantiles).
CONDITIONS, RULES, THRESHOLDS = 4, 24, 64

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature: what it is of the counted columns.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "_capitals / greatest(word_chars, 1)",
    "mark_share": "_marks / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        own = values[self.feature]
        return own >= self.threshold if self.above else own < self.threshold

    def column(self) -> Column:
        own, threshold = F.expr(FEATURES[self.feature]), F.lit(self.threshold)
        return own >= threshold if self.above else own < threshold


Rule = list[Condition]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the five counts of each text and the two that only features use.

    Words are runs other than white space. A window of five words is compared by its 64-bit hash
    within its own text; texts in which no window repeats are not sorted.
    """
    counted = (
        docs.withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        .withColumn("_words", F.array_remove(F.split("_text", "[\\x20\\x09-\\x0D]+"), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
        .withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
        .withColumn("n_words", F.size("_words").cast("long"))
    )

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get("_hashes", i + k) for k in range(5)))

    windowed = counted.withColumn(
        "_windows",
        F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_hashes") - 5), window)),
    )
    keyed = windowed.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    beside = F.arrays_zip(
        F.col("_sorted").alias("own"),
        F.concat(F.array(none), F.slice("_sorted", 1, F.size("_sorted") - 1)).alias("before"),
        F.concat(F.slice("_sorted", 2, F.size("_sorted")), F.array(none)).alias("after"),
    )

    def again(w: Column) -> Column:
        key = w["own"]["h"]
        return key.eqNullSafe(w["before"]["h"]) | key.eqNullSafe(w["after"]["h"])

    places = F.array_sort(F.transform(F.filter(beside, again), lambda w: w["own"]["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total")),
        lambda so_far, i: F.struct(
            i.alias("last"), (so_far["total"] + F.least(F.lit(5), i - so_far["last"])).alias("total")
        ),
        lambda done: done["total"],
    )
    return (
        keyed.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.when(F.col("_sorted").isNotNull(), covered), F.lit(0)).cast("long"))
        .withColumn("_capitals", F.regexp_count("_text", F.lit("\\p{Lu}")).cast("long"))
        .withColumn("_marks", F.regexp_count("_text", F.lit("[!?]")).cast("long"))
        .drop("_text", "_words", "_lines", "_hashes", "_windows", "_sorted")
    )


def _gain(bad: int, good: int, new_bad: np.ndarray, new_good: np.ndarray) -> np.ndarray:
    """Information that a condition adds about the bad rows it keeps."""
    before = np.log2(bad / (bad + good))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = new_bad * (np.log2(new_bad / (new_bad + new_good)) - before)
    return np.where(new_bad > 0, gain, -np.inf)


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Conditions of most gain, one after the other, until no good row is covered."""
    rule: Rule = []
    inside = rows.copy()
    while len(rule) < CONDITIONS and (n_bad := int((inside & bad).sum())) and (n_good := int((inside & ~bad).sum())):
        best: tuple[float, Condition] | None = None
        for feature, own in values.items():
            cuts = np.unique(np.quantile(own[inside], np.linspace(0, 1, THRESHOLDS), method="nearest"))
            cuts = np.unique(np.concatenate((cuts, np.quantile(own[inside & bad], [0, 0.05, 0.1, 0.5], method="nearest"))))
            cuts = cuts[1:]
            if not cuts.size:
                continue
            below_bad = np.searchsorted(np.sort(own[inside & bad]), cuts)
            below_good = np.searchsorted(np.sort(own[inside & ~bad]), cuts)
            for above in (True, False):
                new_bad = n_bad - below_bad if above else below_bad
                new_good = n_good - below_good if above else below_good
                gains = _gain(n_bad, n_good, new_bad, new_good)
                at = int(np.argmax(gains))
                if gains[at] > (best[0] if best else 1e-9):
                    best = (float(gains[at]), Condition(feature, above, float(cuts[at])))
        if best is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(values)
    return rule


def _covered(rule: Rule, values: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    inside = rows.copy()
    for condition in rule:
        inside &= condition.holds(values)
    return inside


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The decision list: rules that reject, in the order learned. Same rows, same list."""
    rules: list[Rule] = []
    left = np.ones(bad.size, dtype=bool)
    growing = np.arange(bad.size) % 3 > 0
    while len(rules) < RULES and (left & bad & growing).any():
        rule = _grow(values, bad, left & growing)

        def worth(r: Rule) -> float:
            hit = _covered(r, values, left & ~growing)
            return float((hit & bad).sum() - (hit & ~bad).sum()) / max(int(hit.sum()), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covered(rule, values, left)
        pruned = hit & ~growing
        sure = all((h & bad).sum() >= PRECISION * h.sum() for h in (hit, pruned))
        if not rule or not sure or hit.sum() < LEAST_COVER:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Whether a row with the statistics stays: the first rule that covers it rejects it."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def learn_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> list[Rule]:
    """Rules from the statistics of labelled documents (`labels`: id and quality, 0 for bad).

    At most `sample` labelled ids are taken, by the hash of the id, so they go out as a bounded
    broadcast and their statistics come back as a bounded result. Rows without an id or a
    quality teach nothing; an id labelled twice counts with its lower quality.
    """
    taken = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    known = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_given")).join(
        F.broadcast(taken), "_id"
    )
    features = [F.expr(text).alias(name) for name, text in FEATURES.items()]
    rows = with_statistics(known, "_given").select("_id", "_quality", *features).collect()
    rows.sort(key=lambda r: tuple(r))
    # A mixing of the order, so that both parts hold all kinds; equal for equal rows.
    rows = [rows[i] for i in np.random.Generator(np.random.PCG64(4)).permutation(len(rows))]
    values = {name: np.array([r[name] for r in rows], dtype=float) for name in FEATURES}
    return learn(values, np.array([r["_quality"] == 0 for r in rows], dtype=bool))


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """`docs` with the counts, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        with_statistics(docs, text_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
        .drop("_capitals", "_marks")
    )


def judge_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A null or empty text has no words and fails the base rule. With no labelled rows, or none of
    one kind, the list is empty and the base rule decides. Repeated rows are judged each; an
    empty table gives no rows.
    """
    rules = learn_rules(docs, labels, id_col, text_col, sample)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_given"))
    return judged(own, rules, "_given").select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """The rows of `docs`, same columns, that base rule and decision list keep."""
    rules = learn_rules(docs, labels, id_col, text_col, sample)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    given = whole.withColumn("_given", F.col(f"_row.`{text_col}`"))
    # A filter is not moved below a column of row numbers. Moved further down it would hold, in
    # place of each column it reads, that column's whole expression, many times over.
    numbered = judged(given, rules, "_given").withColumn("_number", F.monotonically_increasing_id())
    return numbered.where("kept and _number >= 0").select("_row.*")
