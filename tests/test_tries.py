"""Hash tries of sets of rows: one digest whatever the order, and where two sets differ."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from fleetlens.operators import quality
from fleetlens.plans import tries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """The root's digest of a list of texts."""
    counts = Counter(map(sha, rows))
    depth = len(f"{len(counts) - 1:X}") - 1

    def digest(prefix):
        if len(prefix) == depth:
            return sha(",".join(f"{h}:{c}" for h, c in sorted(counts.items()) if h.startswith(prefix)))
        below = sorted({h[: len(prefix) + 1] for h in counts if h.startswith(prefix)})
        return sha(",".join(f"{p[-1]}:{digest(p)}" for p in below))

    return digest("")


def test_digests_of_many_sizes(spark):
    sets = {f"s{n}": [f"row {i} of {n}" for i in range(n)] for n in (1, 2, 16, 17, 40, 256, 257, 600)}
    sets["copies"] = ["a", "a", "b"] * 30
    rows = [(k, t) for k, texts in sets.items() for t in texts]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "app string, text string")
    for layout in (df, df.repartition(7)):
        got = {r.app: r.digest for r in tries.root_digests(layout, ["app"], F.col("text")).collect()}
        assert got == {k: brute(texts) for k, texts in sets.items()}
    assert tries.root_digests(df.limit(0), ["app"], F.col("text")).collect() == []


def files(spark, rows):
    return spark.createDataFrame(rows, "app_id string, path string, content_hash string")


def test_changes_between_two_snapshots(spark):
    before = [("a", f"f{i}", f"h{i}") for i in range(900)] + [("same", f"f{i}", "h") for i in range(50)] + [("gone", "f", "h")]
    after = [r for r in before if r[:2] not in {("a", "f7"), ("gone", "f")}]
    after = [("a", "f8", "other") if r[:2] == ("a", "f8") else r for r in after] + [("a", "new", "h"), ("fresh", "f", "h")]
    random.Random(2).shuffle(after)
    old, new = files(spark, before), files(spark, after)
    got = {tuple(r) for r in quality.file_set_changes(old, new, ["app_id"]).collect()}
    assert got == {("a", "f7", "removed"), ("a", "f8", "changed"), ("a", "new", "added"), ("gone", "f", "removed"), ("fresh", "f", "added")}
    leaves, left, right = tries.differing_rows(old, new, ["app_id"], F.to_json(F.array("path", "content_hash")))
    assert leaves.where("app_id = 'same'").isEmpty()
    assert left.count() + right.count() < 200
    assert quality.file_set_changes(old, old, ["app_id"]).collect() == []


def test_hashes_are_sent_as_bytes(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None)], "app string, text string")
    hashed = tries.row_hashes(rows, ["app"], F.col("text"))
    assert dict(hashed.dtypes)["hash"] == "binary"
    assert {(r.hash and bytes(r.hash).hex(), r.copies) for r in hashed.collect()} == {(sha("x"), 2), (None, 1)}
