"""Manifests, reference integrity, record rules, leak scans and stage histories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import minimizers
from fleetlens.functions.identity import SCHEMA_VERSION_PATTERN, sha256_text
from fleetlens.plans import tries
from fleetlens.plans.ordering import SEQUENCE_WIDTH, previous_row
from fleetlens.plans.partitions import spread
from fleetlens.sources.scratch import materialize

SUPPORTED_MAJOR = 1
READER_VERSION = "1.3"
# Legal stage moves.
STAGE_MOVES = {
    "pending": ["running", "cancelled"],
    "running": ["complete", "partial", "failed", "cancelled"],
}


# --- versions and manifests ------------------------------------------------------------------


def version_part(version: Column | str, part: int) -> Column:
    text = F.col(version) if isinstance(version, str) else version
    found = F.regexp_extract(text, SCHEMA_VERSION_PATTERN, part)
    return F.when(text.rlike(SCHEMA_VERSION_PATTERN), found.try_cast("long"))


def is_compatible(version: Column | str) -> Column:
    """The text is a version and its major is the supported one; any minor is read."""
    return F.coalesce(version_part(version, 1) == SUPPORTED_MAJOR, F.lit(False))


def schema_compat(documents: DataFrame, version: str = "schema_version") -> DataFrame:
    """Add major, minor and compatible."""
    return documents.withColumns(
        {
            "major": version_part(version, 1),
            "minor": version_part(version, 2),
            "compatible": is_compatible(version),
        }
    )


def build_manifest(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, repeated): path, type, hash and version of each artifact; paths used twice.

    `artifacts` holds run_id, artifact_type, path, content, schema_version.
    """
    entries = artifacts.select(
        "run_id", "artifact_type", "path", sha256_text("content").alias("content_hash"), "schema_version"
    )
    repeated = entries.groupBy("run_id", "path").agg(F.count("*").alias("n")).where("n > 1")
    return entries, repeated


def verify_manifest(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, path, problem): unsupported version, then missing file, then changed content.

    `files` holds run_id, path, actual_hash.
    """
    problem = (
        F.when(~is_compatible("schema_version"), "artifact schema version is not supported")
        .when(F.col("actual_hash").isNull(), "recorded in manifest but missing on disk")
        .when(F.col("actual_hash") != F.col("content_hash"), "content hash mismatch")
    )
    return (
        entries.join(files, ["run_id", "path"], "left")
        .select("run_id", "path", problem.alias("problem"))
        .where("problem IS NOT NULL")
    )


def verify_bundles(manifests: DataFrame, declared: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems, trust): every problem of each bundle, and whether the bundle can be read at all.

    `manifests` holds bundle_id and the required manifest fields, `declared` bundle_id, path,
    content_hash, `files` bundle_id, path, actual_hash.
    """
    required = ["proof_id", "tool_version", "schema_version", "generator_version"]
    lacking = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), f"manifest is missing field '{c}'") for c in required])
    )
    broken = manifests.select("bundle_id", F.explode(lacking).alias("problem"))
    text = F.when(F.col("actual_hash").isNull(), F.concat("path", F.lit(" is missing"))).when(
        F.col("actual_hash") != F.col("content_hash"),
        F.concat("path", F.lit(" does not match its declared hash (tampered)")),
    )
    # A bundle with an incomplete manifest is refused before its files are looked at.
    changed = (
        declared.join(broken.select("bundle_id").distinct(), "bundle_id", "left_anti")
        .join(files, ["bundle_id", "path"], "left")
        .select("bundle_id", text.alias("problem"))
        .where("problem IS NOT NULL")
    )
    problems = broken.unionByName(changed)
    bad = problems.select("bundle_id").distinct().withColumn("bad", F.lit(True))
    trust = manifests.select("bundle_id").join(bad, "bundle_id", "left").select(
        "bundle_id", F.col("bad").isNull().alias("trusted")
    )
    return problems, trust


# --- references ------------------------------------------------------------------------------


def dangling_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(app_id, evidence_id): cited ids the evidence does not hold."""
    cited = findings.select("app_id", F.explode("evidence_refs").alias("evidence_id")).distinct()
    return cited.join(evidence.select("app_id", "evidence_id"), ["app_id", "evidence_id"], "left_anti")


def untraceable_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(app_id, id): findings that cite no evidence that exists."""
    hits = (
        findings.select("app_id", "id", F.explode("evidence_refs").alias("evidence_id"))
        .join(evidence.select("app_id", "evidence_id"), ["app_id", "evidence_id"], "left_semi")
        .select("app_id", "id")
    )
    return findings.select("app_id", "id").join(hits, ["app_id", "id"], "left_anti")


def dangling_links(
    findings: DataFrame, questions: DataFrame, scenario_refs: DataFrame
) -> DataFrame:
    """(app_id, link, target): blocking questions, affected findings and scenario ids that do not exist.

    `questions` holds app_id, question, affected array; `scenario_refs` app_id, recommendation.
    """
    ids = findings.select("app_id", F.col("id").alias("target"))
    asked = questions.select("app_id", F.col("question").alias("target"))
    on = ["app_id", "target"]

    def missing(refs: DataFrame, known: DataFrame, link: str) -> DataFrame:
        return refs.distinct().join(known, on, "left_anti").select("app_id", F.lit(link).alias("link"), "target")

    blocking = findings.where("blocking_question IS NOT NULL").select(
        "app_id", F.col("blocking_question").alias("target")
    )
    affected = questions.select("app_id", F.explode("affected").alias("target"))
    cited = scenario_refs.select("app_id", F.col("recommendation").alias("target"))
    return (
        missing(blocking, asked, "blocking_question")
        .unionByName(missing(affected, ids, "affected_recommendation"))
        .unionByName(missing(cited, ids, "scenario_recommendation"))
    )


# --- record rules ----------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """One rule on one field of one record kind.

    `check` is required, non_empty, pattern, one_of or at_least; all but required let a missing
    value pass.
    """

    kind: str
    field: str
    check: str
    argument: object = None

    def broken(self, value: Column) -> Column:
        present = value.isNotNull()
        if self.check == "required":
            return value.isNull()
        if self.check == "non_empty":
            return present & (F.length(value) == 0)
        if self.check == "pattern":
            return present & ~value.rlike(str(self.argument))
        if self.check == "one_of":
            return present & ~value.isin(list(self.argument))  # type: ignore[call-overload]
        if self.check == "at_least":
            number = value.try_cast("decimal(38,6)")
            return present & ~F.coalesce(number >= F.lit(self.argument), F.lit(False))
        raise ValueError(f"unknown check {self.check!r}")

    def reason(self) -> str:
        shown = "" if self.argument is None else f" {self.argument}"
        return f"{self.field}: {self.check}{shown}"


def validate_records(records: DataFrame, rules: Sequence[FieldRule]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): records that keep every rule, and (record_id, kind, reason) rows.

    `records` holds record_id, kind, schema_version and `fields`, a string map. An unsupported
    major version is the only reason given for its record. All rules run in one pass.
    """
    kinds = sorted({rule.kind for rule in rules})
    checks = [
        F.when(
            (F.col("kind") == rule.kind) & rule.broken(F.try_element_at("fields", F.lit(rule.field))),
            rule.reason(),
        )
        for rule in rules
    ]
    unknown = F.when(~F.col("kind").isin(kinds), "unknown record kind")
    reasons = F.when(
        ~is_compatible("schema_version"), F.array(F.lit("unsupported schema version"))
    ).otherwise(F.array_compact(F.array(unknown, *checks)))
    judged = records.withColumn("reasons", reasons)
    rejects = judged.select("record_id", "kind", F.explode("reasons").alias("reason"))
    return judged.where(F.size("reasons") == 0).drop("reasons"), rejects


# --- cache keys ------------------------------------------------------------------------------

CACHE_INPUTS = ["environment_identity", "file_hashes", "stage_config", "tool_versions", "upstream_hashes"]


def stage_cache_key() -> Column:
    """Hash over five string maps (columns named as in CACHE_INPUTS); key order plays no part."""
    empty = F.create_map().cast("map<string,string>")
    ordered = [
        F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(F.col(name), empty)))).alias(name)
        for name in CACHE_INPUTS
    ]
    return sha256_text(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}))


_FILE_ROW = ("path", "content_hash")


def file_set_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest): one hash over all (path, content_hash) rows of a key, in no order.

    It is the root of a trie of row hashes (`plans.tries`), so that sets can also be compared.
    """
    roots = tries.root_digests(files, keys, F.to_json(F.array(*_FILE_ROW)))
    return roots.select(*keys, F.concat(F.lit("sha256:"), "digest").alias("digest"))


def file_set_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, change) of files that two snapshots do not share: added, removed or changed.

    Only files in differing leaves of the two tries are compared.
    """
    _leaves, old, new = tries.differing_rows(before, after, keys, F.to_json(F.array(*_FILE_ROW)))
    sides = old.select(*keys, *_FILE_ROW, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        new.select(*keys, *_FILE_ROW, F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    unlike = sides.groupBy(*keys, *_FILE_ROW).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).where("old <> new")
    change = (
        F.when(F.sum("old") == 0, "added").when(F.sum("new") == 0, "removed").otherwise("changed").alias("change")
    )
    return unlike.groupBy(*keys, "path").agg(change)


def cache_hits(artifacts: DataFrame, current: DataFrame, wanted: int = 2) -> DataFrame:
    """(app_id, hit): all `wanted` stored artifacts carry the current key.

    `artifacts` holds app_id, artifact_type, cache_key; `current` app_id, current_key.
    """
    same = F.col("cache_key").eqNullSafe(F.col("current_key"))
    return (
        current.join(artifacts, "app_id", "left")
        .groupBy("app_id")
        .agg(
            F.count_distinct("artifact_type").alias("found"),
            F.bool_and(same).alias("same"),
        )
        .select("app_id", ((F.col("found") == wanted) & F.col("same")).alias("hit"))
    )


# --- share and leak --------------------------------------------------------------------------


def share_inventory(files: DataFrame) -> DataFrame:
    """(name, byte_size, content_hash) of each exported text."""
    return files.select(
        "name", F.octet_length("content").cast("long").alias("byte_size"), sha256_text("content").alias("content_hash")
    )


def _needle_names(needles: DataFrame) -> DataFrame:
    """(needle_id, needle, size, name): the names of all windows of each needle, of one length."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("needle").cast(pa.binary()).to_pylist()
            sizes = [minimizers.size_for(len(t)) for t in texts]
            names = [minimizers.names_of(t, s) for t, s in zip(texts, sizes, strict=True)]
            own = pa.array(np.repeat(np.arange(len(texts)), [n.size for n in names]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("needle_id").take(own),
                    batch.column("needle").take(own),
                    pa.array(sizes, pa.int32()).take(own),
                    pa.array(np.concatenate(names).view(np.int64) if names else [], pa.int64()),
                ],
                names=["needle_id", "needle", "size", "name"],
            )

    id_type = needles.schema["needle_id"].dataType.simpleString()
    return needles.select("needle_id", "needle").mapInArrow(named, f"needle_id {id_type}, needle string, size int, name long")


def _sieve(names: DataFrame) -> minimizers.Sieve:
    """The names as a set of fixed size, put together on the executors."""
    word = F.shiftright("name", 6).bitwiseAND(F.lit(minimizers.BITS // 64 - 1)).cast("int")
    bit = F.expr("shiftleft(1L, cast(name & 63L AS int))")
    words = np.zeros(minimizers.BITS // 64, dtype=np.uint64)
    for r in names.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        words[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF
    return minimizers.Sieve(words)


def window_names(texts: DataFrame, sizes: list[int], sieve: minimizers.Sieve) -> DataFrame:
    """(text_id, name) of the windows of each text that the sieve holds; texts without null."""
    if not sizes:
        return texts.select("text_id", F.lit(0).cast("long").alias("name")).where(F.lit(False))
    sent = texts.sparkSession.sparkContext.broadcast(sieve)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("text").cast(pa.binary()).to_pylist()
            low, total = 0, 0
            for high in range(1, len(data) + 1):
                total += len(data[high - 1])
                if total < minimizers.SLICE and high < len(data):
                    continue
                ids = batch.column("text_id").slice(low, high - low)
                for text, name in minimizers.names_in(data[low:high], sizes, sent.value):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text)), pa.array(name.view(np.int64))], names=["text_id", "name"]
                    )
                low, total = high, 0

    id_type = texts.schema["text_id"].dataType.simpleString()
    return spread(texts.select("text_id", "text")).mapInArrow(named, f"text_id {id_type}, name long")


def leak_scan(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle_id): which forbidden strings occur in which text, as plain substrings.

    Texts (text_id, text) are read whole and may be looked at by any number of needles. Both sides
    name their windows by least hashes (`minimizers`); a needle takes the longest window that fits
    into it, and of its names the one in the fewest texts is its join key, so a phrase that every
    text has does not become the key. A sieve of fixed size keeps texts from sending names that no
    needle has. `contains` decides. Null and empty needles and null texts are in no result; a
    needle given twice counts once. A repeated row of `texts` is found as often.
    """
    wanted = needles.where("needle <> ''").select("needle_id", "needle").distinct()
    named = materialize(_needle_names(wanted), "needle-names")
    sizes = sorted(r["size"] for r in named.select("size").distinct().collect())
    given = texts.where("text IS NOT NULL")
    held = materialize(window_names(given, sizes, _sieve(named)), "text-names")
    spread = held.groupBy("name").agg(F.count("*").alias("texts"))
    rank = F.struct(F.coalesce("texts", F.lit(0).cast("long")).alias("n"), "name")
    keyed = named.join(spread, "name", "left").groupBy("needle_id", "needle").agg(F.min_by("name", rank).alias("name"))
    # Both written, so that a name in very many texts can be split in the join.
    candidates = held.join(materialize(keyed, "needle-keys"), "name").select("text_id", "needle_id", "needle").distinct()
    return (
        given.select("text_id", "text")
        .join(candidates, "text_id")
        .where(F.contains("text", "needle"))
        .select("text_id", "needle_id")
    )


# --- stages ----------------------------------------------------------------------------------


def stage_transitions(events: DataFrame, width: int = SEQUENCE_WIDTH) -> DataFrame:
    """Add `previous` (pending at the start) and `legal` to each stage event.

    `events` holds run_id, stage, status, pos.
    """
    moves = F.array(
        *[F.lit(f"{a}>{b}") for a, targets in STAGE_MOVES.items() for b in targets]
    )
    moved = previous_row(events, ["run_id", "stage"], "pos", ["status"], "_before", width)
    return (
        moved.withColumn("previous", F.coalesce("_before.status", F.lit("pending")))
        .withColumn("legal", F.array_contains(moves, F.concat_ws(">", "previous", "status")))
        .drop("_before")
    )


def stage_summaries(events: DataFrame) -> DataFrame:
    """Start, end, duration, last status and its detail per (run, stage), with any problem.

    `events` also holds `at` (timestamp) and `detail`.
    """
    last = F.max_by(F.struct("status", "at", "detail"), "pos")
    grouped = events.groupBy("run_id", "stage").agg(
        F.min_by("at", "pos").alias("started_at"), last.alias("last")
    )
    ended = F.when(F.col("last.status") != "running", F.col("last.at"))
    problem = F.when(
        (F.col("status") == "failed") & F.col("detail").isNull(), "a failed stage must state its failure reason"
    ).when(
        (F.col("status") == "partial") & F.col("detail").isNull(), "a partial stage must state its boundary explicitly"
    )
    return (
        grouped.withColumn("ended_at", ended)
        .withColumn(
            "duration_us",
            F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")),
        )
        .select("run_id", "stage", "started_at", "ended_at", "duration_us", "last.status", "last.detail")
        .withColumn("problem", problem)
    )
