"""Secret scan: fixed patterns, and a conditional random field for secrets that no pattern knows.

The field (`secret_tags`) learns from a bounded sample of texts what the patterns mark as secret
values, by shape, neighbouring words and file. So that it does not take one format for the only one,
each assigned value is also shown as a drawn one of other letters and length. It tags every token of every text; spans of it that
touch no pattern's span are added to those. Texts are scanned whole and each by itself, so there is
no shuffle in the scan.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import secret_tags
from fleetlens.llm.common import portions, texts_of
from fleetlens.sources.scratch import materialize

#: Texts to learn from, at most, of those with and of those without a pattern's match: the ones of
#: least hash, each different text once.
SAMPLE = 800
#: Windows of a text with matches, and tokens to either side of what a window is about.
WINDOWS, AROUND = 4, 10
#: Characters to either side of an assigned value that stay where another value takes its place.
NEAR = 200
#: A span has so many characters at least.
LEAST = 6

KINDS = ["assign", "access", "hex", "crf"]
_NAMES = "password|passwd|secret|token|api_?key"
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = re.compile(rf"(?i:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?({_VALUE}+)", re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
#: Letters of other values: hexadecimal in small and large letters, letters and digits, base 64.
_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", digits + ascii_letters, digits + ascii_letters + "+/"]
#: What each spelling of a name holds in small letters.
_PARTS = (b"passw", b"secret", b"token", b"api")
#: The same patterns for Spark, to tell which texts have a match.
_ANY = f"AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|(?i:{_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?{_VALUE}{{6}}"

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of all matches of the patterns, in code points.

    Matches of a kind are leftmost and do not overlap; those too short go, with what they cover.
    """
    out = []
    if (b":" in data or b"=" in data) and any(part in data.lower() for part in _PARTS):
        out += [(*m.span(), 0, m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in data:
        out += [(*m.span(), 1, m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), 2, m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


class _Places:
    """Code points of byte offsets in one text, asked in ascending order."""

    def __init__(self, data: bytes) -> None:
        self.data, self.plain, self.byte, self.point = data, data.isascii(), 0, 0

    def __call__(self, byte: int) -> int:
        if self.plain:
            return byte
        self.point += len(self.data[self.byte : byte].decode())
        self.byte = byte
        return self.point


def _windows(text: str, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and tags around the first secrets of a text, or of two places without one."""
    tokens = secret_tags.tokenize([data])
    if not len(tokens):
        return
    tags = np.full(len(tokens), secret_tags.OUTSIDE, dtype=np.int8)
    centres = []
    for _start, end, _kind, value in base_spans(text, data):
        first, last = len(text[:value].encode()), len(text[:end].encode())
        a, b = np.searchsorted(tokens.end, first, side="right"), np.searchsorted(tokens.first, last)
        if a < b and tags[a] == secret_tags.OUTSIDE:
            tags[a], tags[a + 1 : b] = secret_tags.BEGIN, secret_tags.INSIDE
            centres.append((a, b))
    if not centres:
        some = zlib.crc32(data) % len(tokens)
        # The longest token is most like a secret.
        odd = int(np.argmax(tokens.end - tokens.first))
        centres = [(some, some + 1), (odd, odd + 1)]
    for a, b in centres[:WINDOWS]:
        low, high = max(0, a - AROUND), min(len(tokens), a + AROUND, b + AROUND)
        yield secret_tags.features(tokens, low, high), tags[low:high]
    draw = random.Random(zlib.crc32(data))
    for _start, end, _kind, value in [s for s in base_spans(text, data) if s[2] == 0][:WINDOWS]:
        yield _varied(text[max(0, value - NEAR) : value], text[end : end + NEAR], draw, tokens.files)


def _varied(before: str, after: str, draw: random.Random, files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A window whose assigned value is another one: other letters, another length."""
    value = "".join(draw.choices(draw.choice(_ALPHABETS), k=draw.randint(12, 44))).encode()
    first = len(before.encode())
    tokens = secret_tags.tokenize([before.encode() + value + after.encode()])
    tokens.files = files
    a, b = np.searchsorted(tokens.end, first, side="right"), np.searchsorted(tokens.first, first + len(value))
    tags = np.full(len(tokens), secret_tags.OUTSIDE, dtype=np.int8)
    tags[a], tags[a + 1 : b] = secret_tags.BEGIN, secret_tags.INSIDE
    low, high = max(0, a - AROUND), min(len(tokens), a + AROUND, b + AROUND)
    return secret_tags.features(tokens, low, high), tags[low:high]


def learn_model(texts: DataFrame, sample: int = SAMPLE) -> secret_tags.Model:
    """The field, from at most `sample` different texts with a match and as many without one.

    `texts` has a column text. Hashes of all texts are combined and the least ones taken; what
    comes back to the driver is a few windows of tokens of each text that was taken.
    """
    hashed = texts.select("text", F.xxhash64("text").alias("key"))
    marked = hashed.select("key", F.col("text").rlike(_ANY).alias("held")).groupBy("key").agg(F.max("held").alias("held"))
    # Written, as it is read for both halves of the sample.
    marked = materialize(marked, "marked")
    # Mixed again, since a limit of least keys would follow how the table is laid out.
    order = F.xxhash64(F.lit(11), "key")
    taken = [r.key for held in (True, False) for r in marked.where(F.col("held") == held).orderBy(order, "key").limit(sample).collect()]
    if not taken:
        return secret_tags.train([])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (key, own.tobytes(), tag.tobytes())
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for own, tag in _windows(text, text.encode())
            ]
            names, kinds = ["key", "rows", "tags"], [pa.int64(), pa.binary(), pa.binary()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # `sample` bounds this side.
    keys = texts.sparkSession.createDataFrame([(k,) for k in taken], "key long")
    known = hashed.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("text").alias("text"))
    windows = sorted(tuple(r) for r in known.mapInArrow(cut, "key long, rows binary, tags binary").collect())
    halves: tuple[list[secret_tags.Sequence], list[secret_tags.Sequence]] = ([], [])
    for key, rows, tags in windows:
        own = np.frombuffer(rows, np.int32).reshape(-1, secret_tags.FEATURES)
        halves[key & 1].append((own, np.frombuffer(tags, np.int8)))
    return secret_tags.train(secret_tags.trusted(halves))


def scan(texts: list[str], model: secret_tags.Model) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of all spans of each text, by start and kind."""
    datas = [t.encode() for t in texts]
    base = [base_spans(t, d) for t, d in zip(texts, datas, strict=True)]
    added: list[list[tuple[int, int]]] = [[] for _ in texts]
    tokens = secret_tags.tokenize(datas)
    begins = np.cumsum([0, *(len(d) + 1 for d in datas)])
    places = {}
    for i, first, end in secret_tags.spans(tokens, *secret_tags.tag(tokens, model)):
        place = places.setdefault(i, _Places(datas[i]))
        added[i].append((place(first - int(begins[i])), place(end - int(begins[i]))))
    out = []
    for own, more in zip(base, added, strict=True):
        spans = [(s, e, k) for s, e, k, _ in own]
        if more:
            # Matches of different kinds overlap, so only the union of all is in order.
            starts = np.array([s for s, _, _ in spans], dtype=np.int64)
            reach = np.maximum.accumulate(np.array([e for _, e, _ in spans], dtype=np.int64)) if spans else starts
            for s, e in more:
                before = int(np.searchsorted(starts, e))
                if e - s >= LEAST and (before == 0 or reach[before - 1] <= s):
                    spans.append((s, e, 3))
        out.append(sorted(spans, key=lambda s: (s[0], s[2])))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, spans) of every row: kind, start and end of each span, in code points, end exclusive.

    Kinds are assign, access and hex, the patterns' matches, and crf, what the field adds: spans of
    six characters or more that overlap no match. Spans come by start, then kind. A null or empty
    text has none. Without a match in any text there is nothing to learn from and nothing is added.
    Repeated rows are scanned each and teach once. An empty table gives no rows. Ids keep their
    type; other columns play no part.
    """
    texts = texts_of(docs, id_col, text_col)
    model = learn_model(texts.select("text"), sample)
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                found = scan(part.column("text").to_pylist(), model)
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return texts.mapInArrow(scanned, f"doc_id {id_type}, spans {SPANS}")


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of rows of `find_secrets`."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
