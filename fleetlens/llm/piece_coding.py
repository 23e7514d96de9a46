"""SentencePiece encoding and decoding of documents of any length, by a max-plus scan of chunks.

A model of merges gives one path through a text's pieces: a sequence of pieces is the encoding
exactly if every two neighbours, encoded together, come out as those two. So a giant text is cut
into chunks, and a cut's boundary states are the pieces that may hold the character before it. A
chunk's transfer matrix says for each pair of states at its ends whether the encoding of what lies
between fits to both: 0 if so, else minus infinity. Matrices are combined by max-plus products,
which picks the one path that fits everywhere; then each chunk is encoded between its own two
states, alone. Where a blank follows another character no piece of the model reaches across; a
cut is moved there if such a place is near, and has one state.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import portions, texts_of
from fleetlens.sources.scratch import materialize

#: Characters of a chunk; a longer text is a giant one.
CHUNK = 1 << 15
#: Rows decoded at once.
DECODED = 64
#: How far a cut is moved to come to stand before a blank.
SEEK = 256
_SPACE = "▁"
_NEVER = float("-inf")

#: A boundary state: how many characters its piece has before and behind the cut. FREE holds no
#: piece: at both ends of a text, and where no piece can reach across.
State = tuple[int, int]
FREE: State = (0, 0)


class Coder:
    """A model file of merges, as bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        # Two messages on end are merged, so this appends: normalizer_spec { add_dummy_prefix: false }.
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        size = self.inner.vocab_size()
        plain = [
            i for i in range(size)
            if not (self.inner.is_byte(i) or self.inner.is_control(i) or self.inner.is_unknown(i) or self.inner.is_unused(i))
        ]
        self.pieces = {self.inner.id_to_piece(i).replace(_SPACE, " "): i for i in plain}
        self.reach = max(map(len, self.pieces))
        self.cuts_at_blanks = not any(a != " " and b == " " for p in self.pieces for a, b in zip(p, p[1:], strict=False))
        self.bytes = [
            bytes([int(self.inner.id_to_piece(i)[1:-1], 16)]) if self.inner.is_byte(i)
            else b"" if self.inner.is_control(i)
            else self.inner.id_to_piece(i).replace(_SPACE, " ").encode()
            for i in range(size)
        ]
        self._pairs: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they stand, without the blank that begins a document."""
        return self.inner.encode(texts, num_threads=1)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The document of the ids; the blank that encoding put in front goes."""
        text = b"".join([self.bytes[i] for i in ids]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces (or characters without a piece) stay apart when encoded together."""
        if not left or not right:
            return True
        known = self._pairs.get((left, right))
        if known is None:
            one, two, both = self.encode([left, right, left + right])
            known = self._pairs[left, right] = both == one + two
        return known

    def ends(self, ids: list[int]) -> tuple[str, str]:
        """The first and the last piece of some ids; a character without a piece counts as one."""

        def run(order: list[int]) -> list[bytes]:
            # Bytes of one character: up to the end that can be decoded.
            out = [self.bytes[order[0]]]
            if not self.inner.is_byte(order[0]):
                return out
            for i in order[1:4]:
                try:
                    b"".join(out if order is ids else out[::-1]).decode()
                    break
                except UnicodeDecodeError:
                    out.append(self.bytes[i])
            return out

        backwards = ids[::-1]
        return b"".join(run(ids)).decode(), b"".join(run(backwards)[::-1]).decode()

    def states(self, before: str, behind: str) -> list[State]:
        """Boundary states of a cut between two stretches of text."""
        if self.cuts_at_blanks and before[-1] != " " and behind[:1] == " ":
            return [FREE]
        out = []
        for a in range(1, min(self.reach, len(before)) + 1):
            for b in range(min(self.reach - a, len(behind)) + 1):
                piece = before[len(before) - a :] + behind[:b]
                if piece in self.pieces:
                    if self.encode([piece])[0] == [self.pieces[piece]]:
                        out.append((a, b))
                elif a + b == 1:
                    out.append((a, b))
        return out

    def between(self, text: str, start: int, end: int, entry: State, exit_: State) -> list[int] | None:
        """Ids from behind the entry's piece through the exit's piece, or None if they don't fit.

        The chunk is text[start:end]; what stands around it is context.
        """
        first, last = start + entry[1], end - exit_[0]
        if first > last:
            return None
        inside = self.encode([text[first:last]])[0] if first < last else []
        left, right = text[start - entry[0] : first], text[last : end + exit_[1]]
        if inside:
            head, tail = self.ends(inside)
            if not (self.fits(left, head) and self.fits(tail, right)):
                return None
        elif not self.fits(left, right):
            return None
        return inside + (self.encode([right])[0] if right else [])


def cuts(text: str, chunk: int, coder: Coder) -> list[int]:
    """Where a text is cut: every `chunk` characters, moved to a blank nearby if there is one."""
    out = [0]
    while len(text) - out[-1] > chunk:
        at = nominal = out[-1] + chunk
        while coder.cuts_at_blanks and at < min(nominal + SEEK, len(text)) and not (text[at] == " " != text[at - 1]):
            at += 1
        at = at if at < min(nominal + SEEK, len(text)) else nominal
        if len(text) - at <= 2 * coder.reach:
            break
        out.append(at)
    return [*out, len(text)]


def product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices; associative."""
    return (one[:, :, None] + two[None, :, :]).max(axis=1)


def path(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path through a row of transfer matrices."""
    forward = [matrices[0]]
    for m in matrices[1:]:
        forward.append(product(forward[-1], m))
    assert forward[-1].max() == 0, "no path fits"
    states = [int(forward[-1][0].argmax())]
    for m, before in zip(reversed(matrices[1:]), reversed(forward[:-1]), strict=True):
        states.append(int((before[0] + m[:, states[-1]]).argmax()))
    return states[::-1]


_CHUNKS = (
    "doc long, chunk int, n_chunks int, before string, body string, behind string, "
    "entries array<struct<a:int,b:int>>, exits array<struct<a:int,b:int>>"
)


def encode_documents(
    docs: DataFrame, model_path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the ids of every document, as the library gives them for the whole text.

    A null text is the empty one, which has no ids. Texts of at most `chunk` characters are one
    chunk; chunks of longer ones are spread over the cluster, and only their matrices meet. The
    model must leave texts as they are but for blanks (no normalization). Repeated rows are encoded
    each; an empty table gives no rows. The model file has a fixed size and goes out as a broadcast.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    own = texts_of(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    giant = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for batch in batches:
            for part in portions(batch, "text", 1 << 18):
                texts = [" " + t if t else "" for t in part.column(1).to_pylist()]
                ids = pa.array(coder.encode(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for part in (part for batch in batches for part in portions(batch, "text")):
            for doc, text in zip(*(part.column(i).to_pylist() for i in (0, 1)), strict=True):
                text = " " + text
                places = cuts(text, chunk, coder)
                reach = coder.reach
                states = [[FREE], *(coder.states(text[max(0, c - reach) : c], text[c : c + reach]) for c in places[1:-1]), [FREE]]
                rows = [
                    {
                        "doc": doc, "chunk": i, "n_chunks": len(places) - 1,
                        "before": text[max(0, s - reach) : s], "body": text[s:e], "behind": text[e : e + reach],
                        "entries": [{"a": a, "b": b} for a, b in states[i]],
                        "exits": [{"a": a, "b": b} for a, b in states[i + 1]],
                    }
                    for i, (s, e) in enumerate(zip(places, places[1:], strict=False))
                ]
                state = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("doc", pa.int64()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("before", pa.string()),
                    ("body", pa.string()), ("behind", pa.string()), ("entries", state), ("exits", state),
                ]))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for part in (part for batch in batches for part in portions(batch, "body")):
            out = []
            for row in part.to_pylist():
                text, start = row["before"] + row["body"] + row["behind"], len(row["before"])
                end = start + len(row["body"])
                out.append([
                    [
                        0.0 if coder.between(text, start, end, (e["a"], e["b"]), (x["a"], x["b"])) is not None else _NEVER
                        for x in row["exits"]
                    ]
                    if (len(row["entries"]), len(row["exits"])) != (1, 1)
                    else [0.0]
                    for e in row["entries"]
                ])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("chunk"), pa.array(out, pa.list_(pa.list_(pa.float64())))],
                names=["doc", "chunk", "matrix"],
            )

    def chosen(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        states = path([np.array(r["matrix"]) for r in rows])
        return pa.table({
            "doc": pa.array([r["doc"] for r in rows], pa.int64()),
            "chunk": pa.array([r["chunk"] for r in rows], pa.int32()),
            "entry": pa.array([0, *states[:-1]], pa.int32()),
            "exit": pa.array(states, pa.int32()),
        })

    def backtraced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for part in (part for batch in batches for part in portions(batch, "body")):
            out = []
            for row in part.to_pylist():
                text, start = row["before"] + row["body"] + row["behind"], len(row["before"])
                entry, exit_ = row["entries"][row["entry"]], row["exits"][row["exit"]]
                out.append(coder.between(
                    text, start, start + len(row["body"]), (entry["a"], entry["b"]), (exit_["a"], exit_["b"])
                ))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("chunk"), pa.array(out, pa.list_(pa.int32()))],
                names=["doc", "chunk", "ids"],
            )

    # Numbers of giant documents are written down, so that they stay as they are in later jobs.
    giants = materialize(
        own.where(giant).withColumn("doc", F.monotonically_increasing_id()).select("doc", "doc_id", "text"), "giants"
    )
    parts = materialize(giants.select("doc", "text").mapInArrow(chunks, _CHUNKS), "chunks")
    spread = parts.repartition("doc", "chunk")
    found = spread.mapInArrow(matrices, "doc long, chunk int, matrix array<array<double>>")
    states = found.groupBy("doc").applyInArrow(chosen, "doc long, chunk int, entry int, exit int")
    traced = parts.join(states, ["doc", "chunk"]).mapInArrow(backtraced, "doc long, chunk int, ids array<int>")
    joined = traced.groupBy("doc").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda c: c["ids"])).alias("ids")
    )
    long_ones = giants.select("doc", "doc_id").join(joined, "doc").select("doc_id", "ids")
    return own.where(~giant).mapInArrow(whole, f"doc_id {kind}, ids array<int>").unionAll(long_ones)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text): the text of each row of ids, exact for encoded texts.

    `ids_crc32` is the checksum of the ids as little-endian unsigned 32-bit numbers. Null ids
    count as none. A text that begins with the piece of a blank loses it, as encoding put it there.
    """
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for batch, first in ((b, i) for b in batches for i in range(0, b.num_rows, DECODED)):
            part = batch.slice(first, DECODED)
            lists = part.column(1)
            rows = [(lists[i].values.to_numpy() if lists[i].is_valid else np.empty(0)).astype("<u4") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([r.size for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                    pa.array([coder.decode(r.tolist()) for r in rows], pa.string()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "text"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, n_pieces long, ids_crc32 long, text string")


def coded_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256): every document encoded and decoded again."""
    encoded = encode_documents(docs, model_path, id_col=id_col, text_col=text_col)
    return decode_documents(encoded, model_path).select(
        "doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256")
    )
