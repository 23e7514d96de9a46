"""A linear-chain conditional random field over the tokens of texts: begin, inside, outside.

Tokens are runs of word bytes (letters, digits, `_ - + / .` and all that is not ASCII) or of one
mark. Every token has one row of the weight table for each of its features: its shape, the words
beside it, and what kind of file it stands in. Everything here works on many tokens at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from fleetlens.llm.hashing import mix

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: Tokens that are looked at together.
BLOCK = 1 << 16
#: How far a token's features look to either side.
REACH = 5

_WORDS = 4096
_LENGTHS = np.array([2, 3, 4, 6, 8, 10, 14, 18, 24, 32, 48])
#: Rows of the weight table of each feature, in order.
_SIZES = {
    "shape": 64 * 12,
    "kind": 64,
    "changes": 8 * 12,
    "digits": 8 * 12,
    "mark": _WORDS,
    "before": _WORDS,
    "before2": _WORDS,
    "after": _WORDS,
    "led_by": 4 * _WORDS,
    "led": _WORDS,
    "file": 8 * 8 * 8,
}
FEATURES = len(_SIZES)
_FIRST = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()])[:-1].tolist(), strict=True))
ROWS = sum(_SIZES.values())


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, shape, change, lower = (np.zeros(256, dtype=np.uint8) for _ in range(4))
    for byte in range(256):
        c = chr(byte)
        lower[byte] = ord(c.lower()) if byte < 128 else byte
        if byte >= 128:
            kind[byte], shape[byte], change[byte] = 1, 8, 4
        elif c.isdigit():
            kind[byte], shape[byte], change[byte] = 1, 1, 1
        elif c.isalpha():
            kind[byte], change[byte] = 1, 2 if c.islower() else 3
            shape[byte] = (2 if c.islower() else 4) | (0 if c in "abcdefABCDEF" else 32)
        elif c in "_-+/.":
            kind[byte], shape[byte], change[byte] = 1, 16, 5
        elif byte > 32 and byte != 127:
            kind[byte] = byte
    return kind, shape, change, lower


_KIND, _SHAPE, _CHANGE, _LOWER = _tables()


@dataclass
class Model:
    """Weights of each row for each tag, and of each tag after each."""

    weights: np.ndarray
    moves: np.ndarray


@dataclass
class Tokens:
    """Tokens of several texts in one buffer, each with its place and the number of its text."""

    data: np.ndarray
    first: np.ndarray
    end: np.ndarray
    text: np.ndarray
    files: np.ndarray

    def __len__(self) -> int:
        return self.first.size


def tokenize(texts: list[bytes]) -> Tokens:
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = _KIND[data]
    starts = np.empty(data.size, dtype=bool)
    if data.size:
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    edges = np.flatnonzero(starts)
    ends = np.append(edges[1:], data.size)
    own = kind[edges] != 0
    first, end = edges[own], ends[own]
    sizes = np.maximum(np.diff(begins), 2) - 1

    def share(held: np.ndarray, factor: int) -> np.ndarray:
        counts = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
        n = counts[begins[1:]] - counts[begins[:-1]]
        return np.minimum(7, n * factor // sizes)

    lines = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int64)))
    n_lines = lines[np.maximum(begins[1:] - 1, begins[:-1])] - lines[begins[:-1]] + 1
    # What kind of file a text is: its shares of marks and digits and its number of lines.
    files = 64 * share(kind > 1, 64) + 8 * share(_CHANGE[data] == 1, 32) + np.minimum(7, np.log2(n_lines).astype(np.int64))
    return Tokens(data, first, end, np.searchsorted(begins, first, side="right") - 1, files)


def features(tokens: Tokens, low: int, high: int) -> np.ndarray:
    """Rows of the weight table of tokens `low` to `high`: one column for each feature."""
    a, b = max(0, low - REACH), min(len(tokens), high + 1)
    first, end, text = tokens.first[a:b], tokens.end[a:b], tokens.text[a:b]
    base, stop = first[0], end[-1]
    data = np.concatenate((_LOWER[tokens.data[base:stop]], np.zeros(8, dtype=np.uint8)))
    plain, at, size = tokens.data[base:stop], first - base, end - first
    length = np.searchsorted(_LENGTHS, size, side="right")
    shape = np.bitwise_or.reduceat(_SHAPE[plain], at)
    change = _CHANGE[plain]
    turned = np.zeros(plain.size, dtype=np.int32)
    turned[1:] = (change[1:] != change[:-1]) & (change[1:] > 0) & (change[:-1] > 0)
    turned[at] = 0
    turns = np.minimum(7, np.add.reduceat(turned, at) // 2)
    digits = np.add.reduceat((change == 1).astype(np.int32), at) * 7 // size

    named = np.zeros(size.size, dtype=np.uint64)
    for k in range(8):
        named |= np.where(k < size, data[at + np.minimum(k, size)].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    word = 1 + (mix(named * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)) % np.uint64(_WORDS - 1)).astype(np.int64)
    is_word = _KIND[plain[at]] == 1

    def beside(values: np.ndarray, step: int, none: int = 0) -> np.ndarray:
        out = np.full(values.size, none, dtype=np.int64)
        if step > 0 and values.size > step:
            same = text[step:] == text[:-step]
            out[step:] = np.where(same, values[:-step], none)
        elif step < 0 and values.size > -step:
            same = text[:step] == text[-step:]
            out[:step] = np.where(same, values[-step:], none)
        return out

    near = [beside(word, k) for k in range(1, REACH)]
    words = [beside(is_word.astype(np.int64), k) for k in range(1, REACH)]
    set_by = np.isin(plain[at], np.frombuffer(b":=", dtype=np.uint8)).astype(np.int64)
    quote = np.isin(plain[at], np.frombuffer(b"\"'`", dtype=np.uint8)).astype(np.int64)
    led, how, looking = np.zeros(size.size, dtype=np.int64), np.zeros(size.size, dtype=np.int64), np.ones(size.size, dtype=bool)
    for k in range(1, REACH):
        found = looking & (words[k - 1] > 0)
        led = np.where(found, near[k - 1], led)
        looking &= ~found
        how |= np.where(looking, beside(set_by, k) | 2 * beside(quote, k), 0)
    columns = {
        "shape": shape.astype(np.int64) * 12 + length,
        "kind": shape.astype(np.int64),
        "changes": turns * 12 + length,
        "digits": digits * 12 + length,
        "mark": np.where(size <= 2, word, 0),
        "before": near[0],
        "before2": near[1],
        "after": beside(word, -1),
        "led_by": how * _WORDS + led,
        "led": led,
        "file": tokens.files[text],
    }
    return np.stack([columns[name][low - a : high - a] + _FIRST[name] for name in _SIZES], axis=1).astype(np.int32)


def always_outside(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that every best path leaves outside, whatever stands beside them.

    Putting `outside` for another tag there changes a path by the token's own scores and by two
    moves at most; where the first is more than the moves can give back, the path gets better.
    """
    given = np.maximum((moves - moves[:, [OUTSIDE]]).max(axis=0), 0)
    taken = np.maximum((moves - moves[[OUTSIDE], :]).max(axis=1), 0)
    apart = scores[:, [OUTSIDE]] - scores
    return (apart[:, BEGIN] > given[BEGIN] + taken[BEGIN]) & (apart[:, INSIDE] > given[INSIDE] + taken[INSIDE])


def viterbi(scores: np.ndarray, chains: np.ndarray, moves: np.ndarray, led: np.ndarray, followed: np.ndarray) -> np.ndarray:
    """Best tags of many chains, which lie behind each other in `scores` and have lengths `chains`.

    `led` and `followed` tell whether a token that is outside stands before and after a chain.
    """
    starts = np.concatenate(([0], np.cumsum(chains)[:-1])).astype(np.int64)
    order = np.argsort(-chains, kind="stable")
    at, sizes = starts[order], chains[order]
    best = scores[at] + np.where(led[order, None], moves[OUTSIDE], 0)
    # How many chains are longer than each step.
    longer = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if sizes.size else 0) + 1), side="right")
    back = []
    for t in range(1, longer.size):
        m = longer[t]
        ways = best[:m, :, None] + moves
        # Of equal paths the one that comes from `outside`.
        back.append((2 - ways[:, ::-1, :].argmax(axis=1)).astype(np.int8))
        best[:m] = ways.max(axis=1) + scores[at[:m] + t]
    last = best + np.where(followed[order, None], moves[:, OUTSIDE], 0)
    tag = 2 - last[:, ::-1].argmax(axis=1)
    out = np.full(scores.shape[0], OUTSIDE, dtype=np.int8)
    for t in range(longer.size - 1, -1, -1):
        m = longer[t]
        out[at[:m] + t] = tag[:m]
        if t:
            tag[:m] = back[t - 1][np.arange(m), tag[:m]]
    return out


def tag(tokens: Tokens, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tokens, their tags): all tokens whose best tag is not `outside`, and some that are."""
    open_at, open_scores = [], []
    for low in range(0, len(tokens), BLOCK):
        rows = features(tokens, low, min(low + BLOCK, len(tokens)))
        scores = np.take(model.weights, rows[:, 0], axis=0)
        for k in range(1, FEATURES):
            scores += np.take(model.weights, rows[:, k], axis=0)
        left = np.flatnonzero(~always_outside(scores, model.moves))
        open_at.append(left + low)
        open_scores.append(scores[left])
    at = np.concatenate(open_at) if open_at else np.zeros(0, dtype=np.int64)
    if not at.size:
        return at, np.zeros(0, dtype=np.int8)
    text = tokens.text[at]
    new = np.empty(at.size, dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    chains = np.diff(np.append(heads, at.size))
    lasts = heads + chains - 1
    led = (at[heads] > 0) & (tokens.text[np.maximum(at[heads] - 1, 0)] == text[heads])
    after = np.minimum(at[lasts] + 1, len(tokens) - 1)
    followed = (at[lasts] + 1 < len(tokens)) & (tokens.text[after] == text[lasts])
    return at, viterbi(np.concatenate(open_scores), chains, model.moves, led, followed)


def spans(tokens: Tokens, at: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, first byte, end) in the buffer of each `begin` with the `inside` that follow it.

    An `inside` after nothing begins a span.
    """
    held = np.flatnonzero(tags != OUTSIDE)
    if not held.size:
        return
    own, kind = at[held], tags[held]
    text = tokens.text[own]
    new = np.ones(held.size, dtype=bool)
    new[1:] = (kind[1:] == BEGIN) | (own[1:] != own[:-1] + 1) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:], held.size) - 1
    for h, e in zip(heads, lasts, strict=True):
        yield int(text[h]), int(tokens.first[own[h]]), int(tokens.end[own[e]])


Sequence = tuple[np.ndarray, np.ndarray]


def trusted(halves: tuple[list[Sequence], list[Sequence]], rounds: int = 40) -> list[Sequence]:
    """All sequences but unmarked ones in which a model of the other half finds something.

    Where marks come from patterns, what no pattern knows stands in the sample as an unmarked
    secret; a model that has not seen it tells it from what is really plain.
    """
    out: list[Sequence] = []
    for own, other in (halves, halves[::-1]):
        model = train(other, rounds)
        if not own:
            continue
        scores = model.weights[np.concatenate([f for f, _ in own])].sum(axis=1)
        alone = np.zeros(len(own), dtype=bool)
        sizes = np.array([len(t) for _, t in own])
        best = viterbi(scores, sizes, model.moves, alone, alone)
        ends = np.cumsum(sizes)
        for sequence, low, high in zip(own, ends - sizes, ends, strict=True):
            if (sequence[1] != OUTSIDE).any() or (best[low:high] == OUTSIDE).all():
                out.append(sequence)
    return out


def train(
    sequences: list[Sequence], rounds: int = 80, rate: float = 0.1, penalty: float = 1e-4
) -> Model:
    """Weights of most conditional likelihood with a square penalty, by steps over all sequences.

    A sequence is its feature rows (tokens by features) and its tags. Same sequences, same model.
    """
    sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
    weights, moves = np.zeros((ROWS, 3), dtype=np.float32), np.zeros((3, 3), dtype=np.float32)
    if not sequences:
        return Model(weights, moves)
    sizes = np.array([len(t) for _, t in sequences])
    longer = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    seen, rows = np.unique(np.concatenate([f for f, _ in sequences]), return_inverse=True)
    rows = rows.reshape(-1, FEATURES)
    tags = np.concatenate([t for _, t in sequences]).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    observed = np.eye(3)[tags]
    pairs = np.zeros((3, 3))
    inner = np.ones(tags.size, dtype=bool)
    inner[starts] = False
    np.add.at(pairs, (tags[np.flatnonzero(inner) - 1], tags[inner]), 1)
    flat = rows.ravel()
    own, step = np.zeros((seen.size, 3)), np.zeros((3, 3))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (own, step)]
    n = len(sequences)
    for turn in range(1, rounds + 1):
        node = own[rows].sum(axis=1)
        likely = np.exp(node - node.max(axis=1, keepdims=True))
        go = np.exp(step)
        ahead, scale = np.zeros_like(likely), np.ones(tags.size)
        for t in range(longer.size):
            at = starts[: longer[t]] + t
            now = likely[at] if t == 0 else (ahead[at - 1] @ go) * likely[at]
            scale[at] = now.sum(axis=1)
            ahead[at] = now / scale[at][:, None]
        behind, expected = np.ones_like(likely), np.zeros((3, 3))
        for t in range(longer.size - 1, 0, -1):
            at = starts[: longer[t]] + t
            coming = likely[at] * behind[at] / scale[at][:, None]
            behind[at - 1] = coming @ go.T
            expected += (ahead[at - 1].T @ coming) * go
        share = ahead * behind
        share /= share.sum(axis=1, keepdims=True)
        wrong = share - observed
        slope = np.stack(
            [np.bincount(flat, weights=np.repeat(wrong[:, k], FEATURES), minlength=seen.size) for k in range(3)], axis=1
        )
        for x, g, (m, v) in ((own, slope, state[0]), (step, expected - pairs, state[1])):
            g = g / n + penalty * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    weights[seen], moves[:] = own, step
    return Model(weights, moves)
