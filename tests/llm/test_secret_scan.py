from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import queries, secret_scan, secret_tags

SCHEMA = "doc_id long, text string, spans string, kind int, key string, `a.b` int"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(text):
    """Matches of the three patterns by a walk over the text, as (start, kind, end)."""
    text, out = text or "", []
    value = set(LETTERS + LETTERS.lower() + "0123456789+/_.=-")
    at = 0
    while at < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            own = text[at : at + len(name)]
            if own.isascii() and own.lower() == name:
                k = at + len(name)
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or k >= len(text):
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                stop = k
                while stop < len(text) and text[stop] in value:
                    stop += 1
                if stop > k:
                    end = stop
                    if stop - k >= 6:
                        out.append((at, 0, end))
                    break
        at = end or at + 1
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


pieces = ["password", "passwd", "PassWD", "secret", "token", "api_key", "apikey", "API_KEY", " ", "  ", ":", "=", '"', "'", "é", "\n"]
pieces += ["abcdef", "abc", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "ſ", "K", "x", ".", "#"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(pieces), max_size=14).map("".join))
def test_patterns_beside_a_walk(text):
    assert [(s, k, e) for s, e, k, _ in secret_scan.base_spans(text, text.encode())] == brute(text)


def path_score(scores, moves, tags, led, followed):
    total = sum(scores[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags))
    return total + (moves[2, tags[0]] if led else 0) + (moves[tags[-1], 2] if followed else 0)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(1, 5), min_size=1, max_size=5))
def test_viterbi_beside_all_paths(seed, chains):
    rnd = np.random.Generator(np.random.PCG64(seed))
    scores, moves = rnd.normal(size=(sum(chains), 3)), rnd.normal(size=(3, 3))
    led, followed = rnd.random(len(chains)) < 0.5, rnd.random(len(chains)) < 0.5
    got = secret_tags.viterbi(scores, np.array(chains), moves, led, followed)
    at = 0
    for n, a, b in zip(chains, led, followed):
        own = scores[at : at + n]
        best = max(itertools.product(range(3), repeat=n), key=lambda t: path_score(own, moves, t, a, b))
        assert tuple(got[at : at + n]) == best
        at += n


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 7))
def test_tokens_left_out_are_outside_in_every_best_path(seed, n):
    rnd = np.random.Generator(np.random.PCG64(seed))
    scores, moves = rnd.normal(size=(n, 3)) * 3, rnd.normal(size=(3, 3))
    best = max(itertools.product(range(3), repeat=n), key=lambda t: path_score(scores, moves, t, False, False))
    sure = secret_tags.always_outside(scores, moves)
    assert all(best[i] == secret_tags.OUTSIDE for i in np.flatnonzero(sure))


def likelihood(model, sequences):
    """Log likelihood of the tags by the sum over all paths."""
    total = 0.0
    for rows, tags in sequences:
        scores = model.weights[rows].astype(float).sum(axis=1)
        paths = [path_score(scores, model.moves, t, False, False) for t in itertools.product(range(3), repeat=len(tags))]
        total += path_score(scores, model.moves, tuple(tags), False, False) - np.logaddexp.reduce(paths)
    return total


def test_training_reaches_the_top_of_the_likelihood():
    rnd = np.random.Generator(np.random.PCG64(3))
    sequences = [
        (rnd.integers(0, 6, (n, secret_tags.FEATURES)).astype(np.int32), rnd.integers(0, 3, n).astype(np.int8))
        for n in rnd.integers(1, 6, 30)
    ]
    penalty = 0.05
    model = secret_tags.train(sequences, rounds=600, rate=0.02, penalty=penalty)

    def value(m):
        return likelihood(m, sequences) / 30 - penalty / 2 * ((m.weights.astype(float) ** 2).sum() + (m.moves.astype(float) ** 2).sum())

    top = value(model)
    for _ in range(20):
        moved = secret_tags.Model(model.weights.copy(), model.moves + rnd.normal(0, 0.05, (3, 3)))
        moved.weights[:6] += rnd.normal(0, 0.05, (6, 3))
        assert value(moved) < top


def test_tokens_and_spans():
    texts = ["token = \"ab-c\"###x", "", "é1 b", "\n\n"]
    tokens = secret_tags.tokenize([t.encode() for t in texts])
    words = [bytes(tokens.data[a:b]).decode() for a, b in zip(tokens.first, tokens.end)]
    assert words == ["token", "=", '"', "ab-c", '"', "###", "x", "é1", "b"]
    assert tokens.text.tolist() == [0] * 7 + [2, 2]
    tags = np.array([2, 2, 1, 1, 0, 2, 1, 1, 0], dtype=np.int8)
    got = [(i, bytes(tokens.data[a:b]).decode()) for i, a, b in secret_tags.spans(tokens, np.arange(9), tags)]
    assert got == [(0, '"ab-c'), (0, '"'), (0, "x"), (2, "é1"), (2, "b")]


def test_features_do_not_depend_on_blocks_or_neighbouring_texts(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["token", "=", '"x1y2"', "Word", "é", ":"]) for _ in range(rnd.randrange(60))).encode() for _ in range(9)]
    together = secret_tags.tokenize(texts)
    whole = secret_tags.features(together, 0, len(together))
    alone = [secret_tags.features(t, 0, len(t)) for x in texts if len(t := secret_tags.tokenize([x]))]
    assert (whole == np.concatenate(alone)).all()
    for low in range(0, len(together), 7):
        high = min(low + 7, len(together))
        assert (secret_tags.features(together, low, high) == whole[low:high]).all()


def corpus():
    rnd = random.Random(7)
    words = ["plain", "words", "of", "Text", "12", "é,", "end."]
    texts = []
    for i in range(240):
        own = [rnd.choice(words) for _ in range(40)]
        if i % 3 == 0:
            own.insert(rnd.randrange(40), f'token = "{rnd.randbytes(16).hex()}"')
        texts.append(" ".join(own))
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def test_spans_of_odd_texts(spark):
    texts = corpus()
    key = random.Random(8).randbytes(20).hex().upper()
    odd = [None, "", " \n ", f'é the token "{key}" é', "token=" + "a" * 100_000, "secret: " * 3000, "token" + " " * 200_000 + "x"]
    odd += ["w " * 400_000 + f'token = "{key.lower()}"', "AKIA" * 6, texts[0], texts[0]]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, texts[0]), (1, texts[3])]
    got = secret_scan.span_digests(secret_scan.find_secrets(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(t)
    for r in got:
        matches = [m for m in (brute(t) for t in wanted[r.doc_id]) if digest(m) == r.base_sha256]
        assert matches
        own = matches[0]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in own) for kind in range(3)]
        spans = [(int(s), secret_scan.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 3] == own
        assert all(e <= a or s >= b for s, k, e in spans if k == 3 for a, kind, b in own)
    added = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("crf")] for r in got}
    assert added[1003] == ["crf:13:53"]
    assert not any(added[i] for i in range(240))


def test_held_out_secrets_by_the_field_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = secret_scan.learn_model(docs.where("doc_id % 2 = 0").select("text"))
    assert np.array_equal(model.weights, secret_scan.learn_model(docs.where("doc_id % 2 = 0").repartition(3).select("text")).weights)
    held = [r.text for r in docs.where("doc_id % 2 = 1").collect()]
    hits = values = wrong = clean = 0
    for text in held:
        data = text.encode()
        tokens = secret_tags.tokenize([data])
        found = list(secret_tags.spans(tokens, *secret_tags.tag(tokens, model)))
        base = brute(text)
        inside = [(len(text[:s].encode()), len(text[:e].encode())) for s, _, e in base]
        for s, e in inside:
            values += 1
            hits += any(a < e and b > s for _, a, b in found)
        wrong += sum(not any(a < e and b > s for s, e in inside) for _, a, b in found)
        clean += not base
    assert values > 50 and hits >= 0.98 * values
    assert wrong <= 0.001 * clean


def test_nothing_to_learn_from(spark):
    got = secret_scan.find_secrets(frame(spark, [(1, "plain words"), (2, None)])).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == [(1, []), (2, [])]
    assert secret_scan.find_secrets(frame(spark, [])).collect() == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op11(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        own = brute(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in own) for kind in range(3))
        assert r.base_sha256 == digest(own)
