"""Patterns, field and decoder of the secret scanner against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from balanza.llm import secretscan as scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(found)]


TEXTS = [
    None, "", " ", "é token = \"0123456789abcdef\" x", "PassWD:'aaaaaaaaaaaa", "secret=short", "api_key  = == ==aaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaaa",
    "AKIAAKIAABCDEFGHIJ AKIA AKIAABCDEFGHIJKLM", "xAKIA0123456789ABCDé", "0123456789abcdef" * 3, "aAbB" * 10, "token\n=aaaaaaaaaaaaaaaaa",
    "token=token=secret:aaaaaaaaaaaa", "apikey:0123456789abcdef0 apikey:0123456789abcdef0", "漢" * 40 + "deadbeefdeadbeef" + "漢", "abc " * 60_000,
    "f" * 16, "f" * 15, "f" * 200_000, "!", "tokentoken=abcdefabcdefabcdef",
]


def test_patterns():
    chance = random.Random(4)
    pieces = ["token", "SECRET", "api", "_", "key", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12", "0123abcdef", "deadbeefcafe", "é", "\n", "-.", "zz"]
    texts = TEXTS + ["".join(chance.choice(pieces) for _ in range(chance.randrange(40))) for _ in range(800)]
    got = scan.scan_column(pa.array(texts), None)
    assert [[(s["kind"], s["start"], s["end"]) for s in r] for r in got] == [base(t) for t in texts]


def test_decoder_against_plain_viterbi(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    chance = np.random.default_rng(0)
    for _ in range(60):
        n = int(chance.integers(1, 200))
        emit, first = chance.normal(size=(n, 3)) * 2, chance.random(n) < chance.choice([0, 0.01, 0.3])
        moves, start = chance.normal(size=(3, 3)), np.array([0, 0, -1e9])
        moves[0, 2], first[0] = -1e9, True
        want, ends = [], [*np.flatnonzero(first)[1:], n]
        for a, b in zip(np.flatnonzero(first), ends):
            score, back = start + emit[a], []
            for t in range(a + 1, b):
                options = score[:, None] + moves
                back.append(options.argmax(0))
                score = options.max(0) + emit[t]
            path = [int(score.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            want += path[::-1]
        assert list(scan.decode(emit, first, moves, start)) == want
    assert len(scan.decode(np.zeros((0, 3)), np.zeros(0, bool), moves, start)) == 0


def test_marginals_against_all_paths():
    chance = np.random.default_rng(1)
    emit, moves, start = chance.normal(size=(3, 5, 3)), chance.normal(size=(3, 3)), np.array([0.3, 0.1, -1e9])
    lengths = np.array([5, 1, 3])
    tags, pairs, whole = scan.marginals(emit, lengths, moves, start)
    want_tags, want_pairs, want_whole = np.zeros_like(tags), np.zeros((3, 3)), 0.0
    for i, n in enumerate(lengths):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            weights[path] = np.exp(start[path[0]] + sum(emit[i, t, c] for t, c in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        want_whole += np.log(total)
        for path, w in weights.items():
            for t, c in enumerate(path):
                want_tags[i, t, c] += w / total
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += w / total
    assert np.allclose(tags, want_tags) and np.allclose(pairs, want_pairs) and np.isclose(whole, want_whole)


WORDS = "ate blue city dog eats fish green hat ice jam kite lamp moon nest oak 12 2024 3.5 re-do (so) a, b.".split()


def prose(chance, n):
    return " ".join(chance.choice(WORDS) for _ in range(n))


def corpus(n, seed):
    chance = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(chance, 40)
        if i % 4 == 0:
            value = "".join(chance.choice("0123456789abcdef") for _ in range(40))
            text = f'{text} {chance.choice(["token", "secret", "password"])} = "{value}" {prose(chance, 30)}'
        rows.append((i, text))
    return rows


DOCS = "doc_id bigint, text string, secrets int, spans string, kind int"


def test_field_learns_and_extends_the_patterns(spark):
    rows = corpus(800, 2)
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], DOCS)
    field = scan.learn(docs)
    # Held out: texts that taught nothing, whose values follow names and signs that no pattern knows.
    chance = random.Random(9)
    hidden, clean = [], []
    for _ in range(100):
        value = "".join(chance.choice("0123456789abcdef") for _ in range(40)).upper()
        hidden.append((prose(chance, 20), f'credential = "{value}"', value, prose(chance, 20)))
        clean.append(prose(chance, 60))
    texts = [f"{a} {b} {d}" for a, b, _, d in hidden]
    found = scan.scan_column(pa.array(texts), field)
    caught = sum(any(s["kind"] == "crf" and v in t[s["start"] : s["end"]] for s in r) for r, t, (_, _, v, _) in zip(found, texts, hidden))
    assert caught >= 90
    assert sum(bool(r) for r in scan.scan_column(pa.array(clean), field)) <= 2
    again = scan.scan(docs, field).where("doc_id < 20")
    assert again.columns == ["doc_id", "text", "spans", "kind", "secrets"] and again.count() == 20


def test_report(spark):
    rows = corpus(120, 3) + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (5, TEXTS[3]), (5, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], DOCS)
    got = [tuple(r) for r in scan.secret_report(docs).collect()]
    want = []
    for i, t in rows:
        spans = base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex")]
        want.append((i, *counts, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    for *_, spans in got:
        parts = [(int(a), scan.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        assert parts == sorted(parts)
        own = [(a, b) for a, k, b in parts if k == 3]
        assert all(b <= x or y <= a for a, b in own for x, k, y in parts if k < 3)


def test_without_rows_or_secrets(spark):
    assert scan.secret_report(spark.createDataFrame([], DOCS)).count() == 0
    plain = spark.createDataFrame([(1, "no secrets here", 0, "", 0), (2, None, 0, "", 0)], DOCS)
    assert scan.learn(plain) is None
    assert [r["spans"] for r in scan.secret_report(plain).collect()] == ["", ""]
