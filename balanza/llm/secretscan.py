"""Secret scanning with fixed patterns and a linear-chain conditional random field.

Three patterns find secrets of known forms. The field then tags every token of a text as the
begin of a secret, inside one, or outside, from the token's shape, its neighbours and the look
of the whole text, so it also finds secrets next to words and signs that the patterns don't
know. It is taught by the patterns' own findings in a bounded sample, in context: the features
of a token don't tell a pattern's name or end.

Tokens are runs of letters and digits, and single other signs. Decoding is exact Viterbi over
all tokens of a batch at once: the chain is cut into blocks, each block's best scores are a
3 x 3 matrix for its entry and exit states, and the matrices are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from balanza.llm.common import RangeHash, bounded_batches, utf8_steps, without

# Fixed forms of the contract; letters of the first words are taken in either case.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Texts that are read to teach the field, chosen by a hash of id and text; and windows of tokens taken from them, with and without a secret.
SAMPLE_TEXTS, SAMPLE_WINDOWS, WINDOW = 20_000, 1_500, 48
ROUNDS, RATE, SHRINK = 60, 0.1, 1e-4
#: Tokens of a block of the decoder.
BLOCK = 128

OUT, BEGIN, INSIDE = 0, 1, 2
_NEVER = -1e9

# Classes of bytes: space, other sign, digit, lower, upper, beyond ASCII.
_SPACE, _SIGN, _DIGIT, _SMALL, _LARGE, _WIDE = range(6)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = _SPACE
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = _DIGIT, _SMALL, _LARGE, _WIDE
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Borders of the length classes.
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 11, 15, 19, 27, 39, 63])

_BUCKETS = 4096
#: Values of each feature; a token has one value of each.
SIZES = (256, 13 * 32, 9 * 2 * 5, 16 * 13, 6**5, _BUCKETS, *[_BUCKETS] * 5, 4 * 3 * 3, 64)
_BASE = np.concatenate([[0], np.cumsum(SIZES)])
N_FEATURES = int(_BASE[-1])


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, kind, start, end) in bytes of the buffer of each pattern's findings, by kind; the value's start comes fifth."""
    out, raw = [], data.tobytes()
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        out += [(row, 0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(raw, a, b) if m.end() - m.start(2) >= LEAST_ASSIGN]
        if raw.find(b"AKIA", a, b) >= 0:
            out += [(row, 1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= LEAST_ACCESS]
    # Runs of hex digits, cut at the ends of texts.
    hexes = _HEX[data]
    change = np.flatnonzero(np.diff(hexes, prepend=False, append=False))
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= LEAST_HEX
    for a, b in zip(starts[long], ends[long]):
        cuts = [a, *offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")], b]
        for x, y in zip(cuts, cuts[1:]):
            if y - x >= LEAST_HEX:
                out.append((int(np.searchsorted(offsets, x, "right")) - 1, 2, int(x), int(y), int(x)))
    return out


@dataclass
class Tokens:
    """Tokens of a buffer of texts: byte ranges, the row of each, whether a row begins, and the features."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    features: np.ndarray  # (tokens, features)


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    kind = _CLASS[data]
    word = kind >= _DIGIT
    edge = np.zeros(len(data), bool)
    edge[offsets[offsets < len(data)]] = True
    fresh = word.copy()
    fresh[1:] &= ~word[:-1] | edge[1:]
    begins = fresh | (kind == _SIGN)
    starts = np.flatnonzero(begins)
    n = len(starts)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none.astype(bool), np.zeros((0, len(SIZES)), np.int32))
    # Spaces behind a token belong to its range here and count for nothing.
    total = lambda x: np.add.reduceat(x, starts, dtype=np.int64)
    length = total(kind != _SPACE)
    ends = starts + length
    rows = np.searchsorted(offsets, starts, "right") - 1
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]

    digits, small, large, wide = (total(kind == c) for c in (_DIGIT, _SMALL, _LARGE, _WIDE))
    hexes = total(_HEX[data])
    # Changes of class within a token, and its first five classes as one number.
    runs = np.diff(kind, prepend=kind[:1]) != 0
    runs[starts] = True
    runs &= kind != _SPACE
    changes = total(runs)
    nth = np.cumsum(runs)
    nth[starts[0] :] -= np.repeat(nth[starts], np.diff(starts, append=len(data)))
    shape = total(np.where(runs & (nth < 5), kind * 6 ** np.clip(nth, 0, 4), 0))

    size = np.searchsorted(_LENGTHS, length, "left")
    hashes = RangeHash(_LOWER[data])
    name = (hashes.of(starts, ends) % np.uint64(_BUCKETS)).astype(np.int64)
    opening = (hashes.of(starts, np.minimum(ends, starts + 4)) % np.uint64(_BUCKETS)).astype(np.int64)
    is_word = word[starts]
    # What neighbours are called; long tokens and those with digits are known by their shape alone.
    plain = (length <= 16) & (digits == 0)
    name = np.where(plain, name, shape % 64)

    def beside(step: int) -> np.ndarray:
        """The neighbour's name; 0 beyond the ends of the text."""
        out = np.zeros(n, np.int64)
        if abs(step) < n:
            to, of = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
            out[to] = np.where(rows[to] == rows[of], name[of], 0)
        return out

    gap = np.zeros(n, np.int64)
    gap[1:] = np.minimum(starts[1:] - ends[:-1], 1)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    gap[1:] += newline[starts[1:]] > newline[ends[:-1]]
    gap[first] = 3
    before, after = np.ones(n, np.int64), np.ones(n, np.int64)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    before[first] = 2
    after[np.append(first[1:], True)] = 2
    # The whole text: how many tokens have digits, and how many are signs.
    count = np.bincount(rows, minlength=len(offsets) - 1)
    share = lambda x: np.minimum(15 * np.bincount(rows, x, minlength=len(count)) / np.maximum(count, 1), 7).astype(np.int64)
    look = share(digits > 0) * 8 + share(~is_word)
    has = (digits > 0) + 2 * (small > 0) + 4 * (large > 0) + 8 * (wide > 0)
    columns = (
        np.where(is_word, 0, data[starts]), size * 32 + has + 16 * is_word, (8 * digits // length * 2 + (hexes == length)) * 5 + 4 * large // length,
        np.minimum(changes, 15) * 13 + size, shape, opening, np.where(plain, name, 0),
        beside(-1), beside(-2), beside(-3), beside(1), (gap * 3 + before) * 3 + after, look[rows],
    )
    return Tokens(starts, ends, rows, first, np.stack([c + b for c, b in zip(columns, _BASE)], 1).astype(np.int32))


def tag_base(tokens: Tokens, spans: list[tuple]) -> np.ndarray:
    """The tags that the patterns' values give."""
    tags = np.zeros(len(tokens.starts), np.int8)
    for *_, end, value in spans:
        a, b = np.searchsorted(tokens.starts, [value, end])
        if b > a and tags[a] == OUT:
            tags[a:b] = INSIDE
            tags[a] = BEGIN
    return tags


WINDOWS = "secret boolean, place bigint, tags array<tinyint>, features array<int>"


def windows_of(column: pa.Array, names: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
    """(holds a secret, hash, tags, features) of windows of texts: one around each finding, and one anywhere."""
    for row, _, data, offsets in utf8_steps(column):
        tokens, spans = tokenize(data, offsets), base_spans(data, offsets)
        tags = tag_base(tokens, spans)
        edges = np.searchsorted(tokens.rows, np.arange(len(offsets)))
        spots = [(r, int(np.searchsorted(tokens.starts, value)) - WINDOW // 3) for r, *_, value in spans]
        spots += [(r, int(edges[r] + abs(int(names[row + r])) % max(1, edges[r + 1] - edges[r]))) for r in range(len(offsets) - 1)]
        for i, (r, at) in enumerate(spots):
            a = max(at, int(edges[r]))
            b = min(a + WINDOW, int(edges[r + 1]))
            if b > a:
                yield bool(tags[a:b].any()), int(names[row + r]) ^ (i << 7), tags[a:b], tokens.features[a:b]


@dataclass
class Field:
    """A linear-chain conditional random field: scores of (feature, tag), (tag, next tag) and first tags."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        for column in features.T:
            out += self.weights[column]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def marginals(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of padded sequences (n, length, 3): each token's tag probabilities, expected moves, and the sum of log partition functions."""
    n, width, _ = emit.shape
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    ahead[:, 0] = start + emit[:, 0]
    for t in range(1, width):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
    for t in range(width - 2, -1, -1):
        onward = _log_sum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None], 2)
        back[:, t] = np.where((t + 1 < lengths)[:, None], onward, 0)
    whole = _log_sum(ahead[np.arange(n), lengths - 1], 1)
    inside = (np.arange(width) < lengths[:, None])[..., None]
    tags = np.exp(ahead + back - whole[:, None, None]) * inside
    pairs = ahead[:, :-1, :, None] + moves + (emit + back)[:, 1:, None] - whole[:, None, None, None]
    return tags, (np.exp(np.minimum(pairs, 0)) * inside[:, 1:, :, None]).sum((0, 1)), float(whole.sum())


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> Field:
    """The field that makes the tags of ``sequences`` of (tags, features) likeliest, by Adam steps over all of them at once."""
    n, width, many = len(sequences), max(len(t) for t, _ in sequences), len(SIZES)
    lengths = np.array([len(t) for t, _ in sequences])
    features = np.full((n, width, many), N_FEATURES)
    seen = np.zeros((n, width, 3))
    moved = np.zeros((3, 3))
    for i, (tags, own) in enumerate(sequences):
        features[i, : len(tags)] = own
        seen[i, np.arange(len(tags)), tags] = 1
        np.add.at(moved, (tags[:-1], tags[1:]), 1)
    used, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    flat, blocked = place.ravel(), np.zeros((3, 3))
    blocked[OUT, INSIDE] = _NEVER
    start = np.array([0, 0, _NEVER])
    # One table of parameters: features, then moves.
    table = np.zeros((len(used) + 3, 3))
    mean, square = np.zeros_like(table), np.zeros_like(table)
    for step in range(1, rounds + 1):
        emit = table[place].sum(2)
        tags, moves, _ = marginals(emit, lengths, table[-3:] + blocked, start)
        rest = np.repeat((tags - seen).reshape(-1, 3), many, 0)
        slope = np.stack([np.bincount(flat, rest[:, c], len(used)) for c in range(3)], 1)
        slope = np.concatenate([slope, moves - moved]) / n + SHRINK * table
        slope[: len(used)][used == N_FEATURES] = 0
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        table -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((N_FEATURES + 1, 3), np.float32)
    weights[used] = table[: len(used)]
    weights[N_FEATURES] = 0
    return Field(weights, (table[-3:] + blocked).astype(np.float32), start.astype(np.float32))


def learn(docs: DataFrame, key: str = "doc_id") -> Field | None:
    """A field from a bounded sample of ``docs``; None if the patterns find nothing in it.

    About ``SAMPLE_TEXTS`` distinct rows are read, those with the least hashes: the bound comes
    from a count, not from a sort. Of their windows up to ``SAMPLE_WINDOWS`` with and as many
    without a secret reach the driver.
    """
    rows = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col("text")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    limit = int(min(1.0, SAMPLE_TEXTS / max(total, 1)) * 2**32)
    sample = rows.where(F.shiftrightunsigned("name", 32) < limit).dropDuplicates(["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(s, p, t.tolist(), f.ravel().tolist()) for s, p, t, f in windows_of(batch.column(1), batch.column(0).to_numpy())]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["secret", "place", "tags", "features"])

    windows = sample.mapInArrow(run, WINDOWS)
    parts = [windows.where(F.col("secret") == s).orderBy("place").limit(SAMPLE_WINDOWS) for s in (True, False)]
    taken = parts[0].unionByName(parts[1]).collect()
    if not any(r["secret"] for r in taken):
        return None
    return train([(np.array(r["tags"], np.int64), np.array(r["features"]).reshape(len(r["tags"]), -1)) for r in taken])


def decode(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best tags of all chains, which begin where ``first`` is true, laid end to end.

    The row of chains is cut into blocks. First each block's best scores from any entry to any
    exit state are found, all blocks side by side; these give every block's scores at entry;
    then the blocks are decoded side by side, and the ends are followed back from block to block.
    """
    n = len(emit)
    if n == 0:
        return np.zeros(0, np.int8)
    blocks = -(-n // BLOCK)
    # Blocks are the last axis of all arrays, so that every operation runs along them.
    wide = np.zeros((blocks * BLOCK, 3), np.float64)
    wide[:n] = emit
    wide[n:, 1:] = _NEVER
    wide = np.ascontiguousarray(wide.reshape(blocks, BLOCK, 3).transpose(1, 2, 0))
    begins = np.ones(blocks * BLOCK, bool)
    begins[:n] = first
    begins = begins.reshape(blocks, BLOCK)
    fresh = [np.flatnonzero(begins[:, t]) for t in range(BLOCK)]

    def step(scores: np.ndarray, t: int, came: np.ndarray | None = None) -> np.ndarray:
        """Scores (..., state, block) of tokens t from those of the tokens before; ``came`` gets the former states."""
        out = np.empty_like(scores)
        restart = scores[..., fresh[t]]
        best, best_at = restart.max(-2), restart.argmax(-2)
        for c in range(3):
            top = scores[..., 0, :] + moves[0, c]
            at = np.zeros(top.shape, np.int8)
            for p in (1, 2):
                other = scores[..., p, :] + moves[p, c]
                if came is not None:
                    at[other > top] = p
                np.maximum(top, other, out=top)
            top[..., fresh[t]] = best + start[c]
            out[..., c, :] = top + wide[t, c]
            if came is not None:
                at[..., fresh[t]] = best_at
                came[c] = at
        return out

    across = np.repeat(np.where(np.eye(3, dtype=bool), 0, _NEVER).astype(np.float64)[..., None], blocks, 2)
    for t in range(BLOCK):
        across = step(across, t)
    entry = np.zeros((blocks, 3), np.float64)
    matrices = np.ascontiguousarray(across.transpose(2, 0, 1))
    for k in range(1, blocks):
        scores = (entry[k - 1][:, None] + matrices[k - 1]).max(0)
        entry[k] = scores - scores.max()
    came = np.empty((BLOCK, 3, blocks), np.int8)
    scores = np.ascontiguousarray(entry.T)
    for t in range(BLOCK):
        scores = step(scores, t, came[t])
    # Of each block and last state: the states along its best path, and the one it came from.
    path, state = np.empty((BLOCK, 3, blocks), np.int8), np.repeat(np.arange(3, dtype=np.int8)[:, None], blocks, 1)
    for t in range(BLOCK - 1, -1, -1):
        path[t] = state
        state = np.choose(state, came[t][:, None])
    last = np.empty(blocks, np.int64)
    last[-1] = scores[:, -1].argmax()
    for k in range(blocks - 1, 0, -1):
        last[k - 1] = state[last[k], k]
    return path[:, last, np.arange(blocks)].T.reshape(-1)[:n]


def spans_of(tags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) token of each run of a begin and the insides behind it."""
    starts = np.flatnonzero(tags == BEGIN)
    goes_on = np.append((tags[1:] == INSIDE) & ~first[1:], False)
    stops = np.flatnonzero(~goes_on)
    return starts, stops[np.searchsorted(stops, starts)]


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_column(column: pa.Array, field: Field | None) -> list[list[dict]]:
    """Spans of each text in code points, by start, then kind; the field's own are those that no pattern's span touches."""
    out: list[list[dict]] = []
    for _, _, data, offsets in utf8_steps(column):
        base = base_spans(data, offsets)
        found = [(row, start, kind, end) for row, kind, start, end, _ in base]
        if field is not None and len(data):
            tokens = tokenize(data, offsets)
            tags = decode(field.emissions(tokens.features), tokens.first, field.moves, field.start)
            a, b = spans_of(tags, tokens.first)
            starts, ends, rows = tokens.starts[a], tokens.ends[b], tokens.rows[a]
            # Bytes of patterns' spans before each byte: a span that touches none has as many at both ends.
            cover = np.zeros(len(data) + 1, np.int64)
            for _, _, start, end, _ in base:
                cover[start + 1 : end + 1] = 1
            cover = np.cumsum(cover)
            own = cover[starts] == cover[ends]
            found += zip(rows[own].tolist(), starts[own].tolist(), [3] * int(own.sum()), ends[own].tolist())
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows_out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for row, start, kind, end in sorted(found):
            at = points[offsets[row]]
            rows_out[row].append({"kind": KINDS[kind], "start": int(points[start] - at), "end": int(points[end] - at)})
        out += rows_out
    return out


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with ``secrets``, the spans (kind, start, end) found in each whole text, ends exclusive, in code points.

    Kinds are ``assign``, ``access``, ``hex`` from the patterns, which always stay, and ``crf``.
    A null or empty text has none; repeated rows and ids are scanned one by one, so equal texts
    have equal spans; a text of any length is one chain. A former column ``secrets`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = without(docs, ["secrets"])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scan_column(batch.column(at), field), FOUND)], names=[*batch.schema.names, "secrets"]
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("secrets", SPANS)]))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the secrets of each document, by a field taught by these documents."""
    rows = docs.select("doc_id", "text")
    found = scan(rows, learn(rows))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"),
    )
