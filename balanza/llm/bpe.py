"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Boundaries are found without a regular expression. Each code point becomes a class, each class
a transition function between a few states, and composition of functions is associative: a
blocked scan over function numbers gives the state before every code point of many texts at
once. The slices between boundaries go through a cache to pair merging.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from balanza.llm.common import bounded_batches, list_array, utf8_steps, without

# Code point classes as the scan sees them. LETTER to OTHER come from a table; SPACE_LAST and
# BLANK_LAST are white space before something else, QUOTE_1 and QUOTE_2 begin a contraction of
# one or two letters, BREAK ends a text.
LETTER, NUMBER, SPACE, BLANK, OTHER, SPACE_LAST, BLANK_LAST, QUOTE_1, QUOTE_2, BREAK = range(10)
CLASSES = 10
# What ended just before a code point.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, NEED_1, NEED_2, FRESH = range(8)
STATES = 8

# The contractions that the pre-tokenisation pattern takes whole.
ONE_LETTER = "sdmt"
TWO_LETTERS = ("ll", "ve", "re")

BREAK_POINT = 0x110000
CACHE_SLICES = 200_000
STEP_IDS = 1 << 19


def step(state: int, kind: int) -> int:
    """The state after one code point."""
    if kind == BREAK:
        return FRESH
    if kind == LETTER:
        return {NEED_1: FRESH, NEED_2: NEED_1}.get(state, IN_LETTERS)
    if kind == NUMBER:
        return IN_NUMBERS
    if kind in (SPACE, SPACE_LAST):
        return AFTER_SPACE
    if kind in (BLANK, BLANK_LAST):
        return AFTER_BLANK
    if kind == OTHER or state in (IN_OTHERS, AFTER_SPACE):
        return IN_OTHERS
    return NEED_1 if kind == QUOTE_1 else NEED_2


def begins(state: int, kind: int) -> bool:
    """Whether a code point begins a slice."""
    if kind in (SPACE_LAST, BLANK_LAST, BREAK):
        return True
    if kind in (SPACE, BLANK):
        return state not in (AFTER_SPACE, AFTER_BLANK)
    inside = {LETTER: (IN_LETTERS, NEED_1, NEED_2), NUMBER: (IN_NUMBERS,)}.get(kind, (IN_OTHERS,))
    return state not in (*inside, AFTER_SPACE)


@cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition, function applied to FRESH-or-any state, begins)."""
    functions = [tuple(step(s, k) for s in range(STATES)) for k in range(CLASSES)]
    number = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    known, i = list(number), 0
    while i < len(known):  # close under composition
        for g in list(known):
            for a, b in ((known[i], g), (g, known[i])):
                both = tuple(b[x] for x in a)
                if both not in number:
                    number[both] = len(known)
                    known.append(both)
        i += 1
    m = len(known)
    compose = np.array([[number[tuple(b[x] for x in a)] for b in known] for a in known], np.uint8)
    return (
        np.array([number[f] for f in functions], np.uint8),
        compose.reshape(m * m),
        np.array(known, np.uint8).reshape(m * STATES),
        np.array([[begins(s, k) for k in range(CLASSES)] for s in range(STATES)]).reshape(STATES * CLASSES),
    )


@cache
def _class_table() -> np.ndarray:
    """The class of every code point, with BREAK for BREAK_POINT."""
    table = np.full(BREAK_POINT + 1, OTHER, np.uint8)
    for c in range(BREAK_POINT):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = NUMBER
        elif kind[0] == "Z" or 9 <= c <= 13 or c == 0x85:
            table[c] = BLANK
    table[ord(" ")] = SPACE
    table[BREAK_POINT] = BREAK
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """Prefix compositions of function numbers, in blocks: down the columns, then over the rows."""
    compose = _machine()[1]
    m = int(round(len(compose) ** 0.5))
    n = len(functions)
    if n <= 32:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * m + int(out[i])]
        return out
    width = 1 << max(3, (n.bit_length() - 1) // 2 - 2)
    rows = -(-n // width)
    block = np.zeros(rows * width, np.uint8)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, width).T)  # one row per position in a block
    for j in range(1, width):
        block[j] = compose[block[j - 1].astype(np.intp) * m + block[j]]
    before = scan(block[width - 1])[:-1]
    block[:, 1:] = compose[before.astype(np.intp)[None, :] * m + block[:, 1:]]
    return np.ascontiguousarray(block.T).reshape(-1)[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where slices begin, for code points of texts that each end with BREAK_POINT (which also begins one)."""
    kinds = _class_table()[points]
    space = (kinds == SPACE) | (kinds == BLANK)
    last = space[:-1] & ~space[1:] & (kinds[1:] != BREAK)
    where = np.flatnonzero(last)
    kinds[where] = np.where(kinds[where] == SPACE, SPACE_LAST, BLANK_LAST)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        after = np.append(points, [BREAK_POINT, BREAK_POINT])
        first, second = after[quotes + 1], after[quotes + 2]
        kinds[quotes[np.isin(first, [ord(c) for c in ONE_LETTER])]] = QUOTE_1
        for a, b in TWO_LETTERS:
            kinds[quotes[(first == ord(a)) & (second == ord(b))]] = QUOTE_2
    of_class, _, applied, begin = _machine()
    after = applied[scan(of_class[kinds]).astype(np.intp) * STATES + FRESH]
    before = np.empty_like(after)
    before[0], before[1:] = FRESH, after[:-1]
    return np.flatnonzero(begin[before.astype(np.intp) * CLASSES + kinds])


class Vocabulary:
    """Ranks of a byte-level vocabulary file: ``base64(token) rank`` in each line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.rank.values(), default=-1) + 1
        self.token = [b""] * self.size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.start = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.length, out=self.start[1:])
        self.joined = np.frombuffer(b"".join(self.token), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one slice: the pair of least rank, leftmost first, merges until none can."""
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        if len(piece) <= 24:
            return self._merge_short(piece)
        n = len(piece)
        ends = list(range(1, n + 1))  # end of the part that begins here
        left = list(range(-1, n - 1))
        heap = [(rank[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in rank]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] == n or ends[ends[i]] != end or not alive[ends[i]]:
                continue
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                left[end] = i
                if (found := rank.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (found, i, ends[end]))
            if left[i] >= 0 and (found := rank.get(piece[left[i] : end])) is not None:
                heapq.heappush(heap, (found, left[i], end))
        return [rank[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def _merge_short(self, piece: bytes) -> list[int]:
        rank, none = self.rank, self.size
        cuts = list(range(len(piece) + 1))
        ranks = [rank.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            del cuts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                ranks[i - 1] = rank.get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [rank[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class SliceCache(dict):
    """Slice -> its ids as little-endian 32-bit bytes; starts anew when full, so memory stays bounded."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_SLICES:
            self.clear()
        out = np.array(self.vocab.merge(piece.encode()), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


@cache
def _slice_cache(path: str) -> SliceCache:
    return SliceCache(vocabulary(path))


def encode_steps(column, path: str) -> Iterator[tuple[int, int, pa.ListArray, pa.ListArray]]:
    """(first row, end row, ids, byte offset of each id in its text) for steps of a string column."""
    vocab, ids_of = vocabulary(path), _slice_cache(path)
    for first, end, data, offsets in utf8_steps(column):
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int32)  # code points before each byte
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        ends = heads[offsets[1:]].astype(np.int64)
        starts = boundaries(np.insert(points, ends, BREAK_POINT))
        # Without the breaks: a text's break began a slice of its own.
        breaks = ends + np.arange(len(ends))
        texts_before = np.searchsorted(breaks, starts, "left")
        real = starts != breaks[np.minimum(texts_before, len(breaks) - 1)]
        cuts = (starts - texts_before)[real].tolist()
        slices = [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]
        bounds = np.searchsorted(texts_before[real], np.arange(end - first + 1)).tolist()
        get = ids_of.__getitem__
        ids = [b"".join(map(get, slices[a:b])) for a, b in zip(bounds, bounds[1:])]
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), np.int32)
        lengths = vocab.length[flat]
        place = np.cumsum(lengths) - lengths - np.repeat(offsets[:-1], counts)
        yield first, end, list_array(counts, pa.array(flat)), list_array(counts, pa.array(place.astype(np.int32)))


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>`` and ``offsets array<int>`` (byte offset of each id in the text).

    A null or empty text has no ids. Columns of ``df`` called ids or offsets are replaced; all
    others, repeated rows included, stay. Special tokens are ordinary text.
    """
    bounded_batches(df.sparkSession)
    df = without(df, ["ids", "offsets"])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, ids, offsets in encode_steps(batch.column(names.index(text)), path):
                rows = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, offsets], names=[*names, "ids", "offsets"])

    return df.mapInArrow(run, _schema(df, "ids array<int>, offsets array<int>"))


def _schema(df: DataFrame, added: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def decode_column(column: pa.ListArray, path: str) -> pa.Array:
    """The bytes of each list of ids."""
    vocab = vocabulary(path)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null among ids")
    flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= vocab.size):
        raise ValueError("id outside the vocabulary")
    lengths = vocab.length[flat]
    total = np.cumsum(lengths)
    source = np.repeat(vocab.start[flat] - (total - lengths), lengths)
    data = vocab.joined[source + np.arange(len(source))] if len(source) else np.zeros(0, np.uint8)
    counts = np.asarray(column.value_lengths().fill_null(0))
    ends = np.concatenate([[0], total])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
    offsets = np.zeros(len(counts) + 1, np.int64)
    offsets[1:] = ends
    big = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    return big.cast(pa.binary())


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of ``ids``; null or empty ids give no bytes.

    An id outside the vocabulary, or null, is an error: it can't come from ``encode``.
    """
    bounded_batches(df.sparkSession)
    df = without(df, ["decoded"])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(names.index("ids"))
            many = np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))
            row = 0
            while row < len(ids):
                done = many[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(many, done + STEP_IDS, "right")))
                rows = batch.slice(row, end - row)
                out = decode_column(ids.slice(row, end - row), path)
                yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*names, "decoded"])
                row = end

    return df.mapInArrow(run, _schema(df, "decoded binary"))
