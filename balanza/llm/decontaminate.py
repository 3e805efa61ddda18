"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows of folded text. A document region within
``e`` edits of a window of ``m`` characters shares at least ``m + 1 - q * (e + 1)`` q-grams with
it, on diagonals that spread over at most ``e``. So q-gram hits are counted in overlapping
bands of diagonals, bands below the bound are left out, and the rest is verified by banded
alignment. Items of less than two q-grams are searched as they are. The benchmark is the stated query set: it goes to the tasks in blocks of bounded
size, and documents are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from balanza.llm.common import bounded_batches, mix, utf8_steps, without

Q = 8
#: Edits allowed per character of a window.
EDIT_RATE = 0.1
#: Items longer than a window are cut into windows at this stride.
WINDOW, STRIDE = 120, 60
#: Folded items shorter than this match by chance within words, so they must begin and end at a word's edge.
EDGED_CHARS = 40
#: Scripts written without blanks between words; next to their letters every place is an edge.
UNSPACED = (
    (0xE00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
#: Characters of benchmark text that one pass over the documents takes along.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
BLANK = 32


@cache
def _folded() -> np.ndarray:
    """Code point -> lower-case letter or digit, everything else a blank."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LNM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single blanks, and where each came from."""
    folded = _folded()[points]
    blank = folded == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep):
        keep[0] = ~blank[0]
    at = np.flatnonzero(keep)
    return folded[at], at


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(folded: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(folded) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide, out = folded.astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(q):
        out = out * np.uint64(0x100000001B3) + wide[i : n + i]
    return mix(out)


@dataclass
class Windows:
    """Windows of a block of items, with their q-grams sorted by hash."""

    item: np.ndarray
    text: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    width: np.ndarray
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each hash in the postings; one more at the end
    window: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # filter over hash bits


def edit_budget(m: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits for a window of ``m``: by the rate, but so that the lemma still asks for a q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


def folded_item(text: str | None) -> np.ndarray:
    folded = fold(points_of(text or ""))[0]
    return folded[:-1] if len(folded) and folded[-1] == BLANK else folded


@dataclass
class Whole:
    """Items of one folded length that are searched as they are, in order of their hash."""

    item: np.ndarray
    text: np.ndarray  # a row of code points per item
    hashes: np.ndarray  # distinct
    first: np.ndarray  # item of each hash; one more at the end


def build_whole(items: list[tuple[int, str]], q: int = Q) -> list[Whole]:
    """The items that are too short for the lemma, by length."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items:
        folded = folded_item(text)
        if 0 < len(folded) < 2 * q:
            by_size.setdefault(len(folded), []).append((item, folded))
    out = []
    for m, own in sorted(by_size.items()):
        texts = np.stack([t for _, t in own])
        flat = np.concatenate([gram_hashes(t, m) for t in texts])
        order = np.argsort(flat, kind="stable")
        hashes, first = np.unique(flat[order], return_index=True)
        out.append(Whole(np.array([i for i, _ in own], np.int64)[order], texts[order], hashes, np.append(first, len(flat))))
    return out


def build_windows(items: list[tuple[int, str]], rate: float = EDIT_RATE, q: int = Q) -> Windows | None:
    owner, texts = [], []
    for item, text in items:
        folded = folded_item(text)
        m = len(folded)
        if m < 2 * q:
            continue
        starts = [0] if m <= WINDOW else [*range(0, m - WINDOW, STRIDE), m - WINDOW]
        for s in starts:
            owner.append(item)
            texts.append(folded[s : s + WINDOW])
    if not texts:
        return None
    size = np.array([len(t) for t in texts])
    budget = np.array([edit_budget(m, rate, q) for m in size])
    grams = [gram_hashes(t, q) for t in texts]
    flat, window = np.concatenate(grams), np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return Windows(
        np.array(owner, np.int64), texts, budget, size + 1 - q * (budget + 1), budget + 1,
        hashes, np.append(first, len(flat)), window[order], place[order], maybe,
    )


def edits_by_end(window: np.ndarray, region: np.ndarray, budget: int, anchored: bool = False) -> np.ndarray | None:
    """Least edits to align all of ``window`` with a part of ``region``, by the part's end; None if all are over budget.

    ``anchored``: the part begins where the region does. Rows run over the window; columns are
    all diagonals of the region, which is only as long as the window, the band and the budget
    together.
    """
    m, n = len(window), len(region)
    spread = np.arange(n + 1)
    row = spread.astype(np.int32) if anchored else np.zeros(n + 1, np.int32)
    for i in range(1, m + 1):
        step = np.empty(n + 1, np.int32)
        step[0] = i
        np.minimum(row[:-1] + (region != window[i - 1]), row[1:] + 1, out=step[1:])
        row = np.minimum.accumulate(step - spread) + spread
        if row.min() > budget:
            return None
    return row


def banded_distance(window: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int]:
    """Least edits to align all of ``window`` with some part of ``region``, and the end of that part."""
    row = edits_by_end(window, region, budget)
    if row is None:
        return budget + 1, -1
    end = int(row.argmin())
    return int(row[end]), end


@cache
def _unspaced() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for low, high in UNSPACED:
        table[low : high + 1] = True
    return table


def word_edges(folded: np.ndarray) -> np.ndarray:
    """Whether a word can begin or end at each place of a text, its end included."""
    free = (folded == BLANK) | _unspaced()[folded]
    edges = np.ones(len(folded) + 1, bool)
    edges[1:-1] = free[1:] | free[:-1]
    return edges


def edged_region(window: np.ndarray, own: np.ndarray, a: int, b: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``own[a:b]`` between word edges that is nearest to ``window``, if within budget."""
    row = edits_by_end(window, own[a:b], budget)
    edges, best = word_edges(own), None
    for end in np.flatnonzero((row <= budget) & edges[a : b + 1]).tolist() if row is not None else ():
        back = edits_by_end(window[::-1], own[a : a + end][::-1], budget, anchored=True)
        if back is None:
            continue
        starts = np.arange(a + end, a - 1, -1)
        for at in np.flatnonzero((back <= budget) & edges[starts]).tolist():
            found = (int(back[at]), a + end - at, a + end)
            best = found if best is None else min(best, found)
    return best


def runs_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length."""
    new = np.ones(len(ordered) + 1, bool)
    new[1:-1] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new) if len(ordered) else np.zeros(1, np.int64)


def matches_in(folded: np.ndarray, starts: np.ndarray, block: Windows, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of verified regions in texts laid end to end.

    ``starts``: where each text begins, and the total. Positions are within the text's folded form.
    """
    hashes = gram_hashes(folded, q)
    at = np.flatnonzero(block.maybe[hashes >> np.uint64(64 - FILTER_BITS)]) if len(hashes) else np.zeros(0, np.int64)
    found = np.searchsorted(block.hashes, hashes[at])
    found[found == len(block.hashes)] = 0
    real = block.hashes[found] == hashes[at]
    at, found = at[real], found[real]
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + q <= starts[text + 1]
    at, found, text = at[inside], found[inside], text[inside]
    many = block.first[found + 1] - block.first[found]
    posting = np.repeat(block.first[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    at, text = np.repeat(at - starts[text], many), np.repeat(text, many)
    window, place = block.window[posting], block.place[posting]
    # The diagonal, moved so that it is never negative; each hit counts in two overlapping bands.
    diagonal, width = at - place + WINDOW, block.width[window]
    band = diagonal // width
    key = np.concatenate([band, band - 1]) + 1
    group = (np.tile(text, 2) * len(block.text) + np.tile(window, 2)).astype(np.int64)
    span = int(key.max()) + 1 if len(key) else 1
    # Distinct places of a window in a band: no more than the hits, no fewer than the lemma's.
    cell = (group * span + key) * (WINDOW + 1) + np.tile(place, 2)
    cell.sort()
    cell = cell[runs_of(cell)[:-1]] // (WINDOW + 1)
    edges = runs_of(cell)
    cell, count = cell[edges[:-1]], np.diff(edges)
    group, key = cell // span, cell % span
    text, window = group // len(block.text), group % len(block.text)
    kept = np.flatnonzero(count >= block.bound[window])
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    # Likeliest first, so that later bands of the same window need only beat a known region.
    for i in kept[np.argsort(-count[kept], kind="stable")]:
        t, w = int(text[i]), int(window[i])
        name, e, wide = (t, w), int(block.budget[w]), int(block.width[w])
        if name in out and out[name][2] == 0:
            continue
        low = (int(key[i]) - 1) * wide - WINDOW
        own = folded[starts[t] : starts[t + 1]]
        a, b = max(0, low - e), min(len(own), low + 2 * wide + len(block.text[w]) + e)
        if len(block.text[w]) < EDGED_CHARS:
            region = edged_region(block.text[w], own, a, b, e)
            if region is not None and (name not in out or region[0] < out[name][2]):
                out[name] = (region[1], region[2], region[0])
            continue
        edits, end = banded_distance(block.text[w], own[a:b], e)
        if edits <= e and (name not in out or edits < out[name][2]):
            back, length = banded_distance(block.text[w][::-1], own[a : a + end][::-1], e)
            out[name] = (a + end - length, a + end, edits)
    return [(t, int(block.item[w]), s, end, edits) for (t, w), (s, end, edits) in sorted(out.items())]


def whole_in(folded: np.ndarray, starts: np.ndarray, whole: list[Whole]) -> list[tuple[int, int, int, int, int]]:
    """As ``matches_in``: the first place between word edges of each short item in each text."""
    edges = np.concatenate([*(word_edges(folded[a:b])[:-1] for a, b in zip(starts, starts[1:])), [True]])
    out = []
    for group in whole:
        m = group.text.shape[1]
        hashes = gram_hashes(folded, m)
        if not len(hashes):
            continue
        found = np.searchsorted(group.hashes, hashes)
        found[found == len(group.hashes)] = 0
        at = np.flatnonzero(group.hashes[found] == hashes)
        found, text = found[at], np.searchsorted(starts, at, "right") - 1
        # A text's end is an edge even where the next text begins: that place is the next one's first.
        good = (at + m <= starts[text + 1]) & edges[at] & edges[at + m]
        at, found, text = at[good], found[good], text[good]
        many = group.first[found + 1] - group.first[found]
        one = np.repeat(group.first[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at, text = np.repeat(at, many), np.repeat(text, many)
        same = (folded[at[:, None] + np.arange(m)] == group.text[one]).all(1)
        at, text, one = at[same], text[same], one[same]
        _, lead = np.unique(text.astype(np.int64) * len(group.item) + one, return_index=True)
        place = at[lead] - starts[text[lead]]
        out += zip(text[lead].tolist(), group.item[one[lead]].tolist(), place.tolist(), (place + m).tolist(), [0] * len(lead))
    return out


FOUND = "array<struct<item_id:bigint, start:int, stop:int, edits:int>>"


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, dealt by the hash of their id."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    many = -(-total // BLOCK_CHARS)
    for i in range(many):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == i)
        yield [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``matches``: (item_id, start, stop, edits) of each benchmark window found.

    Positions are code points of the text. A window is found once per document, at its region
    of fewest edits; an item may be found by several windows. Null and empty texts match
    nothing; items that are null or hold no letter or digit find nothing. Case, punctuation and
    runs of blanks do not count. Items shorter than EDGED_CHARS when folded are found between word
    edges only, those shorter than 2 * Q without edits; a one-word item is found wherever its word
    is. Repeated rows are each searched; an existing
    column called matches is replaced. Each block of the benchmark adds one pass.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["matches"]).withColumn("matches", F.array().cast(FOUND))
    for block in blocks_of(benchmark):
        windows, whole = build_windows(block), build_whole(block)
        if windows is not None or whole:
            docs = _search(docs, docs.sparkSession, windows, whole, text)
    return docs


def _search(docs: DataFrame, spark: SparkSession, windows: Windows | None, whole: list[Whole], text: str) -> DataFrame:
    shared = spark.sparkContext.broadcast((windows, whole))  # a block: BLOCK_CHARS bounds it
    names, kind = docs.columns, pa.list_(
        pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, short = shared.value
        for batch in batches:
            for first, end, data, offsets in utf8_steps(batch.column(names.index(text))):
                rows = batch.slice(first, end - first)
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                heads = np.zeros(len(data) + 1, np.int32)
                np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
                cuts = heads[offsets].astype(np.int64)
                parts = [fold(points[a:b]) for a, b in zip(cuts, cuts[1:])]
                starts = np.zeros(len(parts) + 1, np.int64)
                np.cumsum([len(p[0]) for p in parts], out=starts[1:])
                before = rows.column(names.index("matches")).to_pylist()
                folded = np.concatenate([p[0] for p in parts])
                found = matches_in(folded, starts, block) if block is not None else []
                found += whole_in(folded, starts, short) if short else []
                for t, item, start, stop, edits in found:
                    at = parts[t][1]
                    before[t].append({"item_id": item, "start": int(at[start]), "stop": int(at[stop - 1]) + 1, "edits": edits})
                columns = [pa.array(before, kind) if n == "matches" else rows.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contaminated int, n_items, item_ids, least_edits) of each row of ``docs``."""
    found = find(docs.select(key, text), benchmark, text)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        key, (F.size("matches") > 0).cast("int").alias("contaminated"), F.size(items).cast("long").alias("n_items"),
        items.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["edits"])).alias("least_edits"),
    )
