"""Removal of byte strings that occur more than once, by a Burrows-Wheeler transform.

A string of LENGTH bytes is repeated if it also starts anywhere else. To bring equal strings
together, each window of LENGTH bytes is named by its least k-mer (common k-mers last), and
windows in a row with one name are a segment. Segments are compared by name and digest; only
those whose name meets a different segment, or which hold their name twice, send their bytes.

Their bytes go, in blocks of whole names, through a threshold-bounded search on a
Burrows-Wheeler transform: intervals of rows are extended backward breadth first, so that
longest common prefixes appear in increasing order, and the search stops at LENGTH. Rows not
separated by then share LENGTH bytes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from balanza.llm.common import RangeHash, bounded_batches, mix, signed, utf8_steps, without
from balanza.session import materialize

LENGTH = 200
KMER = 24
SKETCH_BITS = 16
#: Bytes of segments that one transform takes; one longer name is a block of its own.
BLOCK_BYTES = 2_000_000
REMEMBERED = 200_000
#: A byte that UTF-8 never has, between segments.
GAP = 0xFF


def kmer_classes(docs: DataFrame, text: str) -> np.ndarray:
    """How many times too full each bucket of k-mers is, as a power of two, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, _ in utf8_steps(batch.column(0)):
                counts += np.bincount(_bucket(RangeHash(data).grams(KMER)), minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["bucket", "n"])

    total = docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS)
    counts[total.column("bucket").to_numpy()] = total.column("n").to_numpy()
    return np.floor(np.log2(np.maximum(counts / max(counts.mean(), 1.0), 1.0))).astype(np.uint8)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row: prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def segments_in(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, length: int):
    """(text, start in text, windows, name, digest, whether the name occurs twice) of the segments of some texts."""
    width = length - KMER + 1
    hashes = RangeHash(data)
    grams = hashes.grams(KMER)
    order = (classes[_bucket(grams)].astype(np.uint64) << np.uint64(58)) | (mix(grams) >> np.uint64(6))
    least = sliding_min(order, width)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    whole = np.arange(len(least)) + length <= offsets[text + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    ends = np.flatnonzero(np.concatenate([whole[:-1] & (~whole[1:] | new[1:]), whole[-1:]]))
    windows = ends - start + 1
    name = least[start]
    spans = windows + width - 1  # k-mers of each segment
    first = np.cumsum(spans) - spans
    places = np.repeat(start - first, spans) + np.arange(spans.sum())
    times = np.add.reduceat(order[places] == np.repeat(name, spans), first)
    digest = hashes.of(start, start + windows - 1 + length)
    return text[start], start - offsets[text[start]], windows, name, digest, times > 1


def segments(docs: DataFrame, classes: np.ndarray, length: int, text: str) -> DataFrame:
    """(name, digest, text_id, start, windows, twice): each task sends equal texts once."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            for first, end, data, offsets in utf8_steps(batch.column(1)):
                ids = batch.column(0).slice(first, end - first).to_numpy()
                owner, start, windows, name, digest, twice = segments_in(data, offsets, shared.value, length)
                fresh = np.zeros(end - first, bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in known:
                        fresh[i] = True
                        known[x] = None
                        if len(known) > REMEMBERED:
                            known.popitem(last=False)
                keep = fresh[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(name[keep]), signed(digest[keep]), pa.array(ids[owner][keep]),
                        pa.array(start[keep].astype(np.int32)), pa.array(windows[keep].astype(np.int32)), pa.array(twice[keep]),
                    ],
                    names=["name", "digest", "text_id", "start", "windows", "twice"],
                )

    schema = "name bigint, digest bigint, text_id bigint, start int, windows int, twice boolean"
    return docs.select("text_id", text).mapInArrow(run, schema)


def marked(found: DataFrame) -> DataFrame:
    """Segments that are repeated as a whole (``sure``) or must be compared byte by byte (``open``).

    Rows stream by in order of name and digest; a row looks at its neighbours only, so a name of
    any number of rows takes no memory.
    """
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None

        def close(rows: pa.RecordBatch, before, after) -> pa.RecordBatch:
            name, digest = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            n = len(name)
            near, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # between row i - 1 and row i
            near[1:n] = name[1:] == name[:-1]
            same[1:n] = near[1:n] & (digest[1:] == digest[:-1])
            for at, (x, y) in ((0, before or (None, None)), (n, after or (None, None))):
                own = min(at, n - 1)
                near[at] = x is not None and x == name[own]
                same[at] = near[at] and y == digest[own]
            sure = same[:-1] | same[1:]
            opened = (near & ~same)[:-1] | (near & ~same)[1:] | np.asarray(rows.column(5))
            keep = pa.array(sure | opened)
            return pa.RecordBatch.from_arrays(
                [*(c.filter(keep) for c in rows.columns), pa.array(sure).filter(keep), pa.array(opened).filter(keep)],
                names=[*names, "sure", "open"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield close(held, before, (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()))
                last = held.num_rows - 1
                before = (held.column(0)[last].as_py(), held.column(1)[last].as_py())
            held = batch
        if held is not None:
            yield close(held, before, None)

    parts = 2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(parts, "name").sortWithinPartitions("name", "digest")
    return ordered.mapInArrow(run, StructType([*found.schema.fields, *StructType.fromDDL("sure boolean, open boolean").fields]))


def rotation_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Cyclic rotations sorted by their first ``depth`` bytes at least, by doubling ranks from eight bytes on."""
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.roll(data, -i).astype(np.uint64)
    known = 8
    while True:
        order = np.argsort(key)  # rotations equal so far may come in any order
        ordered = key[order]
        rank = np.empty(len(data), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        if known >= depth or rank[order[-1]] == len(data) - 1:
            return order
        key = (rank << np.uint64(32)) | np.roll(rank, -(known % len(data)))
        known *= 2


def separated_rows(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For rows 0 to n of the sorted rotations: whether row i shares less than ``length`` bytes with row i - 1.

    Breadth first over intervals of rows with a common prefix: the transform's bytes within an
    interval extend it backward, each to an interval of a prefix one longer. An interval whose end
    is new sets the common prefix there; the others are known already.
    """
    n = len(data)
    last = data[order - 1]  # the byte before each rotation: the transform
    by_byte = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)  # the row of the rotation one byte longer
    same = last[by_byte[1:]] == last[by_byte[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    apart = np.zeros(n + 1, bool)
    apart[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):  # strings of one more byte each time
        size = high - low
        first = np.cumsum(size) - size
        rows = np.repeat(low - first, size) + np.arange(size.sum())
        begin = np.sort(step[rows[previous[rows] < np.repeat(low, size)]])
        end = np.sort(step[rows[following[rows] >= np.repeat(high, size)]]) + 1
        new = ~apart[end]
        if low[0] == 0 and high[-1] == n and len(low) == 1:
            new[:] = True  # the first round: every byte's interval goes on
        apart[end] = True
        low, high = begin[new], end[new]
        if not len(low):
            break
    return apart


def sorted_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes also start elsewhere in the pieces, by the transform."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(bytes([GAP]).join(pieces) + bytes([GAP]), np.uint8)
    order = rotation_order(data, length + 1)
    apart = separated_rows(data, order, length)
    shared = ~apart[1:-1]  # rows i and i + 1
    repeated = np.zeros(len(data), bool)
    repeated[order[:-1][shared]] = True
    repeated[order[1:][shared]] = True
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return [repeated[s : s + max(n - length + 1, 0)] for s, n in zip(starts.tolist(), sizes.tolist())]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes also start elsewhere in the pieces.

    A window whose hash occurs once is no repeat, so only runs of the other windows are sorted;
    of equal runs, which repeat each other, one is sorted with the rest.
    """
    hashes = [RangeHash(np.frombuffer(p, np.uint8)).grams(length) for p in pieces]
    _, name, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    often = np.split(times[name] > 1, np.cumsum([len(h) for h in hashes])[:-1])
    places: dict[bytes, list[tuple[int, int, int]]] = {}
    for i, (piece, flags) in enumerate(zip(pieces, often)):
        for a, b in runs_of(flags):
            places.setdefault(piece[a : b - 1 + length], []).append((i, a, b))
    out = [np.zeros(len(h), bool) for h in hashes]
    found = sorted_windows(list(places), length) if places else []
    for spots, repeated in zip(places.values(), found):
        for i, a, b in spots:
            out[i][a:b] = True if len(spots) > 1 else repeated
    return out


def compared(docs: DataFrame, marks: DataFrame, length: int, text: str) -> DataFrame:
    """(text_id, start, windows) of repeated windows in the open segments."""
    wanted = marks.where("open").groupBy("text_id").agg(F.collect_list(F.struct("name", "digest", "start", "windows")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "digest", "text_id", "start", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for text_id, value, cuts in zip(*(batch.column(i) for i in range(3))):
                raw, own = value.as_py().encode(), text_id.as_py()
                for c in cuts.as_py():
                    a = c["start"]
                    rows.append((c["name"], c["digest"], own, a, raw[a : a + c["windows"] - 1 + length]))
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    pieces = docs.select("text_id", F.coalesce(text, F.lit("")).alias("_text")).join(wanted, "text_id").mapInArrow(
        cut, "name bigint, digest bigint, text_id bigint, start int, piece binary"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, name, digest = 0, None, None

        def solved() -> pa.RecordBatch:
            out: list[tuple] = []
            for (text_id, start, _), repeated in zip(block, repeated_windows([p for _, _, p in block], length)):
                out += [(text_id, start + a, b - a) for a, b in runs_of(repeated)]
            columns = zip(*out) if out else ((), (), ())
            kinds = (pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text_id", "start", "windows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != name:
                    if size > BLOCK_BYTES:
                        yield solved()
                        block, size = [], 0
                    name, digest = row[0], None
                # A whole segment that occurs again is sure; one of its copies is enough to compare with.
                if row[1] == digest:
                    continue
                digest = row[1]
                block.append((row[2], row[3], row[4]))
                size += len(row[4])
        if block:
            yield solved()

    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartition(parts, "name").sortWithinPartitions("name", "digest")
    return ordered.mapInArrow(search, "text_id bigint, start int, windows int")


def with_text_id(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("text_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(text_id, ranges array<struct<start, stop>>): sorted byte ranges of each text with any, which may overlap.

    Texts are known by their 64-bit hash; equal texts of ``length`` bytes or more are ranges as a whole.
    """
    rows = with_text_id(docs.select(F.coalesce(text, F.lit("")).alias(text)), text)
    classes = kmer_classes(rows, text)
    marks = materialize(marked(segments(rows, classes, length, text)), "marks")
    copies = rows.groupBy("text_id").agg(F.count("*").alias("copies"), F.max(F.octet_length(text)).alias("size")).where(
        (F.col("copies") > 1) & (F.col("size") >= length)
    )

    def spans(df: DataFrame) -> DataFrame:
        return df.select("text_id", "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop"))

    ranges = (
        spans(marks.where("sure"))
        .unionByName(spans(compared(rows, marks, length, text)))
        .unionByName(copies.select("text_id", F.lit(0).alias("start"), F.col("size").alias("stop")))
    )
    return ranges.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["stop"]))
        else:
            out.append((r["start"], r["stop"]))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes bigint``, ``spans array<struct<start, stop>>`` and ``kept binary``.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in this or
    another row, is removed, in all places; spans are the maximal removed runs. A null text is
    empty; shorter texts lose nothing; equal rows are copies of each other, so they lose all.
    Columns of these names (and text_id) are replaced; all rows and other columns stay. What is
    kept may begin or end within a character; with ``whole_characters`` the remains of cut
    characters go too, and ``kept`` is text.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["n_bytes", "spans", "kept", "text_id", "ranges"])
    ranges = repeated_ranges(docs, length, text)
    names = docs.columns
    joined = with_text_id(docs, text).join(ranges, "text_id", "left").select(*[f"`{c}`" for c in names], "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        at, kind = names.index(text), pa.string() if whole_characters else pa.binary()
        for batch in batches:
            for first, end, data, offsets in utf8_steps(batch.column(at)):
                rows, cuts, kept = batch.slice(first, end - first), [], []
                for i, own in enumerate(rows.column(len(names))):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    runs = merged(own.as_py() or [])
                    cuts.append([{"start": a, "stop": b} for a, b in runs])
                    edges = [0, *(x for run in runs for x in run), len(raw)]
                    parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
                    kept.append("".join(p.decode(errors="ignore") for p in parts) if whole_characters else b"".join(parts))
                sizes = pa.array(np.diff(offsets).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(names)], sizes, pa.array(cuts, span), pa.array(kept, kind)],
                    names=[*names, "n_bytes", "spans", "kept"],
                )

    kept_type = "string" if whole_characters else "binary"
    added = StructType.fromDDL(f"n_bytes bigint, spans array<struct<start:int, stop:int>>, kept {kept_type}")
    return joined.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))
