"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct word n-grams. Hashes are dealt to groups,
more for larger sets, and the counts per group make the set a point. Two sets share at most the sum of the
smaller counts, group by group, so a pair whose sum is too small is no link; for boxes of
points the same holds with the boxes' upper corners.

Sets that link share one of their rarest n-grams (each set's prefix, ordered by a sketch of
frequencies), which deals the points to groups of bounded-size R-tree leaves. Leaves that
share a key are joined box against box, then point against point. Survivors are verified on
the whole sets. Copies are one point from the start, and points that are already connected
are not compared again, so a large group of near copies costs no pair list.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balanza.llm.common import RangeHash, bounded_batches, list_array, mix, signed, utf8_steps
from balanza.llm.graph import components
from balanza.session import materialize

#: Defaults of near-duplicate search; the similarity is the fraction NUMERATOR / DENOMINATOR.
WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Fewest groups; a power of two, as many as one for each PER_GROUP n-grams if that is more. With
#: fewer, chance alone would bring large unrelated sets over the bound.
GROUPS, PER_GROUP = 256, 8
#: Points in a leaf.
LEAF = 256
#: Leaves of one key are cut from runs of about this many points, sorted by size of set.
RUN = 65_536
SKETCH_BITS = 16
#: Sets and key groups that a task remembers in order not to send copies twice.
REMEMBERED = 200_000
#: A group of points with one key is remembered by its members up to this size.
LISTED = 4_096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


def with_length(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes whose top six bits hold the n-gram's length in bytes (63 at most): long ones are rare ones."""
    return (hashes >> np.uint64(6)) | (np.minimum(letters, 63).astype(np.uint64) << np.uint64(58))


def bucket_in_sketch(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def rarity(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Order keys, rarest first: by the sketch's class, then longest first, then by hash."""
    top = classes[bucket_in_sketch(hashes)].astype(np.uint64) << np.uint64(56)
    length = (np.uint64(63) - (hashes >> np.uint64(58))) << np.uint64(50)
    return top | length | (mix(hashes) & np.uint64((1 << 50) - 1))


def shingle_steps(column, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct hashes of each text end to end, how many of each).

    Fewer words than ``words`` make one hash of the whole sequence; no words, none.
    """
    for first, end, data, offsets in utf8_steps(column):
        n = end - first
        low = _LOWER[data]
        blank = _BLANK[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])) if len(low) else np.zeros(0, int)
        stop = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1 if len(low) else start
        text = np.searchsorted(offsets, start, "right") - 1
        word = RangeHash(low).of(start, stop)
        per_text = np.bincount(text, minlength=n)
        first_word = np.cumsum(per_text) - per_text
        many = max(len(word) - words + 1, 0)
        code = np.zeros(many, np.uint64)
        for i in range(words):
            code = code * _STEP + word[i : many + i]
        whole = text[:many] == text[words - 1 : many + words - 1]
        letters = np.concatenate([[0], np.cumsum(stop - start)])
        hashes, owner = [with_length(mix(code), letters[words:][:many] - letters[:many])[whole]], [text[:many][whole]]
        for k in range(1, words):
            short = np.flatnonzero(per_text == k)
            code = np.full(len(short), k, np.uint64)
            for i in range(k):
                code = code * _STEP + word[first_word[short] + i]
            at = first_word[short]
            hashes.append(with_length(mix(code ^ np.uint64(0x5851F42D4C957F2D)), letters[at + k] - letters[at]))
            owner.append(short)
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        flat, owner = np.concatenate(hashes)[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        for a, b in zip(bounds, bounds[1:]):
            flat[a:b].sort()
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        yield first, end, flat[new], np.bincount(owner[new], minlength=n)


def frequency_classes(docs: DataFrame, words: int, text: str = "text") -> np.ndarray:
    """For each of 2**SKETCH_BITS buckets of hashes, 0 or how many times too full it is, as a power of two.

    Counts cover all documents; the sketch has a fixed size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, flat, _ in shingle_steps(batch.column(0), words):
                counts += np.bincount(bucket_in_sketch(flat), minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["bucket", "n"])

    total = docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS)
    counts[total.column("bucket").to_numpy()] = total.column("n").to_numpy()
    usual = max(counts.mean(), 1.0)
    return np.floor(np.log2(np.maximum(counts / usual, 1.0))).astype(np.uint8)


def set_ids(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, whatever the order of its hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _STEP))])
    stop = np.cumsum(counts)
    return mix((sums[stop] - sums[stop - counts]) + counts.astype(np.uint64))


def pack(groups: np.ndarray) -> bytes:
    """Counts per group: a byte that tells the width of a count, then the counts."""
    many = max(GROUPS, 1 << (len(groups) // PER_GROUP).bit_length())
    counts = np.bincount(groups & (many - 1), minlength=many)
    counts = counts.astype(np.min_scalar_type(counts.max()))
    return bytes([counts.itemsize]) + counts.tobytes()


def unpack(point: bytes) -> np.ndarray:
    return np.frombuffer(point, f"u{point[0]}", offset=1).astype(np.int32)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """The points of the last axis over fewer groups: groups are nested, so counts add up."""
    while points.shape[-1] > groups:
        half = points.shape[-1] // 2
        points = points[..., :half] + points[..., half:]
    return points


def prefix_size(n: int, numerator: int, denominator: int) -> int:
    """So many of a set's first n-grams, in any order common to all sets, meet those of each link."""
    return n - -(-numerator * n // denominator) + 1


def points(docs: DataFrame, classes: np.ndarray, words: int, numerator: int, denominator: int, key: str, text: str) -> DataFrame:
    """(key, text_hash, n, set_id, point, prefix) of each row; prefix is null for a set that its task sent before.

    Sets are equal when their 64-bit ids are. ``set_id`` is null for an empty set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, deal = OrderedDict(), shared.value, np.uint64(16)
        for batch in batches:
            for first, end, flat, counts in shingle_steps(batch.column(1), words):
                stop = np.cumsum(counts)
                start = stop - counts
                ids = set_ids(flat, counts)
                order = rarity(flat, rank)
                group = ((flat >> deal) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                vectors, prefixes, valid = [], [], counts > 0
                for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
                    name = int(ids[i])
                    if a == b or name in known:
                        vectors.append(None)
                        prefixes.append(None)
                        continue
                    known[name] = None
                    if len(known) > REMEMBERED:
                        known.popitem(last=False)
                    vectors.append(pack(group[a:b]))
                    size = prefix_size(b - a, numerator, denominator)
                    prefixes.append(flat[a:b][np.argpartition(order[a:b], size - 1)[:size]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(counts.astype(np.int64)),
                        pa.array(ids.view(np.int64), mask=~valid), pa.array(vectors, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=[key, "text_hash", "n", "set_id", "point", "prefix"],
                )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, text_hash bigint, n bigint, set_id bigint, point binary, prefix array<bigint>"
    return docs.select(key, text, F.xxhash64(F.col(text))).mapInArrow(run, schema)


def meeting_groups(found: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(meeting, set_id): groups of sets that share a prefix n-gram, cut where sizes are too far apart to link.

    Rows are sorted by n-gram and size within hash partitions and read as a stream, so a frequent
    n-gram takes no memory. Sets that meet nobody go; meetings of equal members are one.
    """
    rows = found.where(F.col("prefix").isNotNull()).select(F.explode("prefix").alias("token"), F.col("n").cast("int"), "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        # The last group of what was read may go on: its rows, or for a long one its name and last row.
        held, name_of_long = [np.zeros(0, np.int64)] * 3, None

        def send(meeting: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(meeting), pa.array(sets)], names=["meeting", "set_id"])

        def groups(token: np.ndarray, size: np.ndarray, sets: np.ndarray) -> np.ndarray:
            """Where groups begin, and the end."""
            new = (token[1:] != token[:-1]) | (denominator * size[:-1] < numerator * size[1:])
            return np.flatnonzero(np.concatenate([[True], new, [True]]))

        def closed(edge: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
            many = np.diff(edge)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.view(np.uint64)))])
            name = mix(sums[edge[1:]] - sums[edge[:-1]] + many.astype(np.uint64)).view(np.int64)
            fresh = many > 1
            for i in np.flatnonzero(fresh):
                if (own := int(name[i])) in seen:
                    fresh[i] = False
                else:
                    seen[own] = None
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
            keep = np.repeat(fresh, many)
            return send(np.repeat(name, many)[keep], sets[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            token, size, sets = (
                np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)
            )
            new = np.ones(len(token), bool)  # a set that two tasks sent
            new[1:] = (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])
            token, size, sets = token[new], size[new], sets[new]
            edge = groups(token, size, sets)
            if name_of_long is not None:
                first = edge[1]
                yield send(np.full(first - 1, name_of_long), sets[1:first])  # row 0 was sent
                if len(edge) == 2:
                    held = [token[-1:], size[-1:], sets[-1:]]
                    continue
                token, size, sets, edge = token[first:], size[first:], sets[first:], edge[1:] - first
                name_of_long = None
            cut = edge[-2]
            if cut:
                yield closed(edge[:-1], sets[:cut])
            held = [token[cut:], size[cut:], sets[cut:]]
            if len(held[0]) > LISTED:
                name_of_long = int(mix(held[0][:1].view(np.uint64) + held[1][:1].astype(np.uint64)).view(np.int64)[0])
                yield send(np.full(len(held[0]), name_of_long), held[2])
                held = [h[-1:] for h in held]
        if name_of_long is None and len(held[0]):
            yield closed(groups(*held), held[2])

    parts = 2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "token").sortWithinPartitions("token", "n", "set_id")
    return ordered.mapInArrow(run, "meeting bigint, set_id bigint").distinct()


def leaves(meetings: DataFrame, found: DataFrame) -> DataFrame:
    """(meeting, alone, leaf, low, high, members): R-tree leaves of at most LEAF points, packed in order of set size.

    ``alone``: the meeting has no other leaf; ``low`` and ``high``: the least and largest set.
    Meetings of very many points are cut into runs before they are sorted.
    """
    sets = found.where(F.col("point").isNotNull()).select("set_id", "n", "point").dropDuplicates(["set_id"])
    sizes = meetings.groupBy("meeting").agg(F.count("*").alias("_many"))
    runs = meetings.join(sizes, "meeting").select(
        "meeting", "set_id", (F.col("_many") <= LEAF).alias("alone"),
        F.pmod(F.xxhash64("set_id"), F.ceil(F.col("_many") / RUN)).alias("run"),
    )
    packed = Window.partitionBy("meeting", "run").orderBy("n", "set_id")
    rows = runs.join(sets, "set_id").withColumn("page", F.floor((F.row_number().over(packed) - 1) / LEAF))
    return (
        rows.groupBy("meeting", "run", "page")
        .agg(
            F.first("alone").alias("alone"), F.min("n").alias("low"), F.max("n").alias("high"),
            F.collect_list(F.struct("set_id", "n", "point")).alias("members"),
        )
        .select("meeting", "alone", F.xxhash64("run", "page").alias("leaf"), "low", "high", "members")
    )


class Leaf:
    """Points of a leaf and the upper corner of their box, over as many groups as all its points have."""

    def __init__(self, members: list[dict]):
        self.ids = np.array([m["set_id"] for m in members], np.int64)
        self.sizes = np.array([m["n"] for m in members], np.int64)
        self.own = [unpack(m["point"]) for m in members]
        self.groups = np.array([len(p) for p in self.own])
        self.folded: dict[int, np.ndarray] = {}
        self.corner = self.at(int(self.groups.min())).max(0)
        self.roots = np.array([m["root"] for m in members], np.int64) if "root" in members[0] else self.ids

    def at(self, groups: int) -> np.ndarray:
        """The points over ``groups`` groups; zeros for those that have fewer."""
        if groups not in self.folded:
            out = np.zeros((len(self.own), groups), np.int32)
            for i in np.flatnonzero(self.groups >= groups):
                out[i] = fold(self.own[i], groups)
            self.folded[groups] = out
        return self.folded[groups]


def survivors(a: Leaf, b: Leaf, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places in a, places in b) that the coordinate minima can't rule out, and that are not yet connected.

    Third: the bound's part of both sizes together, the larger the likelier a link.
    """
    none = np.zeros(0, np.int64)
    least = int(a.sizes.min() + b.sizes.min())
    both, groups = numerator + denominator, min(len(a.corner), len(b.corner))
    if both * int(np.minimum(fold(a.corner, groups), fold(b.corner, groups)).sum(dtype=np.int64)) < numerator * least:
        return none, none, none.astype(float)
    apart = a.roots[:, None] != b.roots[None, :]
    small, big = np.minimum(a.sizes[:, None], b.sizes[None, :]), np.maximum(a.sizes[:, None], b.sizes[None, :])
    x, y = np.nonzero(apart & (denominator * small >= numerator * big))
    finest = np.minimum(a.groups[x], b.groups[y])
    keep = ([none], [none], [none.astype(float)])
    for groups in np.unique(finest).tolist():
        left, right, step = a.at(groups), b.at(groups), max(1, 4_000_000 // groups)
        of_these = np.flatnonzero(finest == groups)
        for i in range(0, len(of_these), step):
            p, q = x[of_these[i : i + step]], y[of_these[i : i + step]]
            shared = np.minimum(left[p], right[q]).sum(1, dtype=np.int64)
            ok = both * shared >= numerator * (a.sizes[p] + b.sizes[q])
            keep[0].append(p[ok])
            keep[1].append(q[ok])
            keep[2].append(shared[ok] / (a.sizes[p] + b.sizes[q])[ok])
    return np.concatenate(keep[0]), np.concatenate(keep[1]), np.concatenate(keep[2])


def join_leaves(nodes: DataFrame, numerator: int, denominator: int, nearest_only: bool) -> DataFrame:
    """(a, b) of pairs that survive the bound. ``nearest_only``: for each set only its likeliest and its least partner."""
    columns = ["meeting", "leaf", "low", "high", "members"]
    itself = nodes.select("meeting", "leaf", F.col("leaf").alias("leaf2"), "members", F.lit(None).cast(nodes.schema["members"].dataType).alias("members2"))
    left = nodes.where(~F.col("alone")).select(*columns)
    right = left.select(*[F.col(c).alias(f"{c}2") for c in columns])
    # Boxes first by their sizes: a larger set with more than the smaller's share is no link.
    meet = (
        (F.col("meeting") == F.col("meeting2")) & (F.col("leaf") < F.col("leaf2"))
        & (denominator * F.col("high") >= numerator * F.col("low2")) & (denominator * F.col("high2") >= numerator * F.col("low"))
    )
    pairs = left.join(right, meet).select("meeting", "leaf", "leaf2", "members", "members2").unionByName(itself)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int]] = {}
        least: dict[int, int] = {}
        at, key, cached = None, None, None

        def send(a, b, score) -> pa.RecordBatch:
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "score"])

        def flush() -> pa.RecordBatch:
            score = [r for r, _ in best.values()] + [-1.0] * len(least)
            return send([*best, *least], [*(-q for _, q in best.values()), *least.values()], score)

        for batch in batches:
            for i in range(batch.num_rows):
                meeting = batch.column(0)[i].as_py()
                if best and (meeting != at or len(best) > 4 * LISTED):
                    yield flush()
                    best, least = {}, {}
                at = meeting
                own = batch.column(1)[i].as_py()
                if key != (meeting, own):
                    key, cached = (meeting, own), Leaf(batch.column(3)[i].as_py())
                other = cached if own == batch.column(2)[i].as_py() else Leaf(batch.column(4)[i].as_py())
                x, y, score = survivors(cached, other, numerator, denominator)
                if other is cached:
                    x, y, score = x[x < y], y[x < y], score[x < y]
                a, b = cached.ids[x], other.ids[y]
                if not nearest_only:
                    yield send(np.maximum(a, b), np.minimum(a, b), score)
                    continue
                for u, v in ((a, b), (b, a)):
                    order = np.lexsort((v, -score, u))
                    head = order[np.flatnonzero(np.concatenate([[True], np.diff(u[order]) != 0]))] if len(u) else order
                    for p, q, r in zip(u[head].tolist(), v[head].tolist(), score[head].tolist()):
                        best[p] = max(best.get(p, (r, -q)), (r, -q))
                    order = np.lexsort((v, u))
                    head = order[np.flatnonzero(np.concatenate([[True], np.diff(u[order]) != 0]))] if len(u) else order
                    for p, q in zip(u[head].tolist(), v[head].tolist()):
                        least[p] = min(least.get(p, q), q)
        if best:
            yield flush()

    out = pairs.mapInArrow(run, "a bigint, b bigint, score double")
    if nearest_only:
        chosen = out.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("b"))).alias("best"), F.min("b").alias("least"))
        return chosen.select("a", F.explode(F.array_distinct(F.array(-F.col("best.b"), "least"))).alias("b"))
    return out.select("a", "b").distinct()


def with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaves whose members carry their component's root (their own id where there is none)."""
    place = ["meeting", "alone", "leaf", "low", "high"]
    member = nodes.select(*place, F.explode("members").alias("m")).select(*place, "m.*")
    rooted = member.join(roots.withColumnRenamed("vertex", "set_id"), "set_id", "left")
    return rooted.groupBy(*place).agg(
        F.collect_list(F.struct("set_id", "n", "point", F.coalesce("root", "set_id").alias("root"))).alias("members")
    )


def sets_of(docs: DataFrame, found: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(set_id, shingles) of the sets in ``wanted (set_id)``: the texts of one row each, hashed again.

    A row is found again by its key and the hash of its text, so rows that share a key, null
    included, are not joined with each other; of rows that are equal in both one is read.
    """
    owner = found.where(F.col("point").isNotNull()).join(wanted, "set_id").groupBy("set_id").agg(
        F.min(F.struct(F.col("text_hash").alias("_hash"), F.col(key).alias("_owner"))).alias("_row")
    ).select("set_id", "_row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, flat, counts in shingle_steps(batch.column(1), words):
                ids = batch.column(0).slice(first, end - first)
                # Two texts may have one hash; the set of the other is not the one that is wanted.
                own = pa.array(set_ids(flat, counts).view(np.int64) == ids.to_numpy())
                lists = list_array(counts, signed(flat))
                yield pa.RecordBatch.from_arrays([ids.filter(own), lists.filter(own)], names=["set_id", "shingles"])

    same = (F.xxhash64(F.col(text)) == F.col("_hash")) & F.col(key).eqNullSafe(F.col("_owner"))
    texts = docs.select(F.col(key), F.col(text)).join(owner, same).select("set_id", F.col(text)).dropDuplicates(["set_id", text])
    return texts.mapInArrow(run, "set_id bigint, shingles array<bigint>")


def _one_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(roots: DataFrame) -> DataFrame:
    """Components as edges (a, b): each vertex but the root with its root."""
    return roots.where(F.col("vertex") != F.col("root")).select(F.col("vertex").alias("a"), F.col("root").alias("b"))


def verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    one = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("first")), "a")
    both = one.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("second")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, first, second = batch.columns
            keep = []
            for x, y in zip(first, second):
                x, y = (np.asarray(s.values) for s in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((numerator + denominator) * shared >= numerator * (len(x) + len(y)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return both.select("a", "b", "first", "second").mapInArrow(run, "a bigint, b bigint")


def classes(
    docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the least key reachable over links, its own included.

    Two rows link when ``denominator * |A and B| >= numerator * |A or B|`` for the sets of their
    distinct n-grams of ``words`` words (lower-cased A-Z, cut at ASCII white space). A shorter
    text is one n-gram; a null or empty text or one of blanks has an empty set and links with
    nothing. Equal rows are each returned, in one class. Rows with a null key take part, but are
    never the least unless all of their class are null. Other columns are left out. No link is
    lost: order, bounds and pages only leave out pairs that can't link, or that are connected already.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias(text))
    ranks = frequency_classes(docs, words, text)
    found = materialize(points(docs, ranks, words, numerator, denominator, key, text), "points")
    meetings = materialize(meeting_groups(found, numerator, denominator), "meetings")
    nodes = materialize(leaves(meetings, found), "leaves")
    # First each set with its likeliest partner, and with its least one: in a group of near copies
    # that is the same for most, and connects them at once. Any set that a later pair can hold has one, so
    # these are the sets to go on with and to verify.
    nearest = materialize(join_leaves(nodes, numerator, denominator, True), "nearest")
    alive = nearest.select(F.col("a").alias("set_id")).distinct()
    sets = materialize(sets_of(docs, found, alive, words, key, text), "sets")
    links = materialize(verify(_one_way(nearest), sets, numerator, denominator), "links")
    together = meetings.join(alive, "set_id")
    several = together.groupBy("meeting").agg(F.count("*").alias("_many")).where(F.col("_many") > 1).select("meeting")
    open_nodes = materialize(
        leaves(together.join(several, "meeting"), found.join(alive, "set_id").select("set_id", "n", "point")), "open-leaves"
    )
    # Then the same between components, until it brings few links; what is left shows at last. New
    # links only join the stars that are known, so components never start again from all links.
    roots, known = components(links), links.count()
    while True:
        rooted = with_roots(open_nodes, roots)
        more = verify(_one_way(join_leaves(rooted, numerator, denominator, True)), sets, numerator, denominator)
        more = materialize(more, "links")
        found_now = more.count()
        if found_now:
            roots = components(_stars(roots).unionByName(more))
        if found_now * 100 <= known:
            break
        known += found_now
    # At last all pairs that are still apart and that the bound lets through.
    rooted = with_roots(open_nodes, roots)
    far = materialize(verify(join_leaves(rooted, numerator, denominator, False), sets, numerator, denominator), "links")
    all_roots = roots if far.isEmpty() else components(_stars(roots).unionByName(far))
    labelled = found.select(key, "n", "set_id").join(
        all_roots.withColumnRenamed("vertex", "set_id"), "set_id", "left"
    ).withColumn("root", F.coalesce("root", "set_id"))
    least = labelled.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(key).alias("_least"))
    return labelled.join(least, "root", "left").select(
        key, F.col("n").alias("n_shingles"), F.coalesce("_least", F.col(key)).alias("component_id")
    )
