"""A Merkle manifest of a table, with one inclusion proof a row.

Rows are the leaves of one tree per source, and the roots of these are the leaves of a top
tree. A node stands for a run of up to ``FANOUT`` children and is the SHA-256 of their
concatenated digests.

Proofs come from pointer jumping. Each inner node holds a pointer to an ancestor and the
segment of siblings on the way there. A round joins the nodes with themselves on the pointer:
the segment of the ancestor is appended and the distance doubles, so a tree of height h needs
about log2(h) rounds. Leaves are fifteen times as many as all other nodes, so they jump last,
once, over their parent, whose pointer is at the root by then.

No window holds a whole source: leaves are numbered within slices of a range partition, and a
pointer that very many nodes share is dealt out by blocks of these nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balanza.session import materialize

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Nodes that share a pointer meet it in blocks of 2**BLOCK_BITS, each with its own copy of it.
BLOCK_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the trees' roots.
TOP = "top"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(column: Column) -> Column:
    """SHA-256 in lowercase hex."""
    return F.sha2(column.cast("binary"), 256)


def field(column: Column) -> Column:
    """One field of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their 0-based ``idx`` within ``tree`` by ``order``, nulls first, and the tree's size ``n``.

    Rows are range-partitioned and sorted; each takes its place in its slice, and the slices'
    totals, one row a slice and tree, give where the slice begins. Rows that are equal in
    ``order`` are told apart by where they were read, so a third of the table may be one row
    repeated. The sorted rows are written first: slices stay as they are when a task is repeated.
    """
    own = [c for c in rows.columns if c != "tree"]
    placed = rows.withColumn("_seat", F.monotonically_increasing_id()).repartitionByRange(*order, "_seat")
    placed = placed.sortWithinPartitions(*order, "_seat").select(
        "tree", *own, F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().alias("_row")
    )
    placed = materialize(placed, name)
    before = Window.partitionBy("tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("tree", "_slice").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first")).select(
        "tree", "_slice", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    )
    return placed.join(starts, ["tree", "_slice"]).select(
        "tree", *own, (F.col("_row") - F.col("_first") + F.col("_before")).alias("idx"), "n"
    )


def height_of(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = (n + FANOUT - 1) >> FANOUT_BITS, height + 1
    return height


def levels(leaves: DataFrame, most: int, name: str) -> DataFrame:
    """All inner nodes (tree, level, idx, hash, kids, height) over ``leaves (tree, idx, n, hash)``; a lone leaf is a node too.

    ``kids`` are the digests of the children in order, ``n`` the tree's leaves, ``most`` the
    largest n. Each level groups the one below it, which has up to sixteen times its rows.
    """
    # Powers of the fanout below n, one for each level above the leaves.
    height = F.size(F.filter(F.array(*[F.lit(1 << FANOUT_BITS * k) for k in range(height_of(most) + 1)]), lambda x: x < F.col("n")))
    lone = leaves.where(F.col("n") == 1).select(
        "tree", F.lit(0).alias("level"), "idx", "n", "hash", F.array().cast("array<string>").alias("kids")
    )
    parts, below = [lone], leaves.where(F.col("n") > 1)
    for level in range(1, height_of(most) + 1):
        nodes = (
            below.groupBy("tree", F.shiftright("idx", FANOUT_BITS).alias("idx"), "n")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "hash"))).alias("runs"))
            .select("tree", F.lit(level).alias("level"), "idx", "n", F.transform("runs", lambda r: r["hash"]).alias("kids"))
            .select("tree", "level", "idx", "n", digest(F.array_join("kids", "")).alias("hash"), "kids")
        )
        nodes = materialize(nodes, f"{name}-{level}")
        parts.append(nodes)
        below = nodes.where(F.lit(1 << FANOUT_BITS * level) < F.col("n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("height", height)


def siblings(kids: Column, at: Column) -> Column:
    """The segment of one step up: the digests left and right of child ``at`` (0-based), each side as one string."""
    return F.struct(
        F.array_join(F.slice(kids, F.lit(1), at), "").alias("left"),
        F.array_join(F.slice(kids, at + 2, F.lit(FANOUT)), "").alias("right"),
    )


PATH = "array<struct<left:string,right:string>>"
NODE = ("tree", "level", "idx", "n", "hash", "kids", "height")


def jump(nodes: DataFrame, distance: int) -> DataFrame:
    """One round: each node whose pointer is not at the root takes over its ancestor's pointer and segment.

    Before the round a pointer reaches ``distance`` levels up, or to the root of the node's
    tree. Nodes of a level that share a pointer are consecutive, and so are their blocks.
    """
    block = lambda at: F.expr(f"shiftright({at}, {BLOCK_BITS})")
    # Levels whose nodes point here, and the blocks of these.
    is_top = F.col("level") == F.col("height")
    lowest = F.greatest(F.lit(1), F.col("level") - distance)
    reached = (
        nodes.where((F.col("level") > 1) & (is_top | (F.col("level") > distance)))
        .withColumn("origin", F.explode(F.sequence(lowest, F.when(is_top, F.col("level") - 1).otherwise(lowest))))
        .withColumn("steps", (FANOUT_BITS * (F.col("level") - F.col("origin"))).cast("int"))
        .withColumn("leftmost", F.expr("shiftleft(idx, steps)"))
        .withColumn("rightmost", F.expr(f"least(shiftleft(idx + 1, steps) - 1, shiftright(n - 1, int({FANOUT_BITS} * origin)))"))
        .select(
            F.col("tree").alias("in_tree"), "origin", F.explode(F.sequence(block("leftmost"), block("rightmost"))).alias("block"),
            F.col("level").alias("at_level"), F.col("idx").alias("at_idx"),
            F.col("pointer").alias("next"), F.col("path").alias("more"), F.col("top").alias("next_top"),
        )
    )
    same = (
        (F.col("tree") == F.col("in_tree")) & (F.col("level") == F.col("origin")) & (block("idx") == F.col("block"))
        & (F.col("pointer") == F.col("at_level")) & (F.expr(f"shiftright(idx, int({FANOUT_BITS} * (pointer - level)))") == F.col("at_idx"))
    )
    moved = nodes.where(F.col("pointer").isNotNull()).join(reached, same).select(
        *NODE, F.col("next").alias("pointer"), F.concat("path", "more").alias("path"), F.col("next_top").alias("top")
    )
    return nodes.where(F.col("pointer").isNull()).unionByName(moved)


def with_paths(nodes: DataFrame, ends: DataFrame | None, most: int, name: str) -> DataFrame:
    """Inner nodes with ``path``, the segments of siblings up to the root of all, and ``top``, their tree's root.

    ``ends (tree, root_path)`` continues the path above each tree's own root; None: nothing is above.
    A pointer is the level it points to, null where it points to the root of all.
    """
    steps = nodes.select(
        "tree", (F.col("level") - 1).alias("level"), F.col("idx").alias("parent"), F.col("kids").alias("run"), F.posexplode("kids").alias("kid", "_")
    ).where(F.col("level") > 0).select(
        "tree", "level", (F.shiftleft("parent", FANOUT_BITS) + F.col("kid")).alias("idx"),
        F.array(siblings(F.col("run"), F.col("kid"))).cast(PATH).alias("path"),
    )
    below = nodes.where(F.col("level") < F.col("height")).join(steps, ["tree", "level", "idx"]).select(
        *NODE, (F.col("level") + 1).alias("pointer"), "path", F.lit(None).cast("string").alias("top")
    )
    tops = nodes.where(F.col("level") == F.col("height"))
    if ends is None:
        tops = tops.withColumn("path", F.array().cast(PATH))
    else:
        tops = tops.join(ends.withColumnRenamed("root_path", "path"), "tree")
    tops = tops.select(*NODE, F.lit(None).cast("int").alias("pointer"), "path", F.col("hash").alias("top"))
    now, distance = materialize(below.unionByName(tops), f"{name}-0"), 1
    # Once pointers reach as far as the trees are high, a last round takes them from there to the root of all.
    while distance < 2 * (height_of(most) - 1):
        now = materialize(jump(now, distance), f"{name}-{distance}")
        distance *= 2
    return now


def attach(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``leaves`` with ``path`` to the root of all and ``top``, their tree's root: one step to the parent, then the parent's path.

    A lone leaf is the node itself and adds no step. At most ``FANOUT`` leaves meet in a parent.
    """
    parents = nodes.where(F.col("level") == F.least(F.lit(1), F.col("height"))).select(
        "tree", F.col("idx").alias("parent"), "kids", F.col("path").alias("rest"), "top"
    )
    own = F.when(F.size("kids") > 0, F.array(siblings(F.col("kids"), (F.col("idx") % FANOUT).cast("int")))).otherwise(F.array()).cast(PATH)
    return leaves.withColumn("parent", F.shiftright("idx", FANOUT_BITS)).join(parents, ["tree", "parent"]).select(
        *leaves.columns, F.concat(own, "rest").alias("path"), "top"
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all sibling digests of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(rows: DataFrame, leaves: Column, source: str = "source", key: str = "doc_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, extra columns) of every row of ``rows``; ``leaves`` is its leaf's digest.

    Within a source leaves ascend by key, null keys first, then by digest; equal rows are leaves
    of their own, next to each other, in any order (their digests are equal, their places and
    proofs are not). Rows with a null source are a tree of their own, ordered first. An empty
    text, a null in any field and any length of text are fine; an empty table gives no rows.
    Columns of ``rows`` that are not named are not read.
    """
    tree = field(F.col(f"`{source}`"))
    base = rows.select(
        tree.alias("tree"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("key"), leaves.alias("hash"),
        F.struct(*[c.alias(n) for n, c in (extra or {}).items()] or [F.lit(0).alias("none")]).alias("extra"),
    )
    # Digests are written before the range partition samples them, so texts are read and hashed once.
    base = materialize(base, "merkle-leaves")
    placed = materialize(numbered(base, ["source", "key", "hash"], "merkle-sorted"), "merkle-numbered")
    most = placed.agg(F.max("n")).first()[0] or 0
    inner = levels(placed.select("tree", "idx", "n", "hash"), most, "merkle-level")

    subroots = inner.where(F.col("level") == F.col("height")).select("tree", F.col("hash").alias("subroot"))
    names = placed.where(F.col("idx") == 0).select("tree", "source").join(subroots, "tree")
    tops = numbered(
        names.select(F.lit(TOP).alias("tree"), F.col("tree").alias("branch"), "source", F.col("subroot").alias("hash")), ["source"], "merkle-roots"
    )
    tops = materialize(tops, "merkle-roots-numbered")
    wide = tops.agg(F.max("n")).first()[0] or 0
    crown = with_paths(levels(tops.select("tree", "idx", "n", "hash"), wide, "merkle-top"), None, wide, "merkle-top-path")
    ends = attach(tops, crown).select(F.col("branch").alias("tree"), F.col("path").alias("root_path"))
    ends = materialize(ends, "merkle-ends")

    nodes = with_paths(inner, ends.select("tree", "root_path"), most, "merkle-path")
    found = attach(placed.select("tree", "idx", "key", "hash", "extra"), nodes)
    root = crown.where(F.col("level") == F.col("height")).select("hash").scalar()
    return found.select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path",
        *[F.col("extra")[n].alias(n) for n in extra or {}],
    )


def tampered(column: Column) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(column, UPPER, LOWER)


def verification(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, checked against a table in which some texts were changed.

    Where 5 divides the CRC-32 of the id, the text's A-Z are lowered before its digest is taken
    again; ``folded_root`` is what that leaf and the original siblings give, and ``verified``
    whether it is the root. A null id has no CRC, so its row is not changed.
    """
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    again = [F.when(changed, tampered(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    out = manifest(docs, leaf([F.col(c) for c in FIELDS]), extra={"leaf_now": leaf(again)})
    folded = out.withColumn("folded_root", fold(F.col("leaf_now"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
