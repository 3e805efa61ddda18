"""I-Match fingerprints, in DataFrame functions only.

The lexicon holds terms within a band of inverse document frequency. Random subsets of it give
a document one hash each: of the document's distinct terms in the subset, sorted. A fingerprint
is the list of these hashes; two fingerprints are alike by the part of subsets that agree.
Subsets are so small that a document of its number of terms has about one term in each, which
keeps some subsets untouched by an edit of part of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of the lexicon occur in at least and at most this part of the documents. A document has
#: a bounded mean number of distinct terms, so there are at most (that mean / LEAST_PART) of them.
LEAST_PART, MOST_PART = 0.001, 0.1
SUBSETS = 32
LEAST_LEVEL = 5  # 2**5 = SUBSETS
#: The least part of a text's terms that the lexicon must hold for the others to be left out.
LEAST_KEPT = 0.25
NONE = 0
BUCKETS_A_PARTITION = 8

TERM_BREAK = r"[\s\p{Punct}]+"


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct lower-case terms."""
    words = F.filter(F.split(F.lower(text), TERM_BREAK), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def subset_bits(term: Column) -> Column:
    """The bits of a term's hash that deal it to subsets."""
    return F.shiftrightunsigned(term, 17)


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` hashes in the band, from all documents."""
    counts = docs.select(F.explode(term_hashes(F.coalesce(text, F.lit("")))).alias("term")).groupBy("term").count()
    total = docs.count()
    band = (F.col("count") >= max(1.0, LEAST_PART * total)) & (F.col("count") <= max(1.0, MOST_PART * total))
    return counts.where(band).select("term")


def two_to(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def level_of(terms: Column) -> Column:
    """log2 of the number of distinct terms: subsets hold every 2**level-th term."""
    return F.greatest(F.lit(LEAST_LEVEL), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)))).cast("int"))


def candidates(terms: Column, level: Column) -> Column:
    """Terms that fall into one of the SUBSETS subsets (of this level or the next)."""
    return F.filter(terms, lambda t: F.pmod(subset_bits(t), two_to(level)) < SUBSETS)


def subset_hashes(terms: Column, level: Column) -> Column:
    """One hash per subset of sorted terms; NONE for a subset without terms.

    Terms are sorted by subset and hashed in one pass, in which a subset ends where the next begins.
    """
    width = two_to(level)
    dealt = F.transform(terms, lambda t: F.struct(F.pmod(subset_bits(t), width).cast("int").alias("subset"), t.alias("term")))
    dealt = F.array_sort(F.filter(dealt, lambda x: x["subset"] < SUBSETS))
    empty = F.array().cast("array<bigint>")

    def state(out: Column, at: Column, value: Column) -> Column:
        return F.struct(out.alias("out"), at.alias("at"), value.alias("hash"))

    def closed(s: Column, upto: Column) -> Column:
        """The hashes so far, with the open subset's and NONE for those up to ``upto``."""
        own = F.when(s["at"] >= 0, F.array(s["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(empty)
        return F.concat(s["out"], own, F.array_repeat(F.lit(NONE).cast("long"), upto - s["at"] - 1))

    def step(s: Column, x: Column) -> Column:
        goes_on = state(s["out"], s["at"], F.xxhash64(s["hash"], x["term"]))
        return F.when(x["subset"] == s["at"], goes_on).otherwise(state(closed(s, x["subset"]), x["subset"], F.xxhash64(x["term"])))

    start = state(empty, F.lit(-1), F.lit(0).cast("long"))
    return F.aggregate(dealt, start, step, lambda s: closed(s, F.lit(SUBSETS)))


def hex_of(hashes: Column) -> Column:
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def print_of(found: Column, own: Column, level: Column, plain: Column) -> Column:
    """struct<level, low, high, text>: subset hashes of a level and the next, and the fingerprint.

    ``found``: terms of the lexicon; ``own``: all terms of the subsets. A text of which the
    lexicon holds less than LEAST_KEPT of these is known by all of them: in a group of copies
    that is a large part of the table every term is frequent, and what is left tells them apart.
    ``plain``, the digest of all terms, alone is the fingerprint of a text without terms in the
    subsets.
    """
    chosen = F.when(F.size(found) >= LEAST_KEPT * F.size(own), found).otherwise(own)
    low, high = subset_hashes(chosen, level), subset_hashes(chosen, level + 1)
    text = F.when(F.size(own) == 0, F.concat(F.lit("all:"), plain)).otherwise(
        F.concat_ws(":", level.cast("string"), hex_of(low), hex_of(high))
    )
    return F.struct(level.alias("level"), low.alias("low"), high.alias("high"), text.alias("text"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the part of subsets with terms in either that agree, over the levels both have."""

    def agree(x, y):
        return F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != NONE)))

    def either(x, y):
        return F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != NONE) | (p["y"] != NONE)))

    def part(pairs):
        same, used = (sum((f(x, y) for x, y in pairs[1:]), f(*pairs[0])) for f in (agree, either))
        return F.when(used > 0, same / used).otherwise(F.lit(0.0))

    return (
        F.when(a["text"] == b["text"], F.lit(1.0))
        .when(a["level"] == b["level"], part([(a["low"], b["low"]), (a["high"], b["high"])]))
        .when(a["level"] == b["level"] + 1, part([(a["low"], b["high"])]))
        .when(a["level"] + 1 == b["level"], part([(a["high"], b["low"])]))
        .otherwise(F.lit(0.0))
    )


def with_fingerprints(rows: DataFrame, texts: dict[str, str], words: DataFrame) -> DataFrame:
    """``rows`` (grouped by columns ``bucket, place``, which stay) with a print per text column.

    ``texts`` names the print of each text column, which goes. Terms are matched with the lexicon
    by a join and gathered again under (bucket, place); rows partitioned by bucket stay where
    they are. A text without terms keeps its row.
    """
    kept = [c for c in rows.columns if c not in texts]
    for column, name in texts.items():
        rows = rows.withColumn(f"{name}_terms", term_hashes(F.col(column)))
    for name in texts.values():
        terms = F.col(f"{name}_terms")
        digest = F.substring(F.sha2(F.array_join(F.sort_array(terms), ","), 256), 1, 32)
        rows = rows.withColumns({f"{name}_level": level_of(terms), f"{name}_plain": digest})

    def marked(i: int, name: str) -> Column:
        chosen = candidates(F.col(f"{name}_terms"), F.col(f"{name}_level"))
        return F.transform(chosen, lambda t: F.struct(F.lit(i).alias("which"), t.alias("term")))

    which = [marked(i, name) for i, name in enumerate(texts.values())]
    fixed = [*kept, *(f"{n}_{x}" for n in texts.values() for x in ("level", "plain"))]
    spread = rows.select(*fixed, F.explode_outer(F.concat(*which)).alias("one")).select(*fixed, "one.which", "one.term")
    # The lexicon is bounded by the mean number of distinct terms of a document / LEAST_PART.
    matched = spread.join(F.broadcast(words.select(F.col("term").alias("known"))), F.col("term") == F.col("known"), "left")
    others = [c for c in fixed if c not in ("bucket", "place")]
    gathered = matched.groupBy("bucket", "place").agg(
        *[F.first(c).alias(c) for c in others],
        *[
            F.collect_list(F.when(F.col("which") == i, F.col(c))).alias(f"{n}_{x}")
            for i, n in enumerate(texts.values()) for c, x in (("known", "found"), ("term", "own"))
        ],
    )
    return gathered.select(
        *kept,
        *[print_of(*[F.col(f"{n}_{x}") for x in ("found", "own", "level", "plain")]).alias(n) for n in texts.values()],
    )


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, place, guest, key, text, next): documents by descending key with the next one's text.

    The last is followed by the first. Null keys come last; rows with equal keys are ordered by
    the hash of their text, then text. Keys are cut into ranges (buckets) at approximate quantiles, found
    by one aggregate; the text is shuffled once, by bucket. Each bucket also gets the first
    document of the next as a guest, so that its last row has a successor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(text, F.lit("")).alias(text))
    many = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(key, [i / many for i in range(1, many)], 10 * many)).first()[0] or []
    rows = rows.withColumn("bucket", bucket_of(F.col(key), sorted(set(cuts), reverse=True)))
    order = [F.col(key).desc_nulls_last(), F.xxhash64(text), F.col(text)]
    used = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as cuts, at most
    before = spark.createDataFrame([(b, used[i - 1]) for i, b in enumerate(used)], "of int, bucket int")
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("rank") == 1)
    guests = first.withColumnRenamed("bucket", "of").join(F.broadcast(before), "of")
    columns = ["bucket", key, text]
    both = rows.select(*columns, F.lit(0).alias("guest")).unionByName(guests.select(*columns, F.lit(1).alias("guest")))
    ordered = Window.partitionBy("bucket").orderBy("guest", *order)
    return both.select(
        *columns, "guest", F.row_number().over(ordered).alias("place"), F.lead(text).over(ordered).alias("next")
    )


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are above ``key``, found in two steps; nulls come after all."""
    if not cuts:
        return F.when(key.isNull(), 1).otherwise(0)
    width = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.lit([g[-1] for g in groups])
    at = F.size(F.filter(heads, lambda c: c > key))  # groups wholly above the key
    rest = F.when(
        at < len(groups), F.size(F.filter(F.element_at(F.lit(groups), F.least(at + 1, F.lit(len(groups)))), lambda c: c > key))
    ).otherwise(0)
    return F.when(key.isNull(), len(cuts) + 1).otherwise(F.least(at * width, F.lit(len(cuts))) + rest)


def edited(text: Column, other: Column) -> Column:
    """The last third of ``text`` replaced by the first as many code points (or all) of ``other``."""
    size = F.char_length(text)
    many = F.floor(size / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - many), F.substring(other, F.lit(1), many))


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and likenesses.

    One row per row of ``docs``; null text is empty. Texts with equal terms have equal
    fingerprints, two texts without terms likeness 1. An empty table gives no rows. The lexicon
    comes from all documents, not from edited texts. Rows with a null key come last, in the order
    of their texts' hashes, as rows that share a key do; equal rows follow each other. Other
    columns are not read. Texts of any length are read whole.
    """
    words = lexicon(docs, text)
    rows = neighbours(docs, key, text).withColumn("_edited", edited(F.col(text), F.coalesce("next", F.lit(""))))
    rows = rows.select(
        "bucket", "place", "guest", key, F.char_length(text).cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"), F.col(text).alias("_text"), "_edited",
    )
    prints = with_fingerprints(rows, {"_text": "own", "_edited": "changed"}, words)
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))
    return prints.withColumn("following", following).where(F.col("guest") == 0).select(
        key, "n_chars", "edited_sha256",
        F.col("own.text").alias("fingerprint"), F.col("changed.text").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
