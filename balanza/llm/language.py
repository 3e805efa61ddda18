"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit per language in every slot. An n-gram that is
characteristic of some languages sets their bits in its slots; the AND of its slots gives all
languages that hold it in one lookup. A text counts, per language, how many of its n-grams
answer with that bit, minus the answers that chance alone would give at that slice's fill.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from balanza.llm.common import bounded_batches, held_out, mix, signed, utf8_steps, without

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
PROBES = 3
GRAM = 4
#: Most texts of each language that a filter is learned from (by the hash of their id). Spark ranks up to
#: 1000 rows of a group before the shuffle, so a language of any size sends few rows.
SAMPLE_TEXTS = 1_000
#: An n-gram belongs to the languages that have at least this share of its best language's rate.
LEAST_SHARE = 0.4
#: and is kept if it occurs in this many of the sample's texts, or in all of a language with fewer.
LEAST_TEXTS = 3
#: Languages of one mask; a slot has as many masks as the languages need.
MASK_BITS = 64

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


@cache
def _letters() -> np.ndarray:
    """The code point to hash for each code point: letters in lower case, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of GRAM classes, and which of them hold a letter pair to speak of."""
    folded = _letters()[points]
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    letter = folded != 0
    code = folded[:n].astype(np.uint64)
    held = letter[:n].astype(np.int8)
    for i in range(1, GRAM):
        code = (code << np.uint64(16)) ^ (code >> np.uint64(48)) ^ folded[i : n + i]
        held += letter[i : n + i]
    return mix(code), held >= 2


def steps(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, row of each hash, rows with a letter) for steps of texts."""
    for first, end, data, offsets in utf8_steps(column):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        ends = heads[offsets[1:]].astype(np.int64)
        # Blanks between texts, so that no n-gram spans two and each text has blank margins.
        points = np.insert(points, np.repeat(np.concatenate([[0], ends]), GRAM), 32)
        row = np.repeat(np.arange(end - first), np.diff(np.concatenate([[0], ends])) + GRAM)
        row = np.concatenate([row, np.full(GRAM, max(end - first - 1, 0))])
        hashes, good = gram_hashes(points)
        at = np.flatnonzero(good)
        lettered = np.zeros(end - first, bool)
        # The first gram of a text's first letter may have one letter only; ask the letters themselves.
        lettered[row[np.flatnonzero(_letters()[points] != 0)]] = True
        # A margin belongs to the text behind it, so the place where an n-gram begins tells its text.
        yield first, end, hashes[at], row[at], lettered


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    """PROBES slots of each hash."""
    mask = np.uint64(SLOTS - 1)
    return [((hashes >> np.uint64(SLOT_BITS * i)) & mask).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilter:
    """``masks``: for each MASK_BITS languages their bits of every slot; ``chance``: false answers by language."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray


def sample_texts(docs: DataFrame, limit: int = SAMPLE_TEXTS) -> DataFrame:
    """(lang, text) of at most ``limit`` rows of each language outside the held-out fold.

    Only ids are ranked, by hash, and only those whose hash is so small that about twice the limit
    are left: a language of any size is a few rows of the ranking. The chosen ids are bounded by
    limit and the number of languages, so they are broadcast. Rows with null id, lang or text
    teach nothing.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", FOLDS, HELD_OUT))
    # A row per language. Distinct ids: one id repeated through the table is one chance.
    sizes = taught.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("doc_id", 0.02).alias("ids"))
    share = F.least(F.lit(1.0), F.lit(2.0 * limit + 100) / F.col("ids"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    near = taught.select("doc_id", "lang").join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(place <= share * F.lit(2.0**32))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    ids = (
        near.select("doc_id", "lang", place.alias("place")).distinct().withColumn("rank", rank).where(F.col("rank") <= limit)
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min("lang").alias("_lang"))
    )
    return (
        taught.where(F.col("text").isNotNull()).select("doc_id", "lang", "text")
        .join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .select("lang", "text")
    )


def learn(docs: DataFrame, limit: int = SAMPLE_TEXTS) -> LanguageFilter:
    """The filter of all languages among the teaching rows of (doc_id, lang, text)."""
    sample = sample_texts(docs, limit)
    texts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(texts)
    if not languages:
        return LanguageFilter([], np.zeros((1, SLOTS), np.uint8), np.zeros(0))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, end, hashes, row, _ in steps(batch.column("text")):
                order = np.lexsort((hashes, row))
                h, r = hashes[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                lang = own[first:end][r[new]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(h[new]), pa.array(lang)], names=["gram", "lang"])

    counts = sample.mapInArrow(grams, "gram bigint, lang int").groupBy("gram").agg(
        *[F.sum((F.col("lang") == i).cast("int")).alias(f"n{i}") for i in range(len(languages))]
    )
    rates = [F.col(f"n{i}") / F.lit(float(texts[lang])) for i, lang in enumerate(languages)]
    best = F.greatest(*rates) if len(rates) > 1 else rates[0]
    bits = [F.when(rate >= LEAST_SHARE * best, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for rate in rates]
    parts = [bits[i : i + MASK_BITS] for i in range(0, len(bits), MASK_BITS)]
    names = [f"mask{i}" for i in range(len(parts))]
    masks_of = [sum((F.shiftleft(bit, i) for i, bit in enumerate(part)), F.lit(0).cast("long")).alias(n) for part, n in zip(parts, names)]
    own = [F.col(f"n{i}") for i in range(len(languages))]
    total = F.aggregate(F.array(*own), F.lit(0).cast("long"), lambda a, b: a + b)
    enough = total >= LEAST_TEXTS
    small = [(i, texts[lang]) for i, lang in enumerate(languages) if texts[lang] < LEAST_TEXTS]
    if small:
        enough |= F.exists(F.array(*[own[i] >= n for i, n in small]), lambda x: x)
    shared_by_all = ~F.exists(F.array(*bits), lambda bit: bit == 0) if len(languages) > 1 else F.lit(False)
    kept = counts.where(enough & ~shared_by_all).select("gram", *masks_of)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("gram").to_numpy().view(np.uint64)
            slots = np.concatenate(slots_of(hashes)).astype(np.int32)
            masks = [pa.array(np.tile(batch.column(n).to_numpy(), PROBES)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(slots), *masks], names=["slot", *names])

    # At most SLOTS rows come back, however many texts the sample has.
    schema = ", ".join(["slot int", *(f"{n} bigint" for n in names)])
    found = kept.mapInArrow(place, schema).groupBy("slot").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()
    kind = next((k for bits, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= bits), np.uint64)
    masks = np.zeros((len(names), SLOTS), kind)
    for part, n in zip(masks, names):
        part[found.column("slot").to_numpy()] = found.column(n).to_numpy().view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(masks[i // MASK_BITS] & kind(1 << i % MASK_BITS)) / SLOTS for i in range(len(languages))])
    return LanguageFilter(languages, masks, fill**PROBES)


def predict(df: DataFrame, filters: LanguageFilter, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``lang_pred string`` and ``score double`` (0 to 1).

    The score is the chosen language's part of all corrected counts. A text that is null or has
    no letter is ``und`` with score 0, and so is every text when nothing was learned. A text with
    letters but no known n-gram gets the first language in order, score 0; ties likewise go to
    the first. Columns called lang_pred or score are replaced; all rows stay.
    """
    bounded_batches(df.sparkSession)
    df = without(df, ["lang_pred", "score"])
    kept = [c for c in df.columns if c != text]
    shared = df.sparkSession.sparkContext.broadcast(filters)  # SLOTS masks for each MASK_BITS languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known, count = own.languages, len(own.languages)
        for batch in batches:
            names, scores = [], []
            for first, end, hashes, row, lettered in steps(batch.column(text)):
                n = end - first
                slots = slots_of(hashes)
                answers = [np.bitwise_and.reduce([part[slot] for slot in slots]) for part in own.masks]
                kind = own.masks.dtype.type
                hits = np.stack([
                    np.bincount(row, weights=(answers[i // MASK_BITS] >> kind(i % MASK_BITS)) & kind(1), minlength=n)
                    for i in range(count)
                ]) if count else np.zeros((1, n))
                asked = np.bincount(row, minlength=n)
                if count:
                    chance = own.chance[:, None]
                    hits = np.maximum(hits - asked * chance, 0.0) / np.maximum(1.0 - chance, 1e-9)
                best, total = hits.argmax(0), hits.sum(0)
                part = np.where(total > 0, hits.max(0) / np.maximum(total, 1e-12), 0.0)
                speaks = lettered & (count > 0)
                names += [known[b] if s else UNKNOWN for b, s in zip(best, speaks)]
                scores.append(np.where(speaks, np.clip(part, 0.0, 1.0), 0.0))
            out = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], names=[*kept, "lang_pred", "score"])

    fields = [f for f in df.schema.fields if f.name in kept]
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return df.select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(run, StructType([*fields, *added]))
