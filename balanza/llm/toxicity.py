"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicons (a fixed list of insults, words and word beginnings learned
from labelled texts), insults near second-person words, capitals, punctuation and disguised
spellings. Trees and calibration are MLlib's, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from balanza.llm.common import bounded_batches, held_out, labelled_sample, without
from balanza.session import materialize

# Common insults and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown "
    "garbage filth jerk fool hate".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te tus usted ustedes vosotros vous votre vos toi ton du dich dir dein "
    "deine ihr euch euer".split()
)
#: Characters that stand for letters in disguised spellings.
DISGUISE = str.maketrans("013457@$!|", "oieastasii", "*._-'")

#: Most labelled rows that lexicons, trees and calibration are fitted on (by the hash of their id).
SAMPLE_ROWS = 20_000
#: Learned entries: in this many toxic texts at least, this much likelier there, so many at most.
LEAST_TEXTS, LEAST_RATIO, MOST_ENTRIES = 5, 8.0, 4_000
STEMS = (4, 5, 6)
NEAR = 5

WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"\b[^\W\d_]+(?:[0-9@$!|*._\-]+[^\W\d_]+)+\b")
FEATURES = (
    "insults", "insult_density", "learned_words", "learned_density", "learned_stems", "stem_density",
    "near_second_person", "disguised", "capitals", "exclamations", "symbols", "log_words",
)
UPPER, LOUD = bytes(range(65, 91)), b"!?"
PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or c in b" \t\n\r.,;:'\"-()!?")


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()


@dataclass
class ToxicityModel:
    lexicon: Lexicon = field(default_factory=Lexicon)
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    constant: float = 0.0  # the score where the labels hold only one class


def features_of(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text.lower())
    n = max(len(words), 1)
    bad = sum(map(INSULTS.__contains__, words))
    learned = sum(map(lexicon.words.__contains__, words))
    stems = sum(sum(map(lexicon.stems.__contains__, [w[:k] for w in words])) for k in STEMS) if lexicon.stems else 0
    near = 0
    if bad or learned or stems:
        person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        if person:
            hits = [
                i for i, w in enumerate(words)
                if w in INSULTS or w in lexicon.words or any(w[:k] in lexicon.stems for k in STEMS)
            ]
            spots = np.searchsorted(person, hits)
            for i, s in zip(hits, spots):
                gap = min(abs(i - person[j]) for j in (s - 1, s) if 0 <= j < len(person))
                near += gap <= NEAR
    disguised = 0
    for token in MASKED.findall(text):
        shown = token.lower().translate(DISGUISE)
        disguised += shown in INSULTS or shown in lexicon.words
    raw = text.encode()
    size = max(len(raw), 1)
    return [
        min(bad, 10.0), bad / n, min(learned, 10.0), learned / n, min(stems, 10.0), stems / n,
        min(near, 10.0), min(disguised, 10.0),
        (len(raw) - len(raw.translate(None, UPPER))) / size,
        (len(raw) - len(raw.translate(None, LOUD))) / size,
        len(raw.translate(None, PLAIN)) / size,
        float(np.log1p(len(words))),
    ]


def add_features(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``features array<double>`` in place of the text column."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # at most 2 * MOST_ENTRIES strings
    kept = [c for c in without(df, ["features"]).columns if c != text]
    fields = [f for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = shared.value, batch.column(text)
            rows = [features_of(t.as_py() or "", own) for t in texts]
            out = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, "features"])

    found = df.select(*[f"`{c}`" for c in kept], f"`{text}`")
    return found.mapInArrow(run, StructType([*fields, StructField("features", ArrayType(DoubleType()))]))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and word beginnings that occur in many more toxic than other texts of ``sample``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, terms, toxic = [], [], []
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                words = {w for w in WORD.findall((text.as_py() or "").lower()) if not w.isdigit()}
                own = [("w", w) for w in words if len(w) > 1] + [("s", w) for w in {w[:k] for w in words for k in STEMS if len(w) >= k}]
                kinds += [k for k, _ in own]
                terms += [t for _, t in own]
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array(toxic, pa.int32())],
                names=["kind", "term", "label"],
            )

    sizes = sample.groupBy().agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    bad, good = sizes["bad"] or 0, sizes["good"] or 0
    if not bad or not good:
        return Lexicon()
    ratio = ((F.col("bad") + 0.5) / (bad + 1.0)) / ((F.col("good") + 0.5) / (good + 1.0))
    terms = (
        sample.mapInArrow(run, "kind string, term string, label int")
        .groupBy("kind", "term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .where((F.col("bad") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
        .select("kind", "term", (ratio * F.sqrt("bad")).alias("weight"))
    )
    best = {k: terms.where(F.col("kind") == k).orderBy(F.desc("weight"), "term").limit(MOST_ENTRIES).collect() for k in "ws"}
    return Lexicon(frozenset(r["term"] for r in best["w"]), frozenset(r["term"] for r in best["s"]))


def fit(sample: DataFrame) -> ToxicityModel:
    """A model from a bounded sample of (doc_id, text, label).

    A quarter of the rows (by another hash of the id) is kept for the calibration. Lexicons and
    trees come from the rest.
    """
    sample = materialize(sample.withColumn("label", (F.col("label") > 0).cast("int")), "toxicity-sample")
    later = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(4)) == 0
    lexicon = learn_lexicon(sample.where(~later))
    rows = materialize(
        add_features(sample, lexicon).withColumn("features", array_to_vector("features")).coalesce(4), "toxicity-features"
    )
    counts = {(r["later"], r["label"]): r["n"] for r in rows.groupBy(later.alias("later"), "label").agg(F.count("*").alias("n")).collect()}
    if not counts.get((False, 0)) or not counts.get((False, 1)):
        total = sum(counts.values())
        toxic = counts.get((False, 1), 0) + counts.get((True, 1), 0)
        return ToxicityModel(lexicon, constant=toxic / total if total else 0.0)
    trees = GBTClassifier(maxIter=15, maxDepth=3, maxBins=32, stepSize=0.3, seed=11).fit(rows.where(~later))
    # Without both classes in the calibration rows the trees are calibrated on all rows.
    both = counts.get((True, 0)) and counts.get((True, 1))
    margins = with_margin(trees.transform(rows.where(later) if both else rows))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins.select("margin", F.col("label").cast("double")))
    return ToxicityModel(lexicon, trees, calibration)


def with_margin(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``score double`` in 0 to 1 and ``predicted int`` (1 from 0.5 on).

    Null and empty texts have zero features and are scored like any text. With labels of one
    class only the score is their share of toxic rows (0 without labels). Columns called
    features, score or predicted (and MLlib's margin columns) are replaced; all rows stay.
    """
    df = without(df, ["features", "score", "predicted", "margin", "rawPrediction", "probability", "prediction"])
    if model.trees is None:
        plain = df.drop(text)
        return plain.withColumns({"score": F.lit(float(model.constant)), "predicted": F.lit(int(model.constant >= 0.5))})
    rows = add_features(df, model.lexicon, text).withColumn("features", array_to_vector("features"))
    margins = with_margin(model.trees.transform(rows)).drop("features")
    out = model.calibration.transform(margins).drop("margin")
    clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("score", clipped).drop("prediction").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: The held-out fold of the contract: ids whose crc32 leaves this rest teach nothing.
FOLDS, HELD_OUT = 5, 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``limit`` rows labelled for toxicity outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", limit, FOLDS, HELD_OUT))


def is_held_out():
    return held_out("doc_id", FOLDS, HELD_OUT)
