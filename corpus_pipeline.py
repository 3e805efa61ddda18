"""Documents to training tokens: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.llm import bpe, decontaminate, jaccard, quality, repeats
from balanza.llm.common import read_table
from balanza.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, columns): all but the text in one struct, where no column that an operator adds can replace it."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("columns"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from packed rows, some of them changed; what operators added goes."""
    own = {"text": F.col("text"), **changed}
    return rows.select(*[own.get(c, F.col("columns")[c]).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, fitted on the labels of these documents.

    Without both classes of labels nothing is known against a document and all stay, unless all
    labels are 0.
    """
    model = quality.fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    return unpacked(quality.score(packed(docs), model).where(F.col("predicted") == 1), docs)


def row_name() -> Column:
    """Of a packed row: a struct that tells rows apart, rows with an id first: id, hash of the text, hash of the other columns.

    Rows with equal names are equal in all columns.
    """
    return F.struct(
        F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.to_json("columns")).alias("others_hash"),
    )


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five words, similarity 0.8): the one with the least id.

    Null ids come after all others, and equal ids are told apart by the hashes of their rows; of
    rows that are equal in all columns one stays. Texts without words have no copies: all stay.
    """
    rows = packed(docs).withColumn("row", row_name())
    found = jaccard.classes(rows, key="row")
    first = found.where(F.col("component_id").eqNullSafe(F.col("row"))).groupBy("row").agg(
        ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated")
    )
    first = materialize(first, "kept")
    # Only rows that are repeated as they are need to be brought together again.
    single = rows.join(first.where(~F.col("repeated")), "row", "left_semi")
    one = rows.join(first.where("repeated"), "row", "left_semi").dropDuplicates(["row"])
    return unpacked(single.unionByName(one), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur more than once.

    Null texts stay null; a text that is all repeats stays as an empty one.
    """
    cut = repeats.remove_repeats(packed(docs), whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return unpacked(cut, docs, text=text, n_chars=F.char_length(text).cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found."""
    found = decontaminate.find(packed(docs), read_table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("matches") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: Models, hashes and transforms have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
