"""The corpus pipeline: stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbcurate.llm import minhash, mixing, packing, quality, substring
from kbcurate.llm.memory import bounded_batches
from kbcurate.llm.queries import table, vocabulary
from kbcurate.llm.store import Scratch, count_rows, sized

#: No SQL states the classifier or the packing; tested against brute force instead.
ORACLE_SQL: str | None = None


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the ids in ``gone`` (column ``id``). Null ids stay."""
    gone, seen = Scratch(docs.sparkSession, name).write(gone.select("id").distinct(), count_rows())
    return docs.join(sized(gone, seen["n"]), docs["doc_id"] == gone["id"], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text, and one in a language without trusted text, stays; rows of one id stay or
    go together, rows with a null id stay; an empty table stays empty. Extra columns are kept.
    """
    bounded_batches(spark)
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id"))
    return _without(docs, quality.classify(docs, trusted).where(~F.col("keep")), "rejected")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Texts without words (null, empty) are in no group and stay; so do rows with a null id. Repeated
    rows of an id are one document and stay together; an empty table stays empty. Extra columns are kept.
    """
    bounded_batches(spark)
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")), "duplicates")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a text of which all is cut stays, empty.
    Texts without repeats, null ones and rows with a null id stay as they are."""
    bounded_batches(spark)
    out = substring.remove_repeats(docs)
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    return out.select(
        *others, F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars")
    ).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a shard perhaps in part.

    A null source is a source of its own; rows without words are never taken; rows with a null id
    and repeated rows are documents like others; an empty table stays empty. Extra columns are kept.
    """
    bounded_batches(spark)
    mixed = mixing.mixed_documents(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences; a null or empty text is its end id alone."""
    bounded_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


#: (name, function of the session, the documents so far and the folder of all tables)
STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
