"""A corpus of documents turned into packed training sequences, stage by stage.

Each stage takes what the one before kept, written as Parquet, and returns the columns of
``documents``; the last one returns the packed pieces.

In every stage a null text counts as empty and a null id is kept as it is; very long texts are read
whole; repeated rows are treated alike; columns beyond those of ``documents`` are not read, whatever
their names; an empty table gives an empty one. What each stage does with such rows beyond that
stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsql.llm import mixing, near_dedup, packing, quality, secrets
from vecsql.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Null and empty texts have a score like any other; equal texts stay or go together.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality.score(docs.select(*COLUMNS), model).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Null and empty texts are one group, as are repeated rows, of which one stays. A null id stands only for a group
    without others.
    """
    return near_dedup.dedup(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the secrets found in them are replaced, and their n_chars follow.

    Texts without secrets, null ones among them, keep their n_chars, null or not.
    """
    marked = docs.select(*COLUMNS).withColumn("before", F.xxhash64("text"))
    changed = secrets.redact(marked)
    n_chars = F.when(F.xxhash64("text") == F.col("before"), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return changed.withColumn("n_chars", n_chars).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target of its source asks for.

    A null source is a source of its own; null and empty texts have no words and follow the rate of their source;
    equal rows are taken equally often.
    """
    return mixing.emit_copies(mixing.mixed(spark, docs.select(*COLUMNS)), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their bins, with their text.

    A null or empty text is one piece of no words; equal texts, repeated rows among them, never share a bin; pieces of
    one size go by id and piece.
    """
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL: compression, signatures and packing can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs
