"""Labelled samples of bounded size for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id is an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def usable_labels(labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(doc_id, label) outside fold 0 of the documents that have one label only; no null among them."""
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
    clean = clean.agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
    return clean.filter(fold(F.col("doc_id"), folds) != 0).select("doc_id", "label")


def label_counts(labels: DataFrame, label: str, folds: int = 5) -> dict[int, int]:
    """How many documents have each label, over all usable ones."""
    counts = {r.label: r["count"] for r in usable_labels(labels, label, folds).groupBy("label").count().collect()}
    return {0: counts.get(0, 0), 1: counts.get(1, 0)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, folds: int = 5) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows_per_class`` documents a class, outside fold 0, in the order of a hash.

    The bound makes what the driver collects independent of the corpus. The ids are chosen from
    ``labels`` alone and then joined, so one scan reads the texts of the chosen documents only.
    A document with two different labels is left out, as are null ids, labels and texts. Of the texts of a
    repeated id the smallest stands. Ids are of any type; those of ``labels`` are cast to that of ``docs``.
    """
    clean = usable_labels(labels, label, folds).withColumn("h", F.xxhash64(F.lit(label), "doc_id"))
    chosen = clean.filter("label = 0").orderBy("h", "doc_id").limit(rows_per_class)
    chosen = chosen.unionByName(clean.filter("label = 1").orderBy("h", "doc_id").limit(rows_per_class))
    rows = [(r.doc_id, r.label, r.h) for r in chosen.collect()]
    if not rows:
        return []
    types = {f.name: f.dataType.simpleString() for f in clean.schema}
    wanted = docs.sparkSession.createDataFrame(rows, f"doc_id {types['doc_id']}, label {types['label']}, h long")
    wanted = wanted.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    texts = found.groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(texts, key=lambda r: (r.h, r.doc_id))]
