"""Mixing sources to target weights, with DataFrame operations only.

Sizes are aggregated per source, a water level shares the total out by weight, and each document
is taken ``floor(rate)`` times plus once more with the probability of the fraction, drawn from a
hash of the document: another run or another partitioning takes the same documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, unused

#: Words as this operator counts them.
WORD = r"[^\x20\x09-\x0D]+"

#: Up to so many sources the table of targets is broadcast (some 100 bytes a source).
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], most: int, scratch: Scratch) -> DataFrame:
    """Targets of the sources in ``(source, source_size)``, one row each; there may be as many as web hosts.

    Sources in the order of their names (by code point, null last) take the weights in turn: they are sorted by
    ranges and written with their place, and ranks add the rows of the ranges before. A target stops at ``most`` times its
    source's size and what it leaves is shared by weight among the others until none is above: the level at which the
    rest is shared rises as sources stop, so a few sums over all of them, each with those that stop at the level
    so far, find it.
    """
    placed = scratch.save(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a number a range
    before = [(r["part"], sum(x.n for x in counts[:i])) for i, r in enumerate(counts)]
    before = placed.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", rank).withColumn("weight", weight.cast("long"))
    ranked = ranked.select("source", "source_size", "weight", (F.col("source_size") * F.lit(int(most))).alias("most"))
    ranked = scratch.save(ranked, "ranked")
    level, stopping = 0.0, -1
    while True:
        stops = F.col("most") < F.lit(level) * F.col("weight")
        sums = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(stops, F.col("most"))), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0)).alias("sharing"),
            F.count(F.when(stops, True)).alias("stopping"),
        ).first()
        if sums.stopping == stopping or not sums.sharing:
            break
        level, stopping = (sums.total - sums.stopped) / sums.sharing, sums.stopping
    return ranked.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double")).alias("target"))


def draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(
    spark: SparkSession, docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix"
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``.

    Columns ``doc_id, text, source`` are read; others stay as they are, except that columns of
    these four names are replaced. A null text has size 0, a null source is a source of its own,
    equal rows get equal numbers of copies, an empty table gives an empty one.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(F.col("text")))
    scratch = Scratch(spark, "mixing")
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = scratch.save(targets(sums, weights, most, scratch), "targets")
    few = table.count() <= BROADCAST_SOURCES
    its_source = unused("its_source", docs)
    table = table.withColumnRenamed("source", its_source)
    on = F.col("source").eqNullSafe(F.col(its_source))
    joined = docs.join(F.broadcast(table) if few else table, on).drop(its_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once_more = draw(seed, F.col("doc_id"), F.col("text")) < rate - F.floor(rate)
    return joined.withColumn("copies", (F.floor(rate) + once_more.cast("int")).cast("long"))


def emit_copies(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document as often as its ``copies`` say; those taken no time, or whose ``copies`` are null, go.

    Nulls elsewhere, very long texts and repeated rows are emitted as they are; an empty table stays empty.
    """
    repeated = docs.filter(F.col("copies") > 0).withColumn(unused("copy", docs), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed(spark, docs).select("doc_id", "size", "source_size", "target", taken)


#: The same arithmetic in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rn, 3 * source_size AS most FROM s
), w AS (
  SELECT *, CASE rn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r
), l AS (
  SELECT *,
    coalesce(sum(most) OVER before, 0)::BIGINT AS stopped,
    coalesce(sum(weight) OVER before, 0)::BIGINT AS gone,
    (sum(source_size) OVER ())::BIGINT AS total,
    (sum(weight) OVER ())::BIGINT AS all_weight
  FROM w
  WINDOW before AS (ORDER BY most / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, (total - stopped)::DOUBLE / (all_weight - gone)::DOUBLE AS level FROM l
), g AS (
  SELECT source, source_size,
    least(coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most::DOUBLE), most::DOUBLE) AS target
  FROM v
), x AS (
  SELECT doc_id, size, source_size, target, t,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || t), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
    < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM x
"""
