"""From buckets of candidates to groups, without listing the pairs of a bucket.

Members that share a bucket may be alike. Each member is compared with its bucket's hub only: the
member whose buckets are the largest, which in a group of edited copies is the text closest to all
the others. The links found make components. Members that are then in another component than
their bucket's hub - few, as a rule - are compared with every member of the bucket that belongs to
another component, so no pair of a bucket between two components stays untested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node it reaches.

    Alternating star contraction: every node hands its larger neighbours to its smallest one, then
    its smaller ones. Each round is two aggregations with map-side combining and two joins whose
    skew can be split; the edges never outnumber those given. About log^2 rounds at most.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(least, "a")
        handed = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            handed = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return handed.filter("a <> b").distinct()

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    seen = mark(now)
    for n in range(1, rounds + 1):
        if not seen[0]:
            break
        wide = scratch.save(star(both(now), True), f"{name}-{n}-wide")
        now = scratch.save(star(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), f"{name}-{n}")
        scratch.drop(f"{name}-{n}-wide", f"{name}-{n - 1}")
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct().toDF("node", "root"))


def linked_groups(
    members: DataFrame,
    verify: Callable[[DataFrame, bool], DataFrame],
    alike: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, Column]] | None,
    scratch: Scratch,
    meet: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and components (node, root) of ``members(node, bucket)``; node is a long.

    verify: of pairs (a, b), those that are links; told whether they met the condition of alike. alike: gives two sides of rows (node, bucket,
    root) what it needs and the condition, on ``x`` and ``y``, that a pair must meet to be verified. meet, in place of alike and the second
    verify: of rows (node, bucket, root, apart), links that join all components with a link between two members of a bucket, one of them apart
    from the bucket's hub; no pair has to be a row for that.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.save(members.join(sizes, "bucket"), "shared")
    reach = shared.groupBy("node").agg(F.sum("n").alias("reach"))
    shared = shared.drop("n").join(reach, "node")
    hubs = shared.groupBy("bucket").agg(F.max_by("node", F.struct("reach", -F.col("node"))).alias("hub"))
    placed = scratch.save(shared.join(hubs, "bucket"), "placed")
    scratch.drop("shared")
    stars = placed.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.save(verify(stars, False), "links")
    groups = components(links, scratch, "first")
    root = F.coalesce("root", "node")
    rooted = placed.join(groups, "node", "left").select("node", "bucket", "hub", "reach", root.alias("root"))
    hub_roots = groups.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    rooted = rooted.join(hub_roots, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
    rooted = scratch.save(rooted, "rooted")
    # a bucket whose other members are all alone has been tested in full only if it has two members
    if meet:
        others = rooted.filter("node <> hub").select("node", "bucket", "root", (F.col("root") != F.col("hub_root")).alias("apart"))
        open_ = others.groupBy("bucket").agg(F.max("apart").alias("any"), F.min("root").alias("low"), F.max("root").alias("high"))
        more = scratch.save(meet(others.join(open_.filter("any AND low < high").select("bucket"), "bucket")), "more")
    else:
        apart = rooted.filter("root <> hub_root").select("node", "bucket", "hub", "root")
        open_ = apart.groupBy("bucket").agg(F.count("*").alias("apart"))
        x, y, condition = alike(apart, rooted.join(open_, "bucket").select("node", "bucket", "root"))
        x, y = x.alias("x"), y.alias("y")
        fresh = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.node") != F.col("x.hub")) & condition
        late = x.join(y, fresh).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        more = scratch.save(verify(late, True), "more")
    scratch.drop("rooted", "placed")
    links = links.union(more)
    return links, components(links, scratch, "all") if more.take(1) else groups
