"""Filters, rankings and joins by distance. Exact; see ``index`` for pruned searches.

NULL vectors rank last, ties go by the key, and filters that come with a search apply before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsql.functions.distance import DISTANCES, METRICS, batch_distances, distance, scan
from vecsql.storage import fixed

#: The right side of a join goes to all tasks up to so many bytes; beyond it the join is done by blocks.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4096
#: Of vectors as doubles, what a block of a k-NN join holds of a side, about.
BLOCK_BYTES = 32 << 20
#: Rough distances that are held at once, parts of a row of them of which each gives its least one, and pairs computed anew at once.
PICK_NUMBERS, PARTS, PAIRS = 4 << 20, 32, 1 << 16


def top_k(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, function: str = "array_distance", where: Column | None = None, name: str = "dist") -> DataFrame:
    """The k rows nearest to a constant: one pass, each task keeps k rows."""
    _check_k(k)
    df = df if where is None else df.filter(where)
    return df.withColumn(name, scan(function, column, query)).orderBy(F.col(name).asc_nulls_last(), key).limit(k)


def range_search(df: DataFrame, column: str, query: Sequence[float], radius: float, function: str = "array_distance", inclusive: bool = False, name: str = "dist") -> DataFrame:
    """Rows with a distance below (or up to) the radius; the distance is computed once."""
    # a projection that Catalyst does not merge with the filter: the array's only element
    found = df.withColumn(name, F.explode(F.array(scan(function, column, query))))
    return found.filter(F.col(name) <= radius if inclusive else F.col(name) < radius)


def range_by_operand(df: DataFrame, column: str, operand: Sequence[float], function: str = "l2sq", name: str = "dist") -> DataFrame:
    """The operand is the radius, then the vector; for inner products the function is 'ip'."""
    return range_search(df, column, operand[1:], operand[0], function, name=name)


def post_filtered_top_k(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, where: Column, function: str = "array_distance") -> DataFrame:
    """The filter applies to the k nearest, so fewer may be left."""
    return top_k(df, column, query, k, key, function).filter(where)


def min_by_k(df: DataFrame, value: str, by: Column, k: int, keys: Sequence[str] = (), tie: str | None = None, largest: bool = False, name: str = "values") -> DataFrame:
    """One row, or one a group, with the list of the k values of the smallest ``by``, in its order."""
    _check_k(k)
    tie = tie or value
    ranked = df.withColumn("_by", -by if largest else by).filter(F.col("_by").isNotNull())
    if not keys:
        kept = ranked.orderBy("_by", tie).limit(k)
    else:
        kept = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_by", tie))).filter(F.col("_n") <= k)
    listed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_by", F.col(tie).alias("_tie"), F.col(value).alias("_value")))).alias("_list"))
    return listed.select(*keys, F.col("_list._value").alias(name))


def weighted_top_k(df: DataFrame, terms: Sequence[tuple[float, str, Sequence[float]]], k: int, key: str, function: str = "l2sq", where: Column | None = None, combine: Callable[..., Column] | None = None, name: str = "score") -> DataFrame:
    """The k rows with the smallest weighted sum of distances of several vector columns.

    combine: takes the distances, in the order of the terms, and gives what to rank by instead.
    """
    _check_k(k)
    parts = [scan(function, column, query) for _, column, query in terms]
    score = combine(*parts) if combine else sum((F.lit(float(w)) * p for (w, _, _), p in zip(terms, parts, strict=True)), F.lit(0.0))
    df = df if where is None else df.filter(where)
    return df.withColumn(name, score).orderBy(F.col(name).asc_nulls_last(), key).limit(k)


def _check_k(k: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k < 0:
        raise ValueError("k must be a whole number of at least 0")


def _bytes(df: DataFrame, vector: str) -> int:
    """Bytes of a side's vectors as numbers: counted rows times the largest dimension."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("dims")).first()
    return found.n * 8 * max(1, found.dims)


def knn_join(left: DataFrame, right: DataFrame, left_key: str, left_vector: str, right_key: str, right_vector: str, k: int, function: str = "array_distance", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(left_key, right_key, dist, rank): for each left row its k nearest right rows.

    Right rows with a NULL vector rank last and have a NULL distance; for a NULL left vector
    all distances are NULL and the k smallest right keys stand. left_key must be unique.

    Blocks of both sides meet in tasks that take the k nearest of a block by matrix products of a few rows at a time, and a
    window keeps the k best of the blocks' k: no pair of rows is ever a row of its own beyond k for
    each left row and right block. A right side of a known small size is one block, sent to all tasks.
    """
    _check_k(k)
    spark = left.sparkSession
    function = METRICS.get(function, function)
    l = left.select(F.col(left_key).alias("_l"), _numbers(left, left_vector).alias("_v"))
    r = right.select(F.col(right_key).alias("_r"), _numbers(right, right_vector).alias("_w"))
    schema = T.StructType([T.StructField("_l", l.schema["_l"].dataType), T.StructField("_r", r.schema["_r"].dataType), T.StructField("_d", T.DoubleType())])
    if k == 0:
        best = spark.createDataFrame([], schema)
    elif _bytes(r, "_w") <= broadcast_bytes:
        found = r.toArrow()
        shared = spark.sparkContext.broadcast(_side(found.column(0), found.column(1), k))
        kind = found.schema.field(0).type

        def run(batches):
            for batch in batches:
                for a in range(0, len(batch), BLOCK_ROWS):
                    part = batch.slice(a, BLOCK_ROWS)
                    yield _block(part.column(0), part.column(1), shared.value, k, function, kind)

        # so that few large files don't make few long tasks
        best = l.repartition(spark.sparkContext.defaultParallelism, "_l").mapInArrow(run, schema)
    else:
        # as many blocks a side as keep a block at about BLOCK_BYTES; each left block meets each right block
        n_l, n_r = (max(1, -(-_bytes(x, v) // BLOCK_BYTES)) for x, v in ((l, "_v"), (r, "_w")))
        lb = l.withColumn("_a", F.pmod(F.xxhash64("_l"), F.lit(n_l)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
        rb = r.withColumn("_b", F.pmod(F.xxhash64("_r"), F.lit(n_r)).cast("int")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n_l - 1))))

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            kind = y.schema.field("_r").type
            return pa.Table.from_batches([_block(x.column("_l"), x.column("_v"), _side(y.column("_r"), y.column("_w"), k), k, function, kind)])

        lb, rb = (x.repartition(n_l * n_r, "_a", "_b").groupBy("_a", "_b") for x in (lb, rb))
        best = lb.cogroup(rb).applyInArrow(meet, schema)
    order = Window.partitionBy("_l").orderBy(F.col("_d").asc_nulls_last(), F.col("_r").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key if right_key != left_key else f"right_{right_key}"), F.col("_d").alias("dist"), "rank")


def _numbers(df: DataFrame, column: str) -> Column:
    """Vectors in single precision stay so while they are shuffled; others are double."""
    of_floats = df.select(column).dtypes[0][1] == "array<float>"
    return F.col(column) if of_floats else F.col(column).cast("array<double>")


class _Side(NamedTuple):
    """Keys in order, NULL last; which of them have a vector; the numbers of those without k equal vectors before them, and their vectors."""

    keys: pa.Array
    has: np.ndarray
    rows: np.ndarray
    matrix: np.ndarray


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector without NULLs, and the matrix of those in double."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())[has]
    flat = column.flatten()  # without the NULL rows
    if flat.null_count:
        bad = np.unique(np.repeat(np.arange(len(lengths)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)])
        has[np.flatnonzero(has)[bad]] = False
        return _vectors(pc.if_else(pa.array(has), column, pa.nulls(len(column), column.type)))
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors have different dimensions")
    if not len(lengths):
        return has, np.zeros((0, 0))
    return has, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), int(lengths[0]))


def _equals(matrix: np.ndarray) -> np.ndarray:
    """For each row the number of its group of equal rows."""
    if not matrix.size:
        return np.zeros(len(matrix), np.int64)
    rows = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.itemsize * matrix.shape[1]))).ravel()
    return np.unique(rows, return_inverse=True)[1].reshape(-1)


def _side(keys: pa.Array, vectors: pa.Array, k: int) -> _Side:
    keys, vectors = _whole(keys), _whole(vectors)
    order = pc.sort_indices(keys, null_placement="at_end")
    keys, vectors = keys.take(order), vectors.take(order)
    has, matrix = _vectors(vectors)
    # of equal vectors only those with the k smallest keys can be among the k nearest
    group = _equals(matrix)
    by = np.argsort(group, kind="stable")
    kept = np.sort(by[np.arange(len(by)) - np.searchsorted(group[by], group[by]) < k])
    return _Side(keys, has, np.flatnonzero(has)[kept], matrix[kept])


def _block(left: pa.Array, vectors: pa.Array, right: _Side, k: int, function: str, kind: pa.DataType) -> pa.RecordBatch:
    """The k nearest right rows of the block for each left row; fewer only if it has fewer."""
    left, vectors = _whole(left), _whole(vectors)
    known, queries = _vectors(vectors)
    without = np.flatnonzero(~right.has)
    # parts of the result: left row, right row, distance
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    near = 0
    if len(right.matrix) and len(queries):
        if queries.shape[1] != right.matrix.shape[1]:
            raise ValueError(f"vectors have different dimensions: {queries.shape[1]} and {right.matrix.shape[1]}")
        near = min(k, len(right.matrix))
        # equal left vectors have equal neighbours
        group = _equals(queries)
        _, first = np.unique(group, return_index=True)
        column, dist = nearest(function, queries[first], right.matrix, near)
        parts.append((np.repeat(np.flatnonzero(known), near), right.rows[column[group].ravel()], dist[group].ravel()))
    measured = len(parts[0][0]) if parts else 0
    for rows, rest in ((np.flatnonzero(known), without[: k - near]), (np.flatnonzero(~known), np.arange(min(k, len(right.keys))))):
        parts.append((np.repeat(rows, len(rest)), np.tile(rest, len(rows)), np.zeros(len(rows) * len(rest))))
    rows, columns, dist = (np.concatenate(p) for p in zip(*parts, strict=True))
    missing = np.arange(len(rows)) >= measured
    keys = right.keys.take(pa.array(columns)) if len(right.keys) else pa.nulls(0, kind)
    return pa.RecordBatch.from_arrays([left.take(pa.array(rows)), keys, pa.array(dist, pa.float64(), mask=missing)], ["_l", "_r", "_d"])


def nearest(function: str, queries: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances (queries, k) of the k nearest of each query, ties in the matrix's order; k is at most the rows.

    Products in single precision only pick; whatever their rounding may have put behind others is picked too, and what is picked is
    computed anew in double, each pair by itself. Few queries at a time, so that no array holds more than PICK_NUMBERS numbers.
    """
    n, dims = matrix.shape
    column, dist = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    if not len(queries) or not k:
        return column, dist
    q, m, half, odd_q, odd_m = _scaled(function, queries, matrix)
    kind = np.float32 if half is None or half.max() <= 1000 * np.median(half) else np.float64
    size = np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1)).max(initial=0)
    slack = (dims + 8) * np.finfo(kind).eps * (size[0] * size[1] + (0 if half is None else half.max())) + 1e-30
    q, m = q.astype(kind), np.ascontiguousarray(m.astype(kind).T)
    half = None if half is None else half.astype(kind)
    step, width = max(1, min(256, PICK_NUMBERS // n)), n // PARTS
    parts, odd = np.arange(PARTS) * width, np.flatnonzero(odd_m)
    held = np.empty((min(step, len(q)), n), kind)
    for a in range(0, len(q), step):
        rough = np.matmul(q[a : a + step], m, out=held[: len(q[a : a + step])])
        np.subtract(0 if half is None else half, rough, out=rough)
        rough[:, odd] = np.inf
        # the k-th smallest of the least of parts is no smaller than the k-th smallest of all
        split = width >= 4 * k
        least = rough[:, : width * PARTS].reshape(len(rough), PARTS, width).min(1) if split else rough
        limit = (np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * slack[a : a + step]).astype(kind)
        own, row = np.nonzero(least <= limit[:, None])
        if split:
            row = row[:, None] + parts
            at, part = np.nonzero(rough[own[:, None], row] <= limit[own, None])
            own, row = own[at], row[at, part]
            rest, tail = np.nonzero(rough[:, width * PARTS :] <= limit[:, None])
            own, row = np.r_[own, rest], np.r_[row, tail + width * PARTS]
        if len(odd) or odd_q[a : a + step].any():
            near = np.zeros(rough.shape, bool)
            near[own, row] = True
            near[:, odd] = True
            near[odd_q[a : a + step]] = True
            own, row = np.nonzero(near)
        exact = np.concatenate([_pairs(function, queries[a + own[b : b + PAIRS]], matrix[row[b : b + PAIRS]]) for b in range(0, len(own), PAIRS)])
        order = np.lexsort((row, exact, own))
        best = order[np.searchsorted(own[order], np.arange(len(rough)))[:, None] + np.arange(k)]
        column[a : a + step], dist[a : a + step] = row[best], exact[best]
    return column, dist


def _scaled(function: str, queries: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Both sides for products of at most about 1 a component, half the squares of the rows for distances, and the rows that products say nothing about."""
    out, odd = [], []
    for x in (queries, matrix):
        most = np.abs(x).max(axis=1, initial=0)
        strange = ~(most < 1e150) | (most > 0) & (most < 1e-150)  # squares may not be numbers
        if function == "array_cosine_distance":
            strange |= most == 0  # two zero vectors are alike
            x = np.where(strange[:, None], 0, x) / np.where(strange, 1, most)[:, None]
            x = x / np.sqrt(np.maximum((x * x).sum(1), 1))[:, None]
        out.append(np.where(strange[:, None], 0, x))
        odd.append(strange)
    if function == "array_cosine_distance":
        return *out, None, *odd
    if function not in ("array_distance", "array_negative_inner_product"):
        raise ValueError(f"no batch form of {function!r}")
    most = [np.abs(x).max(initial=0) or 1.0 for x in out]
    if function == "array_negative_inner_product":
        return out[0] / most[0], out[1] / most[1], None, *odd
    q, m = (x / max(most) for x in out)
    return q, m, (m * m).sum(1) / 2, *odd


def _pairs(function: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed component by component: equal pairs get equal ones."""

    def total(terms) -> np.ndarray:
        out = np.zeros(len(a))
        for t in terms:
            out += t
        return out

    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    with np.errstate(all="ignore"):
        if function == "array_distance":
            return np.sqrt(total((p - q) * (p - q) for p, q in zip(x, y, strict=True)))
        dot = total(p * q for p, q in zip(x, y, strict=True))
        if function == "array_negative_inner_product":
            return -dot
        p, r = total(p * p for p in x), total(q * q for q in y)
        return 1 - np.where((p == 0) & (r == 0), 1.0, np.where((p == 0) | (r == 0), 0.0, dot / np.sqrt(p * r)))


#: For each metric of the table macros: what scores a pair, and whether larger scores come first.
_MACRO = {"l2sq": ("array_distance", False), "cosine": ("array_cosine_similarity", True), "ip": ("array_inner_product", True)}


def vss_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, k: int, metric: str = "l2sq", left_key: str | None = None, right_key: str | None = None) -> DataFrame:
    """(score, left_tbl, right_tbl): for each left row the k best right rows, both as structs.

    With 'l2sq' the score is the distance, smallest first; with 'cosine' and 'ip' the similarity,
    largest first. The keys must identify rows; without them the rows are written once with numbers.
    """
    if metric not in _MACRO:
        raise ValueError("Unknown metric")
    score, larger = _MACRO[metric]
    l, left_key = _numbered(left, left_key, "_left_row")
    r, right_key = _numbered(right, right_key, "_right_row")
    lid, rid = l.withColumnRenamed(left_key, "_lk"), r.withColumnRenamed(right_key, "_rk")
    near = knn_join(lid, rid, "_lk", left_col if left_col != left_key else "_lk", "_rk", right_col if right_col != right_key else "_rk", k, METRICS[metric])
    ls = l.select(F.col(left_key).alias("_lk"), F.struct(*left.columns).alias("left_tbl"))
    rs = r.select(F.col(right_key).alias("_rk"), F.struct(*right.columns).alias("right_tbl"))
    both = near.select("_lk", "_rk").join(ls, "_lk").join(rs, "_rk")
    return both.select(DISTANCES[score](F.col(f"left_tbl.{left_col}"), F.col(f"right_tbl.{right_col}")).alias("score"), "left_tbl", "right_tbl")


def _numbered(df: DataFrame, key: str | None, name: str) -> tuple[DataFrame, str]:
    return (df, key) if key else (fixed(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name)


def vss_match(left: DataFrame, right: DataFrame, left_col: str, right_col: str, k: int, metric: str = "l2sq", left_key: str | None = None, right_key: str | None = None) -> DataFrame:
    """The left rows with ``matches``, the list of (score, row) of the k best right rows, best first."""
    if metric not in _MACRO:
        raise ValueError("Unknown metric")
    larger = _MACRO[metric][1]
    l, left_key = _numbered(left, left_key, "_left_row")
    r, right_key = _numbered(right, right_key, "_right_row")
    joined = vss_join(l, r, left_col, right_col, k, metric, left_key, right_key)
    order = F.struct((-F.col("score") if larger else F.col("score")).alias("o"), F.col(f"right_tbl.{right_key}").alias("t"), "score", F.struct(*[F.col(f"right_tbl.{c}").alias(c) for c in right.columns]).alias("row"))
    lists = joined.select(F.col(f"left_tbl.{left_key}").alias("_k"), order.alias("m")).groupBy("_k").agg(F.sort_array(F.collect_list("m")).alias("m"))
    matches = F.transform("m", lambda m: F.struct(m["score"].alias("score"), m["row"].alias("row"))).alias("matches")
    return l.join(lists, l[left_key] == lists["_k"], "left").select(*left.columns, matches)


def mutual_matches(left: DataFrame, right: DataFrame, left_key: str, left_vector: str, right_key: str, right_vector: str, function: str = "array_distance") -> DataFrame:
    """Pairs that are each other's nearest: (left_key, right_key, dist)."""
    ahead = knn_join(left, right, left_key, left_vector, right_key, right_vector, 1, function).toDF("a", "b", "dist", "rank")
    back = knn_join(right, left, right_key, right_vector, left_key, left_vector, 1, function).toDF("b", "a", "_d", "_rank")
    return ahead.join(back, ["a", "b"]).filter("dist is not null").select(F.col("a").alias(left_key), F.col("b").alias(right_key if right_key != left_key else f"right_{right_key}"), "dist")


def distance_between(a: DataFrame, b: DataFrame, column: str, function: str = "array_distance", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row with min, mean and max of the distances between the vectors of two selections; null vectors have none.

    A small second side goes to all tasks. Of two large ones blocks meet blocks, and a pair of blocks gives one row.
    """
    x, y = (d.select(F.col(column).cast("array<double>").alias(n)).filter(F.col(n).isNotNull()) for d, n in ((a, "_a"), (b, "_b")))
    if _bytes(y, "_b") <= broadcast_bytes:
        d = distance(function, F.col("_a"), F.col("_b"))
        return x.join(F.broadcast(y)).select(d.alias("d")).agg(F.min("d").alias("min"), F.avg("d").alias("mean"), F.max("d").alias("max"))
    name = METRICS.get(function, function)
    n_x, n_y = (max(1, -(-d.count() // BLOCK_ROWS)) for d in (x, y))
    xb = x.withColumn("_x", F.pmod(F.xxhash64("_a"), F.lit(n_x))).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(n_y - 1)).cast("array<bigint>")))
    yb = y.withColumn("_y", F.pmod(F.xxhash64("_b"), F.lit(n_y))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1)).cast("array<bigint>")))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"least": [], "total": [], "n": [], "most": []})
        d = batch_distances(name, np.stack(p["_a"].to_numpy()), np.stack(q["_b"].to_numpy()))
        return pd.DataFrame({"least": [d.min()], "total": [d.sum()], "n": [d.size], "most": [d.max()]})

    met = xb.groupBy("_x", "_y").cogroup(yb.groupBy("_x", "_y")).applyInPandas(run, "least double, total double, n long, most double")
    return met.agg(F.min("least").alias("min"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("max"))


def with_tags(df: DataFrame, column: str, every: Sequence[int] = (), some: Sequence[int] = ()) -> DataFrame:
    """Rows whose array of tags holds all of ``every`` and, if given, one of ``some``."""
    for tag in every:
        df = df.filter(F.array_contains(column, tag))
    return df.filter(F.arrays_overlap(F.col(column), F.array(*map(F.lit, some)))) if some else df
