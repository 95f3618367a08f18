import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsql.functions import distance as D
from vecsql.operators import search


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(n, [float(a), float(b), float(c)]) for n, (a, b, c) in enumerate((a, b, c) for a in range(1, 10) for b in range(1, 10) for c in range(1, 10))]
    return spark.createDataFrame(rows, "id int, vec array<float>").cache()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_top_k_on_the_grid(grid):
    got = search.top_k(grid, "vec", [1, 2, 3], 3, "id").collect()
    assert [r.dist for r in got] == [0.0, 1.0, 1.0]


def test_min_by_around_the_middle(grid):
    got = search.min_by_k(grid, "vec", D.euclidean("vec", [5, 5, 5]), 3, tie="id").first()["values"]
    assert 45 - 3 <= sum(sum(v) for v in got) <= 50 and len(got) == 3


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [
        ("<->", [1, 2], [4, 6], 5.0),
        ("l2sq", [1, 2], [4, 6], 25.0),
        ("<+>", [1, 2], [4, 6], 7.0),
        ("<#>", [1, 2], [3, 4], -11.0),
        ("ip", [1, 2], [3, 4], -10.0),
        ("<=>", [1, 0], [0, 2], 1.0),
        ("<=>", [0, 0], [0, 2], 1.0),
        ("<=>", [0, 0], [0, 0], 0.0),
        ("hamming", [0b1011, 1], [0b0001, 0], 3),
        ("tanimoto", [0b1011], [0b0011], 1 - 2 / 3),
        ("sorensen", [0b1011], [0b0011], 1 - 4 / 5),
        ("jaccard", [1, 2, 3], [2, 3, 4], 0.5),
        ("jaccard", [], [], 0.0),
        ("pearson", [1, 2, 3], [2, 4, 6], 0.0),
        ("pearson", [1, 1, 1], [2, 4, 6], 0.0),
        ("pearson", [1, 2, 3], [3, 2, 1], 2.0),
        ("haversine", [0, 0], [0, 90], math.pi / 2),
        ("jensen_shannon", [0.5, 0.5], [0.5, 0.5], 0.0),
        ("cosine_i8", [1, 0], [0, 1], 0.0),
    ],
)
def test_values(spark, name, a, b, want):
    assert value(spark, D.distance(name, a, b)) == pytest.approx(want, abs=1e-8)


def test_kullback_leibler(spark):
    p, q = [0.2, 0.8], [0.6, 0.4]
    assert value(spark, D.distance("kullback_leibler", p, q)) == pytest.approx(sum(x * math.log(x / y) for x, y in zip(p, q, strict=True)), abs=1e-6)


def test_nulls_and_dimensions(spark):
    df = spark.createDataFrame([(None,)], "v array<double>")
    assert df.select(D.euclidean("v", [1, 2]).alias("d")).first().d is None
    with pytest.raises(Exception, match="different dimensions: 3 and 2"):
        value(spark, D.euclidean([1, 2, 3], [1, 2]))
    with pytest.raises(ValueError, match="unknown distance"):
        D.distance("nothing", [1], [1])


def test_bits_of_signs(spark):
    v = [1.0, -1.0] * 40
    got = value(spark, D.to_bits(v))
    assert len(got) == 2 and sum(bin(x & (1 << 64) - 1).count("1") for x in got) == 40


def test_own_measure_and_metric_names(spark):
    D.register("chebyshev", lambda a, b: F.array_max(F.zip_with(D.vector(a), D.vector(b), lambda x, y: F.abs(x - y))))
    assert value(spark, D.distance("chebyshev", [1, 5], [2, 9])) == 4
    with pytest.raises(ValueError, match="known already"):
        D.register("chebyshev", D.l1)
    assert [D.metric_of(x) for x in ("<->", "l2sq", "array_cosine_similarity", "<#>")] == ["l2sq", "l2sq", "cosine", "ip"]


def test_nan_free_batches_equal_expressions(spark):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(3, 5)), rng.normal(size=(4, 5))
    v[0] = 0
    for name in D.METRICS.values():
        want = [[value(spark, D.distance(name, a.tolist(), b.tolist())) for b in v] for a in q]
        assert np.allclose(D.batch_distances(name, q, v), want)


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, [1.0, 1.0]), (2, [5.0, 5.0]), (3, None)], "a_id int, a_vec array<float>")
    b = spark.createDataFrame([(10, [1.0, 1.0]), (11, [1.0, 2.0]), (12, [5.0, 4.0]), (13, None)], "b_id int, b_vec array<float>")
    return a, b


@pytest.mark.parametrize("size", [search.BROADCAST_BYTES, 0])
def test_knn_join_with_nulls(sides, size):
    a, b = sides
    got = search.knn_join(a, b, "a_id", "a_vec", "b_id", "b_vec", 2, broadcast_bytes=size).collect()
    by = {k: [(r.b_id, r.dist) for r in sorted(got, key=lambda r: r["rank"]) if r.a_id == k] for k in (1, 2, 3)}
    assert by == {1: [(10, 0.0), (11, 1.0)], 2: [(12, 1.0), (11, 5.0)], 3: [(10, None), (11, None)]}
    every = search.knn_join(a, b, "a_id", "a_vec", "b_id", "b_vec", 9, broadcast_bytes=size)
    assert every.count() == 12 and every.filter("a_id = 1 and b_id = 13 and rank = 4 and dist is null").count() == 1
    assert search.knn_join(a, b, "a_id", "a_vec", "b_id", "b_vec", 0, broadcast_bytes=size).count() == 0
    with pytest.raises(ValueError, match="k must be"):
        search.knn_join(a, b, "a_id", "a_vec", "b_id", "b_vec", -1)


def test_ties_go_by_key(spark):
    df = spark.createDataFrame([(k, [1.0]) for k in (5, 3, 9, 1)] + [(0, None)], "id int, v array<double>")
    assert [r.id for r in search.top_k(df, "v", [0.0], 5, "id").collect()] == [1, 3, 5, 9, 0]
    assert [r.id for r in search.post_filtered_top_k(df, "v", [0.0], 2, "id", F.col("id") > 1).collect()] == [3]
    assert [r.id for r in search.top_k(df, "v", [0.0], 2, "id", where=F.col("id") > 1).collect()] == [3, 5]


def test_vss_join_and_match(sides):
    a, b = (s.filter(f"{s.columns[1]} is not null") for s in sides)
    got = search.vss_join(a, b, "a_vec", "b_vec", 1, "l2sq", "a_id", "b_id").collect()
    assert {(r.left_tbl.a_id, r.right_tbl.b_id, r.score) for r in got} == {(1, 10, 0.0), (2, 12, 1.0)}
    ip = search.vss_join(a, b, "a_vec", "b_vec", 1, "ip", "a_id", "b_id").collect()
    assert {(r.left_tbl.a_id, r.right_tbl.b_id, r.score) for r in ip} == {(1, 12, 9.0), (2, 12, 45.0)}
    matches = search.vss_match(a, b, "a_vec", "b_vec", 2).collect()
    assert {r.a_id: [m.row.b_id for m in r.matches] for r in matches} == {1: [10, 11], 2: [12, 11]}
    for f in (search.vss_join, search.vss_match):
        with pytest.raises(ValueError, match="Unknown metric"):
            f(a, b, "a_vec", "b_vec", 1, "nothing")


def test_weighted_top_k_with_own_rank(spark):
    df = spark.createDataFrame([(1, [0.0], [9.0]), (2, [2.0], [2.0]), (3, [9.0], [0.0])], "id int, v array<double>, w array<double>")
    terms = [(0.5, "v", [0.0]), (0.5, "w", [0.0])]
    assert [r.id for r in search.weighted_top_k(df, terms, 1, "id").collect()] == [2]
    assert [r.id for r in search.weighted_top_k(df, terms, 3, "id", combine=F.least).collect()] == [1, 3, 2]


def test_range_computes_the_distance_once(grid):
    plan = search.range_search(grid, "vec", [1, 2, 3], 1.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1
    assert search.range_search(grid, "vec", [1, 2, 3], 1.0).count() == 1
    assert search.range_search(grid, "vec", [1, 2, 3], 1.0, inclusive=True).count() == 6


def test_tags(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [2, 3]), (3, None)], "id int, tags array<int>")
    assert [r.id for r in search.with_tags(df, "tags", [2], [3, 4]).collect()] == [2]


def test_half_precision(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=300), rng.normal(size=100) * 1e-6, 2.0 ** np.arange(-26, 17), -(2.0 ** np.arange(-26, 17)) * 1.0005, [0.0, -0.0, 65504, 65519.9, 65520, 1e9, -1e9, 2049, 2051, np.inf, -np.inf]])
    got = np.array(spark.createDataFrame([(x.tolist(),)], "v array<double>").select(D.to_f16("v")).first()[0])
    with np.errstate(over="ignore"):
        assert (got == x.astype(np.float16).astype(float)).all()


def test_distances_between_large_selections(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(70, 4)), rng.normal(size=(50, 4))
    a, b = (spark.createDataFrame([(v.tolist(),) for v in m] + [(None,)], "v array<double>") for m in (x, y))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    for most in (search.BROADCAST_BYTES, 0):
        got = search.distance_between(a, b, "v", broadcast_bytes=most).first()
        assert np.allclose([got.min, got.mean, got.max], [d.min(), d.mean(), d.max()])
    assert search.distance_between(a, b.limit(0), "v", broadcast_bytes=0).first().min is None


def test_joins_without_keys_give_each_row_its_own(spark):
    rows = [(f"n{i}", [float(i), 0.0]) for i in range(40)]
    left = spark.createDataFrame(rows, "name string, v array<double>").repartition(5).orderBy(F.rand(3))
    got = search.vss_join(left, left, "v", "v", 1).collect()
    assert len(got) == 40 and all(r.left_tbl.name == r.right_tbl.name and r.score == 0 for r in got)


@pytest.mark.parametrize("name", ["array_distance", "l2sq", "l1", "array_inner_product", "array_negative_inner_product", "ip", "array_cosine_similarity", "array_cosine_distance", "<->"])
def test_scans_in_batches(spark, name):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 20)))] + [(100, None), (101, [0.0] * 20), (102, [None, *[1.0] * 19])]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(3)
    for q in (rng.normal(size=20).tolist(), [0.0] * 20):
        got = df.select("id", D.scan(name, "v", q).alias("a"), D.distance(name, "v", q).alias("b")).collect()
        assert all((r.a is None) == (r.b is None) and (r.a is None or abs(r.a - r.b) < 1e-9) for r in got) and sum(r.a is None for r in got) == 2
    with pytest.raises(Exception, match="different dimensions: 20 and 17"):
        df.select(D.scan(name, "v", [1.0] * 17)).collect()
    assert df.limit(0).select(D.scan(name, "v", [1.0] * 20)).count() == 0


def _brute(function, q, m, k):
    """The k nearest of each row, each pair by itself."""
    rows, dist = [], []
    for x in q:
        d = search._pairs(function, np.repeat(x[None], len(m), 0), m)
        rows.append(np.lexsort((np.arange(len(m)), d))[:k])
        dist.append(d[rows[-1]])
    return np.array(rows), np.array(dist)


@pytest.mark.parametrize("function", ["array_distance", "array_cosine_distance", "array_negative_inner_product"])
def test_nearest_takes_little_memory_and_loses_no_tie(function):
    import tracemalloc

    rng = np.random.default_rng(0)
    q, m = rng.normal(size=(60, 16)), rng.normal(size=(3000, 16))
    m[::3] = q[:20] = m[0]
    m[5] = q[30] = 0
    m[7] = q[31] = np.nan
    m[9] = np.inf
    for scale in (1, 1e-200, 1e6):
        with np.errstate(all="ignore"):
            for got, want in zip(search.nearest(function, q * scale, m * scale, 5), _brute(function, q * scale, m * scale, 5), strict=True):
                assert np.array_equal(got, want, equal_nan=True)
    # a block of left rows against as many right rows as one block of a broadcast side may have: all distances would take 2 GB
    q, m = rng.normal(size=(4096, 16)), rng.normal(size=(65_536, 16))
    tracemalloc.start()
    search.nearest(function, q, m, 3)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_knn_join_of_many_copies_and_odd_rows(spark, size, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 2048)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 4)).astype(np.float32).astype(float)
    m[50:150] = m[0]
    rows = [(f"k{i:03d}", v.tolist()) for i, v in enumerate(m)] + [("n", None), ("z", [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(7)
    got = search.knn_join(df, df, "id", "v", "id", "v", 4, broadcast_bytes=size).toDF("a", "b", "dist", "rank").collect()
    want, dist = _brute("array_distance", m, m, 4)
    by = {(r.a, r["rank"]): (r.b, r.dist) for r in got}
    assert len(by) == len(got) == 4 * 202
    assert all(by[f"k{i:03d}", n + 1] == (f"k{want[i, n]:03d}", dist[i, n]) for i in range(200) for n in range(4))
    assert [by["n", n] for n in (1, 2, 3, 4)] == [by["z", n] for n in (1, 2, 3, 4)] == [(f"k{n:03d}", None) for n in range(4)]
