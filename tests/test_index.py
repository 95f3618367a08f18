import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsql.operators.index import EF_SEARCH, Catalog, StatementError, check_options, knn_join_indexed


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)) + rng.integers(0, 5, (600, 1)) * 2
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(1000, None)]
    return x.astype(np.float32).astype(float), spark.createDataFrame(rows, "id long, vec array<float>").cache()


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/indexes")


@pytest.mark.parametrize(
    ("options", "message"),
    [
        ({"ef_construction": "foo"}, "HNSW index 'ef_construction' must be an integer"),
        ({"ef_construction": 0}, "HNSW index 'ef_construction' must be at least 1"),
        ({"ef_search": "foo"}, "HNSW index 'ef_search' must be an integer"),
        ({"ef_search": 0}, "HNSW index 'ef_search' must be at least 1"),
        ({"M": "foo"}, "HNSW index 'M' must be an integer"),
        ({"M": 0}, "HNSW index 'M' must be at least 2"),
        ({"M0": "foo"}, "HNSW index 'M0' must be an integer"),
        ({"M0": 0}, "HNSW index 'M0' must be at least 2"),
        ({"metric": 3}, "HNSW index 'metric' must be a string"),
        ({"metric": "foo"}, "HNSW index 'metric' must be one of"),
    ],
)
def test_options(options, message):
    with pytest.raises(StatementError, match=message):
        check_options(options)


def test_options_in_range():
    assert check_options({"ef_construction": 100, "ef_search": 100, "M": 3, "m0": 3}) == {"metric": "l2sq", "ef_construction": 100, "ef_search": 100, "M": 3, "M0": 3}


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_exact_searches_equal_brute_force(catalog, data, metric):
    x, df = data
    catalog.create("i", "t", df, "vec", "id", metric=metric)
    q = x[3] + 0.1
    if metric == "l2sq":
        d = np.sqrt(((x - q) ** 2).sum(1))
    elif metric == "ip":
        d = -(x @ q)
    else:
        d = 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    assert [r.key for r in catalog.search("i", q, 10, exact=True).collect()] == np.argsort(d, kind="stable")[:10].tolist()
    radius = float(np.sort(d)[25] + 1e-9)
    assert {r.key for r in catalog.range("i", q, radius).collect()} == set(np.flatnonzero(d < radius).tolist())
    assert catalog.count("i") == 600
    assert catalog.recall("i", x[:5], 5) >= 0.6
    if metric == "l2sq":
        assert {r.key for r in catalog.relaxed("i", q, radius, patience=99).collect()} == set(np.flatnonzero(d < radius).tolist())
        probed = catalog._probed(catalog.get("i"), q, None, radius)
        assert len(probed) < catalog.get("i").cells  # cells were ruled out


def test_insert_delete_compact_drop(spark, catalog, data):
    _, df = data
    catalog.create("i", "t", df.filter("id < 0"), "vec", "id")
    assert catalog.count("i") == 0
    catalog.insert("i", df.filter("id < 2"))
    catalog.insert("i", df.filter("id = 2"))
    assert catalog.count("i") == 3 and catalog.contains("i", 2)
    catalog.delete("i", df.filter("id = 0").select("id"))
    assert catalog.count("i") == 2 and not catalog.contains("i", 0)
    info = catalog.info().first()
    assert (info.index_name, info["count"], info.capacity, info.dimensions) == ("i", 2, 3, 8)
    catalog.compact("i")
    info = catalog.info().first()
    assert (info["count"], info.capacity) == (2, 2)
    catalog.rename_key("i", 2, 77)
    assert catalog.contains("i", 77) and not catalog.contains("i", 2) and len(catalog.vector_of("i", 77)) == 8
    assert catalog.copy("i", "j").cells >= 1 and catalog.count("j") == 2
    catalog.drop("i")
    with pytest.raises(StatementError, match="Index i not found"):
        catalog.get("i")
    with pytest.raises(StatementError, match="Index zz not found"):
        catalog.compact("zz")


def test_statements_that_fail(spark, catalog, data):
    _, df = data
    catalog.create("i", "t", df, "vec", "id")
    with pytest.raises(StatementError, match='Index with name "i" already exists'):
        catalog.create("i", "t", df, "vec", "id")
    with pytest.raises(StatementError, match="FLOAT"):
        catalog.create("k", "t", df, "id", "vec")
    with pytest.raises(NotImplementedError, match="unique"):
        catalog.create("k", "t", df, "vec", "id", unique=True)
    for f in (catalog.merge, catalog.verify):
        with pytest.raises(NotImplementedError):
            f()
    with pytest.raises(ValueError, match="different dimensions"):
        catalog.search("i", [1.0], 3)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<float>")
    with pytest.raises(StatementError, match="different dimensions"):
        catalog.create("k", "t", mixed, "vec", "id")


def test_the_index_that_serves_a_function(catalog, data):
    _, df = data
    for m in ("ip", "cosine", "l2sq"):
        catalog.create(f"i_{m}", "t", df, "vec", "id", metric=m)
    assert [catalog.match("t", "vec", f).name for f in ("<->", "<=>", "<#>")] == ["i_l2sq", "i_cosine", "i_ip"]
    assert catalog.match("t", "other", "<->") is None


def test_setting_widens_the_search(spark, catalog, data):
    x, df = data
    catalog.create("i", "t", df, "vec", "id")
    index = catalog.get("i")
    narrow = catalog.probes(index)
    spark.conf.set(EF_SEARCH, "100000")
    try:
        assert catalog.probes(index) == index.cells > narrow
        assert catalog.recall("i", x[:3], 5) == 1.0
    finally:
        spark.conf.unset(EF_SEARCH)


def test_indexed_knn_join_over_all_cells_is_exact(catalog, data):
    x, df = data
    catalog.create("i", "t", df, "vec", "id")
    left = df.filter("id < 20 or id = 1000")
    got = knn_join_indexed(catalog, "i", left, "id", "vec", 3, cells=catalog.get("i").cells).collect()
    d = np.sqrt(((x[:20, None] - x[None]) ** 2).sum(2))
    want = {(i, int(j)) for i in range(20) for j in np.argsort(d[i], kind="stable")[:3]}
    assert {(r.id, r.key) for r in got} == want


@pytest.mark.parametrize("cells", [3, None])
def test_indexed_knn_join_makes_no_row_for_a_pair(catalog, data, cells, monkeypatch):
    from vecsql.operators import index as module

    monkeypatch.setattr(module, "BLOCK_BYTES", 4096)
    x, df = data
    catalog.create("i", "t", df, "vec", "id")
    n = cells or catalog.get("i").cells
    got = knn_join_indexed(catalog, "i", df, "id", "vec", 3, cells=n)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan or "MapInArrow" in plan
    info = catalog._centroids(catalog.get("i"))
    centroids = np.array([r.centroid for r in info])
    cell_of = {r.key: r.cell for r in catalog.rows("i").select("key", "cell").collect()}
    ids = np.array(sorted(cell_of))
    d = np.sqrt(((x[ids][:, None] - x[ids][None]) ** 2).sum(2))
    near = np.argsort(((x[ids][:, None] - centroids[None]) ** 2).sum(2), axis=1)[:, :n]
    there = (np.array([cell_of[i] for i in ids])[None, :, None] == near[:, None, :]).any(2)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.argsort(np.where(there[i], d[i], np.inf), kind="stable")[:3]}
    assert {(r.id, r.key) for r in got.collect()} == want


def test_a_deleted_key_may_come_back(spark, catalog, data):
    _, df = data
    catalog.create("i", "t", df, "vec", "id")
    catalog.delete("i", df.filter("id in (1, 2)").select("id"))
    catalog.insert("i", df.filter("id = 1"))
    assert catalog.contains("i", 1) and not catalog.contains("i", 2) and catalog.count("i") == 599
    catalog.compact("i")
    assert catalog.contains("i", 1) and not catalog.contains("i", 2) and catalog.count("i") == 599
    catalog.delete("i", df.filter("id = 1").select("id"))
    assert catalog.count("i") == 598 and catalog.isolate("i") == 1 and catalog.isolate("i") == 0 and catalog.count("i") == 598


def test_a_change_that_broke_off_does_not_count(spark, catalog, data, monkeypatch):
    _, df = data
    catalog.create("i", "t", df.filter("id < 100"), "vec", "id")
    with monkeypatch.context() as m:
        m.setattr(catalog, "_save", lambda index: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            catalog.insert("i", df.filter("id >= 100"))
    assert catalog.count("i") == 100 and sum(r.n for r in catalog._centroids(catalog.get("i"))) == 100
    catalog.insert("i", df.filter("id between 100 and 102"))
    assert catalog.count("i") == 103


def test_neighbours_some_at_a_time(catalog, data):
    x, df = data
    catalog.create("i", "t", df, "vec", "id")
    q = x[9] + 0.2
    order = np.argsort(np.sqrt(((x - q) ** 2).sum(1)), kind="stable").tolist()
    cursor, got = catalog.iterate("i", q), []
    for n in (1, 7, 30, 600):
        got += [k for k, _ in cursor.next(n)]
    assert got == order and cursor.next(5) == []
    cursor = catalog.iterate("i", q)
    cursor.close()
    assert cursor.next() == []


def test_weighted_search_over_several_indexes(spark, catalog, data):
    x, df = data
    y = np.random.default_rng(4).normal(size=(600, 3))
    catalog.create("a", "t", df, "vec", "id")
    catalog.create("b", "t", spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, w array<double>"), "w", "id")
    p, q = x[4] + 0.1, y[8]
    score = 0.3 * ((x - p) ** 2).sum(1) + 2.0 * ((y - q) ** 2).sum(1)
    got = catalog.weighted([(0.3, "a", p.tolist()), (2.0, "b", q.tolist())], 5, wave=40)
    assert [k for k, _ in got] == np.argsort(score, kind="stable")[:5].tolist()
    assert len(catalog.weighted([(1.0, "a", p.tolist())], 3, wave=2, limit=2)) == 2
    with pytest.raises(ValueError, match="weights"):
        catalog.weighted([(-1.0, "a", p.tolist())], 3)


def test_relaxed_reads_a_few_cells(catalog, data):
    x, df = data
    catalog.create("i", "t", df, "vec", "id", cells=20)
    read = []
    rows = catalog.rows
    catalog.rows = lambda name, cells=None: (read.append(len(cells)), rows(name, cells))[1]
    found = {r.key for r in catalog.relaxed("i", x[3], 0.5, patience=2).collect()}
    assert found <= set(np.flatnonzero(np.sqrt(((x - x[3]) ** 2).sum(1)) < 0.5).tolist()) and 3 in found and max(read) < 20


def test_clusters_forks_and_saved_indexes(spark, catalog, data, tmp_path):
    x, df = data
    catalog.create("i", "t", df, "vec", "id")
    cells = catalog.clusters("i")
    assert cells.count() == 600 and cells.select("cluster").distinct().count() <= catalog.get("i").cells
    assert catalog.clusters("i", 3).select("cluster").distinct().count() == 3
    cell = {r.key: r.cluster for r in cells.collect()}
    assert catalog.nearest_cluster("i", x[5]) == cell[5]
    catalog.fork("i", "f")
    assert catalog.count("f") == 0 and catalog.get("f").cells == catalog.get("i").cells
    catalog.insert("f", df.filter("id < 4"))
    assert catalog.count("f") == 4
    at = f"file://{tmp_path}/saved"
    catalog.save("i", at)
    assert catalog.peek(at)["dimensions"] == 8
    catalog.view(at, "v")
    catalog.load(at, "l")
    q = (x[7] + 0.1).tolist()
    want = [r.key for r in catalog.search("i", q, 5, exact=True).collect()]
    catalog.drop("i")
    for name in ("v", "l"):
        assert [r.key for r in catalog.search(name, q, 5, exact=True).collect()] == want
    catalog.drop("v")
    assert catalog.peek(at)["dimensions"] == 8
    with pytest.raises(StatementError, match="not found"):
        catalog.peek(f"file://{tmp_path}/none")


def test_estimates_without_reading_rows(spark, catalog, data):
    _, df = data
    catalog.create("i", "t", df, "vec", "id")
    assert (catalog.estimate("i", 10), catalog.estimate("i", 10_000), catalog.estimate("i", ef=True)) == (10, 600, 64)


def test_indexes_in_folders_can_be_forbidden(spark, catalog, data):
    from vecsql.operators.index import PERSISTENCE

    _, df = data
    spark.conf.set(PERSISTENCE, "false")
    try:
        with pytest.raises(StatementError, match="in-memory databases"):
            catalog.create("i", "t", df, "vec", "id")
    finally:
        spark.conf.unset(PERSISTENCE)


def test_hints_name_the_index(catalog, data):
    _, df = data
    catalog.create("a", "t", df, "vec", "id")
    catalog.create("b", "t", df, "vec", "id")
    assert catalog.match("t", "vec", "<->", "b").name == "b"
    with pytest.raises(StatementError, match="does not serve"):
        catalog.match("t", "vec", "<=>", "b")


def test_a_search_as_wide_as_a_large_table(spark, tmp_path):
    from vecsql import catalog as queries

    vectors = F.array((F.col("id") % 317).cast("float"), (F.col("id") % 331).cast("float"))
    spark.range(100_003).select(F.col("id").alias("vec_id"), vectors.alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["x09_search_setting"](spark, str(tmp_path)).collect() == [(True, 100_003)]
