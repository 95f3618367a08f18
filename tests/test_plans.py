import json
import struct
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsql.operators.index import Catalog, StatementError
from vecsql.plans import estimate, planner, sqlfront, tpcds, tpch
from vecsql.plans.estimate import State, States, q_error
from vecsql.schema import derived, needed, query_vector, vector_field, views, with_clause
from vecsql.sources import loaders

SF = "/root/testdata/sf0.001"


# estimates


def test_update_rule_by_hand():
    s = State("t", "v", 385.0)
    errors = [1.0 + 0.1 * (i % 10) for i in range(50)]
    for e in errors:
        s.learn(e, 10_000, cycle=50)
    gradient = 50 * (median(errors) - 1.5) - 50 * 385 / 10_000
    assert s.v_grad == pytest.approx(0.1 * gradient) and s.learning_rate == pytest.approx(0.099)
    assert s.sample_size == pytest.approx(385 + 0.1 * gradient) and s.recent_qerrors == [] and s.qerror_count == 50
    first = s.v_grad
    for _ in range(50):
        s.learn(8.0, 10_000, cycle=50)
    again = 50 * 6.5 - 50 * (385 + first) / 10_000
    assert s.v_grad == pytest.approx(0.9 * first + 0.099 * again)


def test_sample_size_stays_within_the_table():
    s = State("t", "v", 385.0)
    for _ in range(400):
        s.learn(1000.0, 500, cycle=1)
        assert 1 <= s.sample_size <= 500
    for _ in range(800):
        s.learn(1.0, 500, cycle=1)
        assert 1 <= s.sample_size <= 500
    still = State("t", "v", 385.0)
    still.learn(9.0, 500, cycle=1, update=False)
    assert still.sample_size == 385


def test_q_error():
    assert [q_error(10, 5), q_error(5, 10), q_error(0, 0), q_error(0.2, 4)] == [2, 2, 1, 4]


def test_states_are_kept(spark, tmp_path):
    path = str(tmp_path / "states.json")
    states = States(path)
    states.get(spark, "t", "v").learn(3.0, 100)
    states.save()
    assert States(path).get(spark, "t", "v").recent_qerrors == [3.0]


@pytest.mark.parametrize(("name", "text"), [("vecsql.sample_size", "0"), ("vecsql.sample_update_cycle", "0"), ("vecsql.sample_update_cycle", "1001")])
def test_setting_ranges(spark, name, text):
    spark.conf.set(name, text)
    try:
        with pytest.raises(ValueError, match="must be"):
            estimate.setting(spark, name)
    finally:
        spark.conf.unset(name)
    assert estimate.setting(spark, "vecsql.sample_size") == 385


def test_sampled_and_observed(spark):
    df = spark.range(10_000).withColumn("x", F.col("id") % 10)
    state = State("t", "x", 2000.0)
    assert q_error(estimate.sampled(df, F.col("x") < 3, state, 10_000), 3000) < 1.3
    assert estimate.sampled(df, F.col("x") > 99, state, 10_000) == 5.0  # none found counts as one
    seen, rows = estimate.observed(df.filter("x < 3"))
    seen.count()
    assert rows.get["rows"] == 3000


# planner


@pytest.fixture(scope="module")
def suite(spark):
    return tpch.Suite(spark, SF)


def test_probe_counts_and_starts_small(spark, suite):
    query = suite.describe(
        {"c": ("customer", ["c_custkey"]), "o": ("orders", ["o_orderkey", "o_custkey"]), "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]), "ps": ("partsupp", ["ps_partkey", "ps_suppkey"])},
        [planner.Join("c", "o", (("c_custkey", "o_custkey"),)), planner.Join("l", "o", (("l_orderkey", "o_orderkey"),)), planner.Join("l", "ps", (("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")))],
    )
    plan = planner.plan(query)
    assert plan.vector_rows == 224 and plan.order[0] == "ps" and plan.broadcast and "ps: about 224 rows" in plan.explain()
    text = plan.frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "InMemoryTableScan" in text  # the probe's rows are what the query reads
    off = planner.plan(query, "off")
    assert off.order == ["c", "o", "l", "ps"] and off.frame.count() == plan.frame.count() == planner.plan(query, "sample").frame.count()


def test_two_relations_are_no_vector_query(suite):
    query = suite.describe({"ps": ("partsupp", ["ps_suppkey"]), "s": ("supplier", ["s_suppkey"])}, [planner.Join("ps", "s", (("ps_suppkey", "s_suppkey"),))])
    assert not query.is_vector_query() and planner.plan(query).vector_rows is None


def test_left_joins_stay_behind_their_left_side(spark):
    a = spark.createDataFrame([(1, 1, [0.0]), (2, 2, [0.0])], "a int, k int, v array<double>")
    b = spark.createDataFrame([(1, 5)], "b int, c int")
    c = spark.createDataFrame([(5,), (6,)], "d int")
    query = planner.VectorQuery({"a": a, "b": b, "c": c}, [planner.Join("a", "b", (("k", "b"),), "left"), planner.Join("b", "c", (("c", "d"),), "left")], planner.VectorPredicate("a", "v", (0.0,), 1.0))
    got = planner.plan(query).frame.collect()
    assert sorted((r.a, r.b, r.d) for r in got) == [(1, 1, 5), (2, None, None)]


@pytest.mark.parametrize(("compare", "n"), [("<", 1), ("<=", 2), (">", 1), (">=", 2)])
def test_each_comparison(spark, compare, n):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [2.0])], "id int, v array<double>")
    p = planner.VectorPredicate("a", "v", (0.0,), 1.0, compare=compare)
    assert planner.plan(planner.VectorQuery({"a": df}, [], p)).frame.count() == n


def test_all_modes_agree(spark, suite):
    off = tpch.Suite(spark, SF, suite.query, mode="off")
    for name in ("q3", "q10", "q12", "q18", "q8", "q9"):
        assert sorted(map(str, getattr(suite, name)().collect())) == sorted(map(str, getattr(off, name)().collect())), name


def test_feedback(spark, suite):
    states = States()
    query = suite.describe({"ps": ("partsupp", ["ps_suppkey"])}, [])
    assert planner.feedback(states, query, 100, 50, 1000) == 2
    assert states.states[("ps", "ps_embedding")].recent_qerrors == [2]


def test_an_index_is_counted_and_read(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/indexes")
    catalog.create("it", "item", derived(spark, SF, "item"), "i_embedding", "i_item_sk")
    scanned = tpcds.planned(spark, SF, "q98")
    for mode in ("probe", "sample", "off"):
        found = tpcds.planned(spark, SF, "q98", mode=mode, catalog=catalog)
        assert found.index == "it" and (mode == "off" or "vector side, index it" in found.explain())
        assert sorted(map(str, found.frame.select("i.i_item_id", "d.d_date").collect())) == sorted(map(str, scanned.frame.select("i.i_item_id", "d.d_date").collect()))
    assert found.vector_rows is None and scanned.index is None and scanned.vector_rows == tpcds.planned(spark, SF, "q98", catalog=catalog).vector_rows
    query = tpcds.describe(spark, SF, "q98")
    with pytest.raises(StatementError, match="not found"):
        planner.plan(query, catalog=catalog, index="other")


def test_rows_of_a_limit(spark):
    a = spark.createDataFrame([(i, i % 5, [float(i)]) for i in range(50)], "id int, k int, v array<double>")
    b = spark.createDataFrame([(i, i) for i in range(5)], "b int, c int")
    c = spark.createDataFrame([(i,) for i in range(5)], "d int")
    joins = [planner.Join("a", "b", (("k", "b"),)), planner.Join("b", "c", (("c", "d"),))]
    query = planner.VectorQuery({"a": a, "b": b, "c": c}, joins, planner.VectorPredicate("a", "v", (0.0,), None, key="id", k=7))
    for mode in ("probe", "sample"):
        found = planner.plan(query, mode)
        assert found.vector_rows == 7 and sorted(r.id for r in found.frame.collect()) == list(range(7))


def test_estimates_are_learned_from(spark, suite):
    states = States()
    found = planner.plan(tpcds.describe(spark, SF, "q42"), "sample", states)
    found.collect()
    state = states.states[("i", "i_embedding")]
    true = planner.plan(tpcds.describe(spark, SF, "q42")).vector_rows
    assert state.recent_qerrors == [q_error(found.vector_rows, true)]
    probed = planner.plan(tpcds.describe(spark, SF, "q42"))
    assert probed.learn() is None
    probed.release()
    assert not probed.kept.is_cached


def test_descriptions_as_sql():
    text = tpcds.duckdb_sql("q72")
    assert "LEFT JOIN catalog_returns back ON sale.cs_item_sk = back.cr_item_sk AND sale.cs_order_number = back.cr_order_number" in text
    assert "shipped.d_date > sold.d_date" in text


# SQL front end


@pytest.fixture
def star(spark):
    views(spark, SF, "item", "date_dim", "catalog_sales", "promotion", "catalog_returns")
    return str(query_vector(spark, SF))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT i_item_id, d.d_year FROM catalog_sales cs, item i, date_dim AS d WHERE cs_item_sk = i_item_sk AND cs.cs_sold_date_sk = d.d_date_sk AND i_embedding <-> {q} < 1.25 AND d_year BETWEEN 1995 AND 1996",
        "select d.d_year as y, count(*) as n, min(i.i_embedding <-> {q}) as least from catalog_sales cs join item i on cs_item_sk = i.i_item_sk join date_dim d on cs_sold_date_sk = d_date_sk "
        "where i.i_embedding <-> {q} <= 1.25 and i_category <> 'it''s and' group by d.d_year having count(*) > 1 order by n desc, y limit 3",
        "SELECT i.i_item_id, p_promo_sk, cr_order_number, cs_quantity + 1 AS q FROM catalog_sales cs JOIN item i ON cs.cs_item_sk = i.i_item_sk LEFT JOIN promotion p ON cs_promo_sk = p.p_promo_sk "
        "LEFT OUTER JOIN catalog_returns cr ON cr_item_sk = cs_item_sk AND cr.cr_order_number = cs.cs_order_number WHERE i.i_embedding <<->> [1.44, {bare}] AND cs_quantity > i_manager_id * 5",
        "SELECT a.d_year, b.d_moy, i.* FROM catalog_sales, item i, date_dim a, date_dim b WHERE cs_item_sk = i.i_item_sk AND cs_sold_date_sk = a.d_date_sk AND cs_ship_date_sk = b.d_date_sk AND b.d_date > a.d_date AND array_distance(i.i_embedding, {q}) < 1.2",
    ],
)
def test_planned_statements_give_what_catalyst_gives(spark, star, text):
    text = text.replace("{q}", f"'{star}'").replace("{bare}", star[1:-1])
    found, how = sqlfront.planned(spark, text)
    plain = spark.sql(sqlfront.rewrite(text))
    assert how.order[0] in ("i", "cs", "catalog_sales") and how.vector_rows is not None
    assert found.columns == plain.columns
    got, want = (sorted(map(str, df.collect())) for df in (found, plain))
    assert got == want and got
    assert sorted(map(str, sqlfront.run(spark, text).collect())) == want


def test_statements_that_are_left_to_catalyst(spark, star):
    two = f"SELECT i_item_id FROM item i, catalog_sales WHERE cs_item_sk = i_item_sk AND i_embedding <-> '{star}' < 1.2"
    assert sqlfront.relations_of(spark, two) == 2 and sqlfront.planned(spark, two) is None and sqlfront.run(spark, two).count() > 0
    nested = f"SELECT count(*) AS n FROM item WHERE i_embedding <-> '{star}' < 1.2 AND i_item_sk IN (SELECT cs_item_sk FROM catalog_sales, date_dim WHERE cs_sold_date_sk = d_date_sk)"
    assert sqlfront.is_vector_query(spark, nested) and sqlfront.describe(spark, nested) is None and sqlfront.run(spark, nested).first().n > 0
    assert not sqlfront.is_vector_query(spark, "SELECT 1 FROM item, date_dim, promotion WHERE i_category = 'a <-> b < 3'")


def test_hints_in_text(spark, star, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/indexes")
    for name in ("one", "two"):
        catalog.create(name, "item", derived(spark, SF, "item"), "i_embedding", "i_item_sk")
    text = f"SELECT /*+ indexscan(item two) */ i_item_id FROM catalog_sales, item, date_dim WHERE cs_item_sk = i_item_sk AND cs_sold_date_sk = d_date_sk AND i_embedding <-> '{star}' < 1.25"
    found, how = sqlfront.planned(spark, text, catalog=catalog, key="i_item_sk")
    assert how.index == "two" and sorted(map(str, found.collect())) == sorted(map(str, spark.sql(sqlfront.rewrite(sqlfront._HINT.sub("", text))).collect()))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0], [0.0, 0.0]), (2, [0.0, 2.0], [1.0, 1.0]), (3, None, [5.0, 5.0])]
    spark.createDataFrame(rows, "id int, v array<float>, w array<float>").createOrReplaceTempView("front")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("v <-> '[1, 0]'", [0.0, 5**0.5, None]),
        ("'[1, 0]'::vector(2) <-> v", [0.0, 5**0.5, None]),
        ("v <#> array[1.0, 2]", [-1.0, -4.0, None]),
        ("v <+> [1, 1]", [1.0, 2.0, None]),
        ("v <=> '[2, 0]'", [0.0, 1.0, None]),
        ("1.0 - array_cosine_similarity(v, [2, 0])", [0.0, 1.0, None]),
        ("v <-> w", [1.0, 2**0.5, None]),
        ("array_inner_product(v, [1, 2])", [1.0, 4.0, None]),
    ],
)
def test_operators(spark, vectors, text, want):
    got = [r.x for r in sqlfront.run(spark, f"SELECT {text} AS x FROM front ORDER BY id").collect()]
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_null_safe_equality_is_left_alone(spark, vectors):
    assert sqlfront.rewrite("SELECT a <=> b FROM t WHERE c <=> 'x'") == "SELECT a <=> b FROM t WHERE c <=> 'x'"


def test_range_operators_and_sums(spark, vectors):
    assert [r.id for r in sqlfront.run(spark, "SELECT id FROM front WHERE v <<->> '{4.5, 1, 0}'").collect()] == [1]
    assert [r.id for r in sqlfront.run(spark, "SELECT id FROM front WHERE v <<*>> [-2, 1, 2]").collect()] == [2]
    q = "select id from front where id < 9 order by approximate_sum('0.9 * v <-> {0, 2} + 0.1 * w <-> {0, 0}') limit 2"
    assert [r.id for r in sqlfront.run(spark, q).collect()] == [2, 1]
    with pytest.raises(ValueError, match="approximate_sum"):
        sqlfront.run(spark, "select id from front order by approximate_sum('v') limit 2")


# loaders


@pytest.mark.parametrize(("kind", "split"), [("fbin", 32 << 20), ("fbin", 40), ("u8bin", 32 << 20)])
def test_vector_files(spark, tmp_path, monkeypatch, kind, split):
    monkeypatch.setattr(loaders, "SPLIT_BYTES", split)
    x = np.arange(15).reshape(5, 3).astype(np.dtype(loaders.VECTOR_FILES[kind]))
    path = str(tmp_path / f"x.{kind}")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", 5, 3) + x.tobytes())
    got = {r.ordinal: list(r.vector) for r in loaders.read_vectors(spark, path).collect()}
    assert got == {i: x[i].astype(float).tolist() for i in range(5)}
    part = loaders.read_vectors(spark, path, first=1, count=2, scale=0.5).collect()
    assert {r.ordinal: list(r.vector) for r in part} == {1: (x[1] / 2).tolist(), 2: (x[2] / 2).tolist()}
    assert loaders.read_vectors(spark, path, first=9).count() == 0
    loaders.write_vectors(loaders.read_vectors(spark, path), "vector", "ordinal", str(tmp_path / f"y.{kind}"), kind)
    assert (tmp_path / f"y.{kind}").read_bytes() == open(path, "rb").read()


def test_delimited(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a|2.5|\n2||3.5|\n")
    got = loaders.read_delimited(spark, str(tmp_path / "t.tbl"), "k int, name string, x double")
    assert [tuple(r) for r in got.collect()] == [(1, "a", 2.5), (2, None, 3.5)]
    assert loaders.read_delimited(spark, str(tmp_path / "t.tbl"), "k int, name string, x double", columns=1).columns == ["k"]


def test_zip_and_tags(spark, tmp_path):
    table = spark.createDataFrame([(k,) for k in (5, 3, 9)], "k int")
    vectors = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "ordinal long, vector array<float>")
    got = {r.k: r.v for r in loaders.zip_rows(table, vectors, ["k"], "v").collect()}
    assert got == {3: [0.0], 5: [1.0], 9: None}
    (tmp_path / "a.json").write_text(json.dumps([[1, 2], [], [3]]))
    (tmp_path / "b.jsonl").write_text("[1, 2]\n[]\n[3]\n")
    for name in ("a.json", "b.jsonl"):
        tags = loaders.read_tags(spark, str(tmp_path / name))
        assert {r.ordinal: r.tags for r in tags.collect()} == {0: [1, 2], 1: [], 2: [3]}
    numbered = spark.range(2).select(F.col("id").alias("ordinal")).union(spark.createDataFrame([(7,)], "ordinal long"))
    assert {r.ordinal: r.tags for r in loaders.attach_tags(numbered, tags).collect()} == {0: [1, 2], 1: [], 7: []}


def test_sparse_matrices(spark, tmp_path):
    dense = np.array([[0, 2.0, 0, 1], [0, 0, 0, 0], [3, 0, 0.5, 0]])
    r, c = np.nonzero(dense)
    indptr, data = np.array([0, 2, 2, 4]), dense[r, c]
    np.savez(tmp_path / "m.npz", indptr=indptr, indices=c, data=data, shape=dense.shape, format=b"csr")
    np.save(tmp_path / "m.npy", dense)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 4 4\n1 2 2.0\n1 4 1.0\n3 1 3.0\n3 3 0.5\n")
    (tmp_path / "m.spmat").write_bytes(np.array([3, 4, 4], "<i8").tobytes() + indptr.astype("<i8").tobytes() + c.astype("<i4").tobytes() + data.astype("<f4").tobytes())
    for name in ("m.npz", "m.npy", "m.mtx", "m.spmat"):
        entries, shape = loaders.read_sparse(spark, str(tmp_path / name))
        assert tuple(shape) == (3, 4), name
        lists = {x.row: x.indices for x in loaders.index_lists(entries, rows=3, threshold=0.7).collect()}
        assert lists == {0: [1, 3], 1: [], 2: [0]}, name
    lists = loaders.index_lists(entries, rows=3)
    for kind in ("jsonl", "tsv"):
        loaders.write_lists(lists.coalesce(1), str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).count() == 3
    loaders.write_lists(lists, str(tmp_path / "l.json"), "json")
    assert json.loads((tmp_path / "l.json").read_text()) == [[1, 3], [], [0, 2]]
    with pytest.raises(ValueError, match="unknown kind"):
        loaders.write_lists(lists, "x", "xml")


def test_schema_helpers():
    assert vector_field("v", 3).metadata == {"vector_dim": 3}
    assert needed(("inventory",)) == ["partsupp", "date_dim", "inventory"]
    assert with_clause(("item",)).startswith("WITH item AS")
