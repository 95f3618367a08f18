"""Every query of the library by name, with SQL that DuckDB answers alike where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsql.functions import distance as D
from vecsql.operators import search
from vecsql.operators.index import EF_SEARCH, Catalog, knn_join_indexed
from vecsql.plans import sqlfront, tpcds, tpch
from vecsql.plans.estimate import State, States, probe, q_error, sampled, setting
from vecsql.plans.planner import plan
from vecsql.schema import derived, query_vector, table, views, with_clause
from vecsql.sources import loaders
from vecsql.storage import remember, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
Q1 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)"


def query(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return keep


# distances of every embedding to the first


def _total(term: str) -> str:
    """DuckDB: the sum of a term of a[i] and b[i] over the dimensions."""
    return f"list_sum(list_transform(range(1, len(a) + 1), lambda i: {term}))"


_KNOWN = {
    "d01_array_distance": ("array_distance", f"sqrt({_total('(a[i] - b[i]) * (a[i] - b[i])')})"),
    "d02_l2sq": ("l2sq", _total("(a[i] - b[i]) * (a[i] - b[i])")),
    "d03_cosine_distance": ("array_cosine_distance", f"1 - {_total('a[i] * b[i]')} / (sqrt({_total('a[i] * a[i]')}) * sqrt({_total('b[i] * b[i]')}))"),
    "d04_cosine_similarity": ("array_cosine_similarity", f"{_total('a[i] * b[i]')} / (sqrt({_total('a[i] * a[i]')}) * sqrt({_total('b[i] * b[i]')}))"),
    "d05_inner_product": ("array_inner_product", _total("a[i] * b[i]")),
    "d06_negative_inner_product": ("array_negative_inner_product", f"-{_total('a[i] * b[i]')}"),
    "d07_ip": ("ip", f"1 - {_total('a[i] * b[i]')}"),
    "d08_l1": ("l1", _total("abs(a[i] - b[i])")),
    "d15_pearson": (
        "pearson",
        f"1 - (64 * {_total('a[i] * b[i]')} - {_total('a[i]')} * {_total('b[i]')}) / sqrt((64 * {_total('a[i] * a[i]')} - {_total('a[i]')} ** 2) * (64 * {_total('b[i] * b[i]')} - {_total('b[i]')} ** 2))",
    ),
}


def _to_first(function: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = query_vector(spark, sf_dir)
        return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(D.distance(function, "embedding", q), 6) + F.lit(0.0)).alias("value"))

    return run


def _pairs(expression: str) -> str:
    return f"SELECT vec_id, round({expression}, 6) + 0.0::DOUBLE AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS a, {Q} AS b FROM embeddings)"


for _name, (_function, _sql) in _KNOWN.items():
    query(_name, _pairs(_sql))(_to_first(_function))


def _prepared(prepare: Callable, function: str) -> Query:
    """Of both vectors after a preparation; the second is the first row's, joined as one row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", prepare(F.col("embedding")).alias("a"))
        first = rows.filter("vec_id = 0").select(F.col("a").alias("b"))
        return rows.join(F.broadcast(first)).select("vec_id", (F.round(D.distance(function, F.col("a"), F.col("b")).cast("double"), 6) + F.lit(0.0)).alias("value"))

    return run


_BOTH, _EITHER = "CASE WHEN a[i] > 0 AND b[i] > 0 THEN 1 ELSE 0 END", "CASE WHEN a[i] > 0 OR b[i] > 0 THEN 1 ELSE 0 END"
_COUNT = "CASE WHEN a[i] > 0 THEN 1 ELSE 0 END", "CASE WHEN b[i] > 0 THEN 1 ELSE 0 END"
query("d11_hamming", _pairs(f"({_total(_EITHER)} - {_total(_BOTH)})::DOUBLE"))(_prepared(D.to_bits, "hamming"))
query("d12_tanimoto", _pairs(f"1 - {_total(_BOTH)}::DOUBLE / {_total(_EITHER)}"))(_prepared(D.to_bits, "tanimoto"))
query("d13_sorensen", _pairs(f"1 - 2 * {_total(_BOTH)}::DOUBLE / ({_total(_COUNT[0])} + {_total(_COUNT[1])})"))(_prepared(D.to_bits, "sorensen"))


def _ids(v):
    """The dimensions with a positive component."""
    return F.filter(F.transform(v, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


query("d14_jaccard", _pairs(f"1 - {_total(_BOTH)}::DOUBLE / {_total(_EITHER)}"))(_prepared(_ids, "jaccard"))


def _probabilities(v):
    total = F.aggregate(F.transform(v, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.transform(v, lambda x: F.abs(x.cast("double")) / total)


_P = "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x) / list_sum(list_transform(embedding::DOUBLE[], lambda y: abs(y)))) AS p FROM embeddings)"


def _of_probabilities(expression: str) -> str:
    return f"WITH w AS {_P} SELECT vec_id, round({expression}, 6) + 0.0::DOUBLE AS value FROM (SELECT vec_id, p AS a, (SELECT p FROM w WHERE vec_id = 0) AS b FROM w)"


query("d16_jensen_shannon", _of_probabilities(_total("(a[i] * ln((a[i] + 1e-9) / ((a[i] + b[i]) / 2 + 1e-9)) + b[i] * ln((b[i] + 1e-9) / ((a[i] + b[i]) / 2 + 1e-9))) / 2")))(_prepared(_probabilities, "jensen_shannon"))
query("d17_kullback_leibler", _of_probabilities(_total("a[i] * ln((a[i] + 1e-9) / (b[i] + 1e-9))")))(_prepared(_probabilities, "kullback_leibler"))
query(
    "d18_haversine",
    _pairs("2 * asin(sqrt(sin(radians(90 * b[1] - 90 * a[1]) / 2) ** 2 + cos(radians(90 * a[1])) * cos(radians(90 * b[1])) * sin(radians(180 * b[2] - 180 * a[2]) / 2) ** 2))"),
)(_prepared(lambda v: F.array(v[0].cast("double") * 90, v[1].cast("double") * 180), "haversine"))

_I8 = "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: greatest(least(round(x * 100), 100), -100)::INT) AS p FROM embeddings)"


def _of_i8(expression: str) -> str:
    return f"WITH w AS {_I8} SELECT vec_id, round({expression}, 6) + 0.0::DOUBLE AS value FROM (SELECT vec_id, p AS a, (SELECT p FROM w WHERE vec_id = 0) AS b FROM w)"


query("d19_l2sq_i8", _of_i8(f"{_total('(a[i] - b[i]) * (a[i] - b[i])')}::DOUBLE"))(_prepared(D.quantize_i8, "l2sq_i8"))
query("d19_cosine_i8", _of_i8(f"CASE WHEN {_total('a[i] * b[i]')} = 0 THEN 0 ELSE 1 - {_total('a[i] * b[i]')} / (sqrt({_total('a[i] * a[i]')}) * sqrt({_total('b[i] * b[i]')})) END"))(_prepared(D.quantize_i8, "cosine_i8"))


@query("d09_range_operand", f"SELECT vec_id, round(d, 6) AS dist FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {Q}) ** 2 AS d FROM embeddings) WHERE d < 1.69")
def d09(spark, sf_dir):
    df = search.range_by_operand(table(spark, sf_dir, "embeddings"), "embedding", [1.69, *query_vector(spark, sf_dir)])
    return df.select("vec_id", F.round("dist", 6).alias("dist"))


@query("d10_range_operand_ip", f"SELECT vec_id, round(d, 6) + 0.0::DOUBLE AS dist FROM (SELECT vec_id, 1 - list_inner_product(embedding::DOUBLE[], {Q}) AS d FROM embeddings) WHERE d < 0.845")
def d10(spark, sf_dir):
    df = search.range_by_operand(table(spark, sf_dir, "embeddings"), "embedding", [0.845, *query_vector(spark, sf_dir)], "ip")
    return df.select("vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


@query("d20_casts", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding)::INT AS dims FROM embeddings")
def d20(spark, sf_dir):
    v = D.vector("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size(v).alias("dims"))


# searches



def _over_partsupp(sql: str) -> str:
    return f"{with_clause(('partsupp',))}, ps AS (SELECT *, list_distance(ps_embedding::DOUBLE[], {Q}) AS d FROM partsupp) {sql}"


@query("t01_top_k", _over_partsupp("SELECT ps_partkey * 1000000 + ps_suppkey AS id, round(d, 6) AS dist FROM ps ORDER BY d, id LIMIT 100"))
def t01(spark, sf_dir):
    ps = derived(spark, sf_dir, "partsupp").withColumn("id", F.col("ps_partkey") * 1000000 + F.col("ps_suppkey"))
    return search.top_k(ps, "ps_embedding", query_vector(spark, sf_dir), 100, "id").select("id", F.round("dist", 6).alias("dist"))


@query("t02_min_by_k", f"SELECT array_to_string(list(vec_id ORDER BY d, vec_id), ',') AS ids FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {Q}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 5)")
def t02(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = search.min_by_k(e, "vec_id", D.euclidean("embedding", query_vector(spark, sf_dir)), 5)
    return out.select(F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@query(
    "t02_min_by_k_grouped",
    f"""SELECT label, array_to_string(list(vec_id ORDER BY d, vec_id), ',') AS ids FROM (
      SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS n FROM (SELECT label, vec_id, list_distance(embedding::DOUBLE[], {Q}) AS d FROM embeddings)) WHERE n <= 3 GROUP BY label""",
)
def t02_grouped(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = search.min_by_k(e, "vec_id", D.euclidean("embedding", query_vector(spark, sf_dir)), 3, ["label"])
    return out.select("label", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@query("t03_range", _over_partsupp("SELECT ps_partkey, ps_suppkey, round(d, 6) AS dist FROM ps WHERE d < 1.3"))
def t03(spark, sf_dir):
    found = search.range_search(derived(spark, sf_dir, "partsupp"), "ps_embedding", query_vector(spark, sf_dir), 1.3)
    return found.select("ps_partkey", "ps_suppkey", F.round("dist", 6).alias("dist"))


_TWO = f"{with_clause(('item', 'partsupp'))}"


@query(
    "t04_weighted_top_k",
    f"""{_TWO} SELECT ps_partkey * 1000000 + ps_suppkey AS id,
      round(0.7 * list_distance(ps_embedding::DOUBLE[], {Q}) ** 2 + 0.3 * list_distance(i_embedding::DOUBLE[], {Q1}) ** 2, 6) AS score
      FROM partsupp JOIN item ON i_item_sk = ps_partkey
      ORDER BY 0.7 * list_distance(ps_embedding::DOUBLE[], {Q}) ** 2 + 0.3 * list_distance(i_embedding::DOUBLE[], {Q1}) ** 2, id LIMIT 50""",
)
def t04(spark, sf_dir):
    both = derived(spark, sf_dir, "partsupp").join(derived(spark, sf_dir, "item"), F.col("i_item_sk") == F.col("ps_partkey"))
    both = both.withColumn("id", F.col("ps_partkey") * 1000000 + F.col("ps_suppkey"))
    terms = [(0.7, "ps_embedding", query_vector(spark, sf_dir, 0)), (0.3, "i_embedding", query_vector(spark, sf_dir, 1))]
    # the score is rounded only for show; equal scores go by id on both sides
    return search.weighted_top_k(both, terms, 50, "id").select("id", F.round("score", 6).alias("score"))


def _knn(k: int, order: str = "list_distance(l.embedding::DOUBLE[], r.embedding::DOUBLE[])", tie: str = "r.vec_id") -> str:
    return f"""SELECT l.vec_id AS left_id, r.vec_id AS right_id, {order} AS d, row_number() OVER (PARTITION BY l.vec_id ORDER BY {order}, {tie}) AS n
      FROM embeddings l, embeddings r QUALIFY n <= {k}"""


def _self_join(spark, sf_dir, k, function="array_distance", **options):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.knn_join(e, e, "vec_id", "embedding", "vec_id", "embedding", k, function, **options).toDF("left_id", "right_id", "dist", "rank")


@query("t05_knn_join", f"SELECT left_id, right_id, round(d, 6) AS dist, n::INT AS rank FROM ({_knn(3)})")
def t05(spark, sf_dir):
    return _self_join(spark, sf_dir, 3).select("left_id", "right_id", F.round("dist", 6).alias("dist"), "rank")


@query("t05_knn_join_blocks", f"SELECT left_id, right_id, round(d, 6) AS dist, n::INT AS rank FROM ({_knn(2)})")
def t05_blocks(spark, sf_dir):
    return _self_join(spark, sf_dir, 2, broadcast_bytes=0).select("left_id", "right_id", F.round("dist", 6).alias("dist"), "rank")


_COS = "list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[])"
_DOT = "list_inner_product(l.embedding::DOUBLE[], r.embedding::DOUBLE[])"
for _metric, _order, _show in (("l2sq", "list_distance(l.embedding::DOUBLE[], r.embedding::DOUBLE[])", "d"), ("cosine", f"-{_COS}", "-d"), ("ip", f"-{_DOT}", "-d")):

    def _vss(spark, sf_dir, metric=_metric):
        e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        out = search.vss_join(e, e, "embedding", "embedding", 2, metric, "vec_id", "vec_id")
        return out.select((F.round("score", 5) + F.lit(0.0)).alias("score"), F.col("left_tbl.vec_id").alias("left_id"), F.col("right_tbl.vec_id").alias("right_id"))

    query(f"t06_vss_join_{_metric}", f"SELECT round({_show}, 5) + 0.0::DOUBLE AS score, left_id, right_id FROM ({_knn(2, _order)})")(_vss)


@query("t07_vss_match", f"SELECT left_id, array_to_string(list(right_id ORDER BY n), ',') AS matches FROM ({_knn(3)}) GROUP BY left_id")
def t07(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = search.vss_match(e, e, "embedding", "embedding", 3, "l2sq", "vec_id", "vec_id")
    return out.select(F.col("vec_id").alias("left_id"), F.array_join(F.transform("matches", lambda m: m["row"]["vec_id"].cast("string")), ",").alias("matches"))


@query("t08_grouped_neighbours", f"SELECT left_id, array_to_string(list(right_id ORDER BY d, right_id), ',') AS neighbours, count(*) AS n FROM ({_knn(3)}) GROUP BY left_id")
def t08(spark, sf_dir):
    near = _self_join(spark, sf_dir, 3).groupBy("left_id")
    listed = near.agg(F.sort_array(F.collect_list(F.struct("dist", "right_id"))).alias("m"), F.count("*").alias("n"))
    return listed.select("left_id", F.array_join(F.transform("m", lambda m: m["right_id"].cast("string")), ",").alias("neighbours"), "n")


@query("t10_exact_many", f"SELECT left_id, right_id, round(d, 6) + 0.0::DOUBLE AS dist FROM ({_knn(5, f'(1 - {_COS})')})")
def t10(spark, sf_dir):
    return _self_join(spark, sf_dir, 5, "array_cosine_distance").select("left_id", "right_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


@query("t11_filtered_top_k", f"SELECT vec_id, round(d, 6) AS dist FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {Q}) AS d FROM embeddings WHERE label = 3 ORDER BY d, vec_id LIMIT 20)")
def t11(spark, sf_dir):
    out = search.top_k(table(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 20, "vec_id", where=F.col("label") == 3)
    return out.select("vec_id", F.round("dist", 6).alias("dist"))


@query(
    "t13_mutual_matches",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label < 5 AS low FROM embeddings),
      p AS (SELECT l.vec_id AS a, r.vec_id AS b, list_distance(l.v, r.v) AS d FROM e l, e r WHERE l.low AND NOT r.low),
      x AS (SELECT a, b, d FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1),
      y AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, a) = 1)
      SELECT a AS left_id, b AS right_id, round(d, 6) AS dist FROM x JOIN y USING (a, b)""",
)
def t13(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    low, high = e.filter("label < 5").select("vec_id", "embedding"), e.filter("label >= 5").select("vec_id", "embedding")
    return search.mutual_matches(low, high, "vec_id", "embedding", "vec_id", "embedding").toDF("left_id", "right_id", "dist").withColumn("dist", F.round("dist", 6))


@query("t15_distance_between", "SELECT round(min(d), 6) AS min, round(avg(d), 6) AS mean, round(max(d), 6) AS max FROM (SELECT list_distance(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d FROM embeddings l, embeddings r WHERE l.label = 1 AND r.label = 2)")
def t15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = search.distance_between(e.filter("label = 1"), e.filter("label = 2"), "embedding")
    return out.select(*[F.round(c, 6).alias(c) for c in ("min", "mean", "max")])


@query("t16_tags_and_range", _over_partsupp("SELECT ps_partkey, ps_suppkey, round(d, 6) AS dist FROM ps WHERE d < 1.3 AND list_contains([ps_label, ps_suppkey % 5, ps_partkey % 7], 3)"))
def t16(spark, sf_dir):
    ps = derived(spark, sf_dir, "partsupp").withColumn("ps_tags", F.expr("array(cast(ps_label as int), cast(ps_suppkey % 5 as int), cast(ps_partkey % 7 as int))"))
    found = search.range_search(search.with_tags(ps, "ps_tags", [3]), "ps_embedding", query_vector(spark, sf_dir), 1.3)
    return found.select("ps_partkey", "ps_suppkey", F.round("dist", 6).alias("dist"))


# SQL dialect


@query("sql_operators", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {Q}), 6) AS l2, round(-list_inner_product(embedding::DOUBLE[], {Q}), 6) AS ip, round(1 - list_cosine_similarity(embedding::DOUBLE[], {Q}), 5) + 0.0::DOUBLE AS cos FROM embeddings")
def sql_operators(spark, sf_dir):
    views(spark, sf_dir)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    q = query_vector(spark, sf_dir)
    return sqlfront.run(spark, f"SELECT vec_id, round(embedding <-> '{q}', 6) AS l2, round(embedding <#> '{q}', 6) AS ip, round(embedding <=> '{q}', 5) + 0D AS cos FROM embeddings")


@query("sql_approximate_sum", f"SELECT vec_id, label FROM embeddings ORDER BY 0.5 * list_distance(embedding::DOUBLE[], {Q}) ** 2 + 0.5 * list_distance(embedding::DOUBLE[], {Q1}) ** 2 LIMIT 10")
def sql_approximate_sum(spark, sf_dir):
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    a, b = (", ".join(map(repr, query_vector(spark, sf_dir, n))) for n in (0, 1))
    return sqlfront.run(spark, f"select vec_id, label from embeddings order by approximate_sum('0.5 * embedding <-> {{{a}}} + 0.5 * embedding <-> {{{b}}}') limit 10")


# query suites

for _q, _sql in tpch.SQL.items():

    def _suite(spark, sf_dir, name=_q):
        return getattr(tpch.Suite(spark, sf_dir), name)()

    query(f"qh{int(_q[1:]):02d}", f"{with_clause(('partsupp',))} {_sql.format(d=tpch.DUCK_DISTANCE, r=tpch.RADIUS)}")(_suite)

for _q in tpcds.STARS:

    def _star(spark, sf_dir, name=_q):
        return tpcds.run(spark, sf_dir, name)

    query(f"qd{int(_q[1:]):02d}", tpcds.duckdb_sql(_q))(_star)


_THREE = """FROM web_sales ws JOIN item i ON ws.ws_item_sk = i.i_item_sk JOIN date_dim d ON ws.ws_sold_date_sk = d.d_date_sk
  WHERE i.i_manager_id = 2 AND d.d_year = 1997 AND {d} < 1.3"""


@query("sql_planned", f"{with_clause(('web_sales', 'item', 'date_dim'))} SELECT i_item_id, d_moy, count(*) AS n, round(min(d), 6) AS least FROM (SELECT i.*, d.d_moy, list_distance(i_embedding::DOUBLE[], {Q}) AS d {_THREE.format(d=f'list_distance(i_embedding::DOUBLE[], {Q})')}) GROUP BY i_item_id, d_moy")
def sql_planned(spark, sf_dir):
    views(spark, sf_dir, "web_sales", "item", "date_dim")
    near = f"i.i_embedding <-> '{query_vector(spark, sf_dir)}'"
    found, _ = sqlfront.planned(spark, f"SELECT i.i_item_id, d_moy, count(*) AS n, round(min({near}), 6) AS least {_THREE.format(d=near)} GROUP BY i.i_item_id, d_moy")
    return found


@query("e02_detection", "SELECT 3 AS relations, true AS planned, 3 AS nested, false AS without_range")
def e02(spark, sf_dir):
    views(spark, sf_dir, "web_sales", "item", "date_dim")
    near = "i.i_embedding <-> '[1, 2]'"
    text = f"SELECT i.i_item_id {_THREE.format(d=near)}"
    nested = "WITH a AS (SELECT * FROM item) SELECT * FROM a WHERE EXISTS (SELECT 1 FROM date_dim) AND i_item_sk IN (SELECT ws_item_sk FROM web_sales)"
    row = sqlfront.relations_of(spark, text), sqlfront.is_vector_query(spark, text), sqlfront.relations_of(spark, nested), sqlfront.is_vector_query(spark, nested)
    return spark.createDataFrame([row], "relations int, planned boolean, nested int, without_range boolean")


@query("e06_index_probe", tpcds.duckdb_sql("q98"))
def e06(spark, sf_dir):
    catalog = Catalog(spark, remember(spark, f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}"))
    catalog.create("it", "item", derived(spark, sf_dir, "item"), "i_embedding", "i_item_sk")
    return tpcds.run(spark, sf_dir, "q98", catalog=catalog)


@query("e09_feedback", "SELECT 1 AS learned, true AS known")
def e09(spark, sf_dir):
    states = States()
    found = plan(tpcds.describe(spark, sf_dir, "q42"), "sample", states)
    found.collect()
    learned = states.states[("i", "i_embedding")].recent_qerrors
    return spark.createDataFrame([(len(learned), learned[0] >= 1)], "learned int, known boolean")


# estimates


@query("e03_probe", _over_partsupp("SELECT count(*) AS estimated, count(*) AS counted FROM ps WHERE d < 1.3"))
def e03(spark, sf_dir):
    found = search.range_search(derived(spark, sf_dir, "partsupp"), "ps_embedding", query_vector(spark, sf_dir), 1.3)
    kept, n = probe(found.select("ps_partkey", "ps_suppkey", "dist"))
    return kept.agg(F.lit(n).cast("long").alias("estimated"), F.count("*").alias("counted"))


@query("e08_sampled")
def e08(spark, sf_dir):
    ps, q = derived(spark, sf_dir, "partsupp"), query_vector(spark, sf_dir)
    rows, state = ps.count(), State("partsupp", "ps_embedding", 385.0)
    condition = D.euclidean("ps_embedding", q) < 1.3
    true, out = ps.filter(condition).count(), []
    for seed in range(5):
        estimate = sampled(ps, condition, state, rows, seed)
        state.learn(q_error(estimate, true), rows, cycle=2)
        out.append((seed, float(estimate), float(true), q_error(estimate, true), state.sample_size))
    return spark.createDataFrame(out, "round int, estimated double, counted double, q_error double, sample_size double")


# indexes, in a folder of their own for each call


def _indexed(spark: SparkSession, sf_dir: str, metric: str = "l2sq") -> Catalog:
    catalog = Catalog(spark, remember(spark, f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}"))
    catalog.create("idx", "embeddings", table(spark, sf_dir, "embeddings"), "embedding", "vec_id", metric=metric)
    return catalog


@query("x01_index_exact_top_k", f"SELECT vec_id, round(d, 6) AS dist FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {Q}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10)")
def x01(spark, sf_dir):
    found = _indexed(spark, sf_dir).search("idx", query_vector(spark, sf_dir), 10, exact=True)
    return found.select(F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"))


@query("s04_index_range", f"SELECT vec_id, round(d, 6) + 0.0::DOUBLE AS dist FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {Q}) AS d FROM embeddings) WHERE d < 0.845")
def s04(spark, sf_dir):
    found = _indexed(spark, sf_dir, "cosine").range("idx", query_vector(spark, sf_dir), 0.845)
    return found.select(F.col("key").alias("vec_id"), (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


_TOP = "SELECT vec_id, round(d, 6) AS dist FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {q}) AS d FROM embeddings {where} ORDER BY d, vec_id LIMIT {k})"


@query("s02_index_search", _TOP.format(q=Q, where="", k=10))
def s02(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)  # every cell: what a search finds when it may look everywhere
    found = catalog.search("idx", query_vector(spark, sf_dir), 10, cells=catalog.get("idx").cells)
    return found.select(F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"))


@query("s02_index_search_recall", "SELECT true AS enough")
def s02_recall(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    share = catalog.recall("idx", [query_vector(spark, sf_dir, n) for n in range(5)], 10)
    return spark.createDataFrame([(share >= 0.5,)], "enough boolean")


@query("s03_estimates", "SELECT least(10, count(*))::BIGINT AS of_limit, count(*) AS of_table, least(64, count(*))::BIGINT AS of_search FROM embeddings")
def s03(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    return spark.createDataFrame([(catalog.estimate("idx", 10), catalog.estimate("idx"), catalog.estimate("idx", ef=True))], "of_limit long, of_table long, of_search long")


@query("s05_relaxed_range", f"SELECT vec_id, round(d, 6) AS dist FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {Q}) AS d FROM embeddings) WHERE d < 1.3")
def s05(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)  # with as much patience as there are cells nothing is missed
    found = catalog.relaxed("idx", query_vector(spark, sf_dir), 1.3, patience=catalog.get("idx").cells)
    return found.select(F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"))


@query("s06_iterator", _TOP.format(q=Q, where="", k=30))
def s06(spark, sf_dir):
    cursor = _indexed(spark, sf_dir).iterate("idx", query_vector(spark, sf_dir))
    rows = [r for n in (1, 9, 20) for r in cursor.next(n)]
    cursor.close()
    return spark.createDataFrame(rows, "vec_id long, dist double").withColumn("dist", F.round("dist", 6))


@query(
    "s07_multi_index",
    f"""SELECT a.vec_id, round(0.7 * list_distance(a.embedding::DOUBLE[], {Q}) ** 2 + 0.3 * list_distance(b.embedding::DOUBLE[], {Q1}) ** 2, 6) AS score
      FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 7) % (SELECT count(*) FROM embeddings) ORDER BY 2, 1 LIMIT 10""",
)
def s07(spark, sf_dir):
    catalog, e = _indexed(spark, sf_dir), table(spark, sf_dir, "embeddings")
    n = e.count()
    second = e.select(((F.col("vec_id") - 7 + n) % n).alias("vec_id"), F.col("embedding").alias("other"))
    catalog.create("second", "embeddings", second, "other", "vec_id")
    best = catalog.weighted([(0.7, "idx", query_vector(spark, sf_dir)), (0.3, "second", query_vector(spark, sf_dir, 1))], 10)
    return spark.createDataFrame(best, "vec_id long, score double").withColumn("score", F.round("score", 6))


@query("s17_saved_index", _TOP.format(q=Q, where="", k=10))
def s17(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    catalog.save("idx", f"{catalog.root}-saved")
    catalog.view(remember(spark, f"{catalog.root}-saved"), "seen")
    catalog.drop("idx")
    found = catalog.search("seen", query_vector(spark, sf_dir), 10, exact=True)
    return found.select(F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"))


@query("t09_index_knn_join", f"SELECT left_id, right_id, round(d, 6) AS dist, n::INT AS rank FROM ({_knn(3)})")
def t09(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    near = knn_join_indexed(catalog, "idx", table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, cells=catalog.get("idx").cells)
    return near.select(F.col("vec_id").alias("left_id"), F.col("key").alias("right_id"), F.round("dist", 6).alias("dist"), "rank")


@query("t14_clusters", "SELECT count(*) AS n, count(DISTINCT vec_id) AS keys, 4 AS clusters FROM embeddings")
def t14(spark, sf_dir):
    found = _indexed(spark, sf_dir).clusters("idx", 4)
    return found.agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.countDistinct("cluster").cast("int").alias("clusters"))


@query("t15_fork_and_isolate", "SELECT 0::BIGINT AS forked, count(*) AS gone, (SELECT count(*) FROM embeddings WHERE label <> 0) AS \"left\" FROM embeddings WHERE label = 0")
def t15_fork(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    catalog.fork("idx", "empty")
    catalog.delete("idx", table(spark, sf_dir, "embeddings").filter("label = 0").select("vec_id"))
    return spark.createDataFrame([(catalog.count("empty"), catalog.isolate("idx"), catalog.count("idx"))], "forked long, gone long, left long")


@query("x04_delete_and_insert", "SELECT vec_id FROM embeddings WHERE label <> 0 OR vec_id % 2 = 0")
def x04(spark, sf_dir):
    catalog, e = _indexed(spark, sf_dir), table(spark, sf_dir, "embeddings")
    catalog.delete("idx", e.filter("label = 0").select("vec_id"))
    catalog.insert("idx", e.filter("label = 0 and vec_id % 2 = 0"))
    catalog.compact("idx")
    return catalog.rows("idx").select(F.col("key").alias("vec_id"))


@query("x05_delete_and_compact", "SELECT count(*) AS n, min(vec_id) AS least FROM embeddings WHERE label <> 0")
def x05(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    catalog.delete("idx", table(spark, sf_dir, "embeddings").filter("label = 0").select("vec_id"))
    catalog.compact("idx")
    return catalog.rows("idx").agg(F.count("*").alias("n"), F.min("key").alias("least"))


@query("x08_index_info", "SELECT 'idx' AS index_name, 'embeddings' AS table_name, 'l2sq' AS metric, max(len(embedding))::INT AS dimensions, count(*) AS n, count(*) AS capacity FROM embeddings")
def x08(spark, sf_dir):
    info = _indexed(spark, sf_dir).info()
    return info.select("index_name", "table_name", "metric", "dimensions", F.col("count").alias("n"), "capacity")


# loaders


@query(
    "s11_zip_rows",
    "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS o FROM part) SELECT p_partkey, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM p LEFT JOIN embeddings ON vec_id = o",
)
def s11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    zipped = loaders.zip_rows(table(spark, sf_dir, "part").select("p_partkey"), vectors, ["p_partkey"], "v")
    return zipped.select("p_partkey", F.round(F.aggregate(D.vector("v"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("s13_index_lists", "SELECT l_orderkey AS \"row\", array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS indices FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey")
def s13(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("val"))
    return loaders.index_lists(entries, threshold=25.0).select("row", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


# aggregates, functions and settings around the searches


@query("a07_any_value", "SELECT label, any_value(label % 3)::INT AS any_mod FROM embeddings GROUP BY label")
def a07(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.any_value(F.col("label") % 3).cast("int").alias("any_mod"))


@query("a08_bool_and", f"SELECT label, bool_and(list_distance(embedding::DOUBLE[], {Q}) < 1.5) AS all_near FROM embeddings GROUP BY label")
def a08(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.bool_and(D.euclidean("embedding", query_vector(spark, sf_dir)) < 1.5).alias("all_near"))


@query("f08_table_by_name", "SELECT count(*) AS n FROM nation")
def f08(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return sqlfront.run(spark, "SELECT count(*) AS n FROM IDENTIFIER('na' || 'tion')")


@query(
    "f11_grid",
    """SELECT x, y, z, round(d, 6) AS dist FROM (SELECT a.range AS x, b.range AS y, c.range AS z, list_distance([a.range, b.range, c.range]::DOUBLE[], [1, 2, 3]::DOUBLE[]) AS d
      FROM range(1, 10) a, range(1, 10) b, range(1, 10) c) ORDER BY d, x, y, z LIMIT 7""",
)
def f11(spark, sf_dir):
    grid = spark.range(729).select(*((F.floor(F.col("id") / 9**n) % 9 + 1).cast("long").alias(c) for n, c in enumerate("zyx")))
    grid = grid.withColumn("id", F.col("x") * 100 + F.col("y") * 10 + F.col("z")).withColumn("vec", F.array("x", "y", "z").cast("array<double>"))
    return search.top_k(grid, "vec", [1, 2, 3], 7, "id").select("x", "y", "z", F.round("dist", 6).alias("dist"))


@query("f12_q_error", "SELECT event_id, round(greatest(greatest(value, 1) / greatest(user_id, 1), greatest(user_id, 1) / greatest(value, 1)), 6) AS q_error FROM events WHERE event_id < 500")
def f12(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_id < 500").select("event_id", "value", "user_id").collect()
    return spark.createDataFrame([(r.event_id, q_error(float(r.value), float(r.user_id))) for r in rows], "event_id long, q_error double").withColumn("q_error", F.round("q_error", 6))


@query("e10_update_rule", "SELECT round(385 + 0.1 * g, 6) AS sample_size, round(0.1 * g, 6) AS v_grad, 0.099 AS learning_rate FROM (SELECT 50 * (1.45 - 1.5) - 50 * (385.0 / count(*)) AS g FROM embeddings)")
def e10(spark, sf_dir):
    state, rows = State("embeddings", "embedding", 385.0), table(spark, sf_dir, "embeddings").count()
    for i in range(50):
        state.learn(1 + 0.1 * (i % 10), rows)
    return spark.createDataFrame([(round(state.sample_size, 6), round(state.v_grad, 6), round(state.learning_rate, 6))], "sample_size double, v_grad double, learning_rate double")


@query("e12_settings", "SELECT 385.0::DOUBLE AS sample_size, 50 AS cycle, true AS updates, true AS out_of_range")
def e12(spark, sf_dir):
    found = [setting(spark.newSession(), f"vecsql.{n}") for n in ("sample_size", "sample_update_cycle", "update_sample_size")]
    other = spark.newSession()
    other.conf.set("vecsql.sample_update_cycle", "1001")
    try:
        setting(other, "vecsql.sample_update_cycle")
        wrong = False
    except ValueError:
        wrong = True
    return spark.createDataFrame([(*found, wrong)], "sample_size double, cycle int, updates boolean, out_of_range boolean")


@query("x07_drop", "SELECT 1 AS before, 0 AS after")
def x07(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    before = len(catalog.all())
    catalog.drop("idx")
    return spark.createDataFrame([(before, len(catalog.all()))], "before int, after int")


@query("x09_search_setting", "SELECT true AS wider, count(*) AS found FROM embeddings")
def x09(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    index, other = catalog.get("idx"), spark.newSession()
    most = max(100_000, catalog.count("idx"))  # a search as wide as the table, whatever its size
    other.conf.set(EF_SEARCH, str(most))
    wide = Catalog(other, catalog.root)
    found = wide.search("idx", query_vector(spark, sf_dir), most).count()
    return spark.createDataFrame([(wide.probes(index) == index.cells > catalog.probes(index), found)], "wider boolean, found long")


@query("x10_keys", "SELECT true AS there, false AS renamed, true AS new_name, count(*) AS n FROM embeddings")
def x10(spark, sf_dir):
    catalog = _indexed(spark, sf_dir)
    there = catalog.contains("idx", 3)
    catalog.rename_key("idx", 3, -3)
    return spark.createDataFrame([(there, catalog.contains("idx", 3), catalog.contains("idx", -3), catalog.count("idx"))], "there boolean, renamed boolean, new_name boolean, n long")


@query("x11_index_by_function", "SELECT 'i_l2sq' AS of_distance, 'i_cosine' AS of_cosine, 'i_ip' AS of_product, 'i_l2sq' AS hinted")
def x11(spark, sf_dir):
    catalog = Catalog(spark, remember(spark, f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}"))
    for metric in ("ip", "cosine", "l2sq"):
        catalog.create(f"i_{metric}", "embeddings", table(spark, sf_dir, "embeddings"), "embedding", "vec_id", metric=metric)
    names = [catalog.match("embeddings", "embedding", f).name for f in ("<->", "<=>", "<#>")]
    return spark.createDataFrame([(*names, catalog.match("embeddings", "embedding", "<->", "i_l2sq").name)], "of_distance string, of_cosine string, of_product string, hinted string")


@query("s16_reopened_index", _TOP.format(q=Q, where="", k=10))
def s16(spark, sf_dir):
    again = Catalog(spark, _indexed(spark, sf_dir).root)
    found = again.search("idx", query_vector(spark, sf_dir), 10, exact=True)
    return found.select(F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"))


@query(
    "u02_own_ranking",
    f"""SELECT vec_id, round(greatest(p, q), 6) AS score FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {Q}) ** 2 AS p, list_distance(embedding::DOUBLE[], {Q1}) ** 2 AS q FROM embeddings)
      ORDER BY greatest(p, q), vec_id LIMIT 10""",
)
def u02(spark, sf_dir):
    terms = [(1.0, "embedding", query_vector(spark, sf_dir, n)) for n in (0, 1)]
    out = search.weighted_top_k(table(spark, sf_dir, "embeddings"), terms, 10, "vec_id", combine=F.greatest)
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query("u03_own_distance", f"SELECT vec_id, round({_total('abs(a[i] - b[i]) ** 3')}, 6) + 0.0::DOUBLE AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS a, {Q} AS b FROM embeddings)")
def u03(spark, sf_dir):
    if "cubes" not in D.DISTANCES:
        D.register("cubes", lambda a, b: F.aggregate(F.zip_with(D.vector(a), D.vector(b), lambda x, y: F.pow(F.abs(x - y), F.lit(3))), F.lit(0.0), lambda s, x: s + x))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(D.distance("cubes", "embedding", query_vector(spark, sf_dir)), 6) + F.lit(0.0)).alias("value"))


def _file(spark: SparkSession, name: str) -> str:
    return remember(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}")


@query("s08_vector_file", "SELECT vec_id AS ordinal, round(list_sum(embedding::DOUBLE[]), 5) + 0.0::DOUBLE AS total FROM embeddings")
def s08(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").toPandas()["embedding"]
    path, jvm = _file(spark, "vectors.fbin"), spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(np.array([len(rows), len(rows[0])], "<i4").tobytes() + np.stack(rows).astype("<f4").tobytes()))
    out.close()
    return loaders.read_vectors(spark, path).select("ordinal", (F.round(F.aggregate(D.vector("vector"), F.lit(0.0), lambda s, x: s + x), 5) + F.lit(0.0)).alias("total"))


@query("s10_delimited", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s10(spark, sf_dir):
    path = _file(spark, "nation.tbl")
    table(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit("")).alias("value")).write.text(path)
    return loaders.read_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("s12_tags", "SELECT vec_id AS ordinal, label AS first_tag, (vec_id % 5)::INT AS second_tag FROM embeddings")
def s12(spark, sf_dir):
    path = _file(spark, "tags.jsonl")
    lists = table(spark, sf_dir, "embeddings").orderBy("vec_id").select(F.to_json(F.array(F.col("label").cast("int"), (F.col("vec_id") % 5).cast("int"))).alias("value"))
    lists.coalesce(1).write.text(path)
    return loaders.read_tags(spark, path).select("ordinal", F.col("tags")[0].alias("first_tag"), F.col("tags")[1].alias("second_tag"))


@query("s13_matrix_market", "SELECT vec_id AS \"row\", label::BIGINT AS col, round(list_sum(embedding::DOUBLE[]), 6) AS val FROM embeddings")
def s13_mtx(spark, sf_dir):
    path, e = _file(spark, "matrix.mtx"), table(spark, sf_dir, "embeddings")
    total = F.round(F.aggregate(D.vector("embedding"), F.lit(0.0), lambda s, x: s + x), 6)
    lines = e.select(F.concat_ws(" ", F.col("vec_id") + 1, F.col("label") + 1, total.cast("string")).alias("value"), F.lit(1).alias("at"))
    head = e.agg(F.concat_ws(" ", F.max("vec_id") + 1, F.max("label") + 1, F.count("*")).alias("value")).withColumn("at", F.lit(0))
    lines.union(head).orderBy("at").select("value").coalesce(1).write.text(path)
    return loaders.read_sparse(spark, path)[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["qh03"](spark, sf_dir)
