"""The tables of the query suites, as views over the Parquet files.

``partsupp`` with its vectors, and a star schema of sales, are derived from the base tables by plain
arithmetic, written once in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def vector_field(name: str, dimensions: int, element: T.DataType | None = None) -> T.StructField:
    """A vector column: an array without nulls whose dimension stands in the field's metadata."""
    return T.StructField(name, T.ArrayType(element or T.FloatType(), containsNull=False), True, {"vector_dim": dimensions})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Derived tables by name; each may use the base tables and those before it.
DERIVED = {
    "partsupp": """
        SELECT k.ps_partkey, k.ps_suppkey, (k.ps_partkey * 31 + k.ps_suppkey * 17) % 9999 + 1 AS ps_availqty,
               CAST((k.ps_partkey * 7 + k.ps_suppkey * 3) % 1000 + 1 AS DOUBLE) AS ps_supplycost,
               e.embedding AS ps_embedding, e.label AS ps_label
        FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) k
        JOIN embeddings e ON e.vec_id = (k.ps_partkey * 31 + k.ps_suppkey * 17) % (SELECT count(*) FROM embeddings)""",
    "item": """
        SELECT p.p_partkey AS i_item_sk, concat('ITEM', CAST(p.p_partkey AS VARCHAR(20))) AS i_item_id, p.p_name AS i_item_desc,
               CASE p.p_partkey % 10 WHEN 0 THEN 'Women' WHEN 1 THEN 'Children' WHEN 2 THEN 'Books' WHEN 3 THEN 'Music' WHEN 4 THEN 'Sports'
                    WHEN 5 THEN 'Men' WHEN 6 THEN 'Jewelry' WHEN 7 THEN 'Shoes' WHEN 8 THEN 'Home' ELSE 'Electronics' END AS i_category,
               p.p_partkey % 10 AS i_category_id, p.p_type AS i_class, CAST(p.p_partkey % 97 AS DOUBLE) AS i_current_price,
               p.p_partkey % 5 + 1 AS i_manager_id, p.p_partkey % 13 AS i_brand_id, p.p_brand AS i_brand,
               p.p_partkey % 17 AS i_manufact_id, concat('M', CAST(p.p_partkey % 17 AS VARCHAR(20))) AS i_manufact,
               e.embedding AS i_embedding
        FROM part p JOIN embeddings e ON e.vec_id = (p.p_partkey * 7) % (SELECT count(*) FROM embeddings)""",
    "date_dim": """
        SELECT DISTINCT CAST(t AS DATE) AS d_date, year(t) * 10000 + month(t) * 100 + day(t) AS d_date_sk,
               CAST(year(t) AS INT) AS d_year, CAST(month(t) AS INT) AS d_moy,
               CAST(year(t) * 53 + floor((dayofyear(t) - 1) / 7.0) AS INT) AS d_week_seq
        FROM (SELECT l_shipdate AS t FROM lineitem UNION SELECT o_orderdate AS t FROM orders) days""",
    "store_sales": """
        SELECT l_partkey AS ss_item_sk, year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS ss_sold_date_sk,
               o_custkey AS ss_cdemo_sk, l_suppkey % 30 AS ss_promo_sk, o_custkey AS ss_customer_sk,
               l_suppkey AS ss_store_sk, l_orderkey AS ss_ticket_number
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "catalog_sales": """
        SELECT l_partkey AS cs_item_sk, l_orderkey AS cs_order_number, CAST(l_quantity AS INT) AS cs_quantity,
               year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS cs_sold_date_sk,
               year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS cs_ship_date_sk,
               o_custkey AS cs_bill_cdemo_sk, o_custkey AS cs_bill_hdemo_sk,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 30 END AS cs_promo_sk
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "catalog_returns": """
        SELECT DISTINCT l_partkey AS cr_item_sk, l_orderkey AS cr_order_number FROM lineitem WHERE l_returnflag = 'R'""",
    "web_sales": """
        SELECT l_partkey AS ws_item_sk, year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS ws_sold_date_sk, l_orderkey AS ws_order_number
        FROM lineitem""",
    "inventory": """
        SELECT ps_partkey AS inv_item_sk, ps_suppkey % 25 AS inv_warehouse_sk, d_date_sk AS inv_date_sk, (ps_availqty * 7) % 600 AS inv_quantity_on_hand
        FROM partsupp JOIN date_dim ON d_date_sk % 499 = (ps_partkey + ps_suppkey) % 499""",
    "warehouse": "SELECT n_nationkey AS w_warehouse_sk, n_name AS w_warehouse_name FROM nation",
    "customer_demographics": """
        SELECT c_custkey AS cd_demo_sk, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS cd_gender,
               CASE WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'S' END AS cd_marital_status,
               CASE WHEN c_custkey % 4 < 2 THEN '4 yr Degree' ELSE 'College' END AS cd_education_status
        FROM customer""",
    "household_demographics": """
        SELECT c_custkey AS hd_demo_sk, CASE WHEN c_custkey % 3 = 0 THEN '501-1000' ELSE '0-500' END AS hd_buy_potential FROM customer""",
    "promotion": """
        SELECT n_nationkey AS p_promo_sk, CASE WHEN n_nationkey % 2 = 0 THEN 'N' ELSE 'Y' END AS p_channel_email,
               CASE WHEN n_nationkey % 3 = 0 THEN 'N' ELSE 'Y' END AS p_channel_event FROM nation""",
    "ds_customer": "SELECT c_custkey AS c_customer_sk, c_custkey AS c_current_addr_sk FROM customer",
    "customer_address": "SELECT c_custkey AS ca_address_sk, concat(CAST(10000 + c_custkey % 20 AS VARCHAR(20)), '-1') AS ca_zip FROM customer",
    "store": "SELECT s_suppkey AS s_store_sk, concat(CAST(10000 + s_suppkey % 20 AS VARCHAR(20)), '-2') AS s_zip FROM supplier",
}


_COUNT = "(SELECT count(*) FROM embeddings)"


def needed(names: tuple[str, ...]) -> list[str]:
    """Derived tables behind the given ones, in the order in which they build on each other."""
    import re

    want, out = set(names), []
    for name in reversed(DERIVED):
        if name in want:
            out.append(name)
            want |= {n for n in DERIVED if n != name and re.search(rf"\b{n}\b", DERIVED[name])}
    return out[::-1]


def with_clause(names: tuple[str, ...]) -> str:
    """``WITH`` of the derived tables behind the given ones, for either engine."""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in needed(names))


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of base tables, and of derived ones over them."""
    for name in BASE:
        if name in names or any(name in DERIVED[n] for n in needed(names)):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in needed(names):
        text = DERIVED[name]
        if _COUNT in text:  # known from the files' footers, and a constant makes a better join key than a subquery
            text = text.replace(_COUNT, str(table(spark, sf_dir, "embeddings").count()))
        spark.sql(text).createOrReplaceTempView(name)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views(spark, sf_dir, name)
    return spark.table(name)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]
