"""Vector-augmented TPC-H queries, planned by what their vector predicate leaves.

Each is described once; constants and radius are parameters. Distances are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsql.schema import derived, query_vector, table

from .planner import Join, Plan, VectorPredicate, VectorQuery, plan

RADIUS = 1.3

_PS = (("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey"))


def _date(text: str) -> str:
    return f"timestamp_ntz'{datetime.fromisoformat(text)}'"


def _money(column: str):
    """A price or a rate of two decimals, so that sums don't depend on the order of the rows."""
    return F.col(column).cast("decimal(15,2)")


class Suite:
    """The queries over one directory, for one query vector and radius."""

    def __init__(self, spark: SparkSession, sf_dir: str, query: Sequence[float] | None = None, radius: float = RADIUS, mode: str = "probe"):
        self.spark, self.sf_dir, self.mode = spark, sf_dir, mode
        self.query = tuple(query or query_vector(spark, sf_dir))
        self.radius = radius
        self.plans: list[Plan] = []

    def plan(self, query: VectorQuery) -> Plan:
        self.plans.append(plan(query, self.mode))
        return self.plans[-1]

    def release(self) -> None:
        """Rows that were kept for the queries so far go."""
        while self.plans:
            self.plans.pop().release()

    def table(self, name: str) -> DataFrame:
        return derived(self.spark, self.sf_dir, name) if name == "partsupp" else table(self.spark, self.sf_dir, name)

    def describe(self, relations: dict[str, tuple[str, Sequence[str]]], joins: Sequence[Join], filters: dict[str, str] | None = None, residual: Sequence[str] = ()) -> VectorQuery:
        """relations: alias -> (table, columns needed after its filter)."""
        frames = {alias: self.table(name) for alias, (name, _) in relations.items()}
        columns = {alias: list(c) for alias, (_, c) in relations.items()}
        return VectorQuery(frames, joins, VectorPredicate("ps", "ps_embedding", self.query, self.radius), filters or {}, residual, columns)

    def joined(self, *args, **kwargs) -> DataFrame:
        return self.plan(self.describe(*args, **kwargs)).frame

    @property
    def _dist(self):
        return F.round("dist", 6).alias("dist")

    def q3(self, segment: str = "HOUSEHOLD", day: str = "1997-03-14") -> DataFrame:
        df = self.joined(
            {"c": ("customer", ["c_custkey"]), "o": ("orders", ["o_orderkey", "o_custkey", "o_orderdate"]), "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]), "ps": ("partsupp", ["ps_partkey", "ps_suppkey"])},
            [Join("c", "o", (("c_custkey", "o_custkey"),)), Join("l", "o", (("l_orderkey", "o_orderkey"),)), Join("l", "ps", _PS)],
            {"c": f"c_mktsegment = '{segment}'", "o": f"o_orderdate < {_date(day)}", "l": f"l_shipdate > {_date(day)}"},
        )
        return df.orderBy("dist").select("l_orderkey", "o_orderdate", self._dist)

    def q5(self, region: str = "MIDDLE EAST", first: str = "1996-01-01", end: str = "1998-01-01") -> DataFrame:
        df = self.joined(
            {
                "c": ("customer", ["c_custkey", "c_nationkey"]),
                "o": ("orders", ["o_orderkey", "o_custkey"]),
                "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]),
                "s": ("supplier", ["s_suppkey", "s_nationkey"]),
                "n": ("nation", ["n_nationkey", "n_name", "n_regionkey"]),
                "r": ("region", ["r_regionkey"]),
                "ps": ("partsupp", ["ps_partkey", "ps_suppkey"]),
            },
            [
                Join("c", "o", (("c_custkey", "o_custkey"),)),
                Join("l", "o", (("l_orderkey", "o_orderkey"),)),
                Join("l", "s", (("l_suppkey", "s_suppkey"),)),
                Join("s", "n", (("s_nationkey", "n_nationkey"),)),
                Join("n", "r", (("n_regionkey", "r_regionkey"),)),
                Join("l", "ps", _PS),
            ],
            {"r": f"r_name = '{region}'", "o": f"o_orderdate >= {_date(first)} and o_orderdate < {_date(end)}"},
            ["c.c_nationkey = s.s_nationkey"],
        )
        return df.orderBy("dist").select("n_name", self._dist)

    def q8(self, nation: str = "NATION_7", region: str = "MIDDLE EAST", kind: str = "ECONOMY", first: str = "1995-01-01", last: str = "1996-12-31", limit: int | None = None) -> DataFrame:
        df = self.joined(
            {
                "p": ("part", ["p_partkey"]),
                "s": ("supplier", ["s_suppkey", "s_nationkey"]),
                "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]),
                "o": ("orders", ["o_orderkey", "o_custkey", "o_orderdate"]),
                "c": ("customer", ["c_custkey", "c_nationkey"]),
                "n1": ("nation", ["n_nationkey", "n_regionkey"]),
                "n2": ("nation", ["n_nationkey", "n_name"]),
                "r": ("region", ["r_regionkey"]),
                "ps": ("partsupp", ["ps_partkey", "ps_suppkey"]),
            },
            [
                Join("p", "l", (("p_partkey", "l_partkey"),)),
                Join("s", "l", (("s_suppkey", "l_suppkey"),)),
                Join("l", "ps", _PS),
                Join("l", "o", (("l_orderkey", "o_orderkey"),)),
                Join("o", "c", (("o_custkey", "c_custkey"),)),
                Join("c", "n1", (("c_nationkey", "n_nationkey"),)),
                Join("n1", "r", (("n_regionkey", "r_regionkey"),)),
                Join("s", "n2", (("s_nationkey", "n_nationkey"),)),
            ],
            {"r": f"r_name = '{region}'", "p": f"p_type = '{kind}'", "o": f"o_orderdate between {_date(first)} and {_date(last)}"},
        )
        volume = _money("l_extendedprice") * (1 - _money("l_discount"))
        share = F.sum(F.when(F.col("n2.n_name") == nation, volume).otherwise(0)).cast("double") / F.sum(volume).cast("double")
        out = df.groupBy(F.year("o_orderdate").alias("o_year")).agg(F.round(share, 6).alias("mkt_share")).orderBy("o_year")
        return out if limit is None else out.limit(limit)

    def q9(self, word: str = "ring", limit: int | None = None) -> DataFrame:
        df = self.joined(
            {
                "p": ("part", ["p_partkey"]),
                "s": ("supplier", ["s_suppkey", "s_nationkey"]),
                "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity"]),
                "ps": ("partsupp", ["ps_partkey", "ps_suppkey", "ps_supplycost"]),
                "o": ("orders", ["o_orderkey", "o_orderdate"]),
                "n": ("nation", ["n_nationkey", "n_name"]),
            },
            [
                Join("p", "l", (("p_partkey", "l_partkey"),)),
                Join("s", "l", (("s_suppkey", "l_suppkey"),)),
                Join("l", "ps", _PS),
                Join("l", "o", (("l_orderkey", "o_orderkey"),)),
                Join("s", "n", (("s_nationkey", "n_nationkey"),)),
            ],
            {"p": f"p_name like '%{word}%'"},
        )
        amount = _money("l_extendedprice") * (1 - _money("l_discount")) - _money("ps_supplycost") * _money("l_quantity")
        out = df.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").alias("o_year")).agg(F.sum(amount).cast("double").alias("sum_profit"))
        out = out.orderBy("nation", F.desc("o_year"))
        return out if limit is None else out.limit(limit)

    def q10(self, first: str = "1996-11-01", end: str = "1997-02-01", flag: str = "R") -> DataFrame:
        df = self.joined(
            {"c": ("customer", ["c_custkey", "c_name", "c_acctbal", "c_nationkey"]), "o": ("orders", ["o_orderkey", "o_custkey"]), "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]), "n": ("nation", ["n_nationkey", "n_name"]), "ps": ("partsupp", ["ps_partkey", "ps_suppkey"])},
            [Join("c", "o", (("c_custkey", "o_custkey"),)), Join("l", "o", (("l_orderkey", "o_orderkey"),)), Join("c", "n", (("c_nationkey", "n_nationkey"),)), Join("l", "ps", _PS)],
            {"o": f"o_orderdate >= {_date(first)} and o_orderdate < {_date(end)}", "l": f"l_returnflag = '{flag}'"},
        )
        return df.orderBy("dist").select("c_custkey", "c_name", "c_acctbal", "n_name", self._dist)

    def q11(self, nation: str = "NATION_7") -> DataFrame:
        df = self.joined(
            {"ps": ("partsupp", ["ps_partkey", "ps_suppkey"]), "s": ("supplier", ["s_suppkey", "s_nationkey"]), "n": ("nation", ["n_nationkey"])},
            [Join("ps", "s", (("ps_suppkey", "s_suppkey"),)), Join("s", "n", (("s_nationkey", "n_nationkey"),))],
            {"n": f"n_name = '{nation}'"},
        )
        return df.orderBy("dist").select("ps_partkey", self._dist)

    def q12(self, priorities: Sequence[str] = ("1-URGENT", "2-HIGH"), first: str = "1997-01-01", end: str = "1998-01-01") -> DataFrame:
        listed = ", ".join(f"'{p}'" for p in priorities)
        df = self.joined(
            {"o": ("orders", ["o_orderkey", "o_orderdate", "o_orderpriority"]), "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]), "ps": ("partsupp", ["ps_partkey", "ps_suppkey"])},
            [Join("o", "l", (("o_orderkey", "l_orderkey"),)), Join("l", "ps", _PS)],
            {"o": f"o_orderpriority in ({listed})", "l": f"l_shipdate >= {_date(first)} and l_shipdate < {_date(end)}"},
            ["o.o_orderdate < l.l_shipdate"],
        )
        return df.orderBy("dist").select("o_orderpriority", self._dist)

    def q18(self, least: float = 200.0) -> DataFrame:
        lines = self.table("lineitem")
        large = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter(F.col("q") > least).select(F.col("l_orderkey").alias("k"))
        query = self.describe(
            {"c": ("customer", ["c_custkey", "c_name"]), "o": ("orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]), "l": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]), "ps": ("partsupp", ["ps_partkey", "ps_suppkey"])},
            [Join("c", "o", (("c_custkey", "o_custkey"),)), Join("l", "o", (("l_orderkey", "o_orderkey"),)), Join("l", "ps", _PS)],
        )
        query.relations["o"] = query.relations["o"].join(large, F.col("o_orderkey") == F.col("k"), "left_semi")
        return self.plan(query).frame.orderBy("dist").select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "l_quantity", self._dist)

    def q20(self, prefix: str = "small", nations: Sequence[str] = ("NATION_1", "NATION_7", "NATION_15"), first: str = "1996-01-01", end: str = "1998-01-01", limit: int | None = None) -> DataFrame:
        lines = self.table("lineitem").filter(f"l_shipdate >= {_date(first)} and l_shipdate < {_date(end)}")
        sold = lines.groupBy(F.col("l_partkey").alias("agg_partkey"), F.col("l_suppkey").alias("agg_suppkey")).agg((0.5 * F.sum("l_quantity")).alias("agg_quantity"))
        query = VectorQuery(
            {"ps": self.table("partsupp"), "a": sold, "p": self.table("part")},
            [Join("ps", "a", (("ps_partkey", "agg_partkey"), ("ps_suppkey", "agg_suppkey"))), Join("ps", "p", (("ps_partkey", "p_partkey"),))],
            VectorPredicate("ps", "ps_embedding", self.query, self.radius),
            {"p": f"p_name like '{prefix}%'"},
            ["ps.ps_availqty > a.agg_quantity"],
            {"ps": ["ps_partkey", "ps_suppkey", "ps_availqty"], "p": ["p_partkey"]},
        )
        having = self.plan(query).frame.select(F.col("ps_suppkey").alias("k"))
        chosen = self.table("supplier").join(having, F.col("s_suppkey") == F.col("k"), "left_semi")
        nation = self.table("nation").filter(F.col("n_name").isin(*nations))
        out = chosen.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name").orderBy("s_name")
        return out if limit is None else out.limit(limit)


#: The same queries in SQL; {d} is the distance and {r} the radius.
SQL = {
    "q3": """SELECT l_orderkey, o_orderdate, round({d}, 6) AS dist FROM customer, orders, lineitem, partsupp
        WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1997-03-14 00:00:00'
          AND l_shipdate > TIMESTAMP '1997-03-14 00:00:00' AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND {d} < {r}""",
    "q5": """SELECT n_name, round({d}, 6) AS dist FROM customer, orders, lineitem, supplier, nation, region, partsupp
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
          AND n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
          AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND {d} < {r}""",
    "q8": """SELECT CAST(year(o_orderdate) AS INT) AS o_year,
          round(sum(CASE WHEN n2.n_name = 'NATION_7' THEN l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)) ELSE 0 END)::DOUBLE / sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)))::DOUBLE, 6) AS mkt_share
        FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region, partsupp
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND l_orderkey = o_orderkey
          AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST' AND s_nationkey = n2.n_nationkey
          AND o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00' AND p_type = 'ECONOMY' AND {d} < {r} GROUP BY 1""",
    "q9": """SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)) - ps_supplycost::DECIMAL(15,2) * l_quantity::DECIMAL(15,2))::DOUBLE AS sum_profit
        FROM part, supplier, lineitem, partsupp, orders, nation
        WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
          AND s_nationkey = n_nationkey AND p_name LIKE '%ring%' AND {d} < {r} GROUP BY 1, 2""",
    "q10": """SELECT c_custkey, c_name, c_acctbal, n_name, round({d}, 6) AS dist FROM customer, orders, lineitem, nation, partsupp
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-11-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-02-01 00:00:00'
          AND l_returnflag = 'R' AND c_nationkey = n_nationkey AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND {d} < {r}""",
    "q11": """SELECT ps_partkey, round({d}, 6) AS dist FROM partsupp, supplier, nation
        WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' AND {d} < {r}""",
    "q12": """SELECT o_orderpriority, round({d}, 6) AS dist FROM orders, lineitem, partsupp
        WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate < l_shipdate AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'
          AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND {d} < {r}""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, l_quantity, round({d}, 6) AS dist FROM customer, orders, lineitem, partsupp
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey
          AND o_orderkey = l_orderkey AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND {d} < {r}""",
    "q20": """SELECT s_name, n_name FROM supplier, nation WHERE s_suppkey IN (
          SELECT ps_suppkey FROM partsupp, (SELECT l_partkey AS agg_partkey, l_suppkey AS agg_suppkey, 0.5 * sum(l_quantity) AS agg_quantity FROM lineitem
            WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_partkey, l_suppkey) a
          WHERE agg_partkey = ps_partkey AND agg_suppkey = ps_suppkey AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
            AND ps_availqty > agg_quantity AND {d} < {r})
        AND s_nationkey = n_nationkey AND n_name IN ('NATION_1', 'NATION_7', 'NATION_15')""",
}

#: The distance in DuckDB, in double, to the query vector with id 0.
DUCK_DISTANCE = "list_distance(ps_embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
