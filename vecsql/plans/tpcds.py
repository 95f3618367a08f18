"""Vector-augmented TPC-DS queries over the derived star schema, planned by what their vector predicate leaves.

Each is described once: relations, keys, filters, what follows after the joins, and the columns to show.
Spark gets the description through the planner, DuckDB as SQL made from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vecsql.operators.index import Catalog
from vecsql.schema import derived, query_vector, with_clause

from .planner import Join, Plan, VectorPredicate, VectorQuery, duckdb_from, plan

RADIUS = 1.3


@dataclass(frozen=True)
class Star:
    """relations: alias -> table. keys: joins as 'a.x = b.y', a star after the first for a left join. shown: columns, 'expression AS name' where renamed."""

    relations: dict[str, str]
    keys: Sequence[str]
    filters: dict[str, str]
    shown: Sequence[str]
    residual: Sequence[str] = ()
    item: str = "i"

    def joins(self) -> list[Join]:
        found: dict[tuple[str, str, str], list[tuple[str, str]]] = {}
        for key in self.keys:
            left, right = (k.strip() for k in key.split("="))
            kind = "left" if left.endswith("*") else "inner"
            (a, x), (b, y) = (k.rstrip("* ").split(".") for k in (left, right))
            found.setdefault((a, b, kind), []).append((x, y))
        return [Join(a, b, tuple(keys), kind) for (a, b, kind), keys in found.items()]


def _days(column: str, first: str, last: str) -> str:
    return f"{column} between date '{first}' and date '{last}'"


_SHOWN_ITEM = ("i.i_item_id", "i.i_item_desc", "i.i_category", "i.i_class", "i.i_current_price")


def _category_sales(table: str, prefix: str, categories: Sequence[str], first: str, last: str) -> Star:
    """Items of some categories that a channel sold within some days."""
    listed = ", ".join(f"'{c}'" for c in categories)
    return Star(
        {"sold": table, "i": "item", "d": "date_dim"},
        (f"sold.{prefix}_item_sk = i.i_item_sk", f"sold.{prefix}_sold_date_sk = d.d_date_sk"),
        {"i": f"i.i_category in ({listed})", "d": _days("d.d_date", first, last)},
        _SHOWN_ITEM,
    )


def _in_stock(table: str, key: str, price: int, makers: Sequence[int], first: str, last: str, shown: Sequence[str]) -> Star:
    """Items of some makers and prices in stock within some days, once for each sale."""
    return Star(
        {"stock": "inventory", "i": "item", "d": "date_dim", "sold": table},
        ("stock.inv_item_sk = i.i_item_sk", "stock.inv_date_sk = d.d_date_sk", f"sold.{key} = i.i_item_sk"),
        {
            "i": f"i.i_current_price between {price} and {price + 30} and i.i_manufact_id in ({', '.join(map(str, makers))})",
            "d": _days("d.d_date", first, last),
            "stock": "stock.inv_quantity_on_hand between 100 and 500",
        },
        shown,
    )


STARS = {
    "q7": Star(
        {"sale": "store_sales", "who": "customer_demographics", "d": "date_dim", "i": "item", "promo": "promotion"},
        ("sale.ss_item_sk = i.i_item_sk", "sale.ss_cdemo_sk = who.cd_demo_sk", "sale.ss_sold_date_sk = d.d_date_sk", "sale.ss_promo_sk = promo.p_promo_sk"),
        {
            "who": "who.cd_gender = 'M' and who.cd_marital_status = 'M' and who.cd_education_status = '4 yr Degree'",
            "promo": "promo.p_channel_email = 'N' or promo.p_channel_event = 'N'",
            "d": "d.d_year = 1998",
        },
        ("i.i_item_id",),
    ),
    "q12": _category_sales("web_sales", "ws", ("Women", "Children", "Books"), "1998-02-28", "1998-03-30"),
    "q19": Star(
        {"sale": "store_sales", "d": "date_dim", "i": "item", "buyer": "ds_customer", "home": "customer_address", "shop": "store"},
        (
            *("sale.ss_sold_date_sk = d.d_date_sk", "sale.ss_item_sk = i.i_item_sk", "sale.ss_customer_sk = buyer.c_customer_sk"),
            *("buyer.c_current_addr_sk = home.ca_address_sk", "sale.ss_store_sk = shop.s_store_sk"),
        ),
        {"i": "i.i_manager_id = 2", "d": "d.d_moy = 11 and d.d_year = 1997"},
        ("i.i_brand_id AS brand_id", "i.i_brand AS brand", "i.i_manufact_id", "i.i_manufact"),
        ("substr(home.ca_zip, 1, 5) <> substr(shop.s_zip, 1, 5)",),
    ),
    "q20": _category_sales("catalog_sales", "cs", ("Books", "Music", "Sports"), "1997-06-18", "1997-07-18"),
    "q37": _in_stock("catalog_sales", "cs_item_sk", 16, (3, 5, 11), "1997-03-27", "1997-05-26", ("i.i_item_id", "i.i_item_desc", "i.i_current_price")),
    "q42": Star(
        {"sale": "store_sales", "i": "item", "d": "date_dim"},
        ("sale.ss_item_sk = i.i_item_sk", "sale.ss_sold_date_sk = d.d_date_sk"),
        {"i": "i.i_manager_id = 1", "d": "d.d_moy = 11 and d.d_year = 1998"},
        ("d.d_year", "i.i_category_id", "i.i_category"),
    ),
    "q72": Star(
        {
            **{"sale": "catalog_sales", "stock": "inventory", "depot": "warehouse", "i": "item", "who": "customer_demographics"},
            **{"house": "household_demographics", "sold": "date_dim", "counted": "date_dim", "shipped": "date_dim", "promo": "promotion", "back": "catalog_returns"},
        },
        (
            *("sale.cs_item_sk = stock.inv_item_sk", "stock.inv_warehouse_sk = depot.w_warehouse_sk", "sale.cs_item_sk = i.i_item_sk"),
            *("sale.cs_bill_cdemo_sk = who.cd_demo_sk", "sale.cs_bill_hdemo_sk = house.hd_demo_sk", "sale.cs_sold_date_sk = sold.d_date_sk"),
            *("stock.inv_date_sk = counted.d_date_sk", "sale.cs_ship_date_sk = shipped.d_date_sk", "sale.cs_promo_sk* = promo.p_promo_sk"),
            *("sale.cs_item_sk* = back.cr_item_sk", "sale.cs_order_number* = back.cr_order_number"),
        ),
        {"house": "house.hd_buy_potential = '501-1000'", "who": "who.cd_marital_status = 'M'", "sold": "sold.d_year = 1996"},
        ("i.i_item_desc", "depot.w_warehouse_name", "sold.d_week_seq"),
        ("sold.d_week_seq = counted.d_week_seq", "stock.inv_quantity_on_hand < sale.cs_quantity", "shipped.d_date > sold.d_date + interval '5' day"),
    ),
    "q82": _in_stock("store_sales", "ss_item_sk", 9, (4, 8, 12, 16), "1998-06-07", "1998-07-07", ("i.i_item_id", "i.i_item_desc", "i.i_current_price", "i.i_manufact_id")),
    "q98": _category_sales("store_sales", "ss", ("Men", "Sports", "Jewelry"), "1999-02-05", "1999-03-07"),
}


def describe(spark: SparkSession, sf_dir: str, name: str, query: Sequence[float] | None = None, radius: float = RADIUS) -> VectorQuery:
    star = STARS[name]
    frames = {alias: derived(spark, sf_dir, table) for alias, table in star.relations.items()}
    vector = tuple(query or query_vector(spark, sf_dir))
    predicate = VectorPredicate(star.item, "i_embedding", vector, radius, table="item", key="i_item_sk")
    return VectorQuery(frames, star.joins(), predicate, dict(star.filters), star.residual)


def planned(spark: SparkSession, sf_dir: str, name: str, query: Sequence[float] | None = None, radius: float = RADIUS, mode: str = "probe", catalog: Catalog | None = None) -> Plan:
    return plan(describe(spark, sf_dir, name, query, radius), mode, catalog=catalog)


def run(spark: SparkSession, sf_dir: str, name: str, query: Sequence[float] | None = None, radius: float = RADIUS, mode: str = "probe", catalog: Catalog | None = None) -> DataFrame:
    frame = planned(spark, sf_dir, name, query, radius, mode, catalog).frame
    return frame.orderBy("dist").selectExpr(*STARS[name].shown)


def duckdb_sql(name: str, radius: float = RADIUS) -> str:
    """The same in DuckDB, for the query vector with id 0."""
    star = STARS[name]
    distance = f"list_distance({star.item}.i_embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
    where = [f"({c})" for c in (*star.filters.values(), *star.residual, f"{distance} < {radius!r}")]
    tables = tuple(dict.fromkeys(star.relations.values()))
    return f"{with_clause(tables)}\nSELECT {', '.join(star.shown)} FROM {duckdb_from(star.relations, star.joins())}\nWHERE {' AND '.join(where)}"
