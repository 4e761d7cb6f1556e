"""Keyed views over the given tables, each with the SQL that defines the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from minekit.functions.expr import bands, ratio, rounded
from minekit.operators.classify import risk_class
from minekit.operators.corr import standardise
from minekit.sources.scan import scan_table

VIEW_SQL = {
    "line_by_order": """line_by_order AS (
        SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
               sum(l_quantity) AS quantity, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_cents,
               sum(CAST(round(l_discount * 100) AS BIGINT)) AS discount_pct, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_pct
        FROM lineitem GROUP BY l_orderkey)""",
    "entity": """entity AS (
        SELECT c_custkey AS entity_key, c_name AS name, n_name AS state, c_mktsegment AS segment,
               CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS cases,
               CAST(coalesce(sum(n_returned), 0) AS BIGINT) AS deaths,
               sum(quantity) AS population, c_acctbal AS balance,
               CAST(count(o_orderkey) AS BIGINT) AS n_orders,
               CAST(sum(price_cents) AS DOUBLE) / nullif(CAST(sum(n_lines) AS DOUBLE) * 100, 0) AS avg_price,
               CAST(sum(price_cents) AS DOUBLE) / 100 AS sum_price,
               CAST(sum(discount_pct) AS DOUBLE) / nullif(CAST(sum(n_lines) AS DOUBLE) * 100, 0) AS avg_discount,
               CAST(sum(tax_pct) AS DOUBLE) / nullif(CAST(sum(n_lines) AS DOUBLE) * 100, 0) AS avg_tax,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(o_orderkey) * 100.0::DOUBLE, 0) AS avg_order_total
        FROM customer JOIN nation ON c_nationkey = n_nationkey
             LEFT JOIN orders ON o_custkey = c_custkey
             LEFT JOIN line_by_order ON l_orderkey = o_orderkey
        GROUP BY c_custkey, c_name, n_name, c_mktsegment, c_acctbal)""",
    "sparse": """sparse AS (
        SELECT o_orderkey AS order_key, o_orderstatus AS status, o_orderpriority AS priority,
               CAST(n_lines AS BIGINT) AS lines, CAST(n_returned AS BIGINT) AS returned,
               quantity AS qty, CAST(price_cents AS DOUBLE) / 100 AS price, CAST(NULL AS DOUBLE) AS unused,
               o_totalprice AS total
        FROM orders LEFT JOIN line_by_order ON l_orderkey = o_orderkey)""",
    "daily": """daily AS (
        SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_events,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_value
        FROM events GROUP BY user_id, CAST(ts AS DATE))""",
    "mobility": """mobility AS (
        SELECT user_id, CAST(ts AS DATE) AS day,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'click') AS DOUBLE) / (nullif(count(*) FILTER (WHERE event_type = 'click'), 0) * 100.0::DOUBLE) AS click,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'error') AS DOUBLE) / (nullif(count(*) FILTER (WHERE event_type = 'error'), 0) * 100.0::DOUBLE) AS error,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / (nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) * 100.0::DOUBLE) AS purchase,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'signup') AS DOUBLE) / (nullif(count(*) FILTER (WHERE event_type = 'signup'), 0) * 100.0::DOUBLE) AS signup,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'view') AS DOUBLE) / (nullif(count(*) FILTER (WHERE event_type = 'view'), 0) * 100.0::DOUBLE) AS view
        FROM events GROUP BY user_id, CAST(ts AS DATE))""",
    "raw_points": """raw_points AS (
        SELECT vec_id, round(list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda e, i: i % 3 = 1)), 9) AS x,
               round(list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda e, i: i % 3 = 2)), 9) AS y,
               round(list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda e, i: i % 3 = 0)), 9) AS z, label
        FROM embeddings)""",
    "points": """points AS (
        SELECT vec_id, round((x - (SELECT avg(x) FROM raw_points)) / (SELECT stddev_samp(x) FROM raw_points), 6) AS x,
               round((y - (SELECT avg(y) FROM raw_points)) / (SELECT stddev_samp(y) FROM raw_points), 6) AS y,
               round((z - (SELECT avg(z) FROM raw_points)) / (SELECT stddev_samp(z) FROM raw_points), 6) AS z,
               label + 1 AS cluster
        FROM raw_points)""",
    "truth": """truth AS (
        SELECT vec_id, CASE WHEN x < -0.66 THEN 5 WHEN x < -0.3 THEN 4 WHEN x < 0.2 THEN 3
                            WHEN x < 0.45 THEN 2 WHEN x >= 0.45 THEN 1 END AS truth
        FROM points)""",
    "classes": """classes AS (
        SELECT *, CASE WHEN deaths / nullif(cases, 0) > 0.36 THEN 'high'
                       WHEN deaths / nullif(cases, 0) > 0.30 THEN 'medium' ELSE 'low' END AS risk
        FROM entity)""",
}
_NEEDS = {
    "entity": ["line_by_order"],
    "sparse": ["line_by_order"],
    "points": ["raw_points"],
    "truth": ["points"],
    "classes": ["entity"],
}
# Class bands on the death ratio of ``classes``
RISK_CUTS = (0.36, 0.30)


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the definitions it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str):
        for parent in _NEEDS.get(name, []):
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    definitions = ",\n".join(VIEW_SQL[n] for n in ordered)
    # RECURSIVE only permits a definition to name itself; the others are unaffected
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {definitions},\n{body[5:]}"
    return f"WITH {definitions}\n{body}"


def hundredths(column: str):
    """Two-decimal amounts as whole numbers, whose sums do not depend on the order of rows.

    As by ``round``, halves away from zero, but without a decimal number for each row.
    """
    value = F.col(column).cast("double") * 100
    whole = F.rint(value)
    return F.when(F.abs(value - whole) == 0.5, value + F.signum(value) * 0.5).otherwise(whole).cast("long")


def line_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """Lines pre-aggregated per order, so joins above never see line rows."""
    return scan_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.sum("l_quantity").alias("quantity"),
        F.sum(hundredths("l_extendedprice")).alias("price_cents"),
        F.sum(hundredths("l_discount")).alias("discount_pct"),
        F.sum(hundredths("l_tax")).alias("tax_pct"),
    )


def entity(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    per_customer = (
        orders.join(line_by_order(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.sum("n_lines").alias("n_lines"),
            F.sum("n_returned").alias("n_returned"),
            F.sum("quantity").alias("population"),
            F.count("o_orderkey").alias("n_orders"),
            F.sum("price_cents").alias("price_cents"),
            F.sum("discount_pct").alias("discount_pct"),
            F.sum("tax_pct").alias("tax_pct"),
            F.sum(hundredths("o_totalprice")).alias("order_cents"),
        )
    )
    customer = scan_table(spark, folder, "customer")
    nation = scan_table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("c_custkey").alias("entity_key"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("state"),
            F.col("c_mktsegment").alias("segment"),
            F.coalesce("n_lines", F.lit(0)).cast("long").alias("cases"),
            F.coalesce("n_returned", F.lit(0)).cast("long").alias("deaths"),
            F.col("population"),
            F.col("c_acctbal").alias("balance"),
            F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"),
            ratio("price_cents", F.col("n_lines") * 100).alias("avg_price"),
            (F.col("price_cents").cast("double") / 100).alias("sum_price"),
            ratio("discount_pct", F.col("n_lines") * 100).alias("avg_discount"),
            ratio("tax_pct", F.col("n_lines") * 100).alias("avg_tax"),
            ratio("order_cents", F.col("n_orders") * 100).alias("avg_order_total"),
        )
    )


ENTITY_FEATURES = [
    "population", "balance", "n_orders", "avg_price", "sum_price", "avg_discount", "avg_tax", "avg_order_total",
]


def sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their line totals; orders without lines carry NULLs."""
    return (
        scan_table(spark, folder, "orders")
        .join(line_by_order(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("order_key"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.col("n_lines").alias("lines"),
            F.col("n_returned").alias("returned"),
            F.col("quantity").alias("qty"),
            (F.col("price_cents").cast("double") / 100).alias("price"),
            F.lit(None).cast("double").alias("unused"),
            F.col("o_totalprice").alias("total"),
        )
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan_table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"), (F.sum(hundredths("value")).cast("double") / 100).alias("total_value"))
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def mobility(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scan_table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            *[
                ratio(
                    F.sum(F.when(F.col("event_type") == kind, hundredths("value"))),
                    F.count_if(F.col("event_type") == kind) * 100,
                ).alias(kind)
                for kind in EVENT_TYPES
            ]
        )
    )


def raw_points(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of the vector counts: each axis adds up every third one, from the first, second and third on."""

    def every_third(first: int):
        picked = F.filter(F.col("embedding").cast("array<double>"), lambda e, i: i % 3 == first)
        return F.round(F.aggregate(picked, F.lit(0.0), lambda total, e: total + e), 9)

    return scan_table(spark, folder, "embeddings").select(
        "vec_id", *[every_third(i).alias(axis) for i, axis in enumerate(("x", "y", "z"))], "label"
    )


POINT_AXES = ["x", "y", "z"]


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Three standardised coordinates per vector, with the given label as a 1-based cluster."""
    scaled = standardise(raw_points(spark, folder), POINT_AXES)
    return rounded(scaled, 6).withColumn("cluster", (F.col("label") + 1)).drop("label")


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).select(
        "vec_id", bands("x", [-0.66, -0.3, 0.2, 0.45], [5, 4, 3, 2, 1]).alias("truth")
    )


def classes(spark: SparkSession, folder: str) -> DataFrame:
    return entity(spark, folder).withColumn(
        "risk", risk_class(F.try_divide("deaths", "cases"), high=RISK_CUTS[0], medium=RISK_CUTS[1])
    )
