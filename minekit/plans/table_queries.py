"""Registered queries: scans, projections, filters, joins, sorts, unions and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from minekit.functions import names
from minekit.functions.expr import first_match_case, ratio, rounded
from minekit.lineage import scratch_path
from minekit.operators import clean, joins, profile, rank
from minekit.plans import views
from minekit.plans.registry import query
from minekit.plans.views import with_views
from minekit.sources.scan import scan_csv, scan_csv_override, scan_table
from minekit.sources.sink import format_table


def _as_csv(spark, df) -> str:
    path = scratch_path(spark)
    df.write.option("header", True).option("nullValue", "NA").csv(path)
    return path


# ---------------------------------------------------------------- scans and sinks


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def q_scan_csv(spark, sf):
    path = _as_csv(spark, scan_table(spark, sf, "customer"))
    return scan_csv(spark, path).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"),
        F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment",
    )


@query("scan_csv_override", """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def q_scan_csv_override(spark, sf):
    path = _as_csv(spark, scan_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    df = scan_csv_override(spark, path, {"o_custkey": T.StringType()})
    return df.select("o_custkey", F.col("o_orderkey").cast("long").alias("o_orderkey"), F.round("o_totalprice", 2).alias("o_totalprice"))


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_scan_table(spark, sf):
    return scan_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("scan_boundary", "SELECT s_nationkey AS region_key, s_name AS vertex, s_acctbal AS value FROM supplier")
def q_scan_boundary(spark, sf):
    return scan_table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("region_key"), F.col("s_name").alias("vertex"), F.col("s_acctbal").alias("value")
    )


@query("format_table", with_views("entity", """
    SELECT entity_key, round(avg_price, 2) AS avg_price, round(avg_order_total, 1) AS avg_order_total,
           printf('%.2f%%', round(deaths * 100.0 / nullif(cases, 0), 2)) AS death_per_case
    FROM entity"""))
def q_format_table(spark, sf):
    df = views.entity(spark, sf).select(
        "entity_key", "avg_price", "avg_order_total", ratio("deaths", "cases").alias("death_per_case")
    )
    return format_table(df, {"avg_price": 2, "avg_order_total": 1}, {"death_per_case": 2})


# ---------------------------------------------------------------- projections


@query("project_named", with_views("entity", "SELECT state, cases, deaths, population FROM entity"))
def q_project_named(spark, sf):
    return views.entity(spark, sf).select("state", "cases", "deaths", "population")


@query("project_drop", "SELECT * EXCLUDE (l_shipdate, l_linestatus, l_tax) FROM lineitem")
def q_project_drop(spark, sf):
    return scan_table(spark, sf, "lineitem").drop("l_shipdate", "l_linestatus", "l_tax")


@query("select_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def q_select_numeric(spark, sf):
    return clean.select_numeric(scan_table(spark, sf, "lineitem"))


@query("select_non_numeric", "SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem")
def q_select_non_numeric(spark, sf):
    return clean.select_non_numeric(scan_table(spark, sf, "lineitem")).withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("select_complete_columns", with_views("sparse", "SELECT order_key, status, priority, total FROM sparse"))
def q_select_complete_columns(spark, sf):
    return clean.complete_columns(views.sparse(spark, sf))


@query("drop_all_null_columns", with_views("sparse", "SELECT * EXCLUDE (unused) FROM sparse"))
def q_drop_all_null_columns(spark, sf):
    return clean.drop_all_null_columns(views.sparse(spark, sf))


@query("select_positional", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_select_positional(spark, sf):
    return clean.select_range(scan_table(spark, sf, "orders"), 1, -2)


@query("reorder_front", "SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def q_reorder_front(spark, sf):
    df = scan_table(spark, sf, "orders").drop("o_orderdate")
    return clean.move_front(df, ["o_totalprice"])


@query("project_like", with_views("entity", "SELECT entity_key, state, cases, deaths, n_orders FROM entity"))
def q_project_like(spark, sf):
    df = views.entity(spark, sf)
    like = df.select("entity_key", "state", "cases").columns
    return clean.project_like(df, like, ["deaths", "cases", "n_orders"])


@query("rename_columns", "SELECT n_nationkey AS state_id, n_name AS state, n_regionkey FROM nation")
def q_rename_columns(spark, sf):
    return scan_table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "state_id", "n_name": "state"})


RATES = {
    "cases_per_1000": ("cases", "population", 1000),
    "deaths_per_1000": ("deaths", "population", 1000),
    "death_per_case": ("deaths", "cases", 1),
}


@query("rate_features", with_views("sparse", """
    SELECT order_key, round(lines / nullif(qty, 0) * 1000, 6) AS cases_per_1000,
           round(returned / nullif(qty, 0) * 10000, 6) AS deaths_per_10000,
           round(returned / nullif(lines, 0), 6) AS death_per_case
    FROM sparse"""))
def q_rate_features(spark, sf):
    df = clean.rates(
        views.sparse(spark, sf),
        {
            "cases_per_1000": ("lines", "qty", 1000),
            "deaths_per_10000": ("returned", "qty", 10000),
            "death_per_case": ("returned", "lines", 1),
        },
    )
    return rounded(df.select("order_key", "cases_per_1000", "deaths_per_10000", "death_per_case"))


@query("encode_factors", """
    WITH s AS (SELECT o_orderstatus AS v, CAST(row_number() OVER (ORDER BY o_orderstatus) AS BIGINT) AS code
               FROM (SELECT DISTINCT o_orderstatus FROM orders)),
         p AS (SELECT o_orderpriority AS v, CAST(row_number() OVER (ORDER BY o_orderpriority) AS BIGINT) AS code
               FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderkey, o_orderstatus, o_orderpriority, s.code AS o_orderstatus_code, p.code AS o_orderpriority_code
    FROM orders JOIN s ON o_orderstatus = s.v JOIN p ON o_orderpriority = p.v""")
def q_encode_factors(spark, sf):
    df = scan_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return clean.encode_factors(df, ["o_orderstatus", "o_orderpriority"])


@query("coerce_numeric", """
    SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus,
           TRY_CAST(right(o_orderpriority, 1) AS DOUBLE) AS o_orderpriority, o_totalprice,
           CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS o_orderdate
    FROM orders""")
def q_coerce_numeric(spark, sf):
    df = scan_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.right("o_orderpriority", F.lit(1)).alias("o_orderpriority"), "o_totalprice", "o_orderdate"
    )
    return clean.coerce_numeric(df)


@query("case_bands", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS band, CASE WHEN l_discount > 0.08 THEN 'deep' WHEN l_discount > 0.04 THEN 'some' END AS cut FROM lineitem")
def q_case_bands(spark, sf):
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    return scan_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        first_match_case([(quantity > 40, "high"), (quantity > 20, "medium")], "low").alias("band"),
        first_match_case([(discount > 0.08, "deep"), (discount > 0.04, "some")]).alias("cut"),
    )


@query("null_out_cells", with_views("entity", "SELECT entity_key, state, CASE WHEN state = 'NATION_7' THEN NULL ELSE cases END AS cases, deaths FROM entity"))
def q_null_out_cells(spark, sf):
    df = views.entity(spark, sf).select("entity_key", "state", "cases", "deaths")
    return clean.null_out(df, F.col("state") == "NATION_7", ["cases"])


@query("normalise_block", with_views("entity", """
    SELECT entity_key, population, round(n_orders / nullif(population, 0), 6) AS n_orders,
           round(sum_price / nullif(population, 0), 6) AS sum_price, round(balance / nullif(population, 0), 6) AS balance
    FROM entity"""))
def q_normalise_block(spark, sf):
    df = views.entity(spark, sf).select("entity_key", "population", "n_orders", "sum_price", "balance")
    return rounded(clean.normalise_block(df, 2, "population"))


@query("star_except", "SELECT * EXCLUDE (s_nationkey), round(s_acctbal * 1000 / 7, 2) AS scaled FROM supplier")
def q_star_except(spark, sf):
    scan_table(spark, sf, "supplier").createOrReplaceTempView("minekit_supplier")
    return spark.sql("SELECT * EXCEPT (s_nationkey), round(s_acctbal * 1000 / 7, 2) AS scaled FROM minekit_supplier")


@query("unpivot_measures", with_views("entity", """
    SELECT deaths, variable, CAST(value AS DOUBLE) AS value FROM (
        SELECT deaths, 'balance' AS variable, balance AS value FROM entity
        UNION ALL SELECT deaths, 'n_orders', n_orders FROM entity
        UNION ALL SELECT deaths, 'population', population FROM entity)"""))
def q_unpivot_measures(spark, sf):
    return clean.unpivot_measures(views.entity(spark, sf), ["deaths"], ["balance", "n_orders", "population"])


@query("table_shape", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def q_table_shape(spark, sf):
    return clean.table_shape(scan_table(spark, sf, "lineitem"))


@query("table_structure", """
    WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5) """ + " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", (SELECT CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(typeof({c})) END FROM customer LIMIT 1) AS type,
        string_agg(CAST({c} AS VARCHAR), ' ' ORDER BY c_custkey) AS first_values FROM f"""
    for i, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), 1)))
def q_table_structure(spark, sf):
    return clean.table_structure(scan_table(spark, sf, "customer"), ["c_custkey"])


@query("scatter_layer", with_views("entity", """
    SELECT cases AS x, deaths AS y, population AS size, segment AS "group",
           CASE WHEN deaths >= 20 THEN name END AS label FROM entity"""))
def q_scatter_layer(spark, sf):
    return clean.scatter_layer(
        views.entity(spark, sf), "cases", "deaths", "population", "name", F.col("deaths") >= 20, group="segment"
    )


# ---------------------------------------------------------------- filters


@query("filter_eq", with_views("entity", "SELECT entity_key, state, cases FROM entity WHERE state = 'NATION_3'"))
def q_filter_eq(spark, sf):
    return views.entity(spark, sf).filter(F.col("state") == "NATION_3").select("entity_key", "state", "cases")


@query("filter_and", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def q_filter_and(spark, sf):
    both = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    return scan_table(spark, sf, "orders").filter(both).select("o_orderkey", "o_totalprice")


@query("filter_in", "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_4', 'NOWHERE')")
def q_filter_in(spark, sf):
    return scan_table(spark, sf, "nation").filter(F.col("n_name").isin("NATION_1", "NATION_4", "NOWHERE")).select("n_nationkey", "n_name")


@query("filter_not_in", with_views("sparse", """
    SELECT order_key, lines FROM sparse WHERE lines IS NULL OR lines NOT IN (1, 2, 3)"""))
def q_filter_not_in(spark, sf):
    return clean.filter_not_in(views.sparse(spark, sf), "lines", [1, 2, 3]).select("order_key", "lines")


@query("filter_threshold", with_views("entity", "SELECT entity_key, cases, deaths FROM entity WHERE cases > 30 AND deaths >= 10 AND deaths < 25"))
def q_filter_threshold(spark, sf):
    kept = (F.col("cases") > 30) & (F.col("deaths") >= 10) & (F.col("deaths") < 25)
    return views.entity(spark, sf).filter(kept).select("entity_key", "cases", "deaths")


@query("filter_ne", with_views("sparse", "SELECT order_key, qty FROM sparse WHERE qty <> 24"))
def q_filter_ne(spark, sf):
    return views.sparse(spark, sf).filter(F.col("qty") != 24).select("order_key", "qty")


@query("filter_not_null", with_views("mobility", "SELECT user_id, day, click FROM mobility WHERE click IS NOT NULL"))
def q_filter_not_null(spark, sf):
    present = F.col("click").isNotNull() & ~F.isnan("click")
    return views.mobility(spark, sf).filter(present).select("user_id", "day", "click")


@query("drop_incomplete", with_views("mobility", "SELECT user_id, day, click, view FROM mobility WHERE click IS NOT NULL AND view IS NOT NULL"))
def q_drop_incomplete(spark, sf):
    return clean.drop_incomplete(views.mobility(spark, sf).select("user_id", "day", "click", "view"))


@query("complete_case_counts", with_views("mobility", """
    SELECT (click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL) AS complete,
           CAST(count(*) AS BIGINT) AS n FROM mobility GROUP BY 1"""))
def q_complete_case_counts(spark, sf):
    return clean.complete_case_counts(views.mobility(spark, sf))


@query("filter_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000004')")
def q_filter_prefix(spark, sf):
    return scan_table(spark, sf, "customer").filter(F.col("c_name").startswith("Customer#00000004")).select("c_custkey", "c_name")


@query("filter_snapshot", with_views("daily", "SELECT user_id, day, n_events FROM daily WHERE day = DATE '2024-12-31' - INTERVAL 365 DAY"))
def q_filter_snapshot(spark, sf):
    return clean.snapshot(views.daily(spark, sf), "day", "2024-12-31", 365).select("user_id", "day", "n_events")


@query("filter_above_quantile", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)")
def q_filter_above_quantile(spark, sf):
    df = scan_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return profile.filter_above_quantile(df, "l_extendedprice", 0.95)


@query("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 0 AND 40000")
def q_filter_between(spark, sf):
    return scan_table(spark, sf, "orders").filter(F.col("o_totalprice").between(0, 40000)).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- joins


@query("left_join_key", with_views("mobility entity", """
    SELECT m.user_id, m.day, m.click, e.cases, e.deaths FROM mobility m LEFT JOIN entity e ON m.user_id = e.entity_key + 100"""))
def q_left_join_key(spark, sf):
    census = views.entity(spark, sf).select((F.col("entity_key") + 100).alias("user_id"), "cases", "deaths")
    return views.mobility(spark, sf).select("user_id", "day", "click").join(census, "user_id", "left")


@query("natural_left_join", with_views("entity", """
    SELECT n_name AS state, s_name AS vertex, s_acctbal AS lat, sum_cases
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN (SELECT state, CAST(sum(cases) AS BIGINT) AS sum_cases FROM entity WHERE state <> 'NATION_0' GROUP BY state) e ON e.state = n_name"""))
def q_natural_left_join(spark, sf):
    nation = scan_table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
    vertices = joins.natural_join(scan_table(spark, sf, "supplier"), nation, "inner").select(
        "state", F.col("s_name").alias("vertex"), F.col("s_acctbal").alias("lat")
    )
    metrics = views.entity(spark, sf).filter(F.col("state") != "NATION_0").groupBy("state").agg(F.sum("cases").alias("sum_cases"))
    return joins.natural_join(vertices, metrics)


@query("natural_left_join_multi", """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
         r AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A')
    SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, r.l_partkey
    FROM l LEFT JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber""")
def q_natural_left_join_multi(spark, sf):
    lines = scan_table(spark, sf, "lineitem")
    left = lines.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_suppkey")
    right = lines.filter(F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.natural_join(left, right)


@query("inner_join_on", "SELECT o_orderkey, o_custkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def q_inner_join_on(spark, sf):
    orders = scan_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = scan_table(spark, sf, "customer").select("c_custkey", "c_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")


SITES_SQL = """
    WITH sites AS (SELECT c_nationkey AS area, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_sites
                   FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
                   GROUP BY c_nationkey),
         population AS (SELECT c_nationkey AS area, round(sum(o_totalprice)) AS total_population
                        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey)
    SELECT n_sites, total_population, round(n_sites * 1000000 / total_population, 4) AS sites_per_million
    FROM sites JOIN population USING (area) ORDER BY sites_per_million"""


def site_density(spark, sf):
    """Distinct suppliers per customer area against the area's total, each aggregated before they meet."""
    area = scan_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    orders = scan_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    owned = orders.join(area, F.col("o_custkey") == F.col("c_custkey"))
    lines = scan_table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    sites = (
        lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("area")
        .agg(F.countDistinct("l_suppkey").alias("n_sites"))
    )
    population = owned.groupBy("area").agg(F.round(F.sum("o_totalprice")).alias("total_population"))
    return sites.join(population, "area")


@query("inner_join_using", SITES_SQL)
def q_inner_join_using(spark, sf):
    density = F.round(ratio(F.col("n_sites") * 1000000, "total_population"), 4)
    return site_density(spark, sf).drop("area").withColumn("sites_per_million", density).orderBy("sites_per_million")


@query("lookup_join", """
    SELECT s_name, n_regionkey AS code FROM
    (SELECT s_name, 'nation_' || CAST(s_nationkey + 3 AS VARCHAR) AS place FROM supplier)
    LEFT JOIN nation ON lower(n_name) = place""")
def q_lookup_join(spark, sf):
    places = scan_table(spark, sf, "supplier").select(
        "s_name", F.concat(F.lit("nation_"), (F.col("s_nationkey") + 3).cast("string")).alias("place")
    )
    return joins.lookup_join(places, "place", scan_table(spark, sf, "nation"), "n_name", "n_regionkey", "code").select("s_name", "code")


@query("attach_by_key", with_views("points truth", "SELECT vec_id, x, y, z, truth FROM points JOIN truth USING (vec_id)"))
def q_attach_by_key(spark, sf):
    return joins.attach_by_key(views.points(spark, sf).drop("cluster"), views.truth(spark, sf), "vec_id")


@query("join_coverage", """
    WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1),
         b AS (SELECT s_suppkey + 5 AS k, count(*) AS n FROM supplier GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS suppkey, CAST(coalesce(a.n, 0) AS BIGINT) AS n_left, CAST(coalesce(b.n, 0) AS BIGINT) AS n_right,
           CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' WHEN b.n > 1 THEN 'right_repeats' END AS status
    FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS NULL OR b.n IS NULL OR b.n > 1""")
def q_join_coverage(spark, sf):
    left = scan_table(spark, sf, "lineitem").filter(F.col("l_quantity") > 48).select(F.col("l_suppkey").alias("suppkey"))
    right = scan_table(spark, sf, "supplier").select((F.col("s_suppkey") + 5).alias("suppkey"))
    return joins.join_coverage(left, right, ["suppkey"])


# ---------------------------------------------------------------- sorts, top-k, unions


@query("sort_desc", with_views("sparse", "SELECT order_key, qty FROM sparse ORDER BY qty DESC NULLS LAST, order_key"))
def q_sort_desc(spark, sf):
    return rank.sort_desc(views.sparse(spark, sf).select("order_key", "qty"), "qty", "order_key")


@query("sort_asc", with_views("sparse", "SELECT order_key, qty FROM sparse ORDER BY qty ASC NULLS LAST, order_key"))
def q_sort_asc(spark, sf):
    return rank.sort_asc(views.sparse(spark, sf).select("order_key", "qty"), "qty", "order_key")


@query("top_n", with_views("entity", "SELECT entity_key, cases FROM entity ORDER BY cases DESC, entity_key LIMIT 10"))
def q_top_n(spark, sf):
    return rank.top_n(views.entity(spark, sf).select("entity_key", "cases"), "cases", "entity_key", 10)


@query("best_worst", with_views("entity", """
    WITH r AS (SELECT entity_key, round(cases / nullif(population, 0) * 1000, 6) AS cases_per_1000,
                 round(deaths / nullif(population, 0) * 1000, 6) AS deaths_per_1000,
                 round(deaths / nullif(cases, 0), 6) AS death_per_case FROM entity),
    l AS (SELECT entity_key, 'cases_per_1000' AS metric, cases_per_1000 AS value FROM r
          UNION ALL SELECT entity_key, 'deaths_per_1000', deaths_per_1000 FROM r
          UNION ALL SELECT entity_key, 'death_per_case', death_per_case FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, entity_key) AS w,
                 row_number() OVER (PARTITION BY metric ORDER BY value, entity_key) AS b FROM l WHERE value IS NOT NULL)
    SELECT metric, entity_key, value, 'worst' AS side FROM o WHERE w <= 3
    UNION ALL SELECT metric, entity_key, value, 'best' FROM o WHERE b <= 3"""))
def q_best_worst(spark, sf):
    df = rounded(clean.rates(views.entity(spark, sf), RATES), 6, list(RATES))
    return rank.best_worst(df, "entity_key", list(RATES), 3)


@query("union_labelled", with_views("points truth", """
    SELECT 'given' AS method, CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 2
    UNION ALL SELECT 'truth', CAST(truth AS BIGINT), CAST(count(*) AS BIGINT) FROM truth GROUP BY 2"""))
def q_union_labelled(spark, sf):
    given = views.points(spark, sf).select(F.col("cluster").cast("long").alias("cluster"))
    other = views.truth(spark, sf).select(F.col("truth").cast("long").alias("cluster"))
    count = F.count(F.lit(1)).alias("n")
    return rank.union_labelled(
        {"given": given.groupBy("cluster").agg(count), "truth": other.groupBy("cluster").agg(count)}
    )


# ---------------------------------------------------------------- names


@query("normalise_name", r"SELECT p_partkey, regexp_replace(lower(p_name), '\s+widget\s*$', '') AS name FROM part")
def q_normalise_name(spark, sf):
    return scan_table(spark, sf, "part").select("p_partkey", names.strip_suffix("p_name", "Widget").alias("name"))


def _nested(column: str, rules) -> str:
    """The rule fold as nested first-match replacements of the other engine."""
    out = column
    for pattern, replacement in rules:
        out = "regexp_replace({}, '{}', '{}')".format(out, pattern.replace("'", "''"), replacement.replace("'", "''"))
    return out


# Wordings that put real part names into the shapes the rules look for
NAME_SHAPES = ["{} parish", "st. {} de {}", "city of {}", "la {} de la {}", "o'{}'s {}", "city and county of {}"]


@query("normalise_name_rules", """
    WITH shaped AS (SELECT p_partkey, 1 AS side, CASE WHEN p_size <= 8 THEN lower(p_name) || ' parish'
        WHEN p_size <= 16 THEN 'st. ' || lower(p_name) || ' de ' || lower(p_name) WHEN p_size <= 24 THEN 'city of ' || lower(p_name)
        WHEN p_size <= 32 THEN 'la ' || lower(p_name) || ' de la ' || lower(p_name) WHEN p_size <= 40 THEN 'o''' || lower(p_name) || '''s ' || lower(p_name)
        ELSE 'city and county of ' || lower(p_name) END AS place FROM part)
    SELECT p_partkey, """ + _nested("place", names.ENTITY_NAME_RULES) + """ AS entity_name,
           """ + _nested("place", names.BOUNDARY_NAME_RULES) + """ AS boundary_name FROM shaped""")
def q_normalise_name_rules(spark, sf):
    word = F.lower("p_name")
    place = None
    for i, wording in enumerate(NAME_SHAPES):
        text = F.concat(*[p for piece in wording.split("{}") for p in (F.lit(piece), word)][:-1])
        reached = F.col("p_size") <= 8 * (i + 1) if i + 1 < len(NAME_SHAPES) else F.lit(True)
        place = F.when(reached, text) if place is None else place.when(reached, text)
    return scan_table(spark, sf, "part").select("p_partkey", place.alias("place")).select(
        "p_partkey",
        names.apply_rules("place", names.ENTITY_NAME_RULES).alias("entity_name"),
        names.apply_rules("place", names.BOUNDARY_NAME_RULES).alias("boundary_name"),
    )


