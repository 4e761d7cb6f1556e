"""Registered queries: aggregations and descriptive profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.functions.expr import rounded
from minekit.operators import clean, profile, rank
from minekit.operators.trend import event_markers
from minekit.plans import views
from minekit.plans.registry import query
from minekit.plans.views import with_views
from minekit.sources.scan import scan_table


@query("group_means", with_views("sparse", """
    SELECT status, round(avg(qty), 6) AS avg_qty, round(avg(returned), 6) AS avg_returned,
           CAST(count(*) FILTER (WHERE qty IS NULL) AS BIGINT) AS n_null_qty,
           CAST(count(*) FILTER (WHERE returned IS NULL) AS BIGINT) AS n_null_returned
    FROM sparse GROUP BY status"""))
def q_group_means(spark, sf):
    return rounded(profile.group_means(views.sparse(spark, sf), "status", ["qty", "returned"]))


@query("class_share_by_group", with_views("classes", """
    SELECT state, round(avg(CASE WHEN risk = 'low' THEN 1.0 ELSE 0 END), 6) AS low_pct,
           round(avg(CASE WHEN risk = 'medium' THEN 1.0 ELSE 0 END), 6) AS medium_pct,
           round(avg(CASE WHEN risk = 'high' THEN 1.0 ELSE 0 END), 6) AS high_pct
    FROM classes GROUP BY state ORDER BY low_pct DESC, state"""))
def q_class_share_by_group(spark, sf):
    shares = profile.class_shares(views.classes(spark, sf), "state", "risk", ["low", "medium", "high"])
    return rank.sort_desc(rounded(shares), "low_pct", "state")


@query("count_distinct_by_group", "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3")
def q_count_distinct_by_group(spark, sf):
    # distinct pairs first, so a hot group is spread over its suppliers before it is counted
    return (
        scan_table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus", "l_linenumber")
        .agg(F.countDistinct("l_suppkey").alias("n"))
    )


@query("prefix_rollup", "SELECT left(c_name, 16) AS prefix, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def q_prefix_rollup(spark, sf):
    return (
        scan_table(spark, sf, "customer")
        .groupBy(F.left("c_name", F.lit(16)).alias("prefix"))
        .agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    )


@query("value_counts", with_views("sparse", "SELECT lines, CAST(count(*) AS BIGINT) AS n FROM sparse WHERE lines IS NOT NULL GROUP BY lines"))
def q_value_counts(spark, sf):
    return profile.value_counts(views.sparse(spark, sf), "lines")


@query("contingency_table", with_views("points truth", """
    WITH l AS (SELECT unnest(range(1, 11))::INTEGER AS v),
    c AS (SELECT cluster, truth, count(*) AS n FROM points JOIN truth USING (vec_id) GROUP BY 1, 2)
    SELECT a.v AS cluster, b.v AS truth, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM l a CROSS JOIN l b LEFT JOIN c ON c.cluster = a.v AND c.truth = b.v"""))
def q_contingency_table(spark, sf):
    both = views.points(spark, sf).join(views.truth(spark, sf), "vec_id")
    return profile.contingency_table(both, "cluster", "truth", range(1, 11))


@query("group_mean_nonnull", with_views("sparse", "SELECT lines, round(avg(total), 4) AS mean_total FROM sparse WHERE lines IS NOT NULL GROUP BY lines"))
def q_group_mean_nonnull(spark, sf):
    df = views.sparse(spark, sf).filter(F.col("lines").isNotNull())
    return df.groupBy("lines").agg(F.round(F.avg("total"), 4).alias("mean_total"))


def _union(view: str, cols, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c, view=view) for c in cols)


SUMMARY_SQL = """SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
    round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(avg({c}), 4) AS mean,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {view}"""
SPARSE_NUMBERS = ["lines", "returned", "qty", "price", "total"]


@query("summary_numeric", with_views("sparse", _union("sparse", SPARSE_NUMBERS, SUMMARY_SQL)))
def q_summary_numeric(spark, sf):
    return rounded(profile.summary_numeric(views.sparse(spark, sf), SPARSE_NUMBERS), 4)


@query("summary_dates", _union("(SELECT CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS shipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)",
    ["ordered", "shipped"], """SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
    min({c}) AS min, DATE '1970-01-01' + CAST(floor(quantile_cont(CAST({c} - DATE '1970-01-01' AS DOUBLE), 0.25)) AS INTEGER) AS q1,
    DATE '1970-01-01' + CAST(floor(quantile_cont(CAST({c} - DATE '1970-01-01' AS DOUBLE), 0.5)) AS INTEGER) AS median,
    DATE '1970-01-01' + CAST(floor(avg({c} - DATE '1970-01-01')) AS INTEGER) AS mean,
    DATE '1970-01-01' + CAST(floor(quantile_cont(CAST({c} - DATE '1970-01-01' AS DOUBLE), 0.75)) AS INTEGER) AS q3,
    max({c}) AS max, CAST(max({c}) - min({c}) AS BIGINT) AS range_days FROM {view}"""))
def q_summary_dates(spark, sf):
    lines = scan_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("shipped"))
    orders = scan_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ordered"))
    both = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return profile.summary_dates(both, ["ordered", "shipped"])


@query("summary_dates_by_group", """
    SELECT o_orderpriority, 'o_orderdate' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_missing, CAST(min(o_orderdate) AS DATE) AS min,
           CAST(quantile_cont(CAST(o_orderdate AS DATE), 0.25) AS DATE) AS q1, CAST(quantile_cont(CAST(o_orderdate AS DATE), 0.5) AS DATE) AS median,
           DATE '1970-01-01' + CAST(floor(avg(CAST(o_orderdate AS DATE) - DATE '1970-01-01')) AS INTEGER) AS mean,
           CAST(quantile_cont(CAST(o_orderdate AS DATE), 0.75) AS DATE) AS q3, CAST(max(o_orderdate) AS DATE) AS max,
           CAST(CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) AS BIGINT) AS range_days
    FROM orders GROUP BY o_orderpriority""")
def q_summary_dates_by_group(spark, sf):
    return profile.summary_dates(scan_table(spark, sf, "orders"), ["o_orderdate"], ["o_orderpriority"])


@query("summary_categorical", _union("lineitem", ["l_returnflag", "l_linestatus"], """
    SELECT '{c}' AS "column", {c} AS level, CAST(count(*) AS BIGINT) AS n,
           round(count(*) / (SELECT count(*) FROM {view}), 6) AS share FROM {view} GROUP BY {c}"""))
def q_summary_categorical(spark, sf):
    return rounded(profile.summary_categorical(scan_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("summary_table", with_views("entity", _union("entity", ["cases", "balance"], """
    SELECT '{c}' AS variable, CAST(NULL AS VARCHAR) AS level, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean,
           round(stddev_samp({c}), 4) AS sd, round(CAST(min({c}) AS DOUBLE), 4) AS min,
           round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS pctl25, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS pctl75,
           round(CAST(max({c}) AS DOUBLE), 4) AS max, CAST(NULL AS DOUBLE) AS percent FROM {view}""")
    + """ UNION ALL SELECT 'segment', segment, CAST(count(*) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL,
           round(count(*) * 100.0 / (SELECT count(*) FROM entity), 4) FROM entity GROUP BY segment"""))
def q_summary_table(spark, sf):
    return rounded(profile.summary_table(views.entity(spark, sf), ["cases", "balance"], ["segment"]), 4)


STATS = ["cases", "population", "balance", "avg_price"]
STATS_SQL = """SELECT '{c}' AS "column", round(median(CAST({c} AS DOUBLE)), 4) AS median, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}) / sqrt(count({c})), 4) AS se_mean, round(var_samp({c}), 2) AS variance,
    round(stddev_samp({c}), 4) AS sd, round(stddev_samp({c}) / avg({c}), 4) AS coef_var FROM {view}"""


@query("descriptive_stats", with_views("entity", _union("entity", STATS, STATS_SQL)))
def q_descriptive_stats(spark, sf):
    stats = profile.descriptive_stats(views.entity(spark, sf), STATS).drop("ci_mean")
    return rounded(rounded(stats, 4, ["median", "mean", "se_mean", "sd", "coef_var"]), 2, ["variance"])


@query("descriptive_interval")
def q_descriptive_interval(spark, sf):
    return profile.descriptive_stats(views.entity(spark, sf), STATS).select("column", "mean", "se_mean", "ci_mean")


@query("profile_intro", with_views("sparse", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(9 AS BIGINT) AS n_cols, round(200 / 9, 4) AS pct_discrete,
           round(600 / 9, 4) AS pct_continuous, round(100 / 9, 4) AS pct_all_missing, CAST(0 AS DOUBLE) AS pct_complete_rows,
           round(100.0 * sum((lines IS NULL)::INT + (returned IS NULL)::INT + (qty IS NULL)::INT + (price IS NULL)::INT + 1) / (count(*) * 9), 4) AS pct_missing_cells
    FROM sparse"""))
def q_profile_intro(spark, sf):
    return rounded(profile.profile_intro(views.sparse(spark, sf)), 4)


QUANTILE_PROBS = [0.05, 0.25, 0.5, 0.9, 0.95]


@query("quantiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, CAST(count({c}) AS BIGINT) AS n, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"""
    for c in ("l_extendedprice", "l_quantity") for p in QUANTILE_PROBS))
def q_quantiles(spark, sf):
    df = scan_table(spark, sf, "lineitem")
    return rounded(profile.quantile_table(df, ["l_extendedprice", "l_quantity"], QUANTILE_PROBS), 6, ["value"])


@query("column_sd", _union("lineitem", ["l_quantity", "l_extendedprice", "l_discount"],
    """SELECT '{c}' AS "column", round(stddev_samp({c}), 6) AS sd FROM {view}"""))
def q_column_sd(spark, sf):
    return rounded(profile.column_sd(scan_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("null_profile", with_views("sparse", _union("sparse",
    ["order_key", "status", "priority", "lines", "returned", "qty", "price", "unused", "total"],
    """SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, CAST(count(*) AS BIGINT) AS n_rows FROM {view}""")))
def q_null_profile(spark, sf):
    return clean.null_profile(views.sparse(spark, sf))


@query("histogram_bins", """
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
         b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, lo, (hi - lo) / 20 AS w FROM orders, e)
    SELECT bin, round(lo + bin * w, 4) AS bin_start, round(lo + (bin + 1) * w, 4) AS bin_end, CAST(count(*) AS BIGINT) AS n
    FROM b GROUP BY bin, lo, w""")
def q_histogram_bins(spark, sf):
    return rounded(profile.histogram_bins(scan_table(spark, sf, "orders"), "o_totalprice", 20), 4)


def _box_sql(view: str, cols, by: str = "") -> str:
    key = f"{by}, " if by else ""
    link = f"AND v.{by} IS NOT DISTINCT FROM f.{by}" if by else ""
    picked = f"v.{by}, " if by else ""
    long = " UNION ALL ".join(
        f"""SELECT {key}'{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM {view} WHERE {c} IS NOT NULL""" for c in cols
    )
    return f"""v AS ({long}),
        f AS (SELECT {key}"column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
              FROM v GROUP BY {key}"column"),
        j AS (SELECT {picked}v."column", value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS kept
              FROM v JOIN f ON v."column" = f."column" {link})"""


BOX_SELECT = """round(min(value) FILTER (WHERE kept), 4) AS whisker_low, round(min(q1), 4) AS q1, round(min(median), 4) AS median,
    round(min(q3), 4) AS q3, round(max(value) FILTER (WHERE kept), 4) AS whisker_high, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS n_outliers"""
BOX_COLS = ["cases", "avg_price", "avg_order_total", "balance"]


@query("box_stats", with_views("entity", f"""WITH {_box_sql("entity", BOX_COLS)}
    SELECT "column", {BOX_SELECT} FROM j GROUP BY "column" """))
def q_box_stats(spark, sf):
    return rounded(profile.box_stats(views.entity(spark, sf), BOX_COLS), 4)


@query("box_stats_grouped", with_views("entity", f"""WITH {_box_sql("entity", ["cases", "avg_price"], "segment")}
    SELECT segment, "column", {BOX_SELECT} FROM j GROUP BY segment, "column" """))
def q_box_stats_grouped(spark, sf):
    return rounded(profile.box_stats(views.entity(spark, sf), ["cases", "avg_price"], ["segment"]), 4)


def _hinge_sql(cols) -> str:
    """Hinges from the ordered values: the mean of the two values around a half-integer depth."""
    def at(depth):
        return f"(l[CAST(floor({depth}) AS INTEGER)] + l[CAST(ceil({depth}) AS INTEGER)]) / 2"

    lists = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", list(CAST({c} AS DOUBLE) ORDER BY {c}) AS l, count({c}) AS n FROM entity""" for c in cols
    )
    return f"""WITH v AS ({lists}), d AS (SELECT *, floor((n + 3) / 2) / 2 AS depth FROM v),
        f AS (SELECT "column", l, {at("depth")} AS q1, {at("(n + 1) / 2")} AS median, {at("n + 1 - depth")} AS q3 FROM d),
        j AS (SELECT "column", q1, median, q3, unnest(l) AS value FROM f),
        k AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS kept FROM j)"""


@query("box_stats_hinges", with_views("entity", f"""{_hinge_sql(BOX_COLS)} SELECT "column", {BOX_SELECT} FROM k GROUP BY "column" """))
def q_box_stats_hinges(spark, sf):
    return rounded(profile.box_stats(views.entity(spark, sf), BOX_COLS, hinges=True), 4)


@query("box_outliers", with_views("entity", " UNION ALL ".join(
    f"""SELECT entity_key, '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM entity,
        (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM entity)
        WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)""" for c in BOX_COLS)))
def q_box_outliers(spark, sf):
    return profile.box_outliers(views.entity(spark, sf), "entity_key", BOX_COLS)


@query("arg_max", """
    SELECT label AS best_label, n FROM (SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label)
    ORDER BY n DESC, label LIMIT 1""")
def q_arg_max(spark, sf):
    counts = scan_table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return profile.arg_max(counts, "label", "n")


SUMMARY_BY_SQL = SUMMARY_SQL.replace("SELECT", "SELECT status, ", 1) + " GROUP BY status"


@query("summary_by_group", with_views("sparse", _union("sparse", ["qty", "price"], SUMMARY_BY_SQL)))
def q_summary_by_group(spark, sf):
    return rounded(profile.summary_numeric(views.sparse(spark, sf), ["qty", "price"], ["status"]), 4)


@query("row_reduce", with_views("mobility", """
    SELECT user_id, day, round(coalesce(click, 0) + coalesce(error, 0) + coalesce(purchase, 0) + coalesce(signup, 0) + coalesce(view, 0), 6) AS row_sum,
           greatest(click, error, purchase, signup, view) AS row_max FROM mobility"""))
def q_row_reduce(spark, sf):
    cols = [F.col(c) for c in views.EVENT_TYPES]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return views.mobility(spark, sf).select("user_id", "day", F.round(total, 6).alias("row_sum"), F.greatest(*cols).alias("row_max"))


@query("boundary_centroid", """
    SELECT upper(left(lower(n_name), 1)) || substring(lower(n_name), 2) AS area, round(avg(s_acctbal), 6) AS lat, round(avg(s_suppkey), 6) AS long
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def q_boundary_centroid(spark, sf):
    nation = scan_table(spark, sf, "nation").select("n_nationkey", "n_name")
    vertices = scan_table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        vertices.groupBy(F.initcap("n_name").alias("area"))
        .agg(F.round(F.avg("s_acctbal"), 6).alias("lat"), F.round(F.avg("s_suppkey"), 6).alias("long"))
    )


MARKERS = [("2024-01-08", "week two"), ("2024-01-15", "mid month"), ("2024-01-27", "closing days")]
MARKER_SQL = "CASE " + " ".join(f"WHEN day >= DATE '{d}' THEN '{n}'" for d, n in sorted(MARKERS, reverse=True)) + " END"


@query("event_markers", with_views("daily", f"""
    SELECT user_id, day, {MARKER_SQL} AS marker, 'n_events' AS measure, CAST(n_events AS DOUBLE) AS value FROM daily
    UNION ALL SELECT user_id, day, {MARKER_SQL}, 'total_value', total_value FROM daily"""))
def q_event_markers(spark, sf):
    return event_markers(views.daily(spark, sf), "day", MARKERS, ["user_id"], ["n_events", "total_value"])


