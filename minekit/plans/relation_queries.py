"""Registered queries: scaling, correlation, trends, linear models and principal components."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from minekit.functions.expr import ratio, rounded
from minekit.operators import corr, reduce, trend
from minekit.plans import views
from minekit.plans.registry import query
from minekit.plans.views import ENTITY_FEATURES, with_views
from minekit.sources.scan import scan_table

SCALED = ["cases", "deaths", "balance", "avg_price"]


def _scaled_sql(cols, centre: bool) -> str:
    parts = []
    for c in cols:
        top = f"{c} - (SELECT avg({c}) FROM entity)" if centre else c
        parts.append(f"round(({top}) / (SELECT stddev_samp({c}) FROM entity), 6) AS {c}")
    return f"SELECT entity_key, {', '.join(parts)} FROM entity"


@query("standardise", with_views("entity", _scaled_sql(SCALED, True)))
def q_standardise(spark, sf):
    df = views.entity(spark, sf).select("entity_key", *SCALED)
    return rounded(corr.standardise(df, SCALED))


@query("scale_only", with_views("entity", _scaled_sql(SCALED, False)))
def q_scale_only(spark, sf):
    df = views.entity(spark, sf).select("entity_key", *SCALED)
    return rounded(corr.scale_only(df, SCALED))


@query("zscore_outliers", with_views("entity", "SELECT entity_key, cases, deaths, balance, avg_price FROM entity WHERE NOT ("
    + " OR ".join(f"abs({c} - (SELECT avg({c}) FROM entity)) / (SELECT stddev_samp({c}) FROM entity) > 3" for c in SCALED) + ")"))
def q_zscore_outliers(spark, sf):
    return corr.zscore_outliers(views.entity(spark, sf).select("entity_key", *SCALED), SCALED)


def _pairs_sql(view: str, cols, n: bool = False, nulls: bool = False, by: str = "") -> str:
    """Upper-triangle correlations, one SELECT per pair."""
    out = []
    for a, b in combinations(cols, 2):
        r = f"corr({a}, {b})"
        if nulls:
            r = f"CASE WHEN count(*) = regr_count({a}, {b}) THEN {r} END"
        count = f", CAST(regr_count({a}, {b}) AS BIGINT) AS n" if n else ""
        key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
        out.append(f"SELECT {key}'{a}' AS var_i, '{b}' AS var_j, {r} AS r{count} FROM {view}{group}")
    return " UNION ALL ".join(out)


def _full_sql(upper: str, cols) -> str:
    diagonal = " UNION ALL ".join(f"SELECT '{c}' AS var_i, '{c}' AS var_j, 1.0::DOUBLE AS r" for c in cols)
    return f"""WITH u AS ({upper}), m AS (SELECT var_i, var_j, r FROM u UNION ALL SELECT var_j, var_i, r FROM u UNION ALL {diagonal})"""


MATRIX = ["cases", "deaths", "population", "balance", "avg_price", "sum_price"]


@query("correlation_matrix", with_views("sparse", _full_sql(
    _pairs_sql("sparse", ["total", "lines", "qty", "order_key"], nulls=True), ["total", "lines", "qty", "order_key"])
    + " SELECT var_i, var_j, round(r, 6) AS r FROM m"))
def q_correlation_matrix(spark, sf):
    return rounded(corr.correlation_matrix(views.sparse(spark, sf), ["total", "lines", "qty", "order_key"]))


# five measures of each kind of event on a day, a constant and a column without values: 27 columns, most with gaps
DAY_MEASURES = {"avg": "sum(cents) FILTER (WHERE {k}) / (count(*) FILTER (WHERE {k}) * 100.0::DOUBLE)", "n": "count(*) FILTER (WHERE {k})",
    "top": "max(value) FILTER (WHERE {k})", "low": "min(value) FILTER (WHERE {k})", "total": "sum(cents) FILTER (WHERE {k}) / 100.0::DOUBLE"}
DAY_COLUMNS = [f"{m}_{kind}" for kind in views.EVENT_TYPES for m in DAY_MEASURES] + ["always", "never"]
DAY_SQL = "days AS (SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(
    f"CAST({e.format(k=f"event_type = '{kind}'")} AS DOUBLE) AS {m}_{kind}" for kind in views.EVENT_TYPES for m, e in DAY_MEASURES.items()
) + """, 1.5::DOUBLE AS always, CAST(NULL AS DOUBLE) AS never
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) GROUP BY user_id, CAST(ts AS DATE))"""


def _gappy_pairs_sql(complete: bool) -> str:
    """One SELECT per pair; no entry where a column is constant over the rows that count."""
    out = []
    for a, b in combinations(DAY_COLUMNS, 2):
        both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        varies = f"min({a}) {both} < max({a}) {both} AND min({b}) {both} < max({b}) {both}"
        whole = f" AND regr_count({a}, {b}) = count(*)" if complete else ""
        out.append(f"SELECT '{a}' AS var_i, '{b}' AS var_j, CASE WHEN {varies}{whole} THEN corr({a}, {b}) END AS r, CAST(regr_count({a}, {b}) AS BIGINT) AS n FROM days")
    return " UNION ALL ".join(out)


def _days(spark, sf):
    cents, out = F.round(F.col("value") * 100).cast("long"), []
    for kind in views.EVENT_TYPES:
        own = F.col("event_type") == kind
        total, n = F.sum(F.when(own, cents)), F.count_if(own)
        measures = {"avg": ratio(total, n * 100), "n": n.cast("double"), "top": F.max(F.when(own, F.col("value"))),
            "low": F.min(F.when(own, F.col("value"))), "total": total / F.lit(100.0)}
        out += [c.alias(f"{m}_{kind}") for m, c in measures.items()]
    days = scan_table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(*out)
    return days.withColumns({"always": F.lit(1.5), "never": F.lit(None).cast("double")})


@query("correlation_wide", f"""WITH {DAY_SQL}, {_full_sql(f"SELECT var_i, var_j, r FROM ({_gappy_pairs_sql(True)})", DAY_COLUMNS)[5:]}
    SELECT var_i, var_j, round(r, 6) + 0 AS r FROM m""")
def q_correlation_wide(spark, sf):
    """More than 24 columns, with gaps, a constant one and one without values."""
    return rounded(corr.correlation_matrix(_days(spark, sf), DAY_COLUMNS))


@query("correlation_wide_pairs", f"""WITH {DAY_SQL} SELECT var_i, var_j, round(r, 6) + 0 AS r, n FROM ({_gappy_pairs_sql(False)})""")
def q_correlation_wide_pairs(spark, sf):
    """The same table, each pair over the rows where both columns are present."""
    return rounded(corr.correlation_pairs(_days(spark, sf), DAY_COLUMNS))


@query("correlation_complete", with_views("sparse", """WITH c AS (SELECT lines, returned, qty, price, total FROM sparse
    WHERE lines IS NOT NULL AND returned IS NOT NULL AND qty IS NOT NULL AND price IS NOT NULL), """
    + _full_sql(_pairs_sql("c", ["lines", "returned", "qty", "price", "total"]), ["lines", "returned", "qty", "price", "total"])[5:]
    + " SELECT var_i, var_j, round(r, 6) AS r FROM m"))
def q_correlation_complete(spark, sf):
    return rounded(corr.correlation_complete(views.sparse(spark, sf), ["lines", "returned", "qty", "price", "total"]))


@query("correlation_test", with_views("mobility", "WITH u AS (" + _pairs_sql("mobility", views.EVENT_TYPES, n=True) + """)
    SELECT var_i, var_j, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM u"""))
def q_correlation_test(spark, sf):
    return rounded(corr.correlation_test(views.mobility(spark, sf), views.EVENT_TYPES).drop("p"))


@query("correlation_p_values")
def q_correlation_p_values(spark, sf):
    return corr.correlation_test(views.mobility(spark, sf), views.EVENT_TYPES).select("var_i", "var_j", "p")


@query("correlation_significant", with_views("entity", "WITH u AS (" + _pairs_sql("entity", MATRIX, n=True) + """)
    SELECT var_i, var_j, round(r, 6) AS r FROM u WHERE abs(r) * sqrt((n - 2) / (1 - r * r)) > 1.96"""))
def q_correlation_significant(spark, sf):
    return rounded(corr.correlation_significant(views.entity(spark, sf), MATRIX, 1.96))


@query("correlation_order")
def q_correlation_order(spark, sf):
    return corr.correlation_order(views.entity(spark, sf), MATRIX)


@query("redundant_by_mean_corr", with_views("entity", _full_sql(_pairs_sql("entity", MATRIX), MATRIX) + """,
    a AS (SELECT var_i, avg(abs(r)) AS mean_abs FROM m WHERE var_i <> var_j GROUP BY var_i)
    SELECT DISTINCT CASE WHEN x.mean_abs >= y.mean_abs THEN m.var_i ELSE m.var_j END AS name,
           round(greatest(x.mean_abs, y.mean_abs), 6) AS mean_abs_r
    FROM m JOIN a x ON m.var_i = x.var_i JOIN a y ON m.var_j = y.var_i WHERE m.var_i <> m.var_j AND abs(r) > 0.9"""))
def q_redundant_by_mean_corr(spark, sf):
    return rounded(corr.redundant_by_mean_corr(views.entity(spark, sf), MATRIX, 0.9))


@query("collinear_columns", with_views("entity", "WITH u AS (" + _pairs_sql("entity", MATRIX) + """)
    SELECT var_i AS name, var_j AS because_of, round(r, 6) AS r FROM u WHERE r > 0.95"""))
def q_collinear_columns(spark, sf):
    return rounded(corr.collinear_columns(views.entity(spark, sf), MATRIX, 0.95))


@query("drop_collinear", with_views("entity", "SELECT entity_key, deaths, population, balance, avg_price, sum_price FROM entity"))
def q_drop_collinear(spark, sf):
    df = views.entity(spark, sf).select("entity_key", *MATRIX)
    return corr.drop_collinear(df, MATRIX, 0.95)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DUMMIES = ["cases", "balance"] + [f"segment_{s}" for s in SEGMENTS]


@query("correlation_dummies", with_views("entity", "WITH d AS (SELECT cases, balance, "
    + ", ".join(f"CASE WHEN segment = '{s}' THEN 1.0::DOUBLE ELSE 0 END AS segment_{s}" for s in SEGMENTS) + " FROM entity), "
    + _full_sql(_pairs_sql("d", DUMMIES), DUMMIES)[5:] + " SELECT var_i, var_j, round(r, 6) AS r FROM m"))
def q_correlation_dummies(spark, sf):
    return rounded(corr.correlation_dummies(views.entity(spark, sf), ["cases", "balance"], ["segment", "name"]))


@query("pairwise_correlation", with_views("points", "WITH u AS (" + _pairs_sql("points", ["x", "y", "z"], n=True, by="cluster")
    + ") SELECT cluster, var_i, var_j, round(r, 6) AS r, n FROM u"))
def q_pairwise_correlation(spark, sf):
    return rounded(corr.correlation_pairs(views.points(spark, sf), ["x", "y", "z"], ["cluster"]))


@query("linear_trend", with_views("entity", """
    SELECT state, CAST(regr_count(deaths, cases) AS BIGINT) AS n, round(regr_slope(deaths, cases), 6) AS slope,
           round(regr_intercept(deaths, cases), 6) AS intercept, round(regr_r2(deaths, cases), 6) AS r2,
           round(sqrt(greatest(regr_syy(deaths, cases) - regr_slope(deaths, cases) * regr_sxy(deaths, cases), 0) / (regr_count(deaths, cases) - 2)), 6) AS residual_se
    FROM entity GROUP BY state"""))
def q_linear_trend(spark, sf):
    line = trend.linear_trend(views.entity(spark, sf), "cases", "deaths", ["state"])
    return rounded(line.select("state", "n", "slope", "intercept", "r2", "residual_se"))


@query("linear_band")
def q_linear_band(spark, sf):
    return trend.linear_band(views.entity(spark, sf), "cases", "deaths")


@query("local_trend", with_views("daily", """
    WITH v AS (SELECT CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) AS x, CAST(n_events AS DOUBLE) AS y FROM daily),
    e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
    g AS (SELECT CAST(i AS INTEGER) AS g, lo + (hi - lo) * (i / 79.0) AS px FROM e, (SELECT unnest(range(80)) AS i)),
    h AS (SELECT g, px, quantile_disc(abs(x - px), 0.75) AS h FROM g, v GROUP BY g, px),
    u AS (SELECT g, px, x, y, (x - px) / nullif(h, 0) AS u FROM h, v),
    w AS (SELECT *, pow(1 - pow(abs(u), 3), 3) AS w FROM u WHERE abs(u) < 1),
    s AS (SELECT g, px, count(DISTINCT x) AS n_x, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * pow(u, 3)) AS s3, sum(w * pow(u, 4)) AS s4,
                 sum(w * y) AS t0, sum(w * y * u) AS t1, sum(w * y * u * u) AS t2, sum(w * y * y) AS q FROM w GROUP BY g, px),
    c AS (SELECT *, s2 * s4 - s3 * s3 AS a, s2 * s3 - s1 * s4 AS b, s1 * s3 - s2 * s2 AS d, s0 * s4 - s2 * s2 AS e, s1 * s2 - s0 * s3 AS f, s0 * s2 - s1 * s1 AS k FROM s),
    m AS (SELECT *, s0 * a + s1 * b + s2 * d AS det FROM c),
    r AS (SELECT *, (a * t0 + b * t1 + d * t2) / det AS b0, (b * t0 + e * t1 + f * t2) / det AS b1, (d * t0 + f * t1 + k * t2) / det AS b2 FROM m)
    SELECT g, round(px, 6) AS x, CASE WHEN n_x >= 3 THEN round(b0, 6) END AS fit,
           CASE WHEN n_x >= 3 THEN round(sqrt(greatest(q - b0 * t0 - b1 * t1 - b2 * t2, 0) / s0 * a / det), 6) END AS se FROM r"""))
def q_local_trend(spark, sf):
    daily = views.daily(spark, sf).select(F.unix_date("day").alias("day_number"), "n_events")
    return rounded(trend.local_trend(daily, "day_number", "n_events"))


MODEL = ["cases", "population", "balance", "avg_price", "sum_price", "avg_discount", "avg_tax"]


@query("linear_model")
def q_linear_model(spark, sf):
    return reduce.linear_model(views.entity(spark, sf), MODEL, "deaths")


@query("linear_model_single", with_views("entity", """
    SELECT 'cases' AS term, round(regr_slope(deaths, cases), 5) AS coefficient,
           round(regr_slope(deaths, cases) / sqrt((regr_syy(deaths, cases) - regr_slope(deaths, cases) * regr_sxy(deaths, cases)) / (count(*) - 2) / regr_sxx(deaths, cases)), 4) AS t
    FROM entity UNION ALL
    SELECT '(intercept)', round(regr_intercept(deaths, cases), 5),
           round(regr_intercept(deaths, cases) / sqrt((regr_syy(deaths, cases) - regr_slope(deaths, cases) * regr_sxy(deaths, cases)) / (count(*) - 2)
                 * (1.0 / count(*) + avg(cases) * avg(cases) / regr_sxx(deaths, cases))), 4) FROM entity"""))
def q_linear_model_single(spark, sf):
    model = reduce.linear_model(views.entity(spark, sf), ["cases"], "deaths")
    return rounded(rounded(model.select("term", "coefficient", "t"), 5, ["coefficient"]), 4, ["t"])


@query("repeated_cv")
def q_repeated_cv(spark, sf):
    return reduce.repeated_cv(views.entity(spark, sf), "entity_key", MODEL, "deaths")


@query("importance_t")
def q_importance_t(spark, sf):
    return reduce.importance_t(views.entity(spark, sf), MODEL, "deaths")


@query("top_features")
def q_top_features(spark, sf):
    return reduce.top_features(views.entity(spark, sf), MODEL, "deaths", 3)


@query("pca_components")
def q_pca_components(spark, sf):
    df = views.entity(spark, sf).select("entity_key", *ENTITY_FEATURES)
    return reduce.pca_fit(df, ENTITY_FEATURES).scores(corr.standardise(df, ENTITY_FEATURES), "entity_key")


@query("pca_loadings")
def q_pca_loadings(spark, sf):
    return reduce.pca_fit(views.entity(spark, sf), ENTITY_FEATURES).loading_table()


@query("pca_scree")
def q_pca_scree(spark, sf):
    return reduce.pca_fit(views.entity(spark, sf), ENTITY_FEATURES).scree_table()


@query("pca_cos2")
def q_pca_cos2(spark, sf):
    return reduce.pca_fit(views.entity(spark, sf), ENTITY_FEATURES).cos2_table()


@query("pca_of_matrix")
def q_pca_of_matrix(spark, sf):
    return reduce.pca_of_matrix(views.entity(spark, sf), ENTITY_FEATURES).scree_table()


