"""Registered queries: clusterers and cluster validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.functions.expr import bands, ratio, rounded
from minekit.lineage import cut
from minekit.operators import cluster, joins, profile, validate
from minekit.plans import views
from minekit.plans.registry import query
from minekit.plans.views import POINT_AXES, with_views

AXES = POINT_AXES
DISTANCE = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
PAIRS = f"""pr AS (SELECT a.vec_id AS i, b.vec_id AS j, a.cluster AS ci, b.cluster AS cj, {DISTANCE} AS d
    FROM points a JOIN points b ON a.vec_id <> b.vec_id)"""


@query("pairwise_distance", with_views("points", f"""WITH {PAIRS}
    SELECT i AS vec_id, j AS other, round(d, 6) AS distance, CAST(NULL AS DOUBLE) AS total_distance, CAST(NULL AS DOUBLE) AS mean_distance, CAST(NULL AS DOUBLE) AS farthest
    FROM pr WHERE i < j
    UNION ALL SELECT i, NULL, NULL, round(sum(d), 4), round(avg(d), 6), round(max(d), 6) FROM pr GROUP BY i"""))
def q_pairwise_distance(spark, sf):
    """The distance of each unordered pair, and each row of the matrix reduced to its sum, mean and maximum, without an ``other``."""
    points = cut(views.points(spark, sf))
    pairs = validate.pair_distances(points, "vec_id", AXES)
    # rint, as round() takes each of n(n-1)/2 numbers through its decimal digits
    pairs = pairs.withColumn("distance", F.rint(F.col("distance") * 1e6) / 1e6)
    df = points.withColumn("all", F.lit(1))
    places = cut(validate.labelled_places(df, "vec_id", AXES, ["all"]))
    sums = validate.place_sums(places, AXES, ["all"], ends=True)
    per_place = places.join(sums.select("pid", "total", "far", "n_other"), "pid")
    rows = df.select("vec_id", *AXES).join(per_place, AXES).select(
        "vec_id", F.round("total", 4).alias("total_distance"),
        F.round(ratio("total", F.col("n_other") - 1), 6).alias("mean_distance"), F.round("far", 6).alias("farthest"),
    )
    return pairs.unionByName(rows, allowMissingColumns=True)


KNN_DISTANCE_SQL = with_views("points", f"""WITH {PAIRS},
    o AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pr)
    SELECT i AS vec_id, CAST(rank AS INTEGER) AS rank, j AS neighbour, round(d, 6) AS d FROM o WHERE rank <= 4""")


@query("knn_distance", KNN_DISTANCE_SQL)
def q_knn_distance(spark, sf):
    return rounded(cluster.knn_distance(views.points(spark, sf), "vec_id", AXES, 4))


@query("knn_curve", with_views("points", f"""WITH {PAIRS},
    o AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pr)
    SELECT i AS vec_id, round(d, 6) AS d, CAST(row_number() OVER (ORDER BY d, i) - 1 AS BIGINT) AS position FROM o WHERE rank = 4"""))
def q_knn_curve(spark, sf):
    return rounded(cluster.knn_curve(views.points(spark, sf), "vec_id", AXES, 4))


@query("kmeans_assign")
def q_kmeans_assign(spark, sf):
    return cluster.kmeans_assign(views.points(spark, sf), "vec_id", AXES, 5)


@query("kmeans_best_of")
def q_kmeans_best_of(spark, sf):
    return cluster.kmeans_best_of(views.points(spark, sf), "vec_id", AXES, 3)


@query("bisecting_assign")
def q_bisecting_assign(spark, sf):
    return cluster.bisecting_assign(views.points(spark, sf), "vec_id", AXES, 4)


@query("cluster_profile", with_views("points", " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS name, round(avg({c}), 6) AS value FROM points GROUP BY cluster" for c in AXES)))
def q_cluster_profile(spark, sf):
    return rounded(cluster.cluster_profile(views.points(spark, sf), AXES))


@query("cluster_ss", with_views("points", """
    WITH w AS (SELECT cluster, CAST(count(*) AS BIGINT) AS n, count(*) * (var_pop(x) + var_pop(y) + var_pop(z)) AS within_ss FROM points GROUP BY cluster),
         t AS (SELECT count(*) * (var_pop(x) + var_pop(y) + var_pop(z)) AS total_ss FROM points)
    SELECT cluster, n, round(within_ss, 6) AS within_ss, round(total_ss, 6) AS total_ss,
           round(total_ss - (SELECT sum(within_ss) FROM w), 6) AS between_ss FROM w, t"""))
def q_cluster_ss(spark, sf):
    return rounded(cluster.cluster_ss(views.points(spark, sf), AXES))


@query("cluster_projection")
def q_cluster_projection(spark, sf):
    return cluster.cluster_projection(views.points(spark, sf), "vec_id", AXES)


# one merge per step: the least (distance, keys), each pair of clusters kept once under its least keys
HIER_COMPLETE_K_SQL = with_views("points", f"""WITH merging(step, i, j, d, bi, bj) AS (
        SELECT 0, a.vec_id, b.vec_id, {DISTANCE}, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
        FROM points a JOIN points b ON a.vec_id < b.vec_id
        UNION ALL
        SELECT step + 1, least(ni, nj), greatest(ni, nj), max(d), bi, bj
        FROM (SELECT step, d, bi, bj, CASE WHEN i = bj THEN bi ELSE i END AS ni, CASE WHEN j = bj THEN bi ELSE j END AS nj
              FROM (SELECT step, i, j, d, first_value(i) OVER w AS bi, first_value(j) OVER w AS bj
                    FROM merging WINDOW w AS (ORDER BY d, i, j))
              WHERE step < (SELECT count(*) FROM points) - 4)
        WHERE ni <> nj GROUP BY step, bi, bj, least(ni, nj), greatest(ni, nj)),
    merged AS (SELECT DISTINCT bi, bj FROM merging WHERE bi IS NOT NULL),
    link AS (SELECT bi AS i, bj AS j FROM merged UNION ALL SELECT bj, bi FROM merged),
    reach(i, label) AS (SELECT vec_id, vec_id FROM points UNION SELECT l.j, r.label FROM reach r JOIN link l ON r.i = l.i),
    tops AS (SELECT i AS vec_id, min(label) AS label FROM reach GROUP BY i)
    SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS cluster FROM tops""")


@query("hier_complete_k", HIER_COMPLETE_K_SQL)
def q_hier_complete_k(spark, sf):
    return cluster.complete_linkage(views.points(spark, sf), "vec_id", AXES, 4)


def _tree_sql(part: str) -> str:
    """Spanning trees grown one point per step: take the nearest outside point, then relax the others."""
    return f"""seed AS (SELECT {part} AS part, min(vec_id) AS s FROM points GROUP BY 1),
    grow(step, id, part, x, y, z, done, best, src) AS (
        SELECT 0, b.vec_id, seed.part, b.x, b.y, b.z, b.vec_id = s, {DISTANCE}, CASE WHEN b.vec_id <> s THEN s END
        FROM points b JOIN seed ON b.{part} = seed.part JOIN points a ON a.vec_id = s
        UNION ALL
        SELECT step + 1, id, part, x, y, z, done OR id = c_id,
               CASE WHEN NOT done AND id <> c_id AND d < best THEN d ELSE best END,
               CASE WHEN NOT done AND id <> c_id AND d < best THEN c_id ELSE src END
        FROM (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d
              FROM (SELECT *, first_value(id) OVER w AS c_id, first_value(x) OVER w AS cx, first_value(y) OVER w AS cy,
                           first_value(z) OVER w AS cz, bool_and(done) OVER (PARTITION BY part) AS finished
                    FROM grow WINDOW w AS (PARTITION BY part ORDER BY done, best, id)))
        WHERE NOT finished),
    tree AS (SELECT part, least(id, src) AS a, greatest(id, src) AS b, best AS height
             FROM grow JOIN (SELECT part, max(step) AS step FROM grow GROUP BY part) USING (part, step) WHERE src IS NOT NULL)"""


ONE_TREE = "WITH marked AS (SELECT *, 1 AS all_rows FROM points), " + _tree_sql("all_rows").replace("points", "marked")


HIER_SINGLE_K_SQL = with_views("points", f"""{ONE_TREE},
    kept AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (ORDER BY height DESC, a DESC, b DESC) AS r FROM tree) WHERE r > 3),
    link AS (SELECT a AS i, b AS j FROM kept UNION ALL SELECT b, a FROM kept),
    reach(i, label) AS (SELECT vec_id, vec_id FROM points UNION SELECT l.j, r.label FROM reach r JOIN link l ON r.i = l.i),
    tops AS (SELECT i AS vec_id, min(label) AS label FROM reach GROUP BY i)
    SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS cluster FROM tops""")


@query("hier_single_k", HIER_SINGLE_K_SQL)
def q_hier_single_k(spark, sf):
    return cluster.single_linkage(views.points(spark, sf), "vec_id", AXES, 4)


MERGE_HEIGHTS_SQL = with_views("points", f"""{ONE_TREE}
    SELECT CAST(row_number() OVER (ORDER BY height, a, b) - 1 AS BIGINT) AS step, a, b, round(height, 6) AS height FROM tree""")


@query("merge_heights", MERGE_HEIGHTS_SQL)
def q_merge_heights(spark, sf):
    return rounded(cluster.merge_heights(views.points(spark, sf), "vec_id", AXES))


EPS, MIN_POINTS = 0.6, 5


DBSCAN_ASSIGN_SQL = with_views("points", f"""
    WITH near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM points a JOIN points b ON {DISTANCE} <= {EPS}),
    core AS (SELECT i AS vec_id FROM near GROUP BY i HAVING count(*) >= {MIN_POINTS}),
    link AS (SELECT i, j FROM near WHERE i IN (SELECT vec_id FROM core) AND j IN (SELECT vec_id FROM core)),
    reach(i, label) AS (SELECT vec_id, vec_id FROM core UNION SELECT l.j, r.label FROM reach r JOIN link l ON r.i = l.i),
    tops AS (SELECT i AS vec_id, min(label) AS label FROM reach GROUP BY i),
    ids AS (SELECT label, row_number() OVER (ORDER BY label) AS number FROM (SELECT DISTINCT label FROM tops)),
    edge AS (SELECT n.i AS vec_id, min(number) AS number FROM near n JOIN tops t ON n.j = t.vec_id JOIN ids USING (label)
             WHERE n.i NOT IN (SELECT vec_id FROM core) GROUP BY n.i)
    SELECT p.vec_id, CAST(coalesce(ids.number, edge.number, 0) AS INTEGER) AS cluster,
           CASE WHEN tops.label IS NOT NULL THEN 'core' WHEN edge.number IS NOT NULL THEN 'border' ELSE 'noise' END AS role
    FROM points p LEFT JOIN tops ON p.vec_id = tops.vec_id LEFT JOIN ids ON tops.label = ids.label LEFT JOIN edge ON p.vec_id = edge.vec_id""")


@query("dbscan_assign", DBSCAN_ASSIGN_SQL)
def q_dbscan_assign(spark, sf):
    return cluster.dbscan(views.points(spark, sf), "vec_id", AXES, EPS, MIN_POINTS)


# ---------------------------------------------------------------- internal validation given labels

SILHOUETTE_SQL = """m AS (SELECT i, ci, cj, avg({d}) AS d FROM pr GROUP BY i, ci, cj),
    a AS (SELECT i, d FROM m WHERE ci = cj),
    b AS (SELECT i, min(d) AS d, arg_min(cj, d) AS neighbour FROM m WHERE ci <> cj GROUP BY i),
    s AS (SELECT p.vec_id, p.cluster, b.neighbour, CASE WHEN a.d IS NULL THEN 0 ELSE (b.d - a.d) / greatest(a.d, b.d) END AS width
          FROM points p LEFT JOIN a ON a.i = p.vec_id LEFT JOIN b ON b.i = p.vec_id)"""


@query("silhouette_exact", with_views("points", f"""WITH {PAIRS}, {SILHOUETTE_SQL.format(d="d")}
    SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, CAST(neighbour AS BIGINT) AS neighbour, round(width, 6) AS width FROM s"""))
def q_silhouette_exact(spark, sf):
    return rounded(validate.silhouette(views.points(spark, sf), "vec_id", AXES))


@query("silhouette_fast", with_views("points", f"""WITH {PAIRS}, {SILHOUETTE_SQL.format(d="d * d")}
    SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, round(width, 6) AS width FROM s"""))
def q_silhouette_fast(spark, sf):
    return rounded(validate.silhouette_fast(views.points(spark, sf), "vec_id", AXES))


@query("cluster_separation", with_views("points", f"""WITH {PAIRS}
    SELECT CAST(ci AS BIGINT) AS cluster_i, CAST(cj AS BIGINT) AS cluster_j, round(min(d), 6) AS separation, round(avg(d), 6) AS average_between
    FROM pr WHERE ci <> cj GROUP BY ci, cj"""))
def q_cluster_separation(spark, sf):
    return rounded(validate.cluster_separation(views.points(spark, sf), "vec_id", AXES))


@query("block_dissimilarity", with_views("points", f"""WITH {PAIRS}
    SELECT CAST(ci AS BIGINT) AS cluster_i, CAST(cj AS BIGINT) AS cluster_j, round(avg(d), 6) AS mean_distance FROM pr GROUP BY ci, cj"""))
def q_block_dissimilarity(spark, sf):
    return rounded(validate.block_dissimilarity(views.points(spark, sf), "vec_id", AXES))


@query("dunn_index", with_views("points", f"""WITH {PAIRS}
    SELECT round(min(d) FILTER (WHERE ci <> cj), 6) AS min_separation, round(max(d) FILTER (WHERE ci = cj), 6) AS max_diameter,
           round(min(d) FILTER (WHERE ci <> cj) / max(d) FILTER (WHERE ci = cj), 6) AS dunn FROM pr"""))
def q_dunn_index(spark, sf):
    return rounded(validate.dunn_index(views.points(spark, sf), "vec_id", AXES))


@query("cluster_diameter", with_views("points", f"""WITH {PAIRS}
    SELECT CAST(ci AS BIGINT) AS cluster, round(max(d), 6) AS diameter FROM pr WHERE ci = cj GROUP BY ci"""))
def q_cluster_diameter(spark, sf):
    return rounded(validate.cluster_diameter(views.points(spark, sf), "vec_id", AXES, leaf_points=64))


def _metric_rows(source: str, names, cluster: str = "CAST(NULL AS BIGINT)") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, {cluster} AS cluster, round(CAST({n} AS DOUBLE), 6) AS value FROM {source}" for n in names)


@query("cluster_stats", with_views("points", f"""WITH {PAIRS}, {SILHOUETTE_SQL.format(d="d")},
    ss AS (SELECT cluster, count(*) AS size, count(*) * (var_pop(x) + var_pop(y) + var_pop(z)) AS within_ss FROM points GROUP BY cluster),
    pc AS (SELECT CAST(c.cluster AS BIGINT) AS cluster, size, within_ss,
                  (SELECT max(d) FROM pr WHERE ci = c.cluster AND cj = c.cluster) AS diameter,
                  (SELECT avg(d) FROM pr WHERE ci = c.cluster AND cj = c.cluster) AS average_distance,
                  (SELECT min(d) FROM pr WHERE ci = c.cluster AND cj <> c.cluster) AS separation,
                  (SELECT avg(d) FROM pr WHERE ci = c.cluster AND cj <> c.cluster) AS average_toother,
                  (SELECT avg(width) FROM s WHERE s.cluster = c.cluster) AS silhouette FROM ss c),
    g AS (SELECT ci, cj, avg(d) AS d FROM pr GROUP BY ci, cj),
    tot AS (SELECT count(*) AS n, count(*) * (var_pop(x) + var_pop(y) + var_pop(z)) AS t FROM points),
    w AS (SELECT (SELECT avg(d) FROM pr WHERE ci <> cj) AS average_between,
                 (SELECT sum(size * average_distance) / sum(size) FROM pc WHERE average_distance IS NOT NULL) AS average_within,
                 (SELECT max(d) FROM pr WHERE ci = cj) AS max_diameter, (SELECT min(d) FROM pr WHERE ci <> cj) AS min_separation,
                 (SELECT sum(within_ss) FROM ss) AS total_within_ss, (SELECT avg(width) FROM s) AS avg_silhouette,
                 (SELECT min(d) FROM g WHERE ci <> cj) / (SELECT max(d) FROM g WHERE ci = cj) AS dunn2,
                 (SELECT -sum(size / n * ln(size / n)) FROM ss, tot) AS entropy,
                 (SELECT (t - sum(within_ss)) / (count(*) - 1) / (sum(within_ss) / (any_value(n) - count(*))) FROM ss, tot GROUP BY t) AS ch,
                 (SELECT corr(d, CASE WHEN ci <> cj THEN 1.0 ELSE 0 END) FROM pr) AS pearson_gamma),
    wb AS (SELECT *, min_separation / max_diameter AS dunn, average_within / average_between AS wb_ratio FROM w)
    """ + _metric_rows("pc", ["size", "diameter", "average_distance", "separation", "average_toother", "silhouette", "within_ss"], "cluster")
    + " UNION ALL " + _metric_rows("wb", ["average_between", "average_within", "max_diameter", "min_separation", "total_within_ss",
        "avg_silhouette", "dunn", "dunn2", "entropy", "wb_ratio", "ch", "pearson_gamma"])
    + """ UNION ALL SELECT 'n', NULL, CAST(count(*) AS DOUBLE) FROM points UNION ALL SELECT 'cluster_number', NULL, CAST(count(*) AS DOUBLE) FROM ss
    UNION ALL SELECT 'min_cluster_size', NULL, CAST(min(size) AS DOUBLE) FROM ss
    UNION ALL SELECT 'noise', NULL, CAST(count(*) FILTER (WHERE cluster = 0) AS DOUBLE) FROM points"""))
def q_cluster_stats(spark, sf):
    return rounded(validate.cluster_stats(views.points(spark, sf), "vec_id", AXES))


WIDEST_GAP_SQL = with_views("points", f"""WITH {_tree_sql("cluster")}
    SELECT CAST(part AS BIGINT) AS cluster, round(max(height), 6) AS widest_gap FROM tree GROUP BY part""")


@query("widest_gap", WIDEST_GAP_SQL)
def q_widest_gap(spark, sf):
    return rounded(validate.widest_gap(views.points(spark, sf), "vec_id", AXES))




@query("median_distance", with_views("points", f"""WITH {PAIRS}
    SELECT CAST(ci AS BIGINT) AS cluster, round(median(d), 6) AS median_distance FROM pr WHERE ci = cj GROUP BY ci"""))
def q_median_distance(spark, sf):
    df = views.points(spark, sf).withColumn("cluster", F.col("cluster").cast("long"))
    return rounded(validate.median_distance(df, "vec_id", AXES))


def _labeling_sql(label: str, view: str) -> str:
    pairs = PAIRS.replace("a.cluster AS ci, b.cluster AS cj", f"a.{label} AS ci, b.{label} AS cj").replace("points", view).replace("pr AS", f"pr_{label} AS")
    parts = SILHOUETTE_SQL.format(d="d").replace("p.cluster", f"p.{label}").replace("FROM pr", f"FROM pr_{label}").replace("FROM points p", f"FROM {view} p")
    for name in ("m", "a", "b", "s"):
        parts = parts.replace(f"{name} AS (", f"{name}_{label} AS (").replace(f"FROM {name} ", f"FROM {name}_{label} ").replace(f"JOIN {name} ", f"JOIN {name}_{label} {name} ")
    return f"{pairs}, {parts}"


@query("compare_labelings", with_views("points truth", f"""WITH both_labels AS (SELECT p.*, truth FROM points p JOIN truth USING (vec_id)),
    {_labeling_sql("cluster", "both_labels")}, {_labeling_sql("truth", "both_labels")}
    SELECT 'cluster' AS method, round((SELECT sum(w) FROM (SELECT count(*) * (var_pop(x) + var_pop(y) + var_pop(z)) AS w FROM both_labels GROUP BY cluster)), 6) AS within_ss,
           round((SELECT avg(width) FROM s_cluster), 6) AS avg_silhouette
    UNION ALL SELECT 'truth', round((SELECT sum(w) FROM (SELECT count(*) * (var_pop(x) + var_pop(y) + var_pop(z)) AS w FROM both_labels GROUP BY truth)), 6),
           round((SELECT avg(width) FROM s_truth), 6)"""))
def q_compare_labelings(spark, sf):
    both = views.points(spark, sf).join(views.truth(spark, sf), "vec_id")
    return rounded(validate.compare_labelings(both, "vec_id", AXES, ["cluster", "truth"]))


@query("sweep_wcss")
def q_sweep_wcss(spark, sf):
    return validate.sweep(views.points(spark, sf), "vec_id", AXES, measures=["wcss"])


@query("sweep_silhouette")
def q_sweep_silhouette(spark, sf):
    return validate.sweep(views.points(spark, sf), "vec_id", AXES, measures=["silhouette"])


@query("sweep_dunn")
def q_sweep_dunn(spark, sf):
    return validate.sweep(views.points(spark, sf), "vec_id", AXES, measures=["dunn"])


@query("sweep_best")
def q_sweep_best(spark, sf):
    """The best k by silhouette and by Dunn index."""
    return validate.best_k(validate.sweep(views.points(spark, sf), "vec_id", AXES, measures=["silhouette", "dunn"]))


@query("gap_statistic")
def q_gap_statistic(spark, sf):
    return validate.gap_statistic(views.points(spark, sf), "vec_id", AXES)


# ---------------------------------------------------------------- external validation given labels


@query("truth_bands", with_views("entity", """
    SELECT entity_key, CASE WHEN r < -0.66 THEN 5 WHEN r < -0.3 THEN 4 WHEN r < 0.2 THEN 3 WHEN r < 0.45 THEN 2 WHEN r >= 0.45 THEN 1 END AS truth,
           CASE WHEN r < -0.3 THEN 3 WHEN r < 1.20 THEN 1 WHEN r >= 1.20 THEN 2 END AS truth_three
    FROM (SELECT entity_key, (deaths / nullif(cases, 0) - (SELECT avg(deaths / nullif(cases, 0)) FROM entity)) / (SELECT stddev_samp(deaths / nullif(cases, 0)) FROM entity) AS r FROM entity)"""))
def q_truth_bands(spark, sf):
    df = views.entity(spark, sf).select("entity_key", ratio("deaths", "cases").alias("death_per_case"))
    banded = validate.truth_bands(df, "death_per_case", *validate.FIVE_BANDS)
    return banded.select("entity_key", "truth", bands("death_per_case", *validate.THREE_BANDS).alias("truth_three"))


LEVELS = 10
GRID_SQL = f"""lv AS (SELECT unnest(range(1, {LEVELS + 1})) AS v),
    bt AS (SELECT cluster AS c, truth AS t FROM points JOIN truth USING (vec_id)),
    cells AS (SELECT x.v AS c, y.v AS t, CAST((SELECT count(*) FROM bt WHERE bt.c = x.v AND bt.t = y.v) AS DOUBLE) AS n FROM lv x, lv y),
    mc AS (SELECT c, sum(n) AS n FROM cells GROUP BY c), mt AS (SELECT t, sum(n) AS n FROM cells GROUP BY t),
    tot AS (SELECT sum(n) AS n FROM cells),
    by_t AS (SELECT cells.t, sum(CASE WHEN cells.n > 0 THEN -cells.n / mt.n * log2(cells.n / mt.n) ELSE 0 END) AS e, max(CASE WHEN mt.n > 0 THEN cells.n / mt.n ELSE 0 END) AS p
             FROM cells JOIN mt ON cells.t = mt.t GROUP BY cells.t),
    by_c AS (SELECT cells.c, sum(CASE WHEN cells.n > 0 THEN -cells.n / mc.n * log2(cells.n / mc.n) ELSE 0 END) AS e, max(CASE WHEN mc.n > 0 THEN cells.n / mc.n ELSE 0 END) AS p
             FROM cells JOIN mc ON cells.c = mc.c GROUP BY cells.c)"""


def _measure_sql(what: str) -> str:
    return f"""WITH {GRID_SQL}
    SELECT 'standard' AS mode, round(sum(mt.n / tot.n * {what}), 6) AS value FROM by_t JOIN mt USING (t), tot
    UNION ALL SELECT 'index_weighted', round(sum(mc.n / tot.n * {what}), 6) FROM by_t JOIN mc ON by_t.t = mc.c, tot
    UNION ALL SELECT 'by_cluster', round(sum(mc.n / tot.n * {what}), 6) FROM by_c JOIN mc USING (c), tot"""


def _both(spark, sf):
    return views.points(spark, sf).select("vec_id", "cluster").join(views.truth(spark, sf), "vec_id")


def _all_modes(spark, sf, measure):
    both = _both(spark, sf)
    parts = [
        measure(both, "cluster", "truth", LEVELS, mode).select(F.lit(mode).alias("mode"), F.round("value", 6).alias("value"))
        for mode in ("standard", "index_weighted", "by_cluster")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("external_entropy", with_views("points truth", _measure_sql("e")))
def q_external_entropy(spark, sf):
    return _all_modes(spark, sf, validate.external_entropy)


@query("external_purity", with_views("points truth", _measure_sql("p")))
def q_external_purity(spark, sf):
    return _all_modes(spark, sf, validate.external_purity)


RAND_SQL = """(SELECT (i - a * b / m) / ((a + b) / 2 - a * b / m) FROM (SELECT
    (SELECT sum(n * (n - 1) / 2) FROM cells) AS i, (SELECT sum(n * (n - 1) / 2) FROM mc) AS a,
    (SELECT sum(n * (n - 1) / 2) FROM mt) AS b, (SELECT n * (n - 1) / 2 FROM tot) AS m))"""
VI_SQL = """(SELECT -sum(cells.n / tot.n * ln(cells.n * cells.n / (mc.n * mt.n))) FROM cells JOIN mc ON cells.c = mc.c JOIN mt ON cells.t = mt.t, tot WHERE cells.n > 0)"""


@query("adjusted_rand", with_views("points truth", f"WITH {GRID_SQL} SELECT round({RAND_SQL}, 6) AS value"))
def q_adjusted_rand(spark, sf):
    return rounded(validate.adjusted_rand(_both(spark, sf), "cluster", "truth", LEVELS))


@query("variation_of_information", with_views("points truth", f"WITH {GRID_SQL} SELECT round({VI_SQL}, 6) AS value"))
def q_variation_of_information(spark, sf):
    return rounded(validate.variation_of_information(_both(spark, sf), "cluster", "truth", LEVELS))


@query("external_validation", with_views("points truth", f"""WITH {GRID_SQL}
    SELECT 'cluster' AS method, 'corrected_rand' AS metric, round({RAND_SQL}, 6) AS value
    UNION ALL SELECT 'cluster', 'vi', round({VI_SQL}, 6)
    UNION ALL SELECT 'cluster', 'entropy', round((SELECT sum(mt.n / tot.n * e) FROM by_t JOIN mt USING (t), tot), 6)
    UNION ALL SELECT 'cluster', 'purity', round((SELECT sum(mt.n / tot.n * p) FROM by_t JOIN mt USING (t), tot), 6)
    UNION ALL SELECT 'itself', 'corrected_rand', 1.0 UNION ALL SELECT 'itself', 'vi', 0.0
    UNION ALL SELECT 'itself', 'entropy', 0.0 UNION ALL SELECT 'itself', 'purity', 1.0"""))
def q_external_validation(spark, sf):
    truth = views.truth(spark, sf)
    labels = views.points(spark, sf).select("vec_id", "cluster").join(truth.withColumnRenamed("truth", "itself"), "vec_id")
    return rounded(validate.external_validation(labels, truth, "vec_id", ["cluster", "itself"], LEVELS))


# ---------------------------------------------------------------- outcomes by cluster


def _labelled_entities(spark, sf):
    labels = views.points(spark, sf).select(F.col("vec_id").alias("entity_key"), "cluster")
    return joins.attach_by_key(views.entity(spark, sf), labels, "entity_key")


@query("cluster_risk", with_views("entity points", """
    SELECT p.cluster, round(avg(cases / nullif(population, 0) * 1000), 6) AS avg_cases, round(avg(deaths / nullif(population, 0) * 1000), 6) AS avg_deaths
    FROM entity LEFT JOIN points p ON entity_key = vec_id GROUP BY p.cluster"""))
def q_cluster_risk(spark, sf):
    return rounded(
        _labelled_entities(spark, sf).groupBy("cluster").agg(
            F.avg(ratio("cases", "population") * 1000).alias("avg_cases"),
            F.avg(ratio("deaths", "population") * 1000).alias("avg_deaths"),
        )
    )


@query("cluster_response", with_views("daily points", """
    WITH u AS (SELECT user_id, sum(n_events) / count(*) AS response FROM daily GROUP BY user_id),
         j AS (SELECT cluster, response FROM u JOIN points ON vec_id = user_id)
    SELECT CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n, round(min(response), 6) AS min, round(quantile_cont(response, 0.25), 6) AS q1,
           round(quantile_cont(response, 0.5), 6) AS median, round(avg(response), 6) AS mean, round(quantile_cont(response, 0.75), 6) AS q3, round(max(response), 6) AS max
    FROM j GROUP BY cluster"""))
def q_cluster_response(spark, sf):
    response = views.daily(spark, sf).groupBy("user_id").agg(
        ratio(F.sum("n_events"), F.count(F.lit(1))).alias("response")
    )
    labels = views.points(spark, sf).select(F.col("vec_id").alias("user_id"), F.col("cluster").cast("long").alias("cluster"))
    joined = joins.attach_by_key(response, labels, "user_id").filter(F.col("cluster").isNotNull())
    summary = profile.summary_numeric(joined, ["response"], ["cluster"]).drop("column", "n_missing")
    return rounded(summary)


# ---------------------------------------------------------------- the same questions over many small leaves

SMALL_LEAVES = 40


@query("knn_distance_leaves", KNN_DISTANCE_SQL)
def q_knn_distance_leaves(spark, sf):
    return rounded(cluster.knn_distance(views.points(spark, sf), "vec_id", AXES, 4, leaf_points=SMALL_LEAVES))


@query("hier_single_k_leaves", HIER_SINGLE_K_SQL)
def q_hier_single_k_leaves(spark, sf):
    return cluster.single_linkage(views.points(spark, sf), "vec_id", AXES, 4, leaf_points=SMALL_LEAVES)


@query("merge_heights_leaves", MERGE_HEIGHTS_SQL)
def q_merge_heights_leaves(spark, sf):
    return rounded(cluster.merge_heights(views.points(spark, sf), "vec_id", AXES, leaf_points=SMALL_LEAVES))


@query("dbscan_assign_leaves", DBSCAN_ASSIGN_SQL)
def q_dbscan_assign_leaves(spark, sf):
    return cluster.dbscan(views.points(spark, sf), "vec_id", AXES, EPS, MIN_POINTS, leaf_points=SMALL_LEAVES)
