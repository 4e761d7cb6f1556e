"""Registered queries: labels, splits, feature ranking, classifiers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.functions.expr import ratio, rounded
from minekit.functions.names import BOUNDARY_NAME_RULES, ENTITY_NAME_RULES, apply_rules, strip_suffix
from minekit.lineage import cut
from minekit.operators import classify, joins, network
from minekit.plans import views
from minekit.plans.registry import query
from minekit.plans.views import with_views
from minekit.sources.scan import scan_table

FEATURES = ["population", "balance", "n_orders", "avg_price", "avg_discount", "avg_tax", "avg_order_total"]
CLASSES = ["high", "low", "medium"]
# Groups kept out of training
HELD_OUT = ["NATION_1", "NATION_4", "NATION_8", "NATION_11", "NATION_15", "NATION_17", "NATION_20", "NATION_23"]
HELD_SQL = ", ".join(f"'{n}'" for n in HELD_OUT)


def split(spark, sf):
    # written once: the models read either part many times
    return classify.group_holdout(cut(views.classes(spark, sf)), "state", HELD_OUT)


@query("class_label", with_views("classes", "SELECT entity_key, risk FROM classes"))
def q_class_label(spark, sf):
    return views.classes(spark, sf).select("entity_key", "risk")


@query("class_label_binary", with_views("entity", "SELECT entity_key, deaths / nullif(population, 0) * 10000 > 130 AS bad FROM entity"))
def q_class_label_binary(spark, sf):
    rate = ratio("deaths", "population") * 10000
    return views.entity(spark, sf).select("entity_key", (rate > 130).alias("bad"))


@query("class_balance", with_views("classes", f"""WITH p AS (SELECT risk, CASE WHEN state IN ({HELD_SQL}) THEN 'test' ELSE 'train' END AS part FROM classes)
    SELECT risk, part, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY risk, part
    UNION ALL SELECT risk, 'all', CAST(count(*) AS BIGINT) FROM p GROUP BY risk"""))
def q_class_balance(spark, sf):
    train, test = split(spark, sf)
    parts = train.select("risk", F.lit("train").alias("part")).unionByName(test.select("risk", F.lit("test").alias("part")))
    return classify.class_balance(parts, "risk", "part")


@query("group_holdout", with_views("classes", f"""SELECT entity_key, state, CASE WHEN state IN ({HELD_SQL}) THEN 'test' ELSE 'train' END AS part FROM classes"""))
def q_group_holdout(spark, sf):
    train, test = split(spark, sf)
    keep = ["entity_key", "state"]
    return train.select(*keep, F.lit("train").alias("part")).unionByName(test.select(*keep, F.lit("test").alias("part")))


BINNED = ["state", "segment", "orders_band"]
CRAMER_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM b) AS n_bins, round(chi2, 4) AS chi2,
    round(sqrt(chi2 / (n * least((SELECT count(DISTINCT {c}) FROM b) - 1, (SELECT count(DISTINCT risk) FROM b) - 1))), 6) AS v FROM (
    SELECT sum((o - e) * (o - e) / e) AS chi2, sum(o) AS n FROM (
        SELECT r.n * c.n / t.n AS e, coalesce(x.n, 0) AS o FROM (SELECT {c} AS v, count(*) AS n FROM b GROUP BY 1) r
        CROSS JOIN (SELECT risk, count(*) AS n FROM b GROUP BY 1) c CROSS JOIN (SELECT count(*) AS n FROM b) t
        LEFT JOIN (SELECT {c} AS v, risk, count(*) AS n FROM b GROUP BY 1, 2) x ON x.v = r.v AND x.risk = c.risk))""" for c in BINNED)


@query("cramers_v", with_views("classes", "WITH b AS (SELECT risk, state, segment, CASE WHEN n_orders < 8 THEN 'few' WHEN n_orders < 12 THEN 'some' ELSE 'many' END AS orders_band FROM classes) " + CRAMER_SQL))
def q_cramers_v(spark, sf):
    n = F.col("n_orders")
    banded = views.classes(spark, sf).withColumn("orders_band", F.when(n < 8, "few").when(n < 12, "some").otherwise("many"))
    return rounded(rounded(classify.cramers_v(banded, "risk", BINNED), 4, ["chi2"]), 6, ["v"])


# each stage drops more of the columns that the label was made from
LEAK_STAGES = [
    ["death_per_case", "deaths_per_1000", "deaths", "cases", *FEATURES],
    ["deaths_per_1000", "deaths", "cases", *FEATURES],
    FEATURES,
]


@query("mdl_discretise")
def q_mdl_discretise(spark, sf):
    df = views.classes(spark, sf).withColumn("death_per_case", ratio("deaths", "cases"))
    return classify.mdl_cuts(df, "risk", ["death_per_case", "deaths", *FEATURES])


@query("feature_ranking")
def q_feature_ranking(spark, sf):
    train, _ = split(spark, sf)
    wide = train.withColumns({"death_per_case": ratio("deaths", "cases"), "deaths_per_1000": ratio("deaths", "population") * 1000})
    ranked = classify.rank_features(wide, "risk", LEAK_STAGES[0])
    stages = [
        ranked.filter(F.col("feature").isin(*cols)).withColumn("stage", F.lit(i + 1)) for i, cols in enumerate(LEAK_STAGES)
    ]
    return stages[0].unionByName(stages[1]).unionByName(stages[2])


@query("stratified_folds", with_views("classes", """
    SELECT entity_key, risk, CAST((row_number() OVER (PARTITION BY risk ORDER BY entity_key) - 1) % 10 AS INTEGER) AS fold FROM classes"""))
def q_stratified_folds(spark, sf):
    return classify.stratified_folds(views.classes(spark, sf).select("entity_key", "risk"), "entity_key", "risk", 10)


@query("stratified_split", with_views("classes", """
    SELECT entity_key, risk, CASE WHEN row_number() OVER (PARTITION BY risk ORDER BY entity_key) <= ceil(count(*) OVER (PARTITION BY risk) * 0.8) THEN 'train' ELSE 'test' END AS part FROM classes"""))
def q_stratified_split(spark, sf):
    return classify.stratified_split(views.classes(spark, sf).select("entity_key", "risk"), "entity_key", "risk", 0.8)


KNN_COLS = ["population", "balance", "avg_discount"]
KNN_KS = [1, 3, 5, 10]
KNN_DISTANCE = " + ".join(f"(a.{c} / s.s_{c} - b.{c} / s.s_{c}) * (a.{c} / s.s_{c} - b.{c} / s.s_{c})" for c in KNN_COLS)


@query("knn_classify", with_views("classes", f"""
    WITH tr AS (SELECT * FROM classes WHERE state NOT IN ({HELD_SQL})), te AS (SELECT * FROM classes WHERE state IN ({HELD_SQL})),
    s AS (SELECT {", ".join(f"stddev_samp({c}) AS s_{c}" for c in KNN_COLS)} FROM tr),
    r AS (SELECT a.entity_key, b.risk, row_number() OVER (PARTITION BY a.entity_key ORDER BY sqrt({KNN_DISTANCE}), b.entity_key) AS rank
          FROM te a CROSS JOIN tr b CROSS JOIN s),
    v AS (SELECT entity_key, k, risk, count(*) AS votes FROM r CROSS JOIN (SELECT unnest({KNN_KS}) AS k) WHERE rank <= k GROUP BY 1, 2, 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY entity_key, k ORDER BY votes DESC, risk) AS place FROM v)
    SELECT entity_key, CAST(k AS INTEGER) AS k, risk AS predicted FROM w WHERE place = 1"""))
def q_knn_classify(spark, sf):
    train, test = split(spark, sf)
    return classify.knn_classify(train, test, "entity_key", KNN_COLS, "risk", KNN_KS)


@query("forest_classify")
def q_forest_classify(spark, sf):
    train, test = split(spark, sf)
    model, classes = classify.fit_classifier(train, FEATURES, "risk", "forest")
    return classify.predict(model, classes, test, "entity_key", FEATURES)


@query("tree_classify")
def q_tree_classify(spark, sf):
    train, test = split(spark, sf)
    model, classes = classify.fit_classifier(train, FEATURES, "risk", "tree")
    return classify.predict(model, classes, test, "entity_key", FEATURES)


WHOLE_SQL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
# the divisor gets a billionth of the widest column's variance on top, as Spark's Gaussian model does
BAYES_SQL = f"""
    WITH tr AS (SELECT * FROM classes WHERE state NOT IN ({HELD_SQL}) AND {WHOLE_SQL}), te AS (SELECT * FROM classes WHERE state IN ({HELD_SQL}) AND {WHOLE_SQL}),
    e AS (SELECT 1e-9 * greatest({", ".join(f"var_pop({c})" for c in FEATURES)}) AS eps FROM tr),
    m AS (SELECT risk, ln(count(*) / (SELECT count(*) FROM tr)) AS prior,
                 {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + any_value(eps) AS v_{c}" for c in FEATURES)} FROM tr, e GROUP BY risk),
    s AS (SELECT entity_key, m.risk, prior - ({" + ".join(f"ln(2 * pi() * v_{c}) / 2 + (te.{c} - m_{c}) * (te.{c} - m_{c}) / (2 * v_{c})" for c in FEATURES)}) AS score FROM te CROSS JOIN m)
    SELECT entity_key, arg_max(risk, score) AS predicted FROM s GROUP BY entity_key"""


@query("bayes_classify", with_views("classes", BAYES_SQL))
def q_bayes_classify(spark, sf):
    train, test = split(spark, sf)
    model, classes = classify.fit_classifier(train, FEATURES, "risk", "bayes")
    return classify.predict(model, classes, test, "entity_key", FEATURES)


@query("mlp_classify")
def q_mlp_classify(spark, sf):
    train, test = split(spark, sf)
    model, classes = classify.fit_classifier(train, FEATURES, "risk", "mlp")
    return classify.predict(model, classes, test, "entity_key", FEATURES)


@query("forest_importance")
def q_forest_importance(spark, sf):
    train, _ = split(spark, sf)
    return classify.forest_importance(train, FEATURES, "risk")


# the grids of the three models: five forest widths, five hidden sizes, ten neighbour counts
FOREST_GRID = {f"forest mtry={m}": ("forest", {"featureSubsetStrategy": str(m)}) for m in (2, 3, 4, 5, 7)}
MLP_GRID = {f"mlp size={h}": ("mlp", {"hidden": h}) for h in (1, 3, 5, 7, 9)}


@query("tune_grid")
def q_tune_grid(spark, sf):
    train, _ = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.tune_grid(folded, "entity_key", FEATURES, "risk", "fold", FOREST_GRID)


@query("tune_neighbours")
def q_tune_neighbours(spark, sf):
    train, _ = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.knn_cv(folded, "entity_key", FEATURES, "risk", "fold", range(1, 11))


@query("tune_network")
def q_tune_network(spark, sf):
    train, _ = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.tune_grid(folded, "entity_key", FEATURES, "risk", "fold", MLP_GRID)


# five hidden sizes by five weight decays
DECAY_GRID = network.network_grid((1, 3, 5, 7, 9), (0.0, 0.0001, 0.001, 0.01, 0.1))


@query("tune_network_decay")
def q_tune_network_decay(spark, sf):
    train, _ = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.network_metrics(folded, FEATURES, "risk", "fold", DECAY_GRID)


@query("predict_tuned_network")
def q_predict_tuned_network(spark, sf):
    train, test = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.tuned_network(folded, test, "entity_key", FEATURES, "risk", "fold", DECAY_GRID)


@query("predict_all")
def q_predict_all(spark, sf):
    train, test = split(spark, sf)
    return classify.predict_all(train, test, "entity_key", FEATURES, "risk")


# ---------------------------------------------------------------- evaluation of given predictions

GUESS = "CASE WHEN avg_discount > 0.052 THEN 'high' WHEN avg_discount > 0.048 THEN 'low' ELSE 'medium' END"
GUESS_2 = "CASE WHEN avg_tax > 0.041 THEN 'high' ELSE 'medium' END"


def guesses(spark, sf):
    """Given predictions: two plain rules on two features."""
    discount, tax = F.col("avg_discount"), F.col("avg_tax")
    return views.classes(spark, sf).withColumns(
        {
            "guess": F.when(discount > 0.052, "high").when(discount > 0.048, "low").otherwise("medium"),
            "guess_2": F.when(tax > 0.041, "high").otherwise("medium"),
        }
    )


CELLS_SQL = f"""g AS (SELECT risk AS actual, {GUESS} AS predicted FROM classes),
    k AS (SELECT unnest(['high', 'low', 'medium']) AS c),
    cells AS (SELECT p.c AS predicted, a.c AS actual, CAST((SELECT count(*) FROM g WHERE g.predicted = p.c AND g.actual = a.c) AS BIGINT) AS n FROM k p CROSS JOIN k a)"""


@query("confusion_matrix", with_views("classes", f"WITH {CELLS_SQL} SELECT predicted, actual, n FROM cells"))
def q_confusion_matrix(spark, sf):
    df = guesses(spark, sf).select(F.col("guess").alias("predicted"), F.col("risk").alias("actual"))
    return classify.confusion_matrix(df, "predicted", "actual", CLASSES)


@query("confusion_overall", with_views("classes", f"""WITH {CELLS_SQL},
    e AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (WHERE predicted = actual) AS BIGINT) AS "right" FROM cells),
    ma AS (SELECT actual AS c, sum(n) AS n FROM cells GROUP BY 1), mp AS (SELECT predicted AS c, sum(n) AS n FROM cells GROUP BY 1),
    x AS (SELECT sum(ma.n * mp.n) / ((SELECT n FROM e) * (SELECT n FROM e)) AS chance FROM ma JOIN mp USING (c))
    SELECT n, "right", round("right" / n, 6) AS accuracy, round((SELECT max(n) FROM ma) / n, 6) AS no_information_rate,
           round(("right" / n - chance) / (1 - chance), 6) AS kappa,
           round((SELECT sum((a.n - b.n) * (a.n - b.n) / nullif(a.n + b.n, 0)) FROM cells a JOIN cells b ON a.predicted = b.actual AND a.actual = b.predicted WHERE a.predicted < a.actual), 6) AS mcnemar
    FROM e, x"""))
def q_confusion_overall(spark, sf):
    return rounded(classify.confusion_overall(guesses(spark, sf), "guess", "risk", CLASSES))


@query("confusion_tests")
def q_confusion_tests(spark, sf):
    return classify.confusion_tests(guesses(spark, sf), "guess", "risk", CLASSES)


@query("confusion_metrics", with_views("classes", f"""WITH {CELLS_SQL},
    t AS (SELECT c, (SELECT sum(n) FROM cells WHERE predicted = c AND actual = c) AS tp, (SELECT sum(n) FROM cells WHERE predicted = c AND actual <> c) AS fp,
                 (SELECT sum(n) FROM cells WHERE predicted <> c AND actual = c) AS fn, (SELECT sum(n) FROM cells WHERE predicted <> c AND actual <> c) AS tn FROM k)
    SELECT c AS class, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv,
           round((tp + fn) / (tp + fp + fn + tn), 6) AS prevalence, round(tp / (tp + fp + fn + tn), 6) AS detection_rate,
           round((tp + fp) / (tp + fp + fn + tn), 6) AS detection_prevalence, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM t"""))
def q_confusion_metrics(spark, sf):
    return rounded(classify.confusion_by_class(guesses(spark, sf), "guess", "risk", CLASSES))


FOLD_METRICS_SQL = f"""
    WITH f AS (SELECT risk AS actual, {GUESS} AS g1, {GUESS_2} AS g2, (row_number() OVER (PARTITION BY risk ORDER BY entity_key) - 1) % 10 AS fold FROM classes),
    l AS (SELECT 'discount' AS model, fold, actual, g1 AS predicted FROM f UNION ALL SELECT 'tax', fold, actual, g2 FROM f),
    a AS (SELECT model, fold, count(*) AS n, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS acc FROM l GROUP BY 1, 2),
    r AS (SELECT model, fold, actual AS c, count(*) AS n FROM l GROUP BY 1, 2, 3), p AS (SELECT model, fold, predicted AS c, count(*) AS n FROM l GROUP BY 1, 2, 3),
    e AS (SELECT r.model, r.fold, sum(r.n * p.n) AS hits FROM r JOIN p USING (model, fold, c) GROUP BY 1, 2),
    m AS (SELECT model, 'accuracy' AS metric, acc AS value FROM a
          UNION ALL SELECT model, 'kappa', (acc - hits / (n * n)) / (1 - hits / (n * n)) FROM a JOIN e USING (model, fold))"""


@query("compare_models", with_views("classes", f"""{FOLD_METRICS_SQL}
    SELECT model, metric, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
           round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM m GROUP BY model, metric"""))
def q_compare_models(spark, sf):
    return rounded(classify.compare_models(given_fold_metrics(spark, sf)))


def given_fold_metrics(spark, sf):
    df = guesses(spark, sf).select("entity_key", "risk", "guess", "guess_2")
    folded = classify.stratified_folds(df, "entity_key", "risk", 10)
    long = folded.select(
        "fold", F.col("risk").alias("actual"), F.col("guess").alias("discount"), F.col("guess_2").alias("tax")
    ).unpivot(["fold", "actual"], ["discount", "tax"], "model", "predicted")
    return classify.fold_metrics(long)


@query("tuned_choice", with_views("classes", f"""{FOLD_METRICS_SQL}
    SELECT model, round(avg(value), 6) AS mean FROM m WHERE metric = 'accuracy' GROUP BY model ORDER BY avg(value) DESC, model LIMIT 1"""))
def q_tuned_choice(spark, sf):
    """The candidate with the best mean accuracy over the folds; of equal ones the first in order."""
    return rounded(classify.best_candidate(given_fold_metrics(spark, sf), ["discount", "tax"]))


@query("predict_tuned_neighbours")
def q_predict_tuned_neighbours(spark, sf):
    """Neighbour count chosen on the folds of the training part, then applied to the test part."""
    train, test = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.tuned_knn(folded, test, "entity_key", KNN_COLS, "risk", "fold", range(1, 11))


@query("predict_tuned_forest")
def q_predict_tuned_forest(spark, sf):
    """Forest width chosen on the folds of the training part, then refitted on all of it."""
    train, test = split(spark, sf)
    folded = classify.stratified_folds(train, "entity_key", "risk", 10, seed=1000)
    return classify.tuned_predict(folded, test, "entity_key", FEATURES, "risk", "fold", FOREST_GRID)


@query("prediction_layers", with_views("classes", f"""
    SELECT lower(s_name) AS vertex, lower(n_name) AS state, CAST(s_acctbal AS DOUBLE) AS lat, entity_key, risk,
           CASE WHEN entity_key IS NOT NULL THEN {GUESS} END AS predicted
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN classes ON lower(classes.state) = lower(n_name) AND regexp_extract(lower(classes.name), '[0-9]+$') = regexp_extract(lower(s_name), '[0-9]+$')"""))
def q_prediction_layers(spark, sf):
    """Boundary vertices with label and prediction, matched on the normalised state and the whole number in the name."""

    def place(name, rules):
        return F.regexp_extract(apply_rules(strip_suffix(name, "county"), rules), r"([0-9]+)$", 1).alias("place")

    nation = scan_table(spark, sf, "nation")
    vertices = scan_table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lower("n_name").alias("state"), place("s_name", BOUNDARY_NAME_RULES), F.lower("s_name").alias("vertex"), F.col("s_acctbal").alias("lat")
    )
    labelled = guesses(spark, sf).select(
        F.lower("state").alias("state"), place("name", ENTITY_NAME_RULES), "entity_key", "risk", F.col("guess").alias("predicted")
    )
    return joins.natural_join(vertices, labelled).drop("place")
