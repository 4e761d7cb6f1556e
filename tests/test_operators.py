"""Hand-built frames: missing cells, zero divisors, ties, constant columns, names, repeated keys."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from minekit.functions import names
from minekit.lineage import number_rows
from minekit.operators import classify, clean, corr, joins, profile, rank, reduce, trend, validate
from minekit.sources.scan import scan_csv, scan_csv_override
from minekit.sources.sink import write_table


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_zero_and_missing_divisors_give_null(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 1.0), (3, None, 1.0)], "id int, pop double, cases double")
    assert rows(clean.rates(df, {"r": ("cases", "pop", 1000)}).select("id", "r"), "id") == [(1, None), (2, 500.0), (3, None)]


def test_nan_and_null_are_both_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None)], "v double, s string")
    assert {r["column"]: r["n_missing"] for r in clean.null_profile(df).collect()} == {"v": 2, "s": 1}
    assert clean.drop_incomplete(df).count() == 1
    assert {r["complete"]: r["n"] for r in clean.complete_case_counts(df).collect()} == {True: 1, False: 2}
    assert rows(profile.summary_numeric(df, ["v"]))[0][1:4] == (1, 2, 1.0)


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert clean.filter_not_in(df, "s", ["a"]).count() == 2


def test_sorts_put_null_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "id int, v double")
    assert [r["id"] for r in rank.sort_asc(df, "v", "id").collect()] == [3, 2, 1]
    assert [r["id"] for r in rank.sort_desc(df, "v", "id").collect()] == [2, 3, 1]


def test_leading_zero_keys_survive_as_text(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("01001", "NA", 1.5)], "fips string, name string, v double").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("fips", T.StringType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])
    assert rows(scan_csv(spark, path, schema)) == [("01001", None, 1.5)]


def test_name_rules_replace_the_first_match_only(spark):
    cases = {
        "Dallas County": "dallas", "St. Louis County": "st louis", "City of St. Louis": "st louis city",
        "O'Brien County": "obrien", "Walla Walla County": "wallawalla", "LaSalle Parish": "lasalle",
        "La Salle County": "lasalle", "Queen Anne's County": "queen annes",
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    out = names.apply_rules(names.strip_suffix("name", "county"), names.ENTITY_NAME_RULES)
    assert {r["name"]: r["out"] for r in df.select("name", out.alias("out")).collect()} == cases


def test_natural_join_multiplies_and_attach_refuses(spark):
    left = spark.createDataFrame([("tx", "a", 1), ("tx", "b", 2)], "state string, county string, v int")
    right = spark.createDataFrame([("tx", "a", 10), ("tx", "a", 11)], "state string, county string, w int")
    assert joins.shared_columns(left, right) == ["state", "county"]
    assert joins.natural_join(left, right).count() == 3
    with pytest.raises(Exception, match="repeats"):
        joins.attach_by_key(left.select("county", "v"), right.select("county", "w"), "county").collect()
    status = {r["county"]: r["status"] for r in joins.join_coverage(left, right, ["county"]).collect()}
    assert status == {"a": "right_repeats", "b": "left_only"}


def test_number_rows_with_a_hot_group(spark):
    data = [("hot", i) for i in range(300)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(data, "g string, v int").repartition(6)
    got = number_rows(df, ["v"], ["g"]).toPandas()
    assert (got["position"] == got["v"]).all() and len(got) == 307


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 40, 97])
def test_quantiles_interpolate_linearly(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(0, 3, n), 1)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {r["prob"]: r["value"] for r in profile.quantile_table(df, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(v, p)), p


def test_quantiles_by_narrowing_hold_few_values_at_a_time(spark, monkeypatch):
    """Coarse sketches and small brackets: several passes, the same values, no array above the bound."""
    monkeypatch.setattr(profile, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(profile, "BRACKET", 40)
    monkeypatch.setattr(profile, "PARTS", 8)
    sizes = []
    plain = profile._narrowed

    def watched(counted, group):
        small = plain(counted, group)
        sizes.extend((before["n"], after["n"]) for before, after in (
            (x.filter("inside is not null").groupBy(*group, "prob").count().agg({"count": "max"}).withColumnRenamed("max(count)", "n").first() for x in (counted, small)),
        ))
        return small

    monkeypatch.setattr(profile, "_narrowed", watched)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"v": np.concatenate([rng.normal(0, 9, 30_000), np.full(6_000, 1.5), rng.integers(0, 50, 4_000)])})
    pdf["g"] = np.where(rng.random(len(pdf)) < 0.3, None, np.where(rng.random(len(pdf)) < 0.99, "hot", "cold"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.55, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(pdf, "v double, g string").repartition(7)
    whole = {r["prob"]: r["value"] for r in profile.quantile_table(df, ["v"], probs).collect()}
    assert whole == {p: pytest.approx(np.quantile(pdf.v, p), abs=1e-12) for p in probs}
    parts = {(r["g"], r["prob"]): (r["n"], r["value"]) for r in profile.quantile_table(df, ["v"], probs, ["g"]).collect()}
    for g in ("hot", "cold", None):
        v = pdf.v[pdf.g.isna() if g is None else pdf.g == g]
        for p in probs:
            assert parts[(g, p)] == (len(v), pytest.approx(np.quantile(v, p), abs=1e-12)), (g, p)
    assert len(sizes) == 2 and all(before > 1_000 and after <= 40 for before, after in sizes)


def test_date_summary_of_an_empty_and_a_gappy_column(spark):
    df = spark.createDataFrame([("2020-01-01", None), ("2020-01-04", None), (None, None)], "a string, b string")
    got = {r["column"]: r for r in profile.summary_dates(df, ["a", "b"]).collect()}
    assert [str(got["a"][c]) for c in ("min", "q1", "median", "mean", "q3", "max")] == ["2020-01-01", "2020-01-01", "2020-01-02", "2020-01-02", "2020-01-03", "2020-01-04"]
    assert (got["a"]["n"], got["a"]["n_missing"], got["a"]["range_days"]) == (2, 1, 3)
    assert (got["b"]["n"], got["b"]["n_missing"], got["b"]["median"], got["b"]["range_days"]) == (0, 3, None, None)


def test_quantiles_with_a_value_holding_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(10_000, 2.0), rng.normal(2, 1, 20_000)])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(8)
    got = {r["prob"]: r["value"] for r in profile.quantile_table(df, ["v"], [0.1, 0.5, 0.99]).collect()}
    for p, value in got.items():
        assert value == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_hinges_are_medians_of_halves(spark):
    for n in (4, 5, 6, 7, 11):
        v = np.arange(1.0, n + 1) ** 2
        box = profile.box_stats(spark.createDataFrame(pd.DataFrame({"v": v})), ["v"], hinges=True).first()
        half = math.ceil(n / 2)
        assert box["q1"] == np.median(v[:half]) and box["q3"] == np.median(v[-half:])


def test_constant_column_scales_to_null_and_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "a double, c double")
    assert {r["c"] for r in corr.standardise(df, ["a", "c"]).collect()} == {None}
    assert corr.correlation_pairs(df, ["a", "c"]).first()["r"] is None


def test_collinear_drop_is_signed_and_judged_by_later_columns(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "up": a + rng.normal(size=400) * 0.05, "down": -a + rng.normal(size=400) * 0.05})
    df = spark.createDataFrame(pdf)
    assert corr.drop_collinear(df, ["a", "up", "down"]).columns == ["up", "down"]
    assert corr.drop_collinear(df, ["up", "a", "down"]).columns == ["a", "down"]
    assert corr.drop_collinear(df, ["a", "up", "down"], signed=False).columns == ["down"]


def test_wide_correlations_with_gaps_equal_plain_ones(spark):
    """Thirty columns, some with gaps, one constant and one empty, against the textbook formula per pair."""
    rng = np.random.default_rng(1)
    names = [f"c{i}" for i in range(30)]
    pdf = pd.DataFrame(rng.normal(1000, 2, size=(60, 30)), columns=names)
    pdf.loc[rng.choice(60, 20, replace=False), "c3"] = np.nan
    pdf.loc[5:, "c4"] = np.nan
    pdf["c5"], pdf["c6"] = 0.1, np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r.var_i, r.var_j): (r.r, r.n) for r in corr.correlation_pairs(df, names).collect()}
    whole = {(r.var_i, r.var_j): r.r for r in corr.correlation_matrix(df, names).collect()}
    assert len(got) == 435 and len(whole) == 900
    for (a, b), (r, n) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both)
        if n < 2 or both[a].nunique() < 2 or both[b].nunique() < 2:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-9)
        assert whole[a, b] == whole[b, a] == (r if n == 60 else None)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(5, 2, 300), rng.normal(-1, 3, 300)
    y = 2 + 3 * a - 0.5 * b + rng.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300), "a": a, "b": b, "both": a + b, "flat": 1.0, "y": y})
    return pdf, spark.createDataFrame(pdf)


def test_linear_model_leaves_aliased_terms_out(regression):
    pdf, df = regression
    got = {r["term"]: r for r in reduce.linear_model(df, ["a", "b", "both", "flat"], "y").collect()}
    x = np.column_stack([pdf["a"], pdf["b"], np.ones(300)])
    beta, rss = np.linalg.lstsq(x, pdf["y"], rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / 297)
    for term, value, error in zip(["a", "b", "(intercept)"], beta, se):
        assert got[term]["coefficient"] == pytest.approx(value)
        assert got[term]["t"] == pytest.approx(value / error)
    assert got["both"]["coefficient"] is None and got["flat"]["coefficient"] is None
    top = reduce.top_features(df, ["a", "b", "both"], "y", 1)
    assert top.columns == ["a"]


def test_repeated_cv_equals_refitting(regression):
    pdf, df = regression
    got = reduce.repeated_cv(df, "id", ["a", "b"], "y", folds=4, repeats=2).toPandas()
    folds = df.select("id", *[reduce.fold_number("id", 4, r).alias(f"f{r}") for r in range(2)]).toPandas().sort_values("id")
    assert len(got) == 8
    for _, row in got.iterrows():
        held = (folds[f"f{int(row['repeat'])}"] == row["fold"]).to_numpy()
        x = np.column_stack([np.ones(300), pdf["a"], pdf["b"]])
        beta = np.linalg.lstsq(x[~held], pdf["y"][~held], rcond=None)[0]
        error = pdf["y"][held] - x[held] @ beta
        assert row["n"] == held.sum()
        assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
        assert row["mae"] == pytest.approx(np.abs(error).mean())


def test_pca_against_eigenvectors(regression):
    pdf, df = regression
    result = reduce.pca_fit(df, ["a", "b", "y"])
    values, vectors = np.linalg.eigh(np.corrcoef(pdf[["a", "b", "y"]].T))
    assert result.variances == pytest.approx(values[::-1])
    assert np.allclose(np.abs(result.loadings), np.abs(vectors[:, ::-1]))
    shares = {r["variable"]: r["cos2"] for r in result.cos2_table(3).collect()}
    assert all(v == pytest.approx(1.0) for v in shares.values())


def test_local_trend_recovers_a_parabola(spark):
    x = np.linspace(0, 10, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 3 + 2 * x - 0.5 * x * x}))
    got = trend.local_trend(df, "x", "y", grid=9).toPandas()
    assert np.allclose(got["fit"], 3 + 2 * got["x"] - 0.5 * got["x"] ** 2, atol=1e-6)
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "x double, y double")
    assert {r["fit"] for r in trend.local_trend(two, "x", "y", grid=3).collect()} == {None}


def test_linear_band_is_narrowest_at_the_mean(regression):
    _, df = regression
    band = trend.linear_band(df, "a", "y", grid=41).toPandas()
    width = band["high"] - band["low"]
    assert abs(band["x"][width.idxmin()] - df.agg(F.avg("a")).first()[0]) < 0.5


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "c int, t int")


def test_external_measures_on_known_labelings(spark):
    same = labelled(spark, [(1, 1), (1, 1), (2, 2), (3, 3)])
    swapped = labelled(spark, [(2, 1), (2, 1), (1, 2), (3, 3)])
    for df in (same, swapped):
        assert validate.adjusted_rand(df, "c", "t", 4).first()[0] == pytest.approx(1.0)
        assert validate.variation_of_information(df, "c", "t", 4).first()[0] == pytest.approx(0.0)
        assert validate.external_entropy(df, "c", "t", 4).first()[0] == pytest.approx(0.0)
        assert validate.external_purity(df, "c", "t", 4).first()[0] == pytest.approx(1.0)
    mixed = labelled(spark, [(1, 1), (2, 1), (1, 2), (2, 2)])
    assert validate.external_entropy(mixed, "c", "t", 2).first()[0] == pytest.approx(1.0)
    assert validate.external_purity(mixed, "c", "t", 2, "by_cluster").first()[0] == pytest.approx(0.5)
    # rows: truth 1 is all cluster 2, truth 2 is half and half; weights are the cluster shares 1/4 and 3/4
    skewed = labelled(spark, [(2, 1), (2, 1), (1, 2), (2, 2)])
    assert validate.external_entropy(skewed, "c", "t", 2, "index_weighted").first()[0] == pytest.approx(0.75)
    assert validate.external_entropy(skewed, "c", "t", 2).first()[0] == pytest.approx(0.5)


def test_folds_cover_every_row_once_even_for_a_rare_class(spark):
    df = spark.createDataFrame([(i, "big" if i > 3 else "rare") for i in range(100)], "id int, y string")
    got = classify.stratified_folds(df, "id", "y", 10, seed=3).toPandas()
    assert sorted(got["id"]) == list(range(100))
    assert got[got["y"] == "rare"]["fold"].nunique() == 4
    assert got["fold"].value_counts().max() - got["fold"].value_counts().min() <= 2
    split = classify.stratified_split(df, "id", "y", 0.8, seed=3).toPandas()
    assert (split["part"] == "train").sum() == math.ceil(4 * 0.8) + math.ceil(96 * 0.8)


def test_correlation_beside_one_huge_value_where_the_partner_is_missing(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(1, 11, 1000).astype(float)
    y = x + rng.normal(size=1000)
    rows = [("a", float(u), float(v), 0.1) for u, v in zip(x, y)] + [("b", 1e9, None, 0.1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c double").repartition(4)
    for by in ([], ["g"]):
        got = {(r.var_i, r.var_j): r for r in corr.correlation_pairs(df, ["x", "y", "c"], by).collect() if not by or r.g == "a"}
        assert got["x", "y"].n == 1000 and abs(got["x", "y"].r - np.corrcoef(x, y)[0, 1]) < 1e-9
        assert got["x", "c"].r is None and got["y", "c"].r is None


def test_mdl_finds_the_step_and_leaves_noise_alone(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 2000)
    pdf = pd.DataFrame({"x": x, "noise": rng.normal(size=2000), "y": np.where(x < 4, "a", "b")})
    df = spark.createDataFrame(pdf)
    cuts = classify.mdl_cuts(df, "y", ["x", "noise"]).toPandas()
    # the quantile bin that holds the step is mixed, so it may be cut off on both sides
    assert set(cuts["feature"]) == {"x"} and (cuts["cut"] - 4).abs().max() < 0.1
    ranked = {r["feature"]: r["v"] for r in classify.rank_features(df, "y", ["x", "noise"]).collect()}
    assert ranked["noise"] == 0.0 and ranked["x"] > 0.97


def test_mdl_cuts_lie_on_values_and_missing_cells_cost_only_their_feature(spark):
    x = np.random.default_rng(5).permutation(3000).astype(float)
    rows = [(float(v), None if i % 50 else float(v), "a" if v < 1234 else "b") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, gappy double, y string").repartition(5)
    cuts = {(r["feature"], r["position"]): r["cut"] for r in classify.mdl_cuts(df, "y", ["x", "gappy"]).collect()}
    first = min(v for i, v in enumerate(x) if i % 50 == 0 and v >= 1234)
    assert cuts == {("x", 1): 1234.0, ("gappy", 1): first}
    ranked = {r["feature"]: (r["n_bins"], round(r["v"], 9), round(r["chi2"], 6)) for r in classify.rank_features(df, "y", ["x", "gappy"]).collect()}
    assert ranked == {"x": (2, 1.0, 3000.0), "gappy": (2, 1.0, 60.0)}


def test_knn_vote_ties_and_scaling(spark):
    train = spark.createDataFrame(
        [(1, 0.0, "b"), (2, 0.0, "a"), (3, 10.0, "c"), (4, 10.0, "c"), (5, 10.0, "a")], "id int, x double, y string"
    )
    test = spark.createDataFrame([(100, 1.0), (101, 9.0), (102, None)], "id int, x double")
    got = {(r["id"], r["k"]): r["predicted"] for r in classify.knn_classify(train, test, "id", ["x"], "y", [1, 2, 3]).collect()}
    assert got == {(100, 1): "b", (100, 2): "a", (100, 3): "a", (101, 1): "c", (101, 2): "c", (101, 3): "c"}


def test_confusion_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a")] * 6 + [("a", "b")] * 3 + [("a", "c")], "p string, t string")
    overall = classify.confusion_overall(df, "p", "t", ["a", "b", "c"]).first()
    assert overall["accuracy"] == 0.6 and overall["kappa"] == 0.0
    per = {r["class"]: r for r in classify.confusion_by_class(df, "p", "t", ["a", "b", "c"]).collect()}
    assert per["b"]["sensitivity"] == 0.0 and per["b"]["ppv"] is None and per["a"]["specificity"] == 0.0


def test_written_tables_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int")
    write_table(df, str(tmp_path / "t"), ["g"])
    assert (tmp_path / "t" / "g=a").exists()
    assert spark.read.parquet(str(tmp_path / "t")).filter("g = 'a'").count() == 1


@pytest.mark.parametrize("kind", ["forest", "mlp"])
def test_fits_do_not_depend_on_partitions(spark, kind):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a", "b", "c"])
    pdf["id"], pdf["y"] = np.arange(300), np.where(pdf.a + rng.normal(size=300) > 0, "high", "low")
    df = spark.createDataFrame(pdf)
    settings = {"numTrees": 8, "maxDepth": 4} if kind == "forest" else {"maxIter": 20}
    guesses = []
    for parts in (1, 7):
        model, classes = classify.fit_classifier(df.repartition(parts), ["a", "b", "c"], "y", kind, **settings)
        guesses.append({r.id: r.predicted for r in classify.predict(model, classes, df, "id", ["a", "b", "c"]).collect()})
    assert guesses[0] == guesses[1]


def test_a_misfit_cell_fails_the_scan(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n" + "".join(f"{i},{i}\n" for i in range(100)) + "100,1.5\n")
    df = scan_csv_override(spark, str(path), {"k": T.StringType()})
    assert df.schema["v"].dataType == T.DoubleType() and df.count() == 101
    with pytest.raises(Exception):
        scan_csv_override(spark, str(path), {"v": T.IntegerType()}).collect()
