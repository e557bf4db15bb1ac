import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.moments import sample_skew
from millrace.functions.skew import salted_join
from millrace.operators import anomaly, chart, correlation, features, insights, outliers, profile
from millrace.operators.pivot import pivot
from millrace.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "x": rng.lognormal(0, 1.5, 3000).round(2), "y": rng.normal(size=3000)})
    pdf.loc[pdf.index % 3 == 0, "x"] = 1.0  # a third of all rows hold one value
    pdf.loc[pdf.index % 7 == 0, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(5).cache()
    return pdf, df


def test_quantiles_match_pandas(sample):
    pdf, df = sample
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    whole = exact_quantiles(df, ["x", "y"], probs).toPandas().to_numpy()[0]
    np.testing.assert_allclose(whole, np.r_[pdf.x.quantile(probs), pdf.y.quantile(probs)])
    groups = exact_quantiles(df, ["x"], probs, ["g"]).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(groups.to_numpy(), pdf.groupby("g").x.quantile(probs).unstack().to_numpy())


@pytest.mark.parametrize("size", [1, 2, 3, 10, 299, 301])
def test_quantiles_of_small_groups(spark, size):
    data = np.random.default_rng(size).normal(size=size)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    got = exact_quantiles(df, ["v"], [0.05, 0.5, 0.95]).first()
    np.testing.assert_allclose(list(got), np.quantile(data, [0.05, 0.5, 0.95]))


def test_narrow_brackets_are_exact(spark, monkeypatch):
    from millrace.operators import quantiles

    monkeypatch.setattr(quantiles, "GLOBAL_ACCURACY", 500)
    data = np.random.default_rng(1).gamma(0.5, size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"v": data})).repartition(9)
    np.testing.assert_allclose(list(exact_quantiles(df, ["v"], [0.1, 0.5, 0.9]).first()), np.quantile(data, [0.1, 0.5, 0.9]))


def test_skew_matches_pandas(spark, sample):
    pdf, df = sample
    assert df.agg(sample_skew(F.col("x"))).first()[0] == pytest.approx(pdf.x.skew())
    assert spark.createDataFrame([(1.0,)] * 5, "v double").agg(sample_skew(F.col("v"))).first()[0] == 0.0
    assert spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(sample_skew(F.col("v"))).first()[0] is None


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_matches_pandas(sample, method):
    pdf, df = sample
    both = df.withColumn("one", F.lit(2.0))
    got = correlation.correlation(both, ["x", "y", "g", "one"], method).toPandas().pivot(index="feature_1", columns="feature_2", values="correlation")
    want = pdf[["x", "y", "g"]].corr(method=method)
    for a in want.columns:
        for b in want.columns:
            assert got.loc[a, b] == pytest.approx(want.loc[a, b])
    assert got["one"].isna().all()


def test_encode_for_correlation(spark):
    df = spark.createDataFrame([("b", "x0"), ("a", "x1"), (None, "x2")] + [("a", f"x{i}") for i in range(3, 25)], "s string, t string")
    out = correlation.encode_for_correlation(df)
    assert [r.s for r in out.limit(3).collect()] == [1, 0, None]
    assert dict(out.dtypes)["t"] == "string"


@pytest.mark.parametrize("aggs", [["mean"], ["sum", "median", "std"]])
def test_pivot_with_margins_matches_pandas(spark, aggs):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"r": rng.choice(["p", "q", None], 200), "c": rng.choice(["u", "v"], 200), "v": rng.normal(size=200)})
    pdf.loc[::9, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "r string, c string, v double")
    want = pd.pivot_table(pdf, values=["v"], index="r", columns="c", aggfunc=aggs, margins=True, margins_name="Total")
    got = pivot(df, "r", "v", "c", aggs, fill_value=None, margins=True).toPandas().set_index("r")
    for agg, _, head in want.columns:
        name = f"v_{agg}_{head}" if len(aggs) > 1 else f"v_{head}"
        for key in ("p", "q", "Total"):
            assert got.loc[key, name] == pytest.approx(want[(agg, "v", head)][key]), (agg, head, key)


def test_pivot_details(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 3.0), (None, "x", 5.0)], "r string, c string, v double")
    assert {r.r: (r.v_x, r.v_y) for r in pivot(df, "r", "v", "c").collect()} == {"a": (1.0, 0.0), "b": (3.0, 0.0)}
    assert {r.r: r.v for r in pivot(df.filter("c = 'y'"), "r", "v", aggs="mean").collect()} == {}
    assert [r.v_x for r in pivot(df, "r", "v", "c", sort="desc").collect()] == [3.0, 1.0]
    share = {r.r: r.v_x for r in pivot(df, "r", "v", "c", normalize="columns").collect()}
    assert share == {"a": 25.0, "b": 75.0}
    with pytest.raises(ValueError):
        pivot(df, [], "v")


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 21), 100]] + [(None,)], "v double")
    assert [r.v for r in outliers.outliers(df, "v").collect()] == [100.0]
    assert outliers.treat(df, "v", "remove").count() == 21
    capped = [r.v for r in outliers.treat(df, "v", "cap", "range", lo=2, hi=10).collect()]
    assert None in capped and max(v for v in capped if v is not None) == 10.0
    flat = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert outliers.outlier_stats(flat, "v", "zscore").first().outliers == 0
    z = [r.v for r in outliers.treat(df, "v", "cap", "zscore", threshold=1.0).collect() if r.v is not None]
    data = np.array([*range(1, 21), 100], dtype=float)
    assert max(z) == pytest.approx(data.mean() + data.std(ddof=1))
    codes = [(r.level, r.code) for r in outliers.validate_anomaly(df, "v", 0.4).collect()]
    assert codes == [("warning", "sample"), ("warning", "contamination")]
    assert outliers.validate_anomaly(df.limit(5), "v", 0.1).first().code == "sample"
    assert outliers.validate_anomaly(df, "w", 0.1).first().code == "column"


def brute_lof(values, k):
    d = np.abs(values[:, None] - values[None, :])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, near, 1).max(axis=1)
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(axis=1) + 1e-10)
    return lrd[near].mean(axis=1) / lrd


def test_local_outlier_factor_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "CHUNK", 100)
    data = np.random.default_rng(2).normal(size=700)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(data)] + [(-1, None)], "i int, v double")
    got = anomaly.local_outlier_factors(df, "v", k=5).toPandas().set_index("i").lof
    assert np.isnan(got[-1])
    np.testing.assert_allclose(got.drop(-1).sort_index(), brute_lof(data, 5))
    flagged = anomaly.local_outlier_factor(df, "v", 0.05, k=5).filter("is_outlier").count()
    assert 30 <= flagged <= 36


def test_window_ties_keep_the_nearest():
    assert kernels.nearest_windows(np.array([0.0, 0.0, 5.0, 8.0, 9.0]), 3)[2] == 1


def test_isolation_forest_finds_the_planted_extreme(spark):
    data = np.random.default_rng(4).normal(size=3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*data, 60.0])] + [(-1, None)], "i int, v double")
    out = anomaly.isolation_forest(df, "v", 0.05, key="i").toPandas().set_index("i").is_outlier
    assert out[3000] and not out[-1]
    assert 0.03 < out.mean() <= 0.06


def test_features(spark):
    df = spark.createDataFrame([("b", 1.0, 2.0), (None, 3.0, 2.0), ("a", 5.0, 2.0)], "s string, v double, c double")
    hot = features.one_hot(df, "s").collect()
    assert [(r.s_a, r.s_b) for r in hot] == [(False, True), (False, False), (True, False)]
    with pytest.raises(ValueError):
        features.one_hot(df, "s", max_values=1)
    codes = {r.s: r.s_encoded for r in features.label_encode(df, "s").collect()}
    assert codes == {"a": 0, "b": 1, None: 2}
    std = [r.v for r in features.scale(df, ["v", "c"], "standard").collect()]
    np.testing.assert_allclose(std, (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5]))
    for method in features.SCALERS:
        assert [r.c for r in features.scale(df, "c", method).collect()] == [0.0, 0.0, 0.0]
    poly = features.polynomial(df.select("v", "c"), ["v", "c"], 3)
    assert set(poly.columns) == {"v", "c", "v^2", "v c", "c^2", "v^3", "v^2 c", "v c^2", "c^3"}
    with pytest.raises(ValueError):
        features.polynomial(spark.createDataFrame([(1.0, None)], "v double, c double"), ["v", "c"])


def test_profile_and_quality(spark):
    df = spark.createDataFrame([(1, "a", -1.0, True), (1, "a", -1.0, True), (2, None, None, False), (3, "b", 4.0, None)], "i int, t string, v double, b boolean")
    stats = {r.column: r for r in profile.column_stats(df).collect()}
    assert stats["v"].median == -1.0 and stats["v"].unique == 2 and stats["t"].missing_pct == 25.0 and stats["b"].mean == pytest.approx(2 / 3)
    assert {r.column: (r.missing, r.unique) for r in profile.column_info(df).collect()} == {"i": (0, 3), "t": (1, 2), "v": (1, 2), "b": (1, 2)}
    score = profile.quality_score(df).first()
    assert score.completeness == pytest.approx(40 * 13 / 16, abs=0.01) and score.uniqueness == 15.0 and score.validity == 9.0
    assert score.duplicate_rows == 1 and score.consistency == 30.0 and score.typed_column_share == 0.75
    assert profile.quality_score(df.limit(0)).first().uniqueness == 0.0
    assert [tuple(r) for r in profile.value_counts(df, "t", 1).collect()] == [("a", 2)]
    report = profile.cleaning_report(df, df.dropna().select("i", "t", F.lit(1).alias("z")), [str(i) for i in range(60)]).first()
    assert report.rows_removed == 2 and report.columns_removed == ["b", "v"] and report.columns_added == ["z"] and len(report.recent_actions) == 50
    assert profile.next_step(df).first().advice == "clean text"


def test_findings_and_selection(spark):
    rows = [(i, i * 2.0, 1, "a" if i % 50 else "b", None if i % 20 else 3.0, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, d double, k int, s string, n double, u string")
    kinds = {(r.kind, r.subject) for r in insights.findings(df).collect()}
    assert {("constant", "k"), ("constant", "n"), ("imbalance", "s"), ("high_missing", "n"), ("correlated", "i ~ d"), ("missing", "table")} <= kinds
    drops = {(r.column, r.type) for r in insights.suggest_drops(df).collect()}
    assert drops == {("k", "Constant"), ("n", "Constant"), ("n", "High Missing"), ("d", "High Correlation")}
    picked = {r.column: r.reason for r in insights.select_features(df).collect()}
    assert picked["d"] is None and picked["s"] is None
    assert picked["k"].startswith("never") and picked["i"].startswith("looks like a key") and picked["u"].startswith("looks like a key")


def test_chart_tables(sample):
    pdf, df = sample
    bins = {r.bin: r["count"] for r in chart.histogram(df, "x", 10).collect()}
    want, _ = np.histogram(pdf.x, bins=10)
    assert bins == {i: n for i, n in enumerate(want) if n}
    line = chart.ols(df, "x", "y").first()
    known = pdf.dropna()
    np.testing.assert_allclose([line.slope, line.intercept], np.polyfit(known.x, known.y, 1))
    box = {r.g: r for r in chart.box_stats(df, "x", "g").collect()}
    part = pdf[pdf.g == 1].x
    q1, q3 = part.quantile([0.25, 0.75])
    inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
    assert (box[1].upper_whisker, box[1].outliers) == (inside.max(), len(part) - len(inside))
    assert chart.value_share(df, "g").agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_pivot_keeps_a_key_named_total_and_refuses_clashing_names(spark):
    df = spark.createDataFrame([("Total", "Total", 1.0), ("b", "x", 5.0)], "k string, c string, v double")
    rows = [tuple(r) for r in pivot(df, "k", "v", margins=True).collect()]
    assert sorted(rows) == [("Total", 1.0), ("Total", 6.0), ("b", 5.0)]
    with pytest.raises(ValueError, match="one name"):
        pivot(df, "k", "v", "c", margins=True)
    clash = spark.createDataFrame([("r", "a_b", "c", 1.0), ("r", "a", "b_c", 2.0)], "k string, c string, d string, v double")
    with pytest.raises(ValueError, match="one name"):
        pivot(clash, "k", "v", ["c", "d"])


def test_hot_groups_are_dealt_over_parts(spark):
    """With a key of half the rows and nothing broadcast, no partition of the join holds more than a few parts of it."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).selectExpr("IF(id % 2 = 0, 'hot', CAST(id % 50 AS STRING)) AS k", "CAST(id AS DOUBLE) AS v")
        keys = rows.select("k").distinct().withColumnRenamed("k", "kk")
        sizes = salted_join(rows, keys, [("k", "kk")]).withColumn("p", F.spark_partition_id()).groupBy("k", "_salt").agg(F.count("*").alias("n"), F.max("p").alias("p"))
        hot = sizes.filter("k = 'hot'").toPandas()
        assert len(hot) == 16 and hot["n"].max() <= 10_000 / 16 * 1.5 and hot["p"].nunique() > 1
        box = {r.k: r for r in chart.box_stats(rows, "v", "k").collect()}
        assert box["hot"]["count"] == 10_000 and box["hot"].median == 9_999.0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_three_hundred_columns_correlate_in_one_scan(spark):
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(500, 300)) * 50 + 1e7
    wide[:, 1], wide[:, 5] = wide[:, 0] * -2, 3.0
    wide[rng.random(wide.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(wide, columns=[f"k{i}" for i in range(300)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"k{i} double" for i in range(300))).repartition(4)
    found = correlation.correlation_pairs(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = pdf.corr(min_periods=2)
    rows = found.collect()
    assert len(rows) == 300 * 299 // 2
    for r in rows:
        if "k5" in (r.feature_1, r.feature_2):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want.loc[r.feature_1, r.feature_2], abs=1e-8)


@pytest.mark.parametrize("patterns", [64, 2])
def test_ranks_by_patterns_of_missing_values(spark, monkeypatch, patterns):
    monkeypatch.setattr(correlation, "MOST_PATTERNS", patterns)  # beyond it, pairs are ranked one by one
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 4)) * 3)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.arange(400)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double").repartition(3)
    want = pdf.corr("spearman")
    for r in correlation.correlation_pairs(df, method="spearman").collect():
        assert r.correlation == pytest.approx(want.loc[r.feature_1, r.feature_2], abs=1e-9)
    empty = correlation.correlation_pairs(df.limit(0), method="spearman").collect()
    assert len(empty) == 6 and all(r.correlation is None for r in empty)
