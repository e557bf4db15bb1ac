import numpy as np
import pandas as pd
import pytest
from pyspark.ml import classification as C
from pyspark.ml import evaluation as E
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from millrace.ml import checks, forest, knn, metrics, models, network, weights
from millrace.ml.boost import AdaBoost
from millrace.ml.weights import Condensed
from millrace.session import Tables
from millrace.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"i": range(400), "a": a, "b": b, "side": np.where(a + b > 0, "up", "down"), "y": 3 * a - b + rng.normal(size=400) * 0.1})
    pdf["three"] = np.where(a > 0.5, "hi", np.where(a < -0.5, "lo", "mid"))
    return spark.createDataFrame(pdf).repartition(4).cache()


def test_split_is_stable(table):
    train, test = models.split(table, 0.25, key="i")
    again = models.split(table.repartition(7), 0.25, key="i")[1]
    assert train.count() + test.count() == 400 and 60 < test.count() < 140
    assert {r.i for r in test.collect()} == {r.i for r in again.collect()}
    with pytest.raises(ValueError):
        models.split(table, 0.5)


def test_classifiers_beat_the_majority(table):
    chosen = {
        "Logistic Regression": models.classifiers(2, 2, 320)["Logistic Regression"],
        "Decision Tree": C.DecisionTreeClassifier(maxDepth=5, seed=1),
        "K-Neighbors": knn.KNearest(k=5),
        "AdaBoost": AdaBoost(rounds=7),
    }
    results = models.train_models(table, ["a", "b"], "side", "classification", chosen, folds=None)
    assert {r.name for r in results} == set(chosen)
    assert all(r.metrics["accuracy"] > 0.75 for r in results), [(r.name, r.metrics["accuracy"]) for r in results]
    board = metrics.with_reliability(models.leaderboard(results, "classification"), "classification")
    best = {r.recommendation: r.model for r in metrics.recommend_models(board, "classification").collect()}
    assert {"best_overall", "best_fast", "best_precision", "best_recall", "best_auc"} <= set(best)
    weights = models.feature_importance(results[0].model, ["a", "b"]).collect()
    assert {r.feature for r in weights} == {"a", "b"}


def test_three_classes(table):
    every = models.classifiers(2, 3, 320)
    chosen = {"SVM": every["SVM"], "AdaBoost": AdaBoost(rounds=6), "Naive Bayes": every["Naive Bayes"]}
    chosen["SVM"].getClassifier().setMaxIter(5)
    results = models.train_models(table, ["a", "b"], "three", "classification", chosen, folds=None)
    assert all(r.metrics["accuracy"] > 0.5 for r in results), [(r.name, r.metrics) for r in results]


def test_regressors_and_cross_validation(table):
    results = models.train_models(table, ["a", "b"], "y", "regression", ["Ridge Regression", "K-Neighbors"], folds=3, key="i")
    assert all(r.metrics["r2"] > 0.8 and r.cv_mean > 0.8 and r.cv_std < 0.2 for r in results)
    board = metrics.with_reliability(models.leaderboard(results, "regression"), "regression")
    assert metrics.recommend_models(board, "regression").count() == 5


def test_ridge_strength_matches_closed_form(spark, table):
    pdf = table.toPandas()
    x, y = pdf[["a", "b"]].to_numpy(), pdf.y.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    rows = models.label_rows(table, "y", "regression")
    fitted = models.pipeline("Ridge Regression", models.regressors(400, float(y.std(ddof=1)))["Ridge Regression"], ["a", "b"], scale=False).fit(rows)
    np.testing.assert_allclose(fitted.stages[-1].coefficients.toArray(), want, rtol=1e-4)


def test_tuning_and_stacking(table):
    rows = models.label_rows(table, "side", "classification")
    found = models.tune("Random Forest", C.RandomForestClassifier(seed=1), rows, ["a", "b"], "accuracy", {"numTrees": [3], "maxDepth": [2, 4]})
    assert models.tuning_table(found).count() == 2
    base = {"Decision Tree": C.DecisionTreeClassifier(maxDepth=3), "Naive Bayes": C.NaiveBayes(modelType="gaussian"), "Logistic Regression": C.LogisticRegression()}
    assert models.stack(table, ["a", "b"], "side", "classification", base).metrics["accuracy"] > 0.8
    with pytest.raises(ValueError):
        models.stack(table, ["a", "b"], "side", "classification", dict(list(base.items())[:2]))


@pytest.mark.parametrize("cell_rows", [10_000, 40])
def test_knn_equals_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 7 if cell_rows < 1000 else 10_000)
    rng = np.random.default_rng(9)
    train = pd.DataFrame({"i": range(500), "a": rng.integers(0, 30, 500) * 1.0, "b": rng.normal(size=500).round(1), "t": rng.choice(list("xyz"), 500)})
    train.loc[:160, ["a", "b"]] = 3.0  # a third of the train rows are one point
    test = pd.DataFrame({"j": range(200), "a": rng.integers(-5, 35, 200) * 1.0, "b": rng.normal(size=200).round(1)})
    test.loc[:70, ["a", "b"]] = 3.0
    got = knn.knn_predict(spark.createDataFrame(train), spark.createDataFrame(test), ["a", "b"], "t", "i", 5).toPandas().set_index("j").prediction
    assert len(got) == 200
    for _, row in test.iterrows():
        d = np.sqrt((train.a - row.a) ** 2 + (train.b - row.b) ** 2)
        near = train.assign(d=d).sort_values(["d", "i"]).head(5)
        votes = near.t.value_counts()
        assert got[row.j] == min(votes[votes == votes.max()].index)


def test_metrics_agree_with_mllib(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"label": rng.integers(0, 3, 500) * 1.0, "prediction": rng.integers(0, 3, 500) * 1.0})
    df = spark.createDataFrame(pdf)
    got = metrics.classification_metrics(df).first()
    for ours, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert got[ours] == pytest.approx(E.MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))
    assert got.fpr is None
    scored = spark.createDataFrame(pd.DataFrame({"label": rng.integers(0, 2, 400) * 1.0, "score": rng.integers(0, 20, 400) * 1.0}))
    auc = E.BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(scored)
    assert metrics.roc_auc(scored, "score").first()[0] == pytest.approx(auc)


def test_regression_metric_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (2.0, 1.0)], "label double, prediction double")
    got = metrics.regression_metrics(df).first()
    assert got.mape is None and got.mae == pytest.approx(2 / 3)
    assert metrics.regression_errors(df).first().mean_pct_error == pytest.approx(50.0)
    worst = metrics.worst_predictions(df.withColumn("k", F.monotonically_increasing_id()), ["k"], k=2)
    assert worst.count() == 2


def test_checks(spark, table):
    assert checks.problem_type(table, "y").first().problem_type == "regression"
    assert checks.problem_type(table, "side").first().problem_type == "classification"
    one = table.withColumn("one", F.lit(1))
    assert [r.code for r in checks.check_target(one, "one", "classification").collect()] == ["few_classes"]
    assert [r.code for r in checks.check_target(table, "side", "regression").collect()] == ["not_numeric"]
    assert checks.check_regression(one, ["a"], "one").first().code == "constant_target"
    assert checks.check_ready(table, ["a", "side"], "y").first().code == "not_numeric"
    assert checks.scoring_for(table, "side", "classification") == "roc_auc"
    assert checks.scoring_for(table, "three", "classification") == "accuracy"
    assert checks.default_features(table, "y") == ["i", "a", "b", "side", "three"]
    codes = {(r.code) for r in checks.training_advice(table, ["a"], "side", "classification").collect()}
    assert codes == {"medium"}


@pytest.fixture(scope="module")
def labelled(table):
    return models.label_rows(table, "three", "classification")


def same(a, b, columns):
    rows = [sorted(tuple(map(str, r)) for r in df.select("i", *columns).collect()) for df in (a, b)]
    assert rows[0] == rows[1]


def test_python_models_are_saved_with_their_tables(table, labelled, tmp_path):
    for name, est in (("K-Neighbors", knn.KNearest(k=5)), ("AdaBoost", AdaBoost(rounds=3)), ("SVM", models.classifiers(2, 3, 400)["SVM"])):
        if name == "SVM":
            est.getClassifier().setMaxIter(1)
        fitted = models.pipeline(name, est, ["a", "b"]).fit(labelled)
        sinks.save_model(fitted, f"{tmp_path}/{name}")
        sinks.save_model(fitted, f"{tmp_path}/{name}")  # over the last one
        loaded = sinks.load_model(f"{tmp_path}/{name}")
        same(fitted.transform(labelled), loaded.transform(labelled), ["prediction", "probability"])
    near = models.pipeline("K-Neighbors", knn.KNearest(k=3, problem="regression"), ["a", "b"]).fit(models.label_rows(table, "y", "regression"))
    sinks.save_model(near, f"{tmp_path}/near")
    same(near.transform(table), sinks.load_model(f"{tmp_path}/near").transform(table), ["prediction"])


def test_a_stack_is_saved_with_its_models(labelled, tmp_path):
    base = {"K-Neighbors": knn.KNearest(k=5), "AdaBoost": AdaBoost(rounds=3), "Naive Bayes": C.NaiveBayes(modelType="gaussian")}
    fitted = models.Stack(base, ["a", "b"], "classification", folds=3).fit(labelled.select("i", "a", "b", "label"))
    sinks.save_model(fitted, f"{tmp_path}/stack")
    loaded = sinks.load_model(f"{tmp_path}/stack")
    assert isinstance(loaded, models.StackModel)
    same(fitted.transform(labelled), loaded.transform(labelled), ["prediction"])


def test_boosting_votes_are_one_projection(labelled):
    model = models.pipeline("AdaBoost", AdaBoost(rounds=8), ["a", "b"]).fit(labelled).stages[-1]
    rows = models.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled)
    for r in model.transform(rows).select("a", "b", "rawPrediction", "probability", "prediction").collect():
        votes = np.zeros(3)
        for s in model.stumps:
            votes[s.left if s.feature < 0 or (r.a, r.b)[s.feature] <= s.threshold else s.right] += s.weight
        total = sum(s.weight for s in model.stumps)
        odds = np.exp((votes - (total - votes) / 2) / (total * 2))
        assert np.allclose(r.rawPrediction.toArray(), votes) and np.allclose(r.probability.toArray(), odds / odds.sum())
        assert r.prediction == votes.argmax()
    plan = model.transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 6  # one each for the rounds would be 8 more


def test_neighbour_shares_are_probabilities(labelled):
    scored = models.pipeline("K-Neighbors", knn.KNearest(k=4), ["a", "b"]).fit(labelled).transform(labelled)
    for r in scored.select("rawPrediction", "probability", "prediction").collect():
        raw = r.rawPrediction.toArray()
        assert raw.sum() == 4 and np.allclose(r.probability.toArray(), raw / 4) and raw[int(r.prediction)] == raw.max()


def test_folds_are_shared_and_scored_by_rows(spark, table):
    two = models.label_rows(table, "side", "classification")
    lines = {n: models.pipeline(n, e, ["a", "b"]) for n, e in {"Decision Tree": C.DecisionTreeClassifier(maxDepth=3, seed=1), "AdaBoost": AdaBoost(rounds=3)}.items()}
    with Tables(spark) as tables:
        rows = models.out_of_fold(lines, two, tables, folds=3, key="i")
        kept = rows.toPandas()
        found = {s: {(r.model, r.fold): r.value for r in models.fold_scores(rows, s).collect()} for s in ("accuracy", "f1_weighted", "roc_auc", "r2")}
    assert len(kept) == 800 and kept.groupby("model").fold.value_counts().unstack().nunique().eq(1).all()
    for (model, fold), part in kept.groupby(["model", "fold"]):
        y, p, s = part.label.to_numpy(), part.prediction.to_numpy(), part.score.to_numpy()
        assert found["accuracy"][model, fold] == pytest.approx((y == p).mean())
        assert found["r2"][model, fold] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        pairs = s[y == 1][:, None] - s[y == 0][None]
        assert found["roc_auc"][model, fold] == pytest.approx((pairs > 0).mean() + (pairs == 0).mean() / 2)
        f1 = sum((y == c).mean() * 2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in (0, 1))
        assert found["f1_weighted"][model, fold] == pytest.approx(f1)
    with_null = spark.createDataFrame([("m", 0, 1.0, 1.0, None), ("m", 0, 0.0, 1.0, 0.3)], "model string, fold int, label double, prediction double, score double")
    assert models.fold_scores(with_null, "roc_auc").first()["value"] is None
    checked = models.cross_validate_all(lines, two, "roc_auc", folds=3, key="i")
    assert all(mean > 0.8 and std < 0.2 for mean, std in checked.values())


def test_equal_rows_are_fitted_once_by_weight(table):
    few = models.label_rows(table, "side", "classification").select(F.round("a", 1).alias("a"), F.round("b", 1).alias("b"), "label")
    many = few.unionAll(few).unionAll(few.filter("a > 0"))
    for name, est in models.classifiers(2, 2, 1000).items():
        line = models.pipeline(name, est, ["a", "b"])
        assert isinstance(line.getStages()[-1], Condensed) == (name not in ("Random Forest", "K-Neighbors", "Neural Network"))
    for name, est in (("Logistic Regression", models.classifiers(2, 2, 1000)["Logistic Regression"]), ("Decision Tree", C.DecisionTreeClassifier(maxDepth=4, seed=1)), ("AdaBoost", AdaBoost(rounds=4))):
        line = models.pipeline(name, est, ["a", "b"])
        plain = models.Pipeline(stages=[*line.getStages()[:-1], est])
        got, want = (p.fit(many).transform(few).select("a", "b", "probability").collect() for p in (line, plain))
        sides = [sorted((r.a, r.b, *r.probability.toArray()) for r in rows) for rows in (got, want)]
        np.testing.assert_allclose(sides[0], sides[1], atol=1e-5)


def test_narrow_tables_are_dealt_over_the_cores(spark):
    with Tables(spark) as tables:
        dealt = tables.deal(spark.range(0, 200_000, 1, 1))
        assert dealt.count() == 200_000 and dealt.rdd.getNumPartitions() >= 4
        assert tables.deal(spark.range(0, 0, 1, 1)).count() == 0


def test_base_models_of_a_stack_are_scored_once(spark, labelled, monkeypatch):
    calls = []
    plain = knn.KNearestModel._transform
    monkeypatch.setattr(knn.KNearestModel, "_transform", lambda self, df: calls.append(1) or plain(self, df))
    stored = []
    keep = Tables.keep
    monkeypatch.setattr(Tables, "keep", lambda self, df, label="table": stored.append(label) or keep(self, df, label))
    base = {"K-Neighbors": knn.KNearest(k=5), "Decision Tree": C.DecisionTreeClassifier(maxDepth=3), "Naive Bayes": C.NaiveBayes(modelType="gaussian")}
    models.Stack(base, ["a", "b"], "classification", folds=3).fit(labelled.select("a", "b", "label"))
    assert len(calls) == 3 and stored.count("stack-fold") == 3


def test_copies_of_rows_are_fitted_and_scored_once(spark, table, monkeypatch):
    few = models.label_rows(table, "side", "classification").selectExpr("i", "ROUND(a, 1) AS a", "ROUND(b, 1) AS b", "side", "label").limit(60)
    many = few.crossJoin(spark.range(50).withColumnRenamed("id", "copy"))
    seen = []
    fit = Condensed._fit
    monkeypatch.setattr(Condensed, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    lines = {"Logistic Regression": models.pipeline("Logistic Regression", models.classifiers(2, 2, 1000)["Logistic Regression"], ["a", "b"])}
    with Tables(spark) as tables:
        rows = models.out_of_fold(lines, many, tables, folds=3, key="i")
        assert rows.count() == 3000 and max(seen) <= 60
        assert rows.groupBy("fold", "label").count().filter("count % 50 <> 0").count() == 0
        want = {r.fold: r.value for r in models.fold_scores(rows, "f1_weighted").collect()}
    checked = models.cross_validate_all(lines, many, "f1_weighted", folds=3, key="i")
    assert checked["Logistic Regression"][0] == pytest.approx(sum(want.values()) / 3)
    seen.clear()
    models.train_models(many.drop("label"), ["a", "b"], "side", "classification", ["Decision Tree"], folds=None, key="i")
    base = {n: models.classifiers(2, 2, 1000)[n] for n in ("Logistic Regression", "Decision Tree", "Naive Bayes")}
    models.Stack(base, ["a", "b"], "classification", folds=3).fit(many.select("a", "b", "label"))
    assert max(seen) <= 60


def test_a_scaler_counts_what_rows_stand_for(spark):
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = spark.createDataFrame([(1.0, 5.0, 3), (2.5, 5.0, 1), (-4.0, 5.0, 2000)], "a double, b double, n bigint").withColumnRenamed("n", weights.STANDS_FOR)
    put = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    scaler = StandardScaler(inputCol="x", outputCol="features", withMean=True, withStd=True)
    every = weights.every_row(rows)
    assert every.count() == 2004
    got, want = weights.Scaled(scaler).fit(put.transform(rows)), scaler.fit(put.transform(every))
    np.testing.assert_allclose(got.mean.toArray(), want.mean.toArray())
    np.testing.assert_allclose(got.std.toArray(), want.std.toArray(), atol=1e-12)


@pytest.fixture(scope="module")
def copies(spark):
    """3,000 rows of at most 60 cells."""
    rng = np.random.default_rng(12)
    a, b = rng.integers(0, 10, 3000) * 1.0, rng.integers(0, 6, 3000) * 0.5
    y = np.where(a > 4, 2 * a, -b) + rng.integers(0, 3, 3000)
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y, "side": (y > 3) * 1.0 + (y > 12)})).repartition(4).cache()


@pytest.mark.parametrize("kind, label", [(R.RandomForestRegressor, "y"), (C.RandomForestClassifier, "side")])
def test_a_forest_grows_the_trees_of_mllib_from_cells(copies, kind, label, tmp_path):
    rows = copies.withColumnRenamed(label, "label")
    one = kind(numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=30, minInstancesPerNode=40, seed=3)
    line = models.pipeline("Random Forest", one, ["a", "b"])
    plain = models.Pipeline(stages=[line.getStages()[0], one])
    fitted = [line.fit(weights.distinct_rows(rows, ["a", "b", "label"])), line.fit(rows), plain.fit(rows)]
    assert [isinstance(f.stages[-1], forest.ForestModel) for f in fitted] == [True, True, False]
    sinks.save_model(fitted[0], f"{tmp_path}/forest")
    fitted.append(sinks.load_model(f"{tmp_path}/forest"))
    points = rows.select("a", "b").distinct()
    answers = ["prediction", *(["probability", "rawPrediction"] if kind is C.RandomForestClassifier else [])]
    got = [f.transform(points).orderBy("a", "b").toPandas()[answers] for f in fitted]
    for side in got[:2] + got[3:]:
        for c in answers:
            np.testing.assert_allclose(np.vstack(side[c].map(np.atleast_1d)), np.vstack(got[2][c].map(np.atleast_1d)), atol=1e-9)
    np.testing.assert_allclose(fitted[0].stages[-1].featureImportances.toArray(), fitted[2].stages[-1].featureImportances.toArray(), atol=1e-9)
    many = kind(numTrees=30, maxDepth=30, featureSubsetStrategy="all", seed=3)
    line = models.pipeline("Random Forest", many, ["a", "b"])
    both = [f.fit(rows).transform(points).orderBy("a", "b").toPandas().prediction for f in (line, models.Pipeline(stages=[line.getStages()[0], many]))]
    assert np.corrcoef(*both)[0, 1] > 0.99


def test_a_bootstrap_draws_rows_and_not_distinct_rows(spark):
    from millrace.functions.kernels import drawn_sums

    rows = pd.DataFrame({"cell": ["0", "1", "0"], "y": [1.0, 2.0, 3.0], "n": [400, 900, 0]})
    (drawn,) = drawn_sums(iter([rows]), ["cell"], "n", 2000, 1.0, True, 3, [5])
    for w, mean in zip(drawn.w, (400, 900)):
        assert abs(w.mean() - mean) < 3 and 0.8 * mean < w.var() < 1.2 * mean  # a Poisson draw a row
    np.testing.assert_allclose(drawn.q[1], 4 * drawn.w[1])


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_neighbours_are_fitted_on_distinct_rows(copies, problem):
    rows = copies.withColumnRenamed("side" if problem == "classification" else "y", "label")
    line = models.pipeline("K-Neighbors", knn.KNearest(k=5, problem=problem), ["a", "b"], scale=False)
    assert weights.takes_distinct(line)
    points = rows.selectExpr("a + 0.3 AS a", "b").distinct()
    got, want = (line.fit(t).transform(points).orderBy("a", "b").toPandas().prediction for t in (weights.distinct_rows(rows, ["a", "b", "label"]), rows))
    np.testing.assert_allclose(got, want)


def test_tuning_fits_distinct_rows_and_every_point_of_the_grid(copies, monkeypatch):
    seen = []
    for kind in (forest.Forest, Condensed):
        monkeypatch.setattr(kind, "_fit", lambda self, df, fit=kind._fit: seen.append(df.count()) or fit(self, df))
    rows = copies.withColumn("label", F.expr("CAST(a > 4 AND b > 0.5 AS DOUBLE)"))
    for name, est, grid in (
        ("Random Forest", C.RandomForestClassifier(seed=1, numTrees=5), {"maxDepth": [1, 3]}),
        ("Gradient Boosting", C.GBTClassifier(seed=1, maxIter=1), {"maxDepth": [1, 3]}),
    ):
        found = models.tune(name, est, rows, ["a", "b"], "accuracy", grid)
        assert found.avgMetrics[0] < found.avgMetrics[1]
    assert max(seen) <= 360  # distinct rows of the folds


@pytest.mark.parametrize("kind, label", [(R.RandomForestRegressor, "y"), (C.RandomForestClassifier, "side")])
def test_forests_of_a_grid_are_those_fitted_alone(copies, kind, label, monkeypatch):
    rows = weights.distinct_rows(copies.withColumnRenamed(label, "label"), ["a", "b", "label"])
    est = kind(seed=3, maxDepth=4)
    line = models.Line(stages=models.pipeline("Random Forest", est, ["a", "b"]).getStages())
    summed = []
    monkeypatch.setattr(forest, "_sums", lambda *a, sums=forest._sums: summed.append(a) or sums(*a))
    grid = [{est.numTrees: 1, est.maxDepth: 2}, {est.numTrees: 6, est.maxDepth: 9}, {est.numTrees: 3, est.maxBins: 2}]
    points = rows.select("a", "b").distinct()
    got = {i: m.transform(points).orderBy("a", "b").toPandas().prediction for i, m in line.fitMultiple(rows, grid)}
    assert len(got) == 3 and len(summed) == 2  # rows are drawn once for each way to cut them into cells
    for i, params in enumerate(grid):
        alone = models.pipeline("Random Forest", est.copy(params), ["a", "b"]).fit(rows)
        assert len(alone.stages[-1].trees) == params[est.numTrees]
        np.testing.assert_allclose(got[i], alone.transform(points).orderBy("a", "b").toPandas().prediction)


def test_the_tune_query_searches_the_whole_grid(spark, sf_dir, monkeypatch):
    from millrace.plans import learning

    searched = []

    class Search(models.CrossValidator):
        def fit(self, df):
            searched.extend({p.name: v for p, v in params.items()} for params in self.getEstimatorParamMaps())
            return None

    monkeypatch.setattr(models, "CrossValidator", Search)
    monkeypatch.setattr(models, "tuning_table", lambda found: found)
    learning.tune(spark, sf_dir)
    want = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m} for n in (50, 100, 200) for d in (30, 10, 20) for m in (1, 2)]
    assert sorted(searched, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("steps", [12, 400])
def test_a_network_takes_the_steps_of_mllib_on_distinct_rows(spark, steps):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-4, 5, 3000) * 0.5, rng.integers(-3, 4, 3000) * 0.5
    rows = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "label": ((a * b > 0.3) * 1.0 + (a > 1.4))})).coalesce(1).cache()
    base = C.MultilayerPerceptronClassifier(layers=[2, 5, 3], maxIter=steps, blockSize=3000, seed=9)  # all rows are one block
    line = models.pipeline("Neural Network", base, ["a", "b"], scale=False)
    plain = models.Pipeline(stages=[line.getStages()[0], base])
    fitted = [f.fit(rows).stages[-1] for f in (line, plain)]
    once = line.fit(weights.distinct_rows(rows, ["a", "b", "label"])).stages[-1]
    assert fitted[0].getMaxIter() == steps and not fitted[0].hasDefault("initialWeights") and not fitted[0].isSet("initialWeights")
    np.testing.assert_allclose(once.weights.toArray(), fitted[0].weights.toArray(), rtol=1e-9)
    if steps < 50:
        np.testing.assert_allclose(fitted[0].weights.toArray(), fitted[1].weights.toArray(), rtol=1e-5, atol=1e-7)
    points = line.getStages()[0].transform(rows.select("a", "b").distinct().orderBy("a", "b"))
    got, want = (np.vstack(f.transform(points).toPandas().probability.map(lambda v: v.toArray())) for f in fitted)
    np.testing.assert_allclose(got, want, atol=0.01)


def test_a_network_of_mostly_distinct_rows_is_fitted_by_mllib(table, monkeypatch):
    monkeypatch.setattr(network, "fit_network", None)
    rows = models.label_rows(table, "side", "classification")
    base = C.MultilayerPerceptronClassifier(layers=[2, 4, 2], maxIter=5, seed=9)
    line = models.pipeline("Neural Network", base, ["a", "b"])
    want = models.Pipeline(stages=[*line.getStages()[:-1], base]).fit(rows).stages[-1].weights.toArray()
    np.testing.assert_allclose(line.fit(rows).stages[-1].weights.toArray(), want)
    with pytest.raises(Exception, match="(?i)label"):
        line.fit(table.limit(300).selectExpr("a * 0 AS a", "b * 0 AS b", "7.0 AS label"))
