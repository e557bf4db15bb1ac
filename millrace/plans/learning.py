"""Model checks, metrics, ranking and training."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import checks, knn, metrics, models
from ..ml.boost import AdaBoost
from ..operators.profile import beside, value_counts
from ..session import fresh_path
from ..sources import sinks
from .columns import _LINE_SQL, histogram_sql, rounded_bins, rounded_line
from .quality import rounded
from .registry import CLASSIFIED, ESTIMATED, EVENTS, LINES, query, table

FEATURES = ["p_size", "p_retailprice"]


def priced_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a two-class and a numeric target that depend on the features."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size", "p_retailprice", "CASE WHEN p_retailprice + p_size * 4 > 1050 THEN 'dear' ELSE 'cheap' END AS band",
        "p_retailprice * 2 + p_size * 10 + p_partkey % 7 AS cost",
    )


# -- checks -----------------------------------------------------------------
@query(
    """SELECT CASE WHEN d <= 10 THEN 'classification' WHEN d > 20 AND CAST(d AS DOUBLE) / n > 0.3 THEN 'regression' WHEN d <= 20 THEN 'classification' ELSE 'unknown' END AS problem_type,
    d AS "distinct", n AS "rows" FROM (SELECT COUNT(DISTINCT l_extendedprice) d, COUNT(*) n FROM lineitem)"""
)
def problem_type(spark: SparkSession, sf: str) -> DataFrame:
    return checks.problem_type(table(spark, sf, "lineitem"), "l_extendedprice")


@query(
    """WITH c AS (SELECT COUNT(DISTINCT p_partkey) d, COUNT(*) n FROM part)
    SELECT 'warning' AS level, 'many_classes' AS code, d || ' values would each be a class' AS message FROM c WHERE d > 50
    UNION ALL SELECT 'warning', 'high_cardinality', d || ' of ' || n || ' values are distinct' FROM c WHERE d > n * 0.5
    UNION ALL SELECT 'warning', 'numeric_labels', 'few distinct numbers, which may be codes' FROM c WHERE d <= 10"""
)
def check_target(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_target(table(spark, sf, "part"), "p_partkey", "classification")


@query(
    """WITH t AS (SELECT event_id, user_id, value, value * 2 + 1 AS twice, 1 AS unit, EXTRACT(day FROM ts) AS event_day FROM events)
    SELECT 'warning' AS level, 'correlated' AS code, 'twice' AS feature FROM t HAVING ABS(CORR(twice, value)) > 0.95
    UNION ALL SELECT 'warning', 'correlated', 'event_id' FROM t HAVING ABS(CORR(event_id, value)) > 0.95
    UNION ALL SELECT 'warning', 'identifier', 'event_id' FROM t HAVING COUNT(DISTINCT event_id) > 0.9 * COUNT(*) AND COUNT(DISTINCT event_id) > 100
    UNION ALL SELECT 'warning', 'identifier', 'twice' FROM t HAVING COUNT(DISTINCT twice) > 0.9 * COUNT(*) AND COUNT(DISTINCT twice) > 100
    UNION ALL SELECT 'warning', 'constant', 'unit' FROM t HAVING COUNT(DISTINCT unit) <= 1
    UNION ALL SELECT 'warning', 'date_name', 'event_day' FROM t HAVING COUNT(*) > 0"""
)
def leakage(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").selectExpr("event_id", "user_id", "value", "value * 2 + 1 AS twice", "1 AS unit", "day(ts) AS event_day")
    found = checks.leakage(df, ["event_id", "user_id", "twice", "unit", "event_day"], "value")
    return found.select("level", "code", F.regexp_extract("message", "'([^']+)'", 1).alias("feature"))


@query(
    """SELECT 'error' AS level, 'missing' AS code, CAST(COUNT(*) - COUNT(CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_acctbal END) AS VARCHAR) || ' missing values' AS message FROM customer
    UNION ALL SELECT 'error', 'not_numeric', '''c_mktsegment'' is not numeric' FROM customer HAVING COUNT(*) > 0"""
)
def check_ready(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_mktsegment", "CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_acctbal END AS c_acctbal", "c_nationkey"
    )
    return checks.check_ready(df, checks.default_features(df, "c_nationkey"), "c_nationkey")


@query(
    """WITH t AS (SELECT CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END AS side, 1 AS unit, value FROM events),
    c AS (SELECT MAX(n) AS top, MIN(n) AS low, SUM(n) AS n FROM (SELECT COUNT(*) AS n FROM t GROUP BY side))
    SELECT 'warning' AS level, 'imbalance' AS code FROM c WHERE top > 0.9 * n UNION ALL SELECT 'warning', 'small_class' FROM c WHERE low < 10
    UNION ALL SELECT 'warning', 'constant' FROM t HAVING COUNT(DISTINCT unit) <= 1"""
)
def check_classification(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").selectExpr("CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END AS side", "1 AS unit", "value")
    return checks.check_classification(df, ["unit", "value"], "side").drop("message")


@query(
    """WITH q AS (SELECT QUANTILE_CONT(value, CAST(0.25 AS DOUBLE)) q1, QUANTILE_CONT(value, CAST(0.75 AS DOUBLE)) q3 FROM events),
    o AS (SELECT AVG(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS p FROM events, q)
    SELECT 'warning' AS level, 'skewed' AS code FROM events HAVING ABS(SKEWNESS(value)) > 3
    UNION ALL SELECT 'warning', 'outliers' FROM o WHERE p > 0.05 UNION ALL SELECT 'warning', 'constant' FROM events HAVING COUNT(*) > 0"""
)
def check_regression(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").selectExpr("event_id", "user_id", "value", "1 AS unit")
    return checks.check_regression(df, ["event_id", "unit"], "value").drop("message")


@query(
    """SELECT CASE WHEN n < 100 THEN 'warning' ELSE 'info' END AS level, CASE WHEN n < 100 THEN 'small' WHEN n < 1000 THEN 'medium' ELSE 'large' END AS code FROM (SELECT COUNT(*) AS n FROM labels)
    UNION ALL SELECT 'warning', 'imbalance' FROM labels HAVING GREATEST(AVG(toxic), 1 - AVG(toxic)) > 0.8
    UNION ALL SELECT 'info', 'resample' FROM labels HAVING GREATEST(AVG(toxic), 1 - AVG(toxic)) > 0.8"""
)
def training_advice(spark: SparkSession, sf: str) -> DataFrame:
    return checks.training_advice(table(spark, sf, "labels"), ["quality"], "toxic", "classification").drop("message")


# -- metrics ----------------------------------------------------------------
@query(f"SELECT label, prediction, COUNT(*) AS \"count\" FROM {CLASSIFIED.sql} t GROUP BY label, prediction")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(CLASSIFIED.df(spark, sf))


@query(
    f"""WITH t AS {CLASSIFIED.sql}, k AS (SELECT CAST(COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) tp, CAST(COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) tn,
    CAST(COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) fp, CAST(COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) fn FROM t),
    m AS (SELECT *, tp + fn AS pos, tn + fp AS neg, tp + tn + fp + fn AS n, tp / (tp + fp) AS p1, tn / (tn + fn) AS p0, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0 FROM k)
    SELECT ROUND((tp + tn) / n, 8) AS accuracy, ROUND((pos * p1 + neg * p0) / n, 8) AS precision, ROUND((pos * r1 + neg * r0) / n, 8) AS recall,
    ROUND((pos * 2 * p1 * r1 / (p1 + r1) + neg * 2 * p0 * r0 / (p0 + r0)) / n, 8) AS f1, ROUND(fp / neg, 8) AS fpr, ROUND(fn / pos, 8) AS fnr FROM m"""
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.classification_metrics(CLASSIFIED.df(spark, sf))
    return rounded(found, 8, *found.columns)


@query(
    f"""WITH r AS (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM {CLASSIFIED.sql} t),
    s AS (SELECT CAST(SUM(rank) FILTER (WHERE label = 1) AS DOUBLE) AS w, CAST(SUM(label) AS DOUBLE) AS p, CAST(COUNT(*) - SUM(label) AS DOUBLE) AS n FROM r)
    SELECT ROUND((w - p * (p + 1) / 2) / (p * n), 8) AS roc_auc FROM s"""
)
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(CLASSIFIED.df(spark, sf), "score"), 8, "roc_auc")


@query(
    f"""SELECT COUNT(*) FILTER (WHERE label <> prediction) AS wrong_predictions, ROUND(AVG(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END), 8) AS error_rate,
    ROUND(AVG(confidence), 8) AS avg_confidence, COUNT(*) FILTER (WHERE label <> prediction AND confidence > 0.8) AS wrong_high_confidence,
    COUNT(*) FILTER (WHERE label = prediction AND confidence < 0.5) AS correct_low_confidence FROM {CLASSIFIED.sql} t"""
)
def classification_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.classification_errors(CLASSIFIED.df(spark, sf), confidence="confidence")
    return rounded(found, 8, "error_rate", "avg_confidence")


@query(histogram_sql("value", f"(SELECT confidence + value AS value FROM (SELECT c.*, e.value FROM {CLASSIFIED.sql} c JOIN events e ON c.event_id = e.event_id) WHERE label <> prediction)", 20))
def wrong_confidences(spark: SparkSession, sf: str) -> DataFrame:
    df = CLASSIFIED.df(spark, sf).join(table(spark, sf, "events").select("event_id", "value"), "event_id")
    return rounded_bins(metrics.wrong_confidences(df.withColumn("sure", F.col("confidence") + F.col("value")), "sure"))


@query(
    f"""SELECT ROUND(1 - SUM((label - prediction) ** 2) / SUM((label - (SELECT AVG(label) FROM {ESTIMATED.sql} s)) ** 2), 6) AS r2,
    ROUND(AVG((label - prediction) ** 2), 2) AS mse, ROUND(SQRT(AVG((label - prediction) ** 2)), 4) AS rmse, ROUND(AVG(ABS(label - prediction)), 4) AS mae,
    ROUND(AVG(ABS((label - prediction) / label)) * 100, 6) AS mape FROM {ESTIMATED.sql} t"""
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.regression_metrics(ESTIMATED.df(spark, sf))
    return rounded(rounded(rounded(found, 6, "r2", "mape"), 2, "mse"), 4, "rmse", "mae")


@query(
    f"""SELECT ROUND(AVG(ABS(label - prediction)), 4) AS mean_abs_error, ROUND(QUANTILE_CONT(ABS(label - prediction), CAST(0.5 AS DOUBLE)), 4) AS median_abs_error,
    ROUND(QUANTILE_CONT(ABS(label - prediction), CAST(0.9 AS DOUBLE)), 4) AS pct_90_error, ROUND(AVG(ABS(label - prediction) / ABS(label)) * 100, 6) AS mean_pct_error FROM {ESTIMATED.sql} t"""
)
def regression_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.regression_errors(ESTIMATED.df(spark, sf))
    return rounded(rounded(found, 4, "mean_abs_error", "median_abs_error", "pct_90_error"), 6, "mean_pct_error")


_ESTIMATE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label, prediction, ABS(label - prediction) AS abs_error FROM {ESTIMATED.sql} t
    ORDER BY ABS(label - prediction) DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10"""
)
def worst_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.worst_predictions(ESTIMATED.df(spark, sf), _ESTIMATE_KEYS)


@query(histogram_sql("label - prediction", ESTIMATED.sql, 50))
def residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_bins(metrics.residual_histogram(ESTIMATED.df(spark, sf)))


@query(f"SELECT {_LINE_SQL.format(x='label', y='prediction')} FROM {ESTIMATED.sql} t")
def prediction_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_line(metrics.prediction_line(ESTIMATED.df(spark, sf)))


@query("SELECT toxic, COUNT(*) AS \"count\" FROM labels GROUP BY toxic")
def target_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return value_counts(table(spark, sf, "labels"), "toxic", None)


@query(histogram_sql("l_extendedprice", LINES.sql, 30))
def target_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_bins(metrics.target_distribution(LINES.df(spark, sf), "l_extendedprice", "regression"))


@query('SELECT event_type AS value, COUNT(*) AS "count" FROM ' + EVENTS.sql + " t WHERE event_type IS NOT NULL GROUP BY event_type")
def target_classes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.target_distribution(EVENTS.df(spark, sf), "event_type", "classification")


@query(
    f"""SELECT a."rows", a.classes, b.least, b.greatest FROM (SELECT COUNT(event_type) AS "rows", COUNT(DISTINCT event_type) AS classes FROM {EVENTS.sql} t) a,
    (SELECT MIN(value) AS least, MAX(value) AS greatest FROM {EVENTS.sql} t) b"""
)
def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = EVENTS.df(spark, sf)
    classes = metrics.target_summary(events, "event_type", "classification")
    return beside(classes, metrics.target_summary(events, "value", "regression").drop("rows"))


# -- ranking ----------------------------------------------------------------
# Brands stand in for models: their metrics are aggregates of the part table.
_BOARD_SQL = """(SELECT p_brand AS "Model", CAST(COUNT(*) AS DOUBLE) AS "Training Time (s)", AVG(p_size) / 50 AS "CV Mean",
CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE STDDEV_SAMP(p_size) / 50 END AS "CV Std", AVG(p_retailprice) / 1500 AS "Accuracy", MIN(p_retailprice) / 1000 AS "Precision",
MAX(p_retailprice) / 3000 AS "Recall", CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE AVG(p_retailprice) / 1100 END AS "F1", MAX(p_size) / 60.0 AS "ROC_AUC" FROM part GROUP BY p_brand)"""


def brand_board(spark: SparkSession, sf: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("Model")).agg(
        F.count(F.lit(1)).cast("double").alias("Training Time (s)"),
        (F.avg(size) / 50).alias("CV Mean"),
        F.when(F.col("Model") != "Brand#7", F.stddev_samp(size) / 50).alias("CV Std"),
        (F.avg(price) / 1500).alias("Accuracy"),
        (F.min(price) / 1000).alias("Precision"),
        (F.max(price) / 3000).alias("Recall"),
        F.when(F.col("Model") != "Brand#3", F.avg(price) / 1100).alias("F1"),
        (F.max(size) / 60.0).cast("double").alias("ROC_AUC"),
    )


_RELIABLE_SQL = f"""(SELECT *, CASE WHEN "F1" IS NOT NULL THEN LEAST(GREATEST("F1" - 0.5 * COALESCE("CV Std", 0), 0), 1) END AS "Reliability Score" FROM {_BOARD_SQL} b)"""


@query(f'SELECT "Model", ROUND("F1", 6) AS "F1", ROUND("CV Std", 6) AS "CV Std", ROUND("Reliability Score", 6) AS "Reliability Score" FROM {_RELIABLE_SQL} r')
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    scored = metrics.with_reliability(brand_board(spark, sf), "classification")
    return rounded(scored.select("Model", "F1", "CV Std", "Reliability Score"), 6, "F1", "CV Std", "Reliability Score")


def _pick_sql(name: str, metric: str, direction: str) -> str:
    return f"""SELECT * FROM (SELECT '{name}' AS recommendation, "Model" AS model, ROUND("{metric}", 6) AS value FROM {_RELIABLE_SQL} r
    WHERE "Reliability Score" IS NOT NULL AND "{metric}" IS NOT NULL ORDER BY "{metric}" {direction}, "Model" LIMIT 1)"""


@query(
    " UNION ALL ".join(
        _pick_sql(*p)
        for p in (
            ("best_overall", "Reliability Score", "DESC"), ("best_fast", "Training Time (s)", "ASC"), ("most_stable", "CV Std", "ASC"),
            ("best_precision", "Precision", "DESC"), ("best_recall", "Recall", "DESC"), ("best_auc", "ROC_AUC", "DESC"),
        )
    )
)
def recommend_models(spark: SparkSession, sf: str) -> DataFrame:
    board = metrics.with_reliability(brand_board(spark, sf), "classification")
    return rounded(metrics.recommend_models(board, "classification"), 6, "value")


# -- nearest neighbours -----------------------------------------------------
def _knn_sql(answer: str, more: str = "") -> str:
    return f"""WITH te AS (SELECT * FROM part WHERE p_partkey % 5 = 0), tr AS (SELECT * FROM part WHERE p_partkey % 5 <> 0),
    n AS (SELECT te.p_partkey, tr.p_brand, tr.p_retailprice, ROW_NUMBER() OVER (PARTITION BY te.p_partkey ORDER BY
      SQRT(CAST(te.p_size - tr.p_size AS DOUBLE) ** 2 + (te.p_retailprice - tr.p_retailprice) ** 2{more}), tr.p_partkey) AS r FROM te, tr)
    {answer}"""


@query(
    _knn_sql(
        """, v AS (SELECT p_partkey, p_brand, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY COUNT(*) DESC, p_brand) AS o FROM n WHERE r <= 5 GROUP BY p_partkey, p_brand)
        SELECT p_partkey, p_brand AS prediction FROM v WHERE o = 1"""
    )
)
def knn_predict(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    found = knn.knn_predict(parts.filter("p_partkey % 5 <> 0"), parts.filter("p_partkey % 5 = 0"), FEATURES, "p_brand", "p_partkey", 5)
    return found.select("p_partkey", "prediction")


@query(_knn_sql("SELECT p_partkey, ROUND(AVG(p_retailprice), 6) AS prediction FROM n WHERE r <= 5 GROUP BY p_partkey"))
def knn_regress(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    found = knn.knn_predict(
        parts.filter("p_partkey % 5 <> 0"), parts.filter("p_partkey % 5 = 0"), FEATURES, "p_retailprice", "p_partkey", 5, "regression"
    )
    return rounded(found.select("p_partkey", "prediction"), 6, "prediction")


# -- training ---------------------------------------------------------------
@query()
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = models.split(table(spark, sf, "orders"), 0.2, key="o_orderkey")
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(test.select("o_orderkey", F.lit("test").alias("part")))


@query()
def train_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    found = models.train_models(priced_parts(spark, sf), FEATURES, "band", "classification", folds=None, key="p_partkey")
    return metrics.with_reliability(models.leaderboard(found, "classification"), "classification").drop("Training Time (s)")


@query()
def train_regressors(spark: SparkSession, sf: str) -> DataFrame:
    found = models.train_models(priced_parts(spark, sf), FEATURES, "cost", "regression", folds=None, key="p_partkey")
    return metrics.with_reliability(models.leaderboard(found, "regression"), "regression").drop("Training Time (s)")


@query()
def cross_validated(spark: SparkSession, sf: str) -> DataFrame:
    linear = ["Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet"]
    found = models.train_models(priced_parts(spark, sf), FEATURES, "cost", "regression", linear, folds=5, key="p_partkey")
    board = metrics.with_reliability(models.leaderboard(found, "regression"), "regression")
    return metrics.recommend_models(board, "regression").filter("recommendation <> 'best_fast'")


@query()
def cross_validated_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ["Logistic Regression", "Decision Tree", "Naive Bayes"]
    found = models.train_models(priced_parts(spark, sf), FEATURES, "band", "classification", chosen, folds=5, key="p_partkey")
    return models.leaderboard(found, "classification").drop("Training Time (s)")


def validated(spark: SparkSession, sf: str, problem: str) -> DataFrame:
    """(model, cv_mean, cv_std) of every model of a problem over three folds of the whole table."""
    label = "band" if problem == "classification" else "cost"
    rows = models.label_rows(priced_parts(spark, sf), label, problem)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("std"), F.max("label").alias("top")).first()
    every = models.regressors(seen["n"], seen["std"] or 1.0) if problem == "regression" else models.classifiers(len(FEATURES), int(seen["top"]) + 1, seen["n"])
    lines = {name: models.pipeline(name, est, FEATURES) for name, est in every.items()}
    found = models.cross_validate_all(lines, rows, "r2" if problem == "regression" else "roc_auc", folds=3, key="p_partkey")
    return spark.createDataFrame([(name, *scores) for name, scores in found.items()], "model string, cv_mean double, cv_std double")


@query()
def cross_validated_every_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf, "classification")


@query()
def cross_validated_every_regressor(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf, "regression")


@query()
def tune(spark: SparkSession, sf: str) -> DataFrame:
    """The whole forest grid."""
    rows = models.label_rows(priced_parts(spark, sf), "band", "classification")
    found = models.tune("Random Forest", C.RandomForestClassifier(seed=42), rows, FEATURES, "accuracy")
    return models.tuning_table(found)


@query()
def stack(spark: SparkSession, sf: str) -> DataFrame:
    parts = priced_parts(spark, sf)
    every = models.classifiers(len(FEATURES), 2, parts.count())
    base = {n: every[n] for n in ("Logistic Regression", "Decision Tree", "Naive Bayes")}
    found = models.stack(parts, FEATURES, "band", "classification", base)
    return models.leaderboard([found], "classification").drop("Training Time (s)")


@query()
def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model that was saved and loaded again."""
    rows = models.label_rows(priced_parts(spark, sf), "cost", "regression")
    train, test = models.split(rows, 0.2, key="p_partkey")
    fitted = models.pipeline("Linear Regression", R.LinearRegression(), FEATURES).fit(train)
    path = fresh_path(spark, "model")
    sinks.save_model(fitted, path)
    return rounded(sinks.predictions({"Linear": sinks.load_model(path)}, test), 6, "Linear_Predicted")


@query(
    _knn_sql(
        """, bands AS (SELECT p_brand, DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
        v AS (SELECT p_partkey, code, COUNT(*) AS votes, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY COUNT(*) DESC, code) AS o
          FROM n JOIN bands USING (p_brand) WHERE r <= 5 GROUP BY p_partkey, code)
        SELECT p_partkey, CAST(code AS DOUBLE) AS prediction, CAST(votes AS DOUBLE) / 5 AS confidence FROM v WHERE o = 1""",
        " + ((CAST(te.p_partkey AS DOUBLE) - CAST(tr.p_partkey AS DOUBLE)) / 1000) ** 2",  # no two rows are equally far
    )
)
def saved_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Class and share of the votes by a k-NN classifier that was saved and loaded again."""
    parts = table(spark, sf, "part")
    rows = models.label_rows(parts, "p_brand", "classification").withColumn("place", F.col("p_partkey") / F.lit(1000.0))
    fitted = models.pipeline("K-Neighbors", knn.KNearest(k=5), [*FEATURES, "place"], scale=False).fit(rows.filter("p_partkey % 5 <> 0"))
    path = fresh_path(spark, "model")
    sinks.save_model(fitted, path)
    scored = sinks.load_model(path).transform(rows.filter("p_partkey % 5 = 0"))
    return scored.select("p_partkey", "prediction", metrics.predicted_confidence().alias("confidence"))


@query()
def saved_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of boosted stumps and of a stack over k-NN, saved and loaded again."""
    parts = models.label_rows(priced_parts(spark, sf), "band", "classification")
    train, test = models.split(parts, 0.2, key="p_partkey")
    base = {"K-Neighbors": knn.KNearest(k=5), "AdaBoost": AdaBoost(rounds=10), "Naive Bayes": C.NaiveBayes(modelType="gaussian")}
    fitted = {"AdaBoost": models.pipeline("AdaBoost", base["AdaBoost"], FEATURES).fit(train), "Stack": models.Stack(base, FEATURES, "classification").fit(train.select(*FEATURES, "label"))}
    loaded = {}
    for name, model in fitted.items():
        path = fresh_path(spark, "model")
        sinks.save_model(model, path)
        loaded[name] = sinks.load_model(path)
    return sinks.predictions(loaded, test)


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.label_rows(priced_parts(spark, sf), "cost", "regression")
    fitted = models.pipeline("Decision Tree", R.DecisionTreeRegressor(maxDepth=6, seed=42), FEATURES).fit(rows)
    return models.feature_importance(fitted, FEATURES)
