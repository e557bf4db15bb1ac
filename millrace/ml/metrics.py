"""Metrics, error analysis and ranking over tables of predictions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, col, require
from ..functions.moments import share
from ..operators.chart import histogram, ols
from ..operators.ordering import running_before
from ..operators.profile import beside
from ..operators.quantiles import exact_quantiles

NEAR_ZERO = 1e-10


# -- classification ---------------------------------------------------------
def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count) for every combination that occurs."""
    return pred.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("count"))


def roc_auc(pred: DataFrame, score: str, label: str = "label", positive: float = 1) -> DataFrame:
    """One row: exact area under the ROC curve, ties counted half.

    Equal scores collapse first; their order comes from range-partitioned slices.
    """
    hit = (col(label) == F.lit(positive)).cast("bigint")
    by_score = pred.groupBy(as_double(pred, score).alias("_score")).agg(F.sum(hit).alias("_pos"), F.sum(1 - hit).alias("_neg"))
    ranked = running_before(by_score, ["_score"], "_below", weight="_neg")
    area = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2))
    return ranked.agg(F.try_divide(area, F.sum("_pos").cast("double") * F.sum("_neg")).alias("roc_auc"))


def roc_auc_by(pred: DataFrame, keys: Iterable[str], score: str, label: str = "label", positive: float = 1, rows: Column | None = None) -> DataFrame:
    """``roc_auc`` of every group; NULL where a score is missing or one class is. A row stands for ``rows`` rows."""
    keys = list(keys)
    hit, rows = (col(label) == F.lit(positive)).cast("bigint"), F.lit(1).cast("bigint") if rows is None else rows
    by_score = pred.groupBy(*keys, as_double(pred, score).alias("_score")).agg(F.sum(hit * rows).alias("_pos"), F.sum((1 - hit) * rows).alias("_neg"))
    ranked = running_before(by_score, ["_score"], "_below", weight="_neg", partition_by=keys)
    area = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2))
    known = F.count_if(F.col("_score").isNull()) == 0
    return ranked.groupBy(*keys).agg(F.when(known, F.try_divide(area, F.sum("_pos").cast("double") * F.sum("_neg"))).alias("roc_auc"))


def classification_metrics(
    pred: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = None, positive: float = 1
) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1, FPR and FNR of two
    classes, and the ROC area when a score column is named."""
    cells = confusion_matrix(pred, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    # One row per class: how often it is true, predicted, and both.
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").cast("string").alias("class"), F.col("count").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("h")),
                F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("count").alias("p"), F.lit(0).cast("bigint").alias("h")),
            )
        )
    )
    classes = sides.groupBy("class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    precision, recall = share(F.col("h"), F.col("p")), share(F.col("h"), F.col("t"))
    f1 = share(2 * precision * recall, precision + recall)
    weight = F.col("t").cast("double")
    n = F.sum(weight)
    result = classes.agg(
        F.try_divide(F.sum("h").cast("double"), n).alias("accuracy"),
        F.try_divide(F.sum(weight * precision), n).alias("precision"),
        F.try_divide(F.sum(weight * recall), n).alias("recall"),
        F.try_divide(F.sum(weight * f1), n).alias("f1"),
        F.count(F.lit(1)).alias("_classes"),
    )
    yes_label, yes_pred = F.col("label") == F.lit(positive), F.col("prediction") == F.lit(positive)
    rates = cells.agg(
        F.try_divide(F.sum(F.when(~yes_label & yes_pred, F.col("count")).otherwise(0)).cast("double"), F.sum(F.when(~yes_label, F.col("count")))).alias("_fpr"),
        F.try_divide(F.sum(F.when(yes_label & ~yes_pred, F.col("count")).otherwise(0)).cast("double"), F.sum(F.when(yes_label, F.col("count")))).alias("_fnr"),
    )
    two = F.col("_classes") == 2
    wide = beside(result, rates).select(
        "accuracy", "precision", "recall", "f1", F.when(two, F.col("_fpr")).alias("fpr"), F.when(two, F.col("_fnr")).alias("fnr")
    )
    return beside(wide, roc_auc(pred, score, label, positive)) if score else wide


def classification_errors(
    pred: DataFrame, label: str = "label", prediction: str = "prediction", confidence: str | Column | None = None
) -> DataFrame:
    """One row: wrong predictions, error rate, and what the confidences say.

    ``confidence`` is the probability of the predicted class.
    """
    require(pred, [label, prediction])
    wrong = ~F.coalesce(col(label) == col(prediction), F.lit(False))
    wanted = [F.count_if(wrong).alias("wrong_predictions"), share(F.count_if(wrong), F.count(F.lit(1))).alias("error_rate")]
    if confidence is not None:
        sure = col(confidence) if isinstance(confidence, str) else confidence
        wanted += [
            F.avg(sure).alias("avg_confidence"),
            F.count_if(wrong & (sure > 0.8)).alias("wrong_high_confidence"),
            F.count_if(~wrong & (sure < 0.5)).alias("correct_low_confidence"),
        ]
    return pred.agg(*wanted)


def predicted_confidence(probability: str = "probability", prediction: str = "prediction") -> Column:
    """The predicted class's entry of a probability vector."""
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(probability), F.col(prediction).cast("int") + 1)


def wrong_confidences(pred: DataFrame, confidence: str, label: str = "label", prediction: str = "prediction", bins: int = 20) -> DataFrame:
    """Histogram of confidence over the wrong predictions."""
    return histogram(pred.filter(col(label) != col(prediction)), confidence, bins)


# -- regression -------------------------------------------------------------
def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: R2, MSE, RMSE, MAE and MAPE.

    MAPE needs over 80 % of the actual values away from zero, and uses only those.
    """
    y, p = as_double(pred, label), as_double(pred, prediction)
    safe = F.abs(y) > NEAR_ZERO
    stats = pred.agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("_var"),
        F.count_if(safe).alias("_safe"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(safe, F.abs((y - p) / F.when(safe, y)))).alias("_mape"),
    )
    return stats.select(
        (1 - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2"),
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.when(F.col("_safe") > F.col("_n") * 0.8, F.col("_mape") * 100).alias("mape"),
    )


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Adds residual (actual - predicted) and its absolute value."""
    diff = as_double(pred, label) - as_double(pred, prediction)
    return pred.withColumns({"residual": diff, "abs_error": F.abs(diff)})


def regression_errors(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mean, median and 90th percentile absolute error, mean % error."""
    judged = residuals(pred, label, prediction)
    y = as_double(pred, label)
    safe = F.abs(y) > NEAR_ZERO
    means = judged.agg(
        F.avg("abs_error").alias("mean_abs_error"),
        (F.avg(F.when(safe, F.col("abs_error") / F.abs(F.when(safe, y)))) * 100).alias("mean_pct_error"),
    )
    ranks = exact_quantiles(judged, ["abs_error"], [0.5, 0.9])
    ranks = ranks.select(F.col("abs_error__0").alias("median_abs_error"), F.col("abs_error__1").alias("pct_90_error"))
    return beside(means, ranks).select("mean_abs_error", "median_abs_error", "pct_90_error", "mean_pct_error")


def worst_predictions(
    pred: DataFrame, key: Iterable[str], label: str = "label", prediction: str = "prediction", k: int = 10
) -> DataFrame:
    """The k largest absolute errors, ties by key."""
    keys = [col(c) for c in key]
    judged = residuals(pred, label, prediction)
    return judged.orderBy(F.desc("abs_error"), *keys).limit(k).select(*keys, col(label), col(prediction), "abs_error")


def residual_histogram(pred: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 50) -> DataFrame:
    return histogram(residuals(pred, label, prediction), "residual", bins)


def prediction_line(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Least-squares line of predicted over actual."""
    return ols(pred, label, prediction)


# -- ranking ----------------------------------------------------------------
def with_reliability(leaderboard: DataFrame, problem: str) -> DataFrame:
    """Adds ``Reliability Score``: the main metric minus half the CV deviation, clipped.

    F1 (or Accuracy) to 0..1 for classification, R2 to -1..1 for regression.
    """
    if problem == "classification":
        main, low = ("F1" if "F1" in leaderboard.columns else "Accuracy"), 0.0
    else:
        main, low = "R2", -1.0
    require(leaderboard, [main, "CV Std"])
    risk = col(main) - 0.5 * F.coalesce(col("CV Std"), F.lit(0.0))
    clipped = F.when(risk.isNotNull(), F.least(F.greatest(risk, F.lit(low)), F.lit(1.0)))
    return leaderboard.withColumn("Reliability Score", clipped)


# Which model each recommendation names: (key, column, True for highest) (fixed values).
_PICKS = {
    "classification": (("best_precision", "Precision", True), ("best_recall", "Recall", True), ("best_auc", "ROC_AUC", True)),
    "regression": (("lowest_error", "RMSE", False), ("best_r2", "R2", True)),
}
_COMMON = (("best_overall", "Reliability Score", True), ("best_fast", "Training Time (s)", False), ("most_stable", "CV Std", False))


def recommend_models(leaderboard: DataFrame, problem: str) -> DataFrame:
    """(recommendation, model, value): the best model by each criterion.

    Models without a reliability score are left out; ties go to the first name.
    """
    picks = [p for p in _COMMON + _PICKS[problem] if p[1] in leaderboard.columns]
    valid = leaderboard.filter(col("Reliability Score").isNotNull())
    best = []
    for key, metric, highest in picks:
        value = col(metric).cast("double")
        order = F.struct((-value if highest else value).alias("o"), col("Model").alias("model"))
        best.append(F.min(F.when(value.isNotNull(), F.struct(order.alias("k"), value.alias("v")))).alias(key))
    rows = [
        F.struct(F.lit(key).alias("recommendation"), F.col(f"{key}.k.model").alias("model"), F.col(f"{key}.v").alias("value"))
        for key, _, _ in picks
    ]
    return valid.agg(*best).select(F.inline(F.array(*rows))).filter(F.col("model").isNotNull())


# -- targets ----------------------------------------------------------------
def target_summary(df: DataFrame, target: str, problem: str) -> DataFrame:
    """One row: how many rows have a target, and its classes or else its range."""
    require(df, target)
    rows = F.count(col(target)).alias("rows")
    if problem == "classification":
        return df.agg(rows, F.count_distinct(col(target)).alias("classes"))
    value = as_double(df, target)
    return df.agg(rows, F.min(value).alias("least"), F.max(value).alias("greatest"))


def target_distribution(df: DataFrame, target: str, problem: str, bins: int = 30) -> DataFrame:
    """(value, count) of every class, or the bins of a numeric target."""
    if problem == "regression":
        return histogram(df, target, bins)
    require(df, target)
    known = df.filter(col(target).isNotNull())
    return known.groupBy(col(target).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")
