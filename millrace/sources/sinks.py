"""Writing tables, reports, predictions and models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml import persist


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, one part file per partition."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A cleaning report as JSON, stamped with the time of writing."""
    report.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode(mode).json(path)


def write_pivot(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A pivot table as CSV; its column names are already flat."""
    write_csv(table, path, mode)


def predictions(models: Mapping[str, Model], test: DataFrame, label: str = "label") -> DataFrame:
    """``Actual`` and one ``<model>_Predicted`` column per model."""
    out, kept = test.withColumn("Actual", F.col(label)), ["Actual"]
    for name, model in models.items():
        scored = model.transform(out).withColumn(f"{name}_Predicted", F.col("prediction"))
        kept.append(f"{name}_Predicted")
        out = scored.select(*[F.col(f"`{c}`") for c in test.columns], *[F.col(f"`{c}`") for c in kept])
    return out.select(*[F.col(f"`{c}`") for c in kept])


def save_model(model: Model, path: str) -> None:
    """Any trained model: a pipeline or a stack, whatever its stages are written in."""
    model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    return persist.load_model(path)
