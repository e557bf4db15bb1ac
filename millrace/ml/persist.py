"""Saving and loading of models that are written in Python.

A saved model is a folder with its parameters as metadata, as of any other stage, and
its parts beside it: tables as Parquet, other models in folders of their own. So these
models are saved inside pipelines and stacks, and read back by any session.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession

SETTINGS = "millrace"


class SavedModel(MLWritable, MLReadable):
    """A model with ``settings`` that fit into JSON, and parts that ``save_parts`` writes below a path."""

    def settings(self) -> dict[str, Any]:
        return {}

    def save_parts(self, path: str, spark: SparkSession) -> None:
        pass

    @classmethod
    def from_parts(cls, settings: dict[str, Any], path: str, spark: SparkSession) -> "SavedModel":
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SavedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        self.model.save_parts(path, self.sparkSession)
        # Last, so that a folder with metadata is complete.
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {SETTINGS: self.model.settings()})


class _Reader(MLReader):
    def __init__(self, kind: type[SavedModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> SavedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.kind.__module__}.{self.kind.__name__}")
        model = self.kind.from_parts(metadata[SETTINGS], path, self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def load_model(path: str) -> Any:
    """Any saved model: a pipeline, or a model of this library."""
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())
