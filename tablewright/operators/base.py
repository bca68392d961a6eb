"""Pipeline stages: stateless steps and operators fitted on the training rows.

``Step`` wraps a registered function ``f(df, **args) -> df``. ``FittedOperator``
learns scalars and tables from a training frame; its ``FittedModel`` applies them.
Both save and load inside ordinary ``pyspark.ml`` pipelines.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from tablewright.plans.lookup import FittedTable

STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(func: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a stateless function for use as a pipeline stage."""
    STEPS[func.__name__] = func
    return func


class Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stateless function with JSON arguments: ``Step("zero_to_null", column="age")``."""

    def __init__(self, name: str | None = None, **args: Any):
        super().__init__()
        self.name = Param(self, "name", "registered function")
        self.args = Param(self, "args", "keyword arguments")
        if name is not None:
            self._set(name=name, args=args)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return STEPS[self.getOrDefault(self.name)](dataset, **self.getOrDefault(self.args))


class FittedOperator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Base of operators with a fit. Subclasses give ``defaults``, ``learn`` and ``apply``."""

    defaults: dict[str, Any] = {}

    def __init__(self, **args: Any):
        super().__init__()
        unknown = set(args) - set(self.defaults)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no argument {sorted(unknown)}")
        self.args = Param(self, "args", "keyword arguments")
        self._set(args={**self.defaults, **args})

    def learn(self, train: DataFrame, args: dict[str, Any]) -> tuple[dict[str, Any], dict[str, FittedTable]]:
        raise NotImplementedError

    @staticmethod
    def apply(df: DataFrame, args: dict[str, Any], scalars: dict[str, Any], tables: dict[str, FittedTable]) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> "FittedModel":
        args = self.getOrDefault(self.args)
        train = dataset
        if "split" in dataset.columns and args.get("train_only", True):
            train = dataset.filter("split = 'train'")
        scalars, tables = self.learn(train, args)
        cls = type(self)
        return FittedModel(f"{cls.__module__}.{cls.__qualname__}", args, scalars, tables)


class FittedModel(Model, MLReadable, MLWritable):
    """What a ``FittedOperator`` learned: JSON scalars and parquet tables."""

    def __init__(self, operator: str = "", args: dict | None = None, scalars: dict | None = None, tables: dict[str, FittedTable] | None = None):
        super().__init__()
        self.operator = Param(self, "operator", "class that applies the state")
        self.args = Param(self, "args", "keyword arguments")
        self.scalars = Param(self, "scalars", "fitted numbers and lists")
        self._set(operator=operator, args=args or {}, scalars=scalars or {})
        self.tables = tables or {}

    def state(self) -> dict[str, Any]:
        return self.getOrDefault(self.scalars)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        module, _, name = self.getOrDefault(self.operator).rpartition(".")
        cls = getattr(importlib.import_module(module), name)
        return cls.apply(dataset, self.getOrDefault(self.args), self.getOrDefault(self.scalars), self.tables)

    def copy(self, extra: dict | None = None) -> "FittedModel":
        return self

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader()


class _FittedWriter(MLWriter):
    def __init__(self, instance: FittedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"tables": {n: t.part for n, t in self.instance.tables.items()}})
        for name, table in self.instance.tables.items():
            table.df.write.parquet(f"{path}/table_{name}")


class _FittedReader(MLReader):
    def load(self, path: str) -> FittedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = FittedModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {n: FittedTable.load(self.sparkSession, f"{path}/table_{n}", metadata["tables"][n]) for n in metadata["tables"]}
        return model
