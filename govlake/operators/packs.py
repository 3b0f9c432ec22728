"""Packs and their models: operators as pyspark.ml transformers with params, saved and loaded as any, found by reference and built from a spec."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession

from . import models

_text, _names, _number, _whole = TypeConverters.toString, TypeConverters.toListString, TypeConverters.toFloat, TypeConverters.toInt


def _param(name: str, doc: str, kind: Callable) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Model(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    field = _param("field", "the column that is judged or carried on", _text)
    group_by = _param("group_by", "columns of a group, none for the whole table", _names)

    def of(self, name: str) -> Any:
        return self.getOrDefault(getattr(self, name))


class RobustZ(_Model):
    """models.robust_z as a transformer."""

    threshold = _param("threshold", "|z| above it is an anomaly", _number)

    @keyword_only
    def __init__(self, *, field: str = "value", group_by: list[str] | None = None, threshold: float = 3.5):
        super().__init__()
        self._setDefault(field="value", group_by=[], threshold=3.5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.robust_z(dataset, self.of("field"), self.of("group_by"), self.of("threshold"))


class _Forecast(_Model):
    order_by = _param("order_by", "columns that order the rows of a group", _names)
    horizon = _param("horizon", "steps ahead", _whole)

    @keyword_only
    def __init__(self, *, field: str = "value", group_by: list[str] | None = None, order_by: list[str] | None = None, horizon: int = 7):
        super().__init__()
        self._setDefault(field="value", group_by=[], order_by=[], horizon=7)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})


class LastForecast(_Forecast):
    """models.forecast_last as a transformer."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.forecast_last(dataset, self.of("field"), self.of("group_by"), self.of("order_by"), self.of("horizon"))


class TrendForecast(_Forecast):
    """models.forecast_trend as a transformer."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.forecast_trend(dataset, self.of("field"), self.of("group_by"), self.of("order_by"), self.of("horizon"))


TASKS = {"anomaly": RobustZ, "forecast": LastForecast, "trend": TrendForecast}


def build(task: str, params: Mapping[str, Any] | None = None) -> Transformer:
    """The model of a spec: a task and its params, of which those that the model doesn't have are an error."""
    if task not in TASKS:
        raise ValueError(f"no model for the task {task}")
    given = {k: [v] if k in ("group_by", "order_by") and isinstance(v, str) else v for k, v in (params or {}).items()}
    unknown = sorted(k for k in given if not TASKS[task]().hasParam(k))
    if unknown:
        raise ValueError(f"{task} has no {', '.join(unknown)}")
    return TASKS[task](**given)


@dataclass
class Pack:
    """What a domain brings along: connectors (uri -> table), models by id, custom rules (table -> violations), and symbols that references name."""

    id: str
    connectors: Mapping[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    models: dict[str, Transformer] = field(default_factory=dict)
    custom_quality: Mapping[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    symbols: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_specs(cls, id_: str, specs: DataFrame, **hooks) -> Pack:
        """A pack with a model for each row (id, task, params, a map of text) of specs, a table that people write. Texts are read as the param's type; lists are split at commas."""
        made = {}
        for r in specs.select("id", "task", "params").collect():
            model = TASKS[r.task] if r.task in TASKS else None
            given = {}
            for k, v in (r.params or {}).items():
                kind = getattr(getattr(model, k, None), "typeConverter", _text)
                given[k] = [x.strip() for x in v.split(",") if x.strip()] if kind is _names else float(v) if kind is _number else int(v) if kind is _whole else v
            made[r.id] = build(r.task, given)
        return cls(id_, models=made, **hooks)

    def save(self, path: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/{name}")

    def load(self, path: str, kinds: Mapping[str, type[_Model]]) -> None:
        """Models that were saved below a folder: id -> class."""
        self.models |= {name: kind.load(f"{path}/{name}") for name, kind in kinds.items()}


def resolve(reference: str, packs: Mapping[str, Pack]) -> Any:
    """What `pack://id/file#symbol` names: a symbol of the pack, else its model of that id. Only what packs have registered is found; nothing is imported by name."""
    m = re.match(r"pack://([^/#]+)/([^#]*)#(.+)\Z", reference)
    if not m or m[1] not in packs:
        raise LookupError(f"no pack for {reference}")
    pack = packs[m[1]]
    found = pack.symbols.get(m[3], pack.models.get(m[3]))
    if found is None:
        raise LookupError(f"{m[1]} has no {m[3]}")
    return found
