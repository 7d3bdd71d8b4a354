"""Where models plug in: scorers and controllers as functions that run on workers over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.ship import ship


def score(df: DataFrame, load: Callable[[], Callable[[Mapping[str, list]], Sequence[float]]], inputs: Sequence[str], key: str = "key", clamp: bool = True, threshold: float | None = None) -> DataFrame:
    """``key, score`` of each row by a model.

    ``load`` runs once a task and gives a function from a batch's columns to scores; they are clamped to 0..1 and, given a threshold,
    made 0 or 1 (at or above it). A null or NaN score stays null.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            values = model({n: b.column(i + 1).to_pylist() for i, n in enumerate(inputs)}) if b.num_rows else []
            out = [None if v is None or v != v else float(v) for v in values]
            if clamp:
                out = [None if v is None else min(1.0, max(0.0, v)) for v in out]
            if threshold is not None:
                out = [None if v is None else float(v >= threshold) for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["key", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *inputs).mapInArrow(run, f"key {kind}, score double")


def build(config: Mapping[str, Any]) -> Any:
    """The object a configuration names: ``target`` (dotted path) called with the other entries, nested ones built first."""
    module, _, name = config["target"].rpartition(".")
    args = {k: build(v) if isinstance(v, Mapping) and "target" in v else v for k, v in config.items() if k != "target"}
    return getattr(import_module(module), name)(**args)
