"""Run logs: JSON lines, a configuration snapshot, an optional tracker, and plots where a plotting package is installed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession


class Tracker(Protocol):
    def log(self, record: Mapping[str, Any]) -> None: ...

    def finish(self) -> None: ...


class RunLog:
    """JSON lines of a run, begun anew and flushed at each record; records go to a tracker too, if there is one."""

    def __init__(self, path: str, tracker: Tracker | None = None):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self._out, self._tracker = open(path, "w", encoding="utf-8"), tracker

    def log(self, record: Mapping[str, Any]) -> None:
        print(json.dumps(dict(record), ensure_ascii=False, default=str), file=self._out, flush=True)
        if self._tracker is not None:
            self._tracker.log(record)

    def close(self) -> None:
        if not self._out.closed:
            self._out.close()
            if self._tracker is not None:
                self._tracker.finish()

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def snapshot(config: Mapping[str, Any], path: str) -> None:
    """The resolved configuration beside a run's logs."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=2, default=str, ensure_ascii=False), encoding="utf-8")


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """A run's records as a table, columns as they come."""
    return spark.read.json(path)


def plot(table: DataFrame, x: str, ys: Sequence[str], path: str, title: str = "") -> str | None:
    """A line for each column over ``x`` (a table of runs or steps is small), as a picture; None where no plotting package is installed."""
    try:
        import matplotlib
    except ImportError:
        return None
    matplotlib.use("Agg")
    from matplotlib import pyplot

    rows = table.select(x, *ys).orderBy(x).collect()
    figure, axes = pyplot.subplots(figsize=(8, 5))
    for y in ys:
        axes.plot([r[x] for r in rows], [r[y] for r in rows], marker="o", label=y)
    axes.set_xlabel(x)
    axes.set_title(title)
    axes.legend()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    figure.savefig(path)
    pyplot.close(figure)
    return path


def plot_losses(spark: SparkSession, log: str, path: str) -> str | None:
    """Loss by step of a training log."""
    from .kgqa import load_losses

    return plot(load_losses(spark, log), "step", ["loss"], path, "training loss")


def plot_run(spark: SparkSession, log: str, path: str) -> str | None:
    """Mean reward and the routes' census by update of a policy run's log."""
    r = run_records(spark, log)
    return plot(r, "update", [c for c in ("mean_reward", "mean_precision", "mean_recall", "mean_escalated", "mean_skip", "mean_extract") if c in r.columns], path, "policy run")


def plot_frontier(runs: DataFrame, path: str) -> str | None:
    """Accuracy by mean cost."""
    return plot(runs, "mean_cost", ["accuracy"], path, "cost and accuracy")
