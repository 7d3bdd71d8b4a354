"""The named queries of this package and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("names", "near", "splits", "cutoffs", "mixing", "packing", "leaks", "languages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for m in _MODULES:
        module = importlib.import_module(f"{__package__}.{m}")
        out |= {k: f for k, f in vars(module).items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
    return dict(sorted(out.items()))


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
