"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides, with ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
