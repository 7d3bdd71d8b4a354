"""Making this package importable in Python workers that do not have it installed."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .lineage import ensure_checkpoint_dir

_PACKAGE = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def _archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    return out.getvalue()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the workers, once an application, by way of the shared checkpoint folder.

    Without a session, that of the thread.
    """
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    ensure_checkpoint_dir(spark)
    path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get(), f"loomgraph-{uuid.uuid4().hex}.zip")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(_archive()))
    finally:
        stream.close()
    sc.addPyFile(path.toString())
    _SENT.add(sc.applicationId)
