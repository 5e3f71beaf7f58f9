"""This package on the executors of a cluster, whose Python workers import it inside Arrow functions."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .scratch import shared_dir

PACKAGE = Path(__file__).resolve().parent.parent
_NAME = PACKAGE.name + ".zip"


def packed() -> bytes:
    """The modules of the package as a zip archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(PACKAGE.parent))
    return out.getvalue()


def share(spark: SparkSession) -> None:
    """Give the package to all executors, once a context; a ``local[...]`` master has it.

    The archive lies in the shared folder and stays there: late executors fetch it too.
    """
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local" or _NAME in context._python_includes:
        return
    context.addPyFile(_stored(spark))


def _stored(spark: SparkSession) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/driftmark-package-{uuid.uuid4().hex}/{_NAME}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(packed()))
    finally:
        out.close()
    return path.toString()
