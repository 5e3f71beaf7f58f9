"""Intermediate tables in the folder that the cluster shares.

Iterative and multi-branch jobs cut their lineage by writing a table and
reading it again.  The table lives under ``spark.checkpoint.dir``, which every
executor sees, so a lost executor costs no more than its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Only a ``local[...]`` master, where driver and executors are one process,
    may fall back to a temporary folder; a cluster without the setting is an
    error rather than a silent write to some machine's own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="driftmark-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark).rstrip('/')}/driftmark-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def mark() -> int:
    """Where the intermediate tables made from now on begin, for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete this process's intermediate tables since a mark (and made before another); results that still read them must have been written."""
    gone, _made[since:until] = _made[since:until], []
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
