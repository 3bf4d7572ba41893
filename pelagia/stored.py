"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where a local master leaves that unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='pelagia-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``rows`` written as Parquet in the shared folder and read back, and where they are.

    Computed once, however often they are read; lost executors don't cost them; and what follows is planned over a
    plain scan. ``drop`` deletes the table, as does the end of the driver.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/pelagia-{name}-{uuid.uuid4().hex}"
    _paths[path] = spark
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def drop(path: str) -> None:
    spark = _paths.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    for path in list(_paths):
        try:
            drop(path)
        except Exception:  # noqa: BLE001  the session has ended before this process
            pass
