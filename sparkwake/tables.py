"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_dirs: dict[str, str] = {}
_open: list[list[str]] = []  # what each open scope has made so far


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names, which driver and executors share.

    Only a local session may do without that setting. The folder is removed at the end of the program, and when the
    session has been stopped by then, the tables in it stay.
    """
    app = spark.sparkContext.applicationId
    if app not in _dirs:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            base = "/tmp/checkpoints"
        _dirs[app] = f"{base.rstrip('/')}/sparkwake-{app}"
        atexit.register(release, spark, [_dirs[app]])
    return _dirs[app]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes intermediate tables that nothing reads any more."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of the tables made within, as a list that is still filled."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        made = _open.pop()
        if _open:
            _open[-1].extend(made)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder: cuts its lineage, survives lost executors, is never computed twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
