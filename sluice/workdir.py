"""Shared scratch storage: where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in this one process, as in tests, a temporary folder takes its
    place; it is removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, _roots[app], ignore_errors=True)
    return _roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    For results several later jobs read. Unlike ``persist`` the copy survives the
    loss of executors, and unlike ``checkpoint`` later scans prune its columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
