"""Saved models, by name."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def safe_name(name: str) -> str:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def _path(spark: SparkSession, text: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def save_model(model: PipelineModel, name: str, folder: str, backup: bool = False) -> str:
    """Saves under the normalised name; with ``backup`` the model it replaces is kept beside it."""
    spark = SparkSession.getActiveSession()
    target = f"{folder}/{safe_name(name)}"
    if backup:
        fs, path = _path(spark, target)
        if fs.exists(path):
            stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
            fs.rename(path, _path(spark, f"{target}_backup_{stamp}")[1])
    model.write().overwrite().save(target)
    return target


def load_model(name: str, folder: str) -> PipelineModel:
    spark = SparkSession.getActiveSession()
    target = f"{folder}/{safe_name(name)}"
    fs, path = _path(spark, target)
    if not fs.exists(path):
        raise FileNotFoundError(f"no model {target}")
    return PipelineModel.load(target)
