"""Labelled flow files: ``<Family>-training.parquet`` and ``<Family>-testing.parquet``.

A unit is a file of that name or a folder of part files of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions.copies import number_copies
from sluice.functions.scalars import col
from sluice.operators import labels, sampling
from sluice.schemas import CATEGORY, DEPLOYMENT_CLASSES, FEATURES, TARGET

_UNIT = r"^(.*/(?:[^/=]*=)?([^/=]*-(training|testing)\.parquet))(/.*)?$"
_TRAINING_UNIT = r"^(.*/(?:[^/=]*=)?([^/=]*-training[^/=]*\.parquet))(/.*)?$"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the parquet files below a folder; only the listing is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(folder).select("path"))


def split_units(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, family, split), split and family being told by the name."""
    units = _paths(spark, folder).where(F.col("path").rlike(_UNIT)).select(
        *[F.regexp_extract("path", _UNIT, i).alias(n) for i, n in ((1, "unit"), (2, "file_name"), (3, "split"))])
    return units.distinct().select(F.col("unit").alias("path"), "file_name",
                                   F.split_part("file_name", F.lit("-"), F.lit(1)).alias("family"), "split")


def common_families(units: DataFrame) -> DataFrame:
    """Units of the families found in both splits."""
    both = (units.select("family", "split").distinct().groupBy("family")
            .agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("family"))
    return units.join(both, "family", "left_semi")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_units(units: DataFrame) -> DataFrame:
    """All units by column name, absent columns null. One scan per family."""
    spark = units.sparkSession
    by_family: dict[str, list[str]] = {}
    for r in units.select("family", "path").orderBy("path").collect():
        by_family.setdefault(r["family"], []).append(r["path"])
    return _union([spark.read.option("mergeSchema", "true").parquet(*paths) for paths in by_family.values()])


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the common families."""
    units = split_units(spark, folder)
    present = {r[0] for r in units.select("split").distinct().collect()}
    if present != {"training", "testing"}:
        raise FileNotFoundError(f"no training or no testing files in {folder}")
    common = common_families(units)
    return tuple(read_units(common.where(F.col("split") == s)) for s in ("training", "testing"))


def deployment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows usable for the deployed model: 77 features and a deployment label.

    Units without a label or without all features are left out, judged by their schema.
    """
    found = _paths(spark, folder).where(F.col("path").rlike(_TRAINING_UNIT))
    units = sorted(r[0] for r in found.select(F.regexp_extract("path", _TRAINING_UNIT, 1)).distinct().collect())
    if not units:
        raise FileNotFoundError(f"no training files in {folder}")
    frames = [spark.read.parquet(u) for u in units]
    usable = [f.select(*[col(c) for c in FEATURES], TARGET) for f in frames
              if TARGET in f.columns and set(FEATURES) <= set(f.columns)]
    if not usable:
        raise ValueError("no usable training rows")
    return labels.deployment_only(labels.rename_or_keep(_union(usable), CATEGORY))


def deployment_sample(spark: SparkSession, folder: str, per_class: int = 3000, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each deployment class. Each copy of a row is drawn on its own."""
    rows = number_copies(deployment_rows(spark, folder), "_copy")
    return sampling.sample_per_class(rows, TARGET, per_class, [*FEATURES, "_copy"], seed).drop("_copy")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Collected rows of known classes as features and label; all 77 features must be there."""
    raw = spark.read.option("header", True).csv(path)
    absent = [c for c in [*FEATURES, TARGET] if c not in raw.columns]
    if absent:
        raise ValueError(f"collected rows lack columns: {absent[:10]}")
    rows = raw.select(*[col(c).try_cast("double").alias(c) for c in FEATURES], TARGET)
    return rows.where(F.col(TARGET).isin(DEPLOYMENT_CLASSES))


def flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Extractor output, every column as text; names are trimmed and converted later."""
    return spark.read.option("header", True).csv(path)


def append_labelled(rows: DataFrame, label: str, path: str) -> None:
    """Adds rows of one class to a collected data set, stored by class."""
    rows.withColumn(TARGET, F.lit(label)).write.mode("append").partitionBy(TARGET).parquet(path)
