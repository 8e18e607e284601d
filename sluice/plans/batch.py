"""The batch run: labelled files in; profile, models, ranking and result tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.operators import labels, profiling, sampling
from sluice.plans import training
from sluice.schemas import TrainingConfig
from sluice.sources import datasets, eventlog


def profile_tables(train: DataFrame, test: DataFrame) -> DataFrame:
    """The data report of both splits, as read and with harmonised labels."""
    named = labels.harmonise(train, test)
    parts = [profiling.summary(train=a, test=b).withColumn("stage", F.lit(stage))
             for stage, a, b in (("raw", train, test), ("harmonised", *named))]
    return parts[0].unionByName(parts[1])


def run_batch(spark: SparkSession, data: str, out: str, config: TrainingConfig = TrainingConfig(),
              resplit: tuple[Sequence[str], Sequence[str]] | None = None, chosen: Sequence[str] | None = None,
              settings: Mapping[str, Sequence[Mapping]] | None = None) -> DataFrame:
    """Reads the common families below ``data``, profiles, trains and ranks; returns the table of models.

    ``resplit``, features and row order, first makes one table of both splits and splits it again. Tables go to
    ``out``/tables, models to ``out``/models.
    """
    train, test = datasets.load_dataset(spark, data)
    eventlog.write_metric_table(profile_tables(train, test), f"{out}/tables", "data_profile")
    if resplit is not None:
        features, order = resplit
        both = sampling.combine_resplit(train, test, features, order, seed=config.seed)
        train, test = (both.where(F.col("held_out") == held).drop("held_out", "split_rank") for held in (False, True))
    return training.train_and_rank(train, test, f"{out}/models", config, chosen, settings, tables=f"{out}/tables")


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the tables a run has written."""
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/tables/{name}")
