"""Label vocabularies: harmonising, categories, label filters and label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.functions.scalars import map_lookup
from sluice.schemas import CATEGORY, DEPLOYMENT_CLASSES, HARMONISE, TARGET


def distinct_labels(df: DataFrame) -> DataFrame:
    return df.select(TARGET).where(F.col(TARGET).isNotNull()).distinct()


def drop_test_only(train: DataFrame, test: DataFrame) -> DataFrame:
    """Drops test rows whose label neither occurs in training nor can be renamed."""
    known = distinct_labels(train)
    renamable = F.coalesce(F.col(TARGET).isin(list(HARMONISE)), F.lit(False))
    # Labels are tested on the distinct labels, so only those are joined with the training labels.
    unknown = distinct_labels(test).where(~renamable).join(known, TARGET, "left_anti")
    return _without_labels(test, unknown)


def _without_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Drops rows of the given labels; labels of a class vocabulary, so the set is tiny."""
    drop = [r[0] for r in labels.collect()]
    return df.where(~F.coalesce(F.col(TARGET).isin(drop), F.lit(False))) if drop else df


def rename_test(test: DataFrame, strict: bool = True) -> DataFrame:
    """Training names for test labels; others are dropped, category names too when strict."""
    name = map_lookup(HARMONISE, F.col(TARGET))
    if not strict:
        name = F.coalesce(name, F.when(F.col(TARGET).isin(list(CATEGORY.values())), F.col(TARGET)))
    return test.withColumn(TARGET, name).where(F.col(TARGET).isNotNull())


def to_category(df: DataFrame) -> DataFrame:
    return df.withColumn(TARGET, map_lookup(CATEGORY, F.col(TARGET))).where(F.col(TARGET).isNotNull())


def harmonise(train: DataFrame, test: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both splits with category labels. Rows with unmapped labels go."""
    test = rename_test(drop_test_only(train, test), strict)
    return to_category(train), to_category(test)


def rename_or_keep(df: DataFrame, vocabulary: dict[str, str] = HARMONISE) -> DataFrame:
    """Renames labels in the vocabulary, leaves the others as they are."""
    return df.withColumn(TARGET, F.coalesce(map_lookup(vocabulary, F.col(TARGET)), F.col(TARGET)))


def drop_unseen(train: DataFrame, test: DataFrame) -> DataFrame:
    """Drops test rows whose label does not occur in training (null labels too)."""
    unseen = distinct_labels(test).join(distinct_labels(train), TARGET, "left_anti")
    return _without_labels(test.where(F.col(TARGET).isNotNull()), unseen)


def deployment_only(df: DataFrame) -> DataFrame:
    return df.where(F.col(TARGET).isin(DEPLOYMENT_CLASSES))


def unsupported_labels(df: DataFrame) -> DataFrame:
    """Labels that the deployed model has no class for."""
    return distinct_labels(df.where(~F.col(TARGET).isin(DEPLOYMENT_CLASSES)))


def label_sets(train: DataFrame, test: DataFrame) -> DataFrame:
    """Every label with where it occurs: both, train only, test only."""
    a, b = distinct_labels(train), distinct_labels(test)
    return (a.intersect(b).withColumn("found_in", F.lit("both"))
            .unionByName(a.subtract(b).withColumn("found_in", F.lit("train")))
            .unionByName(b.subtract(a).withColumn("found_in", F.lit("test"))))


def encode(df: DataFrame, classes: list[str], column: str = TARGET, out: str = "label_index") -> DataFrame:
    """Class index by position in the sorted class list; an unknown class is an error."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column)).cast("int")
    known = F.when(position > 0, position - 1).otherwise(
        F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(column), F.lit("null")))).cast("int"))
    return df.withColumn(out, known)


def class_list(df: DataFrame, column: str = TARGET) -> list[str]:
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def class_name(index: F.Column, classes: list[str]) -> F.Column:
    """Class of an index; indexes without a class read ``Class <n>``."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.coalesce(F.get(names, index), F.concat(F.lit("Class "), index.cast("string")))
