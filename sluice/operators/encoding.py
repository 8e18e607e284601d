"""Scaling, category encoding, and the train-fitted feature preprocessor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice import workdir
from sluice.functions.columns import column_facts
from sluice.functions.scalars import col, finite, numeric_columns
from sluice.operators import cleaning, dedup, labels, profiling, sampling, selection, vocabulary
from sluice.schemas import TARGET


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest valid value per column."""
    return {c: (f.finite_lo, f.finite_hi) for c, f in column_facts(df, columns).items()}


def scaled(value: Column, lo: float, hi: float) -> Column:
    """(x - min) / range, not clipped; a column without range counts as range 1."""
    return (value - F.lit(float(lo))) / F.lit(float(hi - lo) if hi > lo else 1.0)


def apply_minmax(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[scaled(col(c).cast("double"), *ranges[c]).alias(c) if c in ranges else col(c)
                       for c in df.columns])


# More one-hot columns than this, in all, are slots of sparse vectors and never reach the driver.
MOST_CATEGORIES = 10_000


def fit_categories(df: DataFrame, columns: Sequence[str], most: int = MOST_CATEGORIES) -> dict[str, list[str]]:
    """Sorted categories per column, for one expression each. More than ``most`` in all are refused, before they reach
    the driver; ``vocabulary`` encodes any number of them."""
    out: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in columns])
        found = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("v").isNotNull()).distinct()
        rows = found.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} categories in columns {list(columns)}; encode them by vocabulary.onehot_vector")
        for r in sorted(rows):
            out[r["c"]].append(r["v"])
    return out


def onehot_columns(categories: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """``column_value`` to 1.0/0.0; a value unknown at fitting time gives all zeros."""
    return {f"{c}_{v}": F.coalesce((col(c).cast("string") == v).cast("double"), F.lit(0.0))
            for c, values in categories.items() for v in values}


class FlowPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns, from the rows it is fitted on only: leakage-like, constant and highly
    correlated columns to drop, medians, ranges, most frequent values and categories.

    Columns whose categories exceed ``mostCategories`` in all have them in a table (``vocabularyPath``, by default in
    the shared folder), to which a saved model refers; their features come last, as slots of a sparse vector.
    """

    correlationThreshold = Param(Params._dummy(), "correlationThreshold", "drop above this |r|", TypeConverters.toFloat)
    ignoreCols = Param(Params._dummy(), "ignoreCols", "columns that are not features", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    mostCategories = Param(Params._dummy(), "mostCategories", "categories kept in the model itself", TypeConverters.toInt)
    vocabularyPath = Param(Params._dummy(), "vocabularyPath", "where the table of further categories is kept", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, correlationThreshold: float = 0.9, ignoreCols: list[str] | None = None,
                 outputCol: str = "features", mostCategories: int = MOST_CATEGORIES, vocabularyPath: str | None = None):
        super().__init__()
        self._setDefault(correlationThreshold=0.9, ignoreCols=[], outputCol="features", mostCategories=MOST_CATEGORIES, vocabularyPath="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FlowPreprocessorModel:
        skip = set(self.getOrDefault("ignoreCols"))
        columns = [c for c in dataset.columns if c not in skip]
        leakage = selection.leakage_columns(columns)
        columns = [c for c in columns if c not in leakage]
        # Several passes follow; they read these columns as written here, not what made them.
        dataset = workdir.materialize(dataset.select(*[col(c) for c in columns]), "preprocess-fit")
        facts = column_facts(dataset, columns)
        constant = [c for c in columns if facts[c].is_constant]
        columns = [c for c in columns if c not in constant]
        numeric = [c for c in numeric_columns(dataset) if c in columns]
        text = [c for c in columns if c not in numeric]
        medians = cleaning.fit_medians(dataset, numeric)
        correlated: list[str] = []
        if len(numeric) > 1:
            filled = cleaning.apply_medians(dataset.select(*[col(c) for c in numeric]), medians)
            corr = selection.correlation_matrix(filled, numeric)
            correlated = selection.highly_correlated(numeric, corr, self.getOrDefault("correlationThreshold"))
        numeric = [c for c in numeric if c not in correlated]
        if not numeric and not text:
            raise ValueError("no usable features remain after preprocessing")
        # Filling with the median, a value between the extremes, leaves the extremes as they are.
        ranges = {c: (medians[c], medians[c]) if facts[c].finite_lo is None
                  else (facts[c].finite_lo, facts[c].finite_hi) for c in numeric}
        narrow, wide, table = self._categories(dataset, text)
        state = {
            "dropped": {"leakage": leakage, "constant": constant, "high_correlation": correlated},
            "numeric": numeric, "text": [c for c in text if c in narrow], "medians": {c: float(medians[c]) for c in numeric},
            "ranges": {c: [float(v) for v in r] for c, r in ranges.items()},
            "modes": cleaning.most_frequent(dataset, text), "categories": narrow,
            "wide": wide, "vocabulary": table,
        }
        return FlowPreprocessorModel(state=state, outputCol=self.getOrDefault("outputCol"))

    def _categories(self, dataset: DataFrame, text: Sequence[str]) -> tuple[dict[str, list[str]], dict[str, int], str]:
        """Sorted categories of the columns with few, sizes of the others, and where the table of these is."""
        if not text:
            return {}, {}, ""
        values = workdir.materialize(vocabulary.distinct_values(dataset, text), "categories")
        counts, room = vocabulary.sizes(values), self.getOrDefault("mostCategories")
        narrow: dict[str, list[str]] = {}
        for c in sorted(text, key=lambda c: counts.get(c, 0)):
            if counts.get(c, 0) <= room:
                narrow[c], room = [], room - counts.get(c, 0)
        for r in sorted(values.where(F.col("column").isin(list(narrow))).collect()):
            narrow[r["column"]].append(r["value"])
        wide = {c: counts[c] for c in text if c not in narrow}
        path = ""
        if wide:
            path = self.getOrDefault("vocabularyPath") or workdir.new_path(dataset.sparkSession, "vocabulary")
            vocabulary.number_values(values.where(F.col("column").isin(list(wide))), path)
        return narrow, wide, path


class FlowPreprocessorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted columns and values", TypeConverters.identity)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: dict | None = None, outputCol: str | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def dropped_columns(self) -> dict[str, list[str]]:
        return self.getOrDefault("state")["dropped"]

    def feature_columns(self, df: DataFrame) -> dict[str, Column]:
        """Output feature name to expression; numeric features first, then one-hot ones."""
        s = self.getOrDefault("state")
        out = {}
        for c in s["numeric"]:
            value = finite(col(c).try_cast("double")) if c in df.columns else F.lit(None).cast("double")
            out[c] = scaled(F.coalesce(value, F.lit(s["medians"][c])), *s["ranges"][c])
        for c in s["text"]:
            filled = self._filled(df, c)
            out |= {f"{c}_{v}": F.coalesce((filled == v).cast("double"), F.lit(0.0)) for v in s["categories"][c]}
        return out

    def _filled(self, df: DataFrame, column: str) -> Column:
        value = col(column).cast("string") if column in df.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(self.getOrDefault("state")["modes"].get(column)))

    def feature_table(self, spark: SparkSession) -> DataFrame:
        """(slot, name) of all features, whatever their number."""
        s = self.getOrDefault("state")
        names = list(s["numeric"]) + [f"{c}_{v}" for c in s["text"] for v in s["categories"][c]]
        out, begin = spark.createDataFrame(list(enumerate(names)), "slot long, name string"), len(names)
        for c, n in s.get("wide", {}).items():
            of = vocabulary.read(spark, s["vocabulary"]).where(F.col("column") == c)
            out = out.unionByName(of.select((F.col("position") + begin).alias("slot"), F.concat(F.lit(f"{c}_"), "value").alias("name")))
            begin += n
        return out

    def feature_names(self) -> list[str]:
        s = self.getOrDefault("state")
        if s.get("wide"):
            raise ValueError(f"the categories of {list(s['wide'])} are in a table; see feature_table")
        return list(s["numeric"]) + [f"{c}_{v}" for c in s["text"] for v in s["categories"][c]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, s = self.getOrDefault("outputCol"), self.getOrDefault("state")
        columns = list(self.feature_columns(dataset).values())
        wide = s.get("wide", {})
        if not wide:
            return dataset.withColumn(out, array_to_vector(F.array(*columns)))
        return vocabulary.with_vector(dataset, vocabulary.read(dataset.sparkSession, s["vocabulary"]),
                                      {c: self._filled(dataset, c) for c in wide}, wide, out, columns)


def preprocess_static(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str],
                      correlation_threshold: float = 0.8, validation_size: float = 0.2, seed: int = 42) -> dict:
    """The fixed path: harmonise, deduplicate, split, then medians, single-value and correlated
    columns, class indexes and ranges, all fitted on the training part.

    Returns the three parts with scaled features and ``label_index``, and what was fitted.
    """
    kept = list(dict.fromkeys([*features, *keys, TARGET]))
    train, test = labels.harmonise(train, test)
    # Every later step reads these rows again, so they are written once.
    train = workdir.materialize(dedup.remove_duplicates(train.select(*kept)), "static-distinct")
    train = workdir.materialize(sampling.mark_holdout(train, TARGET, validation_size, keys, seed), "static-train")
    test = workdir.materialize(dedup.remove_duplicates(test.select(*kept)), "static-test")
    fit, val = (train.where(F.col("held_out") == held).drop("held_out") for held in (False, True))
    medians = cleaning.fit_medians(fit, features)
    parts = {n: cleaning.apply_medians(d, medians) for n, d in (("train", fit), ("validation", val), ("test", test))}
    single = selection.single_value_columns(parts["train"], features)
    left = [c for c in features if c not in single]
    correlated = selection.highly_correlated(left, selection.correlation_matrix(parts["train"], left), correlation_threshold)
    left = [c for c in left if c not in correlated]
    classes = labels.class_list(parts["train"])
    ranges = fit_minmax(parts["train"], left)
    out = {n: labels.encode(apply_minmax(selection.drop_columns(d, single + correlated), ranges), classes)
           for n, d in parts.items()}
    return out | {"classes": classes, "medians": medians, "ranges": ranges, "feature_names": left,
                  "dropped_single_value": single, "dropped_high_correlation": correlated}


def static_report(result: dict) -> DataFrame:
    """What the fixed path kept: rows per part and class."""
    parts = [profiling.label_distribution(result[n]).withColumn("part", F.lit(n)) for n in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
