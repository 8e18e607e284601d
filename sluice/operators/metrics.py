"""Classification metrics over a predictions table.

Everything but the AUC follows from (label, prediction) counts: the predictions are
reduced to K*K rows per group before anything else happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice import workdir

_CHUNKS = 256

METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro"]


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class of a confusion table; 0 where undefined."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 hit.alias("correct")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("correct")))).alias("s"))
    sums = sides.select(*by, "s.*").groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    rated = sums.withColumns({"precision": _share(F.col("correct"), F.col("predicted")),
                              "recall": _share(F.col("correct"), F.col("support"))})
    f1 = _share(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    return rated.withColumn("f1_score", f1).select(*by, "class", "precision", "recall", "f1_score", "support", "correct")


def averages(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, support-weighted averages and macro F1 from the per-class table."""
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    return classes.groupBy(*by).agg(
        (F.sum("correct") / total).alias("accuracy"), weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"), weighted("f1_score").alias("f1_weighted"),
        F.avg("f1_score").alias("f1_macro"))


def summarise(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return averages(per_class(confusion(predictions, by), by), by)


def _below(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds ``neg_below``, the negatives with a lower score in the same group.

    Distinct scores are cut at their quantiles into chunks, so one class with very many
    of them is spread over many tasks.
    """
    def upto(w):
        return F.sum("neg").over(w) - F.col("neg")

    cuts = counts.groupBy(*groups).agg(F.percentile_approx(
        "score", [i / _CHUNKS for i in range(1, _CHUNKS)], 10_000).alias("_cuts"))
    chunked = counts.join(workdir.materialize(cuts, "score-cuts"), groups)  # one row per group
    chunked = chunked.withColumn("_chunk", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    totals = chunked.groupBy(*groups, "_chunk").agg(F.sum("neg").alias("neg"))
    before = totals.select(*groups, "_chunk", upto(Window.partitionBy(*groups).orderBy("_chunk")).alias("_before"))
    inside = chunked.withColumn("_inside", upto(Window.partitionBy(*groups, "_chunk").orderBy("score")))
    return (inside.join(before, [*groups, "_chunk"])
            .withColumn("neg_below", F.col("_before") + F.col("_inside")).drop("_chunk", "_before", "_inside"))


def class_auc(predictions: DataFrame, n_classes: int, by: Sequence[str] = (), probability: str = "probability") -> DataFrame:
    """One-vs-rest area under the ROC curve per class, ties counting half.

    Rows are first counted per (class, score), then ranked by running sums over scores.
    """
    groups = [*by, "class"]
    scores = predictions.select(*by, "label", F.posexplode(F.slice(F.col(probability), 1, n_classes)).alias("class", "score"))
    positive = (F.col("label") == F.col("class")).cast("long")
    counts = scores.groupBy(*groups, "score").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    counts = workdir.materialize(counts, "score-counts")
    ranked = _below(counts, groups)
    pairs = (F.col("pos").cast("decimal(19,0)") * (F.col("neg_below") * 2 + F.col("neg")).cast("decimal(19,0)"))
    sums = ranked.groupBy(*groups).agg(F.sum(pairs).alias("_won2"), F.sum("pos").alias("support"), F.sum("neg").alias("_neg"))
    won = F.col("_won2").cast("double") / 2
    return sums.select(*groups, "support", F.try_divide(won, F.col("support").cast("double") * F.col("_neg")).alias("auc"))


def roc_auc_weighted(predictions: DataFrame, n_classes: int, by: Sequence[str] = (), probability: str = "probability") -> DataFrame:
    """Prevalence-weighted mean of the class AUCs; for two classes that of class 1.

    Null when a class has no rows or all rows, where it is undefined.
    """
    auc = class_auc(predictions, n_classes, by, probability)
    if n_classes == 2:
        return auc.where(F.col("class") == 1).select(*by, F.col("auc").alias("roc_auc_ovr_weighted"))
    whole = F.count(F.when(F.col("auc").isNotNull(), 1)) == n_classes
    mean = F.sum(F.col("auc") * F.col("support")) / F.sum("support")
    return auc.groupBy(*by).agg(F.when(whole, mean).alias("roc_auc_ovr_weighted"))


def evaluate(predictions: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """The six metrics per group."""
    base, auc = summarise(predictions, by), roc_auc_weighted(predictions, n_classes, by)
    if by:
        return base.join(auc, list(by))
    return base.withColumn("_one", F.lit(1)).join(auc.withColumn("_one", F.lit(1)), "_one").drop("_one")


def across_folds(fold_metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; undefined folds are left out."""
    names = [*METRICS, "roc_auc_ovr_weighted"]
    return fold_metrics.groupBy(*by).agg(*[a for m in names if m in fold_metrics.columns for a in (
        F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std"))])


def cross_validated(predictions: DataFrame, n_classes: int, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    return across_folds(evaluate(predictions, n_classes, [*by, fold]), by)


def selection_score(train_f1: Column, cv_f1: Column, cv_macro: Column, cv_std: Column) -> Column:
    overfit = F.greatest(F.lit(0.0), train_f1 - cv_f1)
    return cv_f1 + cv_macro * 0.35 - overfit * 2.0 - cv_std * 2.0


def model_table(train: DataFrame, cv: DataFrame, test: DataFrame) -> DataFrame:
    """One row per model with train, cross-validation and test metrics, gaps and score."""
    t = train.select("model", F.col("accuracy").alias("tr_acc"), F.col("f1_weighted").alias("tr_f1"))
    joined = t.join(cv, "model").join(test, "model")
    tr, cvf, te = F.col("tr_f1"), F.col("cv_f1_weighted_mean"), F.col("f1_weighted")
    return joined.select(
        F.col("model").alias("Model"), F.col("tr_acc").alias("Train Accuracy"), tr.alias("Train F1-Score"),
        F.col("cv_accuracy_mean").alias("CV Accuracy Mean"), F.col("cv_accuracy_std").alias("CV Accuracy Std"),
        cvf.alias("CV F1-Score Mean"), F.col("cv_f1_weighted_std").alias("CV F1-Score Std"),
        F.col("cv_f1_macro_mean").alias("CV F1-Macro Mean"),
        F.col("cv_roc_auc_ovr_weighted_mean").alias("CV ROC-AUC Mean"),
        F.col("accuracy").alias("Test Accuracy"), F.col("precision_weighted").alias("Test Precision"),
        F.col("recall_weighted").alias("Test Recall"), te.alias("Test F1-Score"), F.col("f1_macro").alias("Test F1-Macro"),
        F.col("roc_auc_ovr_weighted").alias("Test ROC-AUC"),
        (tr - cvf).alias("Overfit Gap F1"), (cvf - te).alias("Generalization Gap F1"),
        selection_score(tr, cvf, F.col("cv_f1_macro_mean"), F.col("cv_f1_weighted_std")).alias("Selection Score"))


def table_of_splits(predictions: DataFrame, n_classes: int, fold: str = "fold") -> DataFrame:
    """The model table of predictions with model, split (train, test) and fold.

    Predictions are read once for the confusion counts and once for the scores, all models, splits and folds
    together; the rest works on these counts.
    """
    by = ["model", "split", "_part"]
    rows = predictions.withColumn("_part", F.when(F.col("split") == "train", F.col(fold)).otherwise(F.lit(-1)))
    cells = workdir.materialize(confusion(rows, by), "confusion")
    whole = workdir.materialize(averages(per_class(cells, by), by).join(roc_auc_weighted(rows, n_classes, by), by), "scores")
    of = {split: whole.where(F.col("split") == split) for split in ("train", "test")}
    fitted = cells.where("split = 'train'").groupBy("model", "label", "prediction").agg(F.sum("n").alias("n"))
    return model_table(averages(per_class(fitted, ["model"]), ["model"]), across_folds(of["train"], ["model"]), of["test"])


CV_COLUMNS = ["CV Accuracy Mean", "CV Accuracy Std", "CV F1-Score Mean", "CV F1-Score Std", "CV F1-Macro Mean"]
TEST_COLUMNS = ["Test Accuracy", "Test Precision", "Test Recall", "Test F1-Score", "Test F1-Macro", "Test ROC-AUC"]

# Metric name -> columns that may hold it, first match wins.
METRIC_ALIASES = {
    "accuracy": ["Accuracy", "CV Accuracy Mean", "Test Accuracy"],
    "precision": ["Precision", "CV Precision Mean", "Test Precision"],
    "recall": ["Recall", "CV Recall Mean", "Test Recall"],
    "f1": ["F1-Score", "CV F1-Score Mean", "Test F1-Score"],
    "f1_std": ["CV F1-Score Std"],
    "f1_macro": ["F1-Macro", "CV F1-Macro Mean", "Test F1-Macro"],
    "roc_auc": ["ROC-AUC", "Test ROC-AUC", "CV ROC-AUC Mean"],
}


def rank(table: DataFrame) -> DataFrame:
    """Models by selection score, best first."""
    return table.orderBy(F.desc("Selection Score"), "Model")


def selected(table: DataFrame) -> DataFrame:
    return rank(table).limit(1)


def best_by(table: DataFrame, column: str) -> DataFrame:
    """The model with the largest value of one metric, the first by name on ties."""
    best = F.min(F.struct((-F.col(f"`{column}`")).alias("less"), F.col("Model").alias("model")))
    return table.where(F.col(f"`{column}`").isNotNull()).agg(best.alias("b")).select("b.model", (-F.col("b.less")).alias("value"))


def metric_column(columns: Sequence[str], metric: str) -> str | None:
    return next((c for c in METRIC_ALIASES.get(metric, []) if c in columns), None)
