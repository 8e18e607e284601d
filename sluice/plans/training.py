"""Training: leakage-free splits, cross-validated candidates, final fits, selection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice import workdir
from sluice.functions.copies import number_copies
from sluice.functions.scalars import col
from sluice.operators import cleaning, dedup, encoding, labels, metrics, models, neighbours, profiling, sampling, selection, trees
from sluice.schemas import FEATURES, TARGET, TrainingConfig
from sluice.sources import eventlog, registry

_META = ["row_id", models.LABEL, models.WEIGHT, TARGET, "fold", "stopping"]


@dataclass
class Splits:
    train: DataFrame
    test: DataFrame
    classes: list[str]


def prepare_splits(train: DataFrame, test: DataFrame) -> Splits:
    """Harmonised, deduplicated splits whose test rows never occur in training.

    Each row gets ``row_id``, a hash of its content, which later steps sample and split by.
    """
    train, test = labels.harmonise(train, test)
    features = dedup.common_features(train, test)
    train = workdir.materialize(with_row_id(dedup.remove_duplicates(train)), "train")
    test = labels.drop_unseen(train, dedup.remove_duplicates(test))
    test = workdir.materialize(with_row_id(dedup.remove_seen_in_training(train, test, features)), "test")
    return Splits(train, test, labels.class_list(train))


def with_row_id(df: DataFrame) -> DataFrame:
    content = [F.coalesce(col(c).cast("string"), F.lit("~")) for c in df.columns]
    return df.withColumn("row_id", F.md5(F.concat_ws("|", *content)))


def _number_copies(df: DataFrame) -> DataFrame:
    """Makes the ids of repeated rows different."""
    return number_copies(df, "_copy").withColumn("row_id", F.concat_ws("-", "row_id", F.col("_copy").cast("string"))).drop("_copy")


def training_rows(splits: Splits, config: TrainingConfig) -> DataFrame:
    """Balanced training rows with class index, weight and fold, written once."""
    rows = splits.train
    if config.balance_training:
        rows = _number_copies(sampling.balance_training(rows, TARGET, ["row_id"], config))
    rows = workdir.materialize(labels.encode(rows, splits.classes, out=models.LABEL), "balanced")
    group = selection.group_column(splits.train.drop(TARGET, "row_id"))
    if group is None:
        rows = sampling.stratified_folds(rows, TARGET, ["row_id"], config.cv_folds, config.seed)
    else:
        rows = sampling.group_folds(rows, TARGET, group, config.cv_folds, config.seed)
    rows = models.with_early_stopping_rows(rows, ["row_id"], config.seed)
    return workdir.materialize(rows.withColumn(models.WEIGHT, F.lit(1.0)), "training-rows")


def test_rows(splits: Splits) -> DataFrame:
    return labels.encode(splits.test, splits.classes, out=models.LABEL).withColumn(models.WEIGHT, F.lit(1.0))


def _oversampled(rows: DataFrame, seed: int) -> DataFrame:
    """Prepared rows with synthetic ones; these only have features, label and weight."""
    points = rows.select(models.LABEL, "row_id", vector_to_array("features").alias("vec"))
    made = neighbours.smote(points, models.LABEL, "row_id", seed=seed)
    return made.select(models.LABEL, F.col("id").alias("row_id"), array_to_vector("vec").alias("features"),
                       F.lit(1.0).alias(models.WEIGHT), F.lit(False).alias("stopping"))


def _preprocessor(config: TrainingConfig) -> encoding.FlowPreprocessor:
    return encoding.FlowPreprocessor(correlationThreshold=config.correlation_threshold, ignoreCols=_META)


class Fold:
    """One fold: preprocessing fitted on its training part and applied to both parts, once."""

    def __init__(self, rows: DataFrame, fold: int, config: TrainingConfig):
        fit, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        pre = _preprocessor(config).fit(fit)
        keep = ["row_id", models.LABEL, models.WEIGHT, "stopping", "features"]
        self.fold, self.config = fold, config
        self.fit = workdir.materialize(profiling.with_balanced_weight(pre.transform(fit).select(*keep), models.LABEL), "fold-fit")
        self.held = workdir.materialize(pre.transform(held).select(*keep), "fold-held")
        self._oversampled: DataFrame | None = None

    def rows(self, oversample: bool) -> DataFrame:
        if not oversample:
            return self.fit
        if self._oversampled is None:
            self._oversampled = workdir.materialize(_oversampled(self.fit, self.config.seed), "fold-smote")
        return self._oversampled


def _fold_blocks(folds: Sequence[Fold], oversample: bool) -> list[dict] | None:
    """Blocks of the rows each fold learns from, of its training and its held-out rows; None if all are too many to be sent."""
    out, left = [], trees.WHOLE
    for fold in folds:
        held = {}
        for name, rows in (("learn", fold.rows(oversample)), ("fit", fold.fit), ("held", fold.held)):
            if name == "fit" and not oversample:
                held[name] = held["learn"]
                continue
            table = trees.Table.of(trees.blocks_of(rows, models.LABEL, models.WEIGHT), left)
            if table.held is None:
                return None
            left -= table.rows * table.features
            held[name] = table.held
        out.append(held)
    return out


def _predict_together(held: list[dict], learners: Sequence, folds: Sequence[int], spark: SparkSession) -> DataFrame:
    """Predictions of every learner on every fold in one job: each task fits one learner on one fold and scores both parts."""
    classes = 1 + max(int(trees.from_row(r).y.max()) for h in held for rows in h.values() for r in rows)
    sent = spark.sparkContext.broadcast((held, list(learners), list(folds), classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, learners, folds, classes = sent.value
        for batch in batches:
            for job in batch["id"].to_pylist():
                setting, at = divmod(job, len(folds))
                score = learners[setting]([trees.from_row(r) for r in held[at]["learn"]], classes)
                for part in ("held", "fit"):
                    for block in map(trees.from_row, held[at][part]):
                        p, n = score(block.x), len(block.y)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([setting] * n, pa.int32()), pa.array([folds[at]] * n, pa.int32()), pa.array([part] * n), pa.array(block.y, pa.int32()),
                             pa.array(p.argmax(axis=1), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))],
                            ["setting", "fold", "part", "label", "prediction", "probability"])

    jobs = len(learners) * len(folds)
    return spark.range(0, jobs, 1, jobs).mapInArrow(run, "setting int, fold int, part string, label int, prediction int, probability array<double>")


def cross_predict(folds: Sequence[Fold], candidate: models.Candidate, settings: Sequence[Mapping],
                  config: TrainingConfig) -> DataFrame:
    """Predictions of every setting on every fold, for held-out and training rows, as one table."""
    spark = folds[0].held.sparkSession
    path = workdir.new_path(spark, "cv-predictions")
    if hasattr(candidate.build(**settings[0]), "learner"):
        held = _fold_blocks(folds, candidate.oversample)
        if held is not None:
            _predict_together(held, [candidate.build(**s).learner() for s in settings], [f.fold for f in folds], spark).write.parquet(path)
            return spark.read.parquet(path)

    def run(job: tuple[int, Mapping, Fold]) -> None:
        i, setting, fold = job
        model = candidate.build(**setting).fit(fold.rows(candidate.oversample))
        for part, rows in (("held", fold.held), ("fit", fold.fit)):
            scored = models.as_predictions(model.transform(rows), setting=i, fold=fold.fold, part=part)
            scored.write.parquet(f"{path}/{i}-{fold.fold}-{part}")  # jobs run at the same time

    for fold in folds:
        fold.rows(candidate.oversample)  # before threads share it
    jobs = [(i, s, f) for i, s in enumerate(settings) for f in folds]
    pool = ThreadPool(max(1, config.parallelism))
    try:
        pool.map(inheritable_thread_target(spark)(run), jobs)
    finally:
        pool.close()
    return spark.read.parquet(*[f"{path}/{i}-{f.fold}-{part}" for i, _s, f in jobs for part in ("held", "fit")])


def cv_table(predictions: DataFrame, n_classes: int) -> DataFrame:
    """Per setting: mean and deviation over folds of the held-out metrics, and mean training F1."""
    by = ["setting", "fold"]
    held = metrics.across_folds(metrics.evaluate(predictions.where("part = 'held'"), n_classes, by), ["setting"])
    fit = metrics.summarise(predictions.where("part = 'fit'"), by)
    return held.join(fit.groupBy("setting").agg(F.avg("f1_weighted").alias("cv_train_f1_weighted_mean")), "setting")


def search(folds: Sequence[Fold], candidate: models.Candidate, n_classes: int,
           config: TrainingConfig) -> tuple[dict, DataFrame]:
    """The best of ``search_iter`` random settings by held-out weighted F1, and the table of all."""
    settings = models.draw_settings(candidate.grid, config.search_iter, config.seed) if candidate.grid else [{}]
    table = workdir.materialize(cv_table(cross_predict(folds, candidate, settings, config), n_classes), "search")
    best = table.orderBy(F.desc("cv_f1_weighted_mean"), "setting").first()["setting"]
    return settings[best], table


def final_model(rows: DataFrame, candidate: models.Candidate, setting: Mapping, config: TrainingConfig) -> PipelineModel:
    """Preprocessing and model fitted on all training rows; boosting stops early on its own 15 %."""
    early = candidate.base == "XGBoost"
    pre = _preprocessor(config).fit(rows.where(~F.col("stopping")) if early else rows)
    ready = profiling.with_balanced_weight(pre.transform(rows), models.LABEL)
    ready = workdir.materialize(ready.select("row_id", models.LABEL, models.WEIGHT, "stopping", "features"), "final-fit")
    if candidate.oversample:
        ready = workdir.materialize(_oversampled(ready, config.seed), "final-smote")
    extra = {"stop": "stopping"} if early else {}
    return PipelineModel([pre, candidate.build(**setting, **extra).fit(ready)])


def train_and_rank(train: DataFrame, test: DataFrame, folder: str, config: TrainingConfig = TrainingConfig(),
                   chosen: Sequence[str] | None = None, settings: Mapping[str, Sequence[Mapping]] | None = None,
                   tables: str | None = None) -> DataFrame:
    """Cross-validates, fits and evaluates the candidates; saves them and the best one.

    ``chosen`` limits the candidates; ``settings`` gives fixed settings per candidate name
    instead of random ones. ``tables`` is a folder for the result tables. Returns the table of models, best first.
    """
    spark = train.sparkSession
    splits = prepare_splits(train, test)
    n = len(splits.classes)
    rows = training_rows(splits, config)
    held_out = test_rows(splits)
    if tables is not None:
        _write_class_tables(splits, rows, tables, config)
    folds = [Fold(rows, r[0], config) for r in rows.select("fold").distinct().orderBy("fold").collect()]
    path, cv = workdir.new_path(spark, "predictions"), None
    for c in models.candidates(n, config.seed, config.enable_smote):
        if chosen is not None and c.name not in chosen:
            continue
        if settings and c.name in settings:
            options = list(settings[c.name])
            table = workdir.materialize(cv_table(cross_predict(folds, c, options, config), n), "search")
            setting = options[table.orderBy(F.desc("cv_f1_weighted_mean"), "setting").first()["setting"]]
        else:
            setting, table = search(folds, c, n, config)
        best = table.orderBy(F.desc("cv_f1_weighted_mean"), "setting").limit(1).withColumn("model", F.lit(c.name))
        cv = best if cv is None else cv.unionByName(best)
        if tables is not None:
            eventlog.write_metric_table(table, tables, f"{registry.safe_name(c.name)}_randomized_search")
        model = final_model(rows, c, setting, config)
        registry.save_model(model, c.name, folder)
        for split, part in (("train", rows), ("test", held_out)):
            scored = models.as_predictions(model.transform(part), model=c.name, split=split)
            scored.write.mode("append").parquet(path)
    predictions = spark.read.parquet(path)
    table = metrics.model_table(metrics.summarise(predictions.where("split = 'train'"), ["model"]), cv,
                                metrics.evaluate(predictions.where("split = 'test'"), n, ["model"]))
    table = workdir.materialize(metrics.rank(table), "model-table")
    if tables is not None:
        _write_score_tables(table, predictions.where("split = 'test'"), splits.classes, tables)
    winner = metrics.selected(table).first()["Model"]
    registry.save_model(registry.load_model(winner, folder), "selected_model", folder, backup=True)
    return metrics.rank(table)


def _write_class_tables(splits: Splits, rows: DataFrame, tables: str, config: TrainingConfig) -> None:
    """Class distribution of both splits, and of training before and after balancing."""
    distribution = (profiling.class_distribution(splits.train, splits.classes, "train", TARGET)
                    .unionByName(profiling.class_distribution(splits.test, splits.classes, "test", TARGET)))
    eventlog.write_metric_table(distribution, tables, "class_distribution")
    report = workdir.materialize(sampling.balance_report(splits.train, rows, splits.classes, TARGET, config), "balance-report")
    for name, part in (("training_balance_before_after", F.col("split") != "summary"), ("training_balance_summary", F.col("split") == "summary")):
        eventlog.write_metric_table(report.where(part), tables, name)


def _write_score_tables(table: DataFrame, test: DataFrame, classes: Sequence[str], tables: str) -> None:
    """Model table, its cross-validation and its test scores, and the test scores per class."""
    by_class = metrics.per_class(metrics.confusion(test, ["model"]), ["model"]).drop("correct")
    named = by_class.withColumn("class", labels.class_name(F.col("class"), list(classes)))
    for name, df in (("robust_model_summary", table), ("test_per_class_metrics", named),
                     ("validation_scores", table.select("Model", *metrics.CV_COLUMNS)),
                     ("test_scores", table.select("Model", *metrics.TEST_COLUMNS))):
        eventlog.write_metric_table(df, tables, name)


def train_live_lab(collected: DataFrame, sample: DataFrame | None, folder: str, holdout: float = 0.25,
                   live_weight: float = 10.0, n_trees: int = 600, depth: int = 60, seed: int = 42) -> DataFrame:
    """Deployment model from collected rows, weighted up, and a sample of the public data set.

    Saves it as the selected model, the previous one kept as a backup. Returns its
    held-out predictions.
    """
    frames = {"live_lab": collected} if sample is None else {"cicddos2019": sample, "live_lab": collected}
    mixed = cleaning.invalid_to_null(dedup.tag_sources(**frames), FEATURES)
    mixed = workdir.materialize(_number_copies(with_row_id(mixed)), "live-lab")
    classes = labels.class_list(mixed)
    if len(classes) < 2:
        raise ValueError("at least two classes are needed to train a deployment model")
    source = F.when(F.col("_source") == "live_lab", F.lit(live_weight)).otherwise(F.lit(1.0))
    rows = labels.encode(mixed, classes, out=models.LABEL).withColumn("source_weight", source)
    counts = {r[0]: r[1] for r in rows.groupBy(TARGET).count().collect()}
    if min(counts.values()) >= 2:
        rows = sampling.mark_holdout(rows, TARGET, holdout, ["row_id"], seed)
    else:
        rows = sampling.mark_holdout_plain(rows, holdout, ["row_id"], seed)
    fit = rows.where(~F.col("held_out"))
    medians = cleaning.fit_medians(fit, FEATURES)
    ranges = encoding.fit_minmax(cleaning.apply_medians(fit, medians), FEATURES)
    state = {"dropped": {}, "numeric": FEATURES, "text": [], "medians": medians, "modes": {}, "categories": {},
             "ranges": {c: list(r) for c, r in ranges.items()}}
    pre = encoding.FlowPreprocessorModel(state=state)
    ready = profiling.with_balanced_weight(pre.transform(fit), models.LABEL)
    ready = ready.withColumn(models.WEIGHT, F.col(models.WEIGHT) * F.col("source_weight"))
    forest = models.extra_trees(trees=n_trees, depth=depth, min_split=2, min_leaf=1, seed=seed).fit(ready)
    model = PipelineModel([pre, forest])
    registry.save_model(model, "selected_model", folder, backup=True)
    return models.as_predictions(model.transform(rows.where("held_out")), model="selected_model", split="test")


def score_flows(model: PipelineModel, flows: DataFrame) -> DataFrame:
    """Flows with the model's class probabilities as an array."""
    return model.transform(flows).withColumn("probability", vector_to_array("probability"))
