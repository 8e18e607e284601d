"""Metrics, model ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import metrics as M
from sluice.plans import bindings as B
from sluice.plans.registry import query

_N = 5
_A = "(3 + (row_id * k) % 5)"
_OTHER = "((prediction + 1 + row_id % 4) % 5)"
_P = [f"(case when prediction = {c} then {_A} when {_OTHER} = {c} then 8 - {_A} else 0 end / 8.0{{d}})" for c in range(_N)]

PRED_CTE = B.PREDICTIONS_CTE + (
    ", pred as (select *, [" + ", ".join(p.format(d="::double") for p in _P) + "] as probability from pred0)")


def predictions(spark, sf):
    return B.predictions(spark, sf).withColumn("probability", F.array(*[F.expr(p.format(d="D")) for p in _P])).drop("k")


def _per_class_sql(by: str, src: str = "pred") -> str:
    """Per-class figures for the given group columns, as CTEs ``pc`` and ``av``."""
    g = by + ", " if by else ""
    using = f"using ({g} class)"
    return f"""lab as (select {g} label as class, count(*) as support, count(*) filter (label = prediction) as correct from {src} group by {g} label),
  prd as (select {g} prediction as class, count(*) as predicted from {src} group by {g} prediction),
  pc0 as (select {g} class, coalesce(support, 0) as support, coalesce(correct, 0) as correct, coalesce(predicted, 0) as predicted
    from lab full join prd {using}),
  pc1 as (select *, case when predicted = 0 then 0 else correct / predicted::double end as precision,
    case when support = 0 then 0 else correct / support::double end as recall from pc0),
  pc as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1_score from pc1),
  av as (select {g} sum(correct) / sum(support)::double as accuracy, sum(precision * support) / sum(support) as precision_weighted,
    sum(recall * support) / sum(support) as recall_weighted, sum(f1_score * support) / sum(support) as f1_weighted,
    avg(f1_score) as f1_macro from pc {'group by ' + by if by else ''})"""


def _auc_sql(by: str, src: str = "pred") -> str:
    g = by + ", " if by else ""
    return f"""sc as (select {g} label, unnest(range(0, {_N})) as class, unnest(probability) as score from {src}),
  cn as (select {g} class, score, count(*) filter (label = class) as pos, count(*) filter (label <> class) as neg from sc group by {g} class, score),
  bl as (select *, coalesce(sum(neg) over (partition by {g} class order by score rows between unbounded preceding and 1 preceding), 0) as below from cn),
  ca as (select {g} class, sum(pos) as support, case when sum(pos) * sum(neg) > 0 then
    sum(pos * (2 * below + neg))::double / 2 / (sum(pos)::double * sum(neg)) end as auc from bl group by {g} class),
  wa as (select {g} case when count(auc) = {_N} then sum(auc * support) / sum(support) end as roc_auc_ovr_weighted from ca {'group by ' + by if by else ''})"""


_TEST = "pred_t as (select * from pred where split = 'test')"


def _test(spark, sf):
    return predictions(spark, sf).where("split = 'test'")


def _round(df, cols, digits=10):
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def _rsql(cols, digits=10) -> str:
    return ", ".join(f'round("{c}", {digits}) as "{c}"' for c in cols)


@query("confusion_matrix", f"with {PRED_CTE} select model, label, prediction, count(*) as n from pred group by model, label, prediction")
def _(spark, sf):
    return M.confusion(predictions(spark, sf), ["model"])


@query("metric_accuracy", f"with {PRED_CTE} select model, split, avg(case when label = prediction then 1.0::double else 0.0::double end) "
                          "as accuracy from pred group by model, split")
def _(spark, sf):
    return M.summarise(predictions(spark, sf), ["model", "split"]).select("model", "split", "accuracy")


_PC = ["precision", "recall", "f1_score"]


@query("metric_per_class", f"with {PRED_CTE}, {_TEST}, {_per_class_sql('model', 'pred_t')} select model, 'test' as split, class, "
                           f"{_rsql(_PC)}, support from pc")
def _(spark, sf):
    pc = M.per_class(M.confusion(_test(spark, sf), ["model"]), ["model"]).drop("correct")
    return _round(pc, _PC).withColumn("split", F.lit("test"))


_W = ["precision_weighted", "recall_weighted", "f1_weighted"]


@query("metric_weighted", f"with {PRED_CTE}, {_per_class_sql('model, split')} select model, split, {_rsql(_W)} from av")
def _(spark, sf):
    return _round(M.summarise(predictions(spark, sf), ["model", "split"]).select("model", "split", *_W), _W)


@query("metric_macro_f1", f"with {PRED_CTE}, {_per_class_sql('model, split')} select model, split, round(f1_macro, 10) as f1_macro from av")
def _(spark, sf):
    return _round(M.summarise(predictions(spark, sf), ["model", "split"]).select("model", "split", "f1_macro"), ["f1_macro"])


@query("metric_roc_auc_ovr", f"with {PRED_CTE}, {_auc_sql('model, split')} select model, split, round(roc_auc_ovr_weighted, 10) as roc_auc_ovr_weighted from wa")
def _(spark, sf):
    return _round(M.roc_auc_weighted(predictions(spark, sf), _N, ["model", "split"]), ["roc_auc_ovr_weighted"])


@query("metric_auc_per_class", f"with {PRED_CTE}, {_auc_sql('model')} select model, class, support, round(auc, 10) as auc from ca")
def _(spark, sf):
    return _round(M.class_auc(predictions(spark, sf), _N, ["model"]), ["auc"])


_ALL = [*M.METRICS, "roc_auc_ovr_weighted"]
_CV = f"""cvp as (select * from pred where split = 'train'), {_per_class_sql('model, fold', 'cvp')}, {_auc_sql('model, fold', 'cvp')},
  cv as (select model, {', '.join(f'avg({m}) as cv_{m}_mean, stddev_pop({m}) as cv_{m}_std' for m in _ALL)}
    from av join wa using (model, fold) group by model)"""
_CVC = [f"cv_{m}_{s}" for m in _ALL for s in ("mean", "std")]


@query("cross_validate", f"with {PRED_CTE}, {_CV} select model, {_rsql(_CVC)} from cv")
def _(spark, sf):
    train = predictions(spark, sf).where("split = 'train'")
    return _round(M.cross_validated(train, _N), _CVC)


def _rename(sql: str, suffix: str) -> str:
    """The per-class and AUC CTEs under other names, so several can stand in one statement."""
    import re
    return re.sub(r"\b(lab|prd|pc0|pc1|pc|av|sc|cn|bl|ca|wa)\b", lambda m: m.group(0) + suffix, sql)


_TABLE = f"""with {PRED_CTE}, {_TEST}, {_CV},
  {_rename(_per_class_sql('model', 'pred_t'), '_t')}, {_rename(_auc_sql('model', 'pred_t'), '_t')},
  {_rename(_per_class_sql('model', 'cvp'), '_r')},
  tab as (select t.model as "Model", r.accuracy as "Train Accuracy", r.f1_weighted as "Train F1-Score",
  cv_accuracy_mean as "CV Accuracy Mean", cv_accuracy_std as "CV Accuracy Std", cv_f1_weighted_mean as "CV F1-Score Mean",
  cv_f1_weighted_std as "CV F1-Score Std", cv_f1_macro_mean as "CV F1-Macro Mean", cv_roc_auc_ovr_weighted_mean as "CV ROC-AUC Mean",
  t.accuracy as "Test Accuracy", t.precision_weighted as "Test Precision", t.recall_weighted as "Test Recall",
  t.f1_weighted as "Test F1-Score", t.f1_macro as "Test F1-Macro", roc_auc_ovr_weighted as "Test ROC-AUC",
  r.f1_weighted - cv_f1_weighted_mean as "Overfit Gap F1", cv_f1_weighted_mean - t.f1_weighted as "Generalization Gap F1",
  cv_f1_weighted_mean + 0.35::double * cv_f1_macro_mean - 2 * greatest(0, r.f1_weighted - cv_f1_weighted_mean) - 2 * cv_f1_weighted_std as "Selection Score"
  from av_t t join wa_t using (model) join av_r r using (model) join cv using (model))"""
_TABC = ["Train Accuracy", "Train F1-Score", "CV Accuracy Mean", "CV Accuracy Std", "CV F1-Score Mean", "CV F1-Score Std",
         "CV F1-Macro Mean", "CV ROC-AUC Mean", "Test Accuracy", "Test Precision", "Test Recall", "Test F1-Score",
         "Test F1-Macro", "Test ROC-AUC", "Overfit Gap F1", "Generalization Gap F1", "Selection Score"]


def _table(spark, sf):
    return M.table_of_splits(predictions(spark, sf), _N)


@query("metric_table", f"{_TABLE} select \"Model\", {_rsql(_TABC)} from tab")
def _(spark, sf):
    return _round(_table(spark, sf), _TABC)


@query("generalization_gaps", f"{_TABLE} select \"Model\", {_rsql(['Overfit Gap F1', 'Generalization Gap F1'])} from tab")
def _(spark, sf):
    return _round(_table(spark, sf), _TABC).select("Model", "Overfit Gap F1", "Generalization Gap F1")


@query("selection_score", f"{_TABLE} select \"Model\", {_rsql(['Selection Score'])} from tab")
def _(spark, sf):
    return _round(_table(spark, sf), _TABC).select("Model", "Selection Score")


@query("rank_models", f"{_TABLE} select \"Model\", {_rsql(['Selection Score'])} from tab order by \"Selection Score\" desc limit 1")
def _(spark, sf):
    return _round(M.selected(_table(spark, sf)), _TABC).select("Model", "Selection Score")


@query("best_by_metric", f"""{_TABLE} select 'CV F1-Score Mean' as metric, max_by("Model", "CV F1-Score Mean") as model,
  round(max("CV F1-Score Mean"), 10) as value from tab union all select 'Test F1-Score', max_by("Model", "Test F1-Score"),
  round(max("Test F1-Score"), 10) from tab""")
def _(spark, sf):
    table = _table(spark, sf)
    parts = [M.best_by(table, c).withColumn("metric", F.lit(c)) for c in ("CV F1-Score Mean", "Test F1-Score")]
    return _round(parts[0].unionByName(parts[1]), ["value"])


@query("score_projections", f"""{_TABLE} select 'cv' as kind, "Model", {', '.join(f'round("{c}", 10) as c{i}' for i, c in enumerate(M.CV_COLUMNS))},
  null as c5 from tab union all select 'test', "Model", {', '.join(f'round("{c}", 10)' for c in M.TEST_COLUMNS)} from tab""")
def _(spark, sf):
    table = _round(_table(spark, sf), _TABC)
    cv = table.select(F.lit("cv").alias("kind"), "Model", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(M.CV_COLUMNS)],
                      F.lit(None).cast("double").alias("c5"))
    return cv.unionByName(table.select(F.lit("test").alias("kind"), "Model", *[
        F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(M.TEST_COLUMNS)]))


@query("metric_alias_pick", f"{_TABLE} select \"Model\", round(\"CV F1-Score Mean\", 10) as f1, round(\"Test Precision\", 10) as precision, "
                            "round(\"Test ROC-AUC\", 10) as roc_auc from tab")
def _(spark, sf):
    table = _round(_table(spark, sf), _TABC)
    return table.select("Model", *[F.col(f"`{M.metric_column(table.columns, m)}`").alias(m) for m in ("f1", "precision", "roc_auc")])
