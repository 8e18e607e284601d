"""Labels, duplicates, cleaning, profiling, feature selection, sampling and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import scalars as S
from sluice.operators import cleaning, dedup, labels, profiling, sampling, selection
from sluice.plans import bindings as B
from sluice.plans.registry import query
from sluice.schemas import (CATEGORY, DEPLOYMENT_CLASSES, EXTRACTOR_COLUMNS, FEATURES, HARMONISE, TARGET,
                            TIME_FEATURES, TrainingConfig)

_FEAT = B.FEATURE_COLS
_KEY3 = ["f_qty", "f_disc", "f_tax"]


def _map_sql(mapping: dict[str, str], col: str = "Label") -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_ROW = "l_orderkey, l_linenumber, f_price, Label"
_ROWC = _ROW.split(", ")

LABELLED_CTE = B.SPLITS_CTE + f""",
test_known as (select * from raw_test where Label in (select Label from raw_train) or Label in {_in(HARMONISE)}),
test_named as (select * replace ({_map_sql(HARMONISE)} as Label) from test_known),
test_named_ok as (select * from test_named where Label is not null),
train_cat as (select * from (select * replace ({_map_sql(CATEGORY)} as Label) from raw_train) t where Label is not null),
test_cat as (select * from (select * replace ({_map_sql(CATEGORY)} as Label) from test_named_ok) t where Label is not null)"""


def _raw(spark, sf):
    return B.raw_train(spark, sf), B.raw_test(spark, sf)


def _cat(spark, sf):
    return labels.harmonise(*_raw(spark, sf))


# ---- labels ----


@query("label_harmonize_test", f"with {B.SPLITS_CTE} select * from (select l_orderkey, l_linenumber, f_price, "
                               f"{_map_sql(HARMONISE)} as Label from raw_test) t where Label is not null")
def _(spark, sf):
    return labels.rename_test(B.raw_test(spark, sf)).select(*_ROWC)


@query("label_drop_test_only", f"with {LABELLED_CTE} select {_ROW} from test_known")
def _(spark, sf):
    return labels.drop_test_only(*_raw(spark, sf)).select(*_ROWC)


@query("label_category", f"with {B.SPLITS_CTE} select * from (select l_orderkey, l_linenumber, f_price, "
                         f"{_map_sql(CATEGORY)} as Label from raw_train) t where Label is not null")
def _(spark, sf):
    return labels.to_category(B.raw_train(spark, sf)).select(*_ROWC)


@query("label_harmonize_full", f"with {LABELLED_CTE} select 'train' as split, {_ROW} from train_cat union all "
                               f"select 'test', {_ROW} from test_cat")
def _(spark, sf):
    train, test = _cat(spark, sf)
    return (train.select(F.lit("train").alias("split"), *_ROWC)
            .unionByName(test.select(F.lit("test").alias("split"), *_ROWC)))


@query("label_map_fallback", f"with {B.FLOWS_CTE} select l_orderkey, l_linenumber, f_price, "
                             f"coalesce({_map_sql(HARMONISE)}, Label) as Label from flows")
def _(spark, sf):
    return labels.rename_or_keep(B.flows(spark, sf)).select(*_ROWC)


# One training class bears another's name, so that test labels unseen in training exist.
_RENAMED = "case when Label = 'LDAP Flood' then 'UDP Flood' else Label end"


@query("label_drop_unseen_test", f"with {LABELLED_CTE}, seen as (select {_RENAMED} as Label from train_cat) "
                                 f"select {_ROW} from test_cat where Label in (select Label from seen)")
def _(spark, sf):
    train, test = _cat(spark, sf)
    return labels.drop_unseen(train.withColumn(TARGET, F.expr(_RENAMED)), test).select(*_ROWC)


_DEPLOY = f"{B.FLOWS_CTE}, named as (select *, coalesce({_map_sql(CATEGORY | {'DrDoS_UDP': 'UDP Flood'})}, Label) as cat from flows)"


def _named(spark, sf):
    return labels.rename_or_keep(B.flows(spark, sf), CATEGORY | {"DrDoS_UDP": "UDP Flood"})


@query("deployment_label_filter", f"with {_DEPLOY} select Label, kept, count(*) as n from (select cat as Label, "
       f"cat in {_in(DEPLOYMENT_CLASSES)} as kept from named) t group by Label, kept")
def _(spark, sf):
    named = _named(spark, sf)
    kept = labels.deployment_only(named).groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True))
    dropped = (named.join(labels.unsupported_labels(named), TARGET).groupBy(TARGET)
               .agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(False)))
    return kept.unionByName(dropped)


@query("set_common_labels", f"""with {B.SPLITS_CTE}, a as (select distinct Label from raw_train),
  b as (select distinct Label from raw_test) select coalesce(a.Label, b.Label) as Label,
  case when a.Label is null then 'test' when b.Label is null then 'train' else 'both' end as found_in
  from a full join b on a.Label = b.Label""")
def _(spark, sf):
    return labels.label_sets(*_raw(spark, sf))


@query("encode_labels", f"with {LABELLED_CTE} select {_ROW}, dense_rank() over (order by Label) - 1 as label_index from train_cat")
def _(spark, sf):
    train, _test = _cat(spark, sf)
    return labels.encode(train, labels.class_list(train), out="label_index").select(*_ROWC, "label_index")


@query("label_index_lookup", f"""with {B.SCORED_CTE}, names as (select unnest(range(7)) as i, unnest([{', '.join(
    f"'{c}'" for c in DEPLOYMENT_CLASSES)}]) as name) select event_id, cast(event_id % 9 as int) as class_index,
  coalesce(name, 'Class ' || (event_id % 9)) as class_name from scored left join names on i = event_id % 9""")
def _(spark, sf):
    index = (F.col("event_id") % 9).cast("int")
    return B.scored(spark, sf).select("event_id", index.alias("class_index"),
                                      labels.class_name(index, DEPLOYMENT_CLASSES).alias("class_name"))


# ---- duplicates and splits ----


@query("dedup_rows", f"with {B.FLOWS_CTE} select distinct f_qty, f_disc, f_tax, f_ratio from flows")
def _(spark, sf):
    return dedup.remove_duplicates(B.flows(spark, sf).select(*_KEY3, "f_ratio"))


@query("duplicate_count", f"""with {B.FLOWS_CTE}, t as (select f_qty, f_disc, f_tax, f_ratio from flows)
  select (select count(*) from t) as rows, (select count(*) from t) - (select count(*) from (select distinct * from t) d)
  as duplicates""")
def _(spark, sf):
    return dedup.duplicate_count(B.flows(spark, sf).select(*_KEY3, "f_ratio"))


_COMBINED = LABELLED_CTE + f""",
combined as (select *, 0 as split_rank from raw_train union all by name
  select * replace (coalesce({_map_sql(HARMONISE)}, Label) as Label), 1 as split_rank from test_known),
firsts as (select * from (select *, row_number() over (partition by f_qty, f_disc, f_tax
  order by split_rank, l_orderkey, l_linenumber, Label) as r from
  (select f_qty, f_disc, f_tax, l_orderkey, l_linenumber, Label, split_rank from combined) c) d where r = 1)"""
_FIRST = [*_KEY3, "l_orderkey", "l_linenumber", TARGET]


@query("combine_splits", f"with {_COMBINED} select split_rank, {_ROW} from combined")
def _(spark, sf):
    return dedup.combine_splits(*_raw(spark, sf)).select("split_rank", *_ROWC)


@query("dedup_features_keep_first", f"with {_COMBINED} select * exclude (r) from firsts")
def _(spark, sf):
    combined = dedup.combine_splits(*_raw(spark, sf)).select(*_FIRST, "split_rank")
    return dedup.keep_first(combined, _KEY3, ["split_rank", "l_orderkey", "l_linenumber"])


# Part of the training half has other quantities, so that some test tuples are unseen; nulls are matched.
_SHIFTED = "case when (l_orderkey + l_linenumber) % 3 = 0 then f_qty else f_qty + 50 end"
_SEEN = f""", tr as (select {_SHIFTED} as f_qty, f_disc, f_ratio, Label from raw_train),
te as (select f_qty, f_disc, f_ratio, l_orderkey, l_linenumber, Label from raw_test),
seen as (select distinct f_qty, f_disc, f_ratio from tr)"""
_MATCH = " and ".join(f"s.{c} is not distinct from t.{c}" for c in ("f_qty", "f_disc", "f_ratio"))
_SEENC = ["f_qty", "f_disc", "f_ratio"]


def _seen_pair(spark, sf):
    train = B.raw_train(spark, sf).withColumn("f_qty", F.expr(_SHIFTED)).select(*_SEENC, TARGET)
    return train, B.raw_test(spark, sf).select(*_SEENC, "l_orderkey", "l_linenumber", TARGET)


@query("cross_split_anti_join", f"with {B.SPLITS_CTE} {_SEEN} select t.* from te t where not exists "
                                f"(select 1 from seen s where {_MATCH})")
def _(spark, sf):
    return dedup.remove_seen_in_training(*_seen_pair(spark, sf))


@query("anti_join_report", f"with {B.SPLITS_CTE} {_SEEN} select count(*) as removed from te t where exists "
                           f"(select 1 from seen s where {_MATCH})")
def _(spark, sf):
    return dedup.seen_in_training(*_seen_pair(spark, sf)).agg(F.count(F.lit(1)).alias("removed"))


@query("union_sources_tagged", f"with {LABELLED_CTE} select _source, Label, count(*) as n, sum(f_qty) as qty from ("
       "select 'cicddos2019' as _source, Label, f_qty from train_cat union all "
       "select 'live_lab', Label, f_qty from test_cat) t group by _source, Label")
def _(spark, sf):
    train, test = _cat(spark, sf)
    return dedup.tag_sources(cicddos2019=train, live_lab=test).groupBy("_source", TARGET).agg(
        F.count(F.lit(1)).alias("n"), F.sum("f_qty").alias("qty"))


# ---- cleaning ----

_VALID = "case when isfinite(f_ratio) then f_ratio end"
_MED = "round(quantile_cont(%s, 0.5), 9)"


@query("invalid_to_null", f"with {B.FLOWS_CTE} select {_ROW}, {_VALID} as f_ratio, (select count(*) from flows "
                          "where isinf(f_ratio)) as infinite from flows")
def _(spark, sf):
    flows = B.flows(spark, sf)
    infinite = cleaning.count_infinite(flows).first()["infinite"]
    return cleaning.invalid_to_null(flows).select(*_ROWC, "f_ratio", F.lit(infinite).alias("infinite"))


_IMPUTED = ["f_qty", "f_price", "f_disc", "f_tax", "f_ratio"]


def _rounded(*cols, digits=9):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def _med_sql(source: str) -> str:
    return ", ".join(f"quantile_cont({_VALID if c == 'f_ratio' else c}, 0.5) as {c}" for c in _IMPUTED) + f" from {source}"


@query("impute_self_median", f"""with {B.FLOWS_CTE}, med as (select {_med_sql('flows')}) select l_orderkey, l_linenumber,
  f_price, Label, round(coalesce(case when isfinite(flows.f_ratio) then flows.f_ratio end,
  (select f_ratio from med)), 9) as f_ratio from flows""")
def _(spark, sf):
    return cleaning.impute_with_own_medians(B.flows(spark, sf)).select(*_ROWC, *_rounded("f_ratio"))


@query("fit_medians", f"with {B.SPLITS_CTE}, med as (select {_med_sql('raw_train')}) select "
                      + ", ".join(f"round({c}, 9) as {c}" for c in _IMPUTED) + " from med")
def _(spark, sf):
    med = cleaning.fit_medians(B.raw_train(spark, sf), _IMPUTED)
    one = spark.createDataFrame([tuple(med[c] for c in _IMPUTED)], ", ".join(f"{c} double" for c in _IMPUTED))
    return one.select(*_rounded(*_IMPUTED))


@query("apply_medians", f"""with {B.SPLITS_CTE}, med as (select {_med_sql('raw_train')}) select l_orderkey, l_linenumber,
  f_price, Label, round(coalesce(case when isfinite(t.f_ratio) then t.f_ratio end, (select f_ratio from med)), 9) as f_ratio
  from raw_test t""")
def _(spark, sf):
    train, test = _raw(spark, sf)
    return cleaning.apply_medians(test, cleaning.fit_medians(train, _IMPUTED)).select(*_ROWC, *_rounded("f_ratio"))


@query("impute_mode_categorical", """with t as (select event_id, case when event_id % 3 = 0 then null else event_type end
  as kind, case when event_id % 5 = 0 then null else cast(user_id % 40 as varchar) end as grp from events),
  mk as (select kind from t where kind is not null group by kind order by count(*) desc, kind limit 1),
  mg as (select grp from t where grp is not null group by grp order by count(*) desc, grp limit 1)
  select event_id, coalesce(kind, (select kind from mk)) as kind, coalesce(grp, (select grp from mg)) as grp from t""")
def _(spark, sf):
    ev = B.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 5 != 0, (F.col("user_id") % 40).cast("string")).alias("grp"))
    return cleaning.impute_most_frequent(ev, ["kind", "grp"])


# ---- profiling ----


@query("profile_shape", f"with {B.SPLITS_CTE} select 'train' as split, count(*) as rows, 10 as columns from raw_train "
                        "union all select 'test', count(*), 10 from raw_test")
def _(spark, sf):
    train, test = _raw(spark, sf)
    shape = [df.agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
             for s, df in (("train", train), ("test", test))]
    return shape[0].unionByName(shape[1])


@query("profile_label_distribution", f"with {B.FLOWS_CTE}, c as (select Label, count(*) as count from flows group by Label) "
                                     "select Label, count, count / (select sum(count) from c)::double * 100.0::double as percent from c")
def _(spark, sf):
    return profiling.label_distribution(B.flows(spark, sf))


_ALL = ["l_orderkey", "l_linenumber", *B.FEATURE_COLS, "Label", "split"]
_TYPES_SQL = " union all ".join(f"select typeof({c}) as ty, '{c}' as \"column\", count({c}) as cells from flows group by 1" for c in _ALL)


@query("profile_dtypes", f"""with {B.FLOWS_CTE}, t as ({_TYPES_SQL})
  select case ty when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' else 'string' end as dtype,
  count(*) as columns, sum(cells)::bigint as cells from t group by 1""")
def _(spark, sf):
    return profiling.dtype_counts(B.flows(spark, sf))


_CLS = ["l_linenumber", "f_qty", "f_price", "f_disc", "f_tax", "f_ratio", "f_const"]


@query("profile_column_classes", f"with {B.FLOWS_CTE}, d as (" + " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as n from flows" for c in _CLS) +
    ") select \"column\", case when n < 10 then 'categorical' else 'numerical' end as class from d "
    "union all select 'Label', 'categorical'")
def _(spark, sf):
    cat, num = profiling.column_classes(B.flows(spark, sf).select(*_CLS, TARGET))
    return spark.createDataFrame([(c, "categorical") for c in cat] + [(c, "numerical") for c in num],
                                 "column string, class string")


@query("select_dtypes_split", f"""with {B.FLOWS_CTE}, t as ({_TYPES_SQL})
  select "column", case when ty = 'VARCHAR' then 'categorical' else 'numeric' end as class, cells from t""")
def _(spark, sf):
    flows = B.flows(spark, sf)
    numeric = set(S.numeric_columns(flows))
    kinds = [F.struct(F.lit(c).alias("column"), F.lit("numeric" if c in numeric else "categorical").alias("class"),
                      F.count(S.col(c)).alias("cells")) for c in flows.columns]
    return flows.agg(F.array(*kinds).alias("k")).select(F.inline("k"))


@query("profile_missing", f"with {B.FLOWS_CTE} select count(*) as rows, sum(case when f_ratio is null or isnan(f_ratio) "
                          "then 1 else 0 end) as missing from flows")
def _(spark, sf):
    return profiling.missing_and_infinite(B.flows(spark, sf)).select("rows", "missing")


@query("profile_infinite", f"with {B.FLOWS_CTE} select count(*) as rows, count(*) filter (isinf(f_ratio)) as infinite from flows")
def _(spark, sf):
    return profiling.missing_and_infinite(B.flows(spark, sf)).select("rows", "infinite")


_SUMC = ["l_linenumber", "f_qty", "f_disc", "f_ratio", "f_const", TARGET]


def _summary_sql(split: str, source: str) -> str:
    cols = ", ".join(_SUMC)
    return f"""
  select '{split}' as split, 'rows' as metric, '' as item, count(*)::double as value from {source}
  union all select '{split}', 'columns', '', 6
  union all select '{split}', 'missing', '', count(*) from {source} where f_ratio is null
  union all select '{split}', 'infinite', '', count(*) from {source} where isinf(f_ratio)
  union all select '{split}', 'duplicates', '', (select count(*) from {source}) - (select count(*) from
    (select distinct {cols} from {source}) d)
  union all select '{split}', 'categorical_columns', '', 1 + (select {' + '.join(
      f"(case when count(distinct {c}) < 10 then 1 else 0 end)" for c in _SUMC[:-1])} from {source})
  union all select '{split}', 'numerical_columns', '', (select {' + '.join(
      f"(case when count(distinct {c}) < 10 then 0 else 1 end)" for c in _SUMC[:-1])} from {source})
  union all select '{split}', 'label_rows', Label, count(*) from {source} group by Label
  union all select '{split}', 'label_percent', Label, count(*) / (select count(*) from {source})::double * 100.0::double
    from {source} group by Label
  union all select '{split}', 'dtype_columns', 'int', 1 union all select '{split}', 'dtype_columns', 'double', 4
  union all select '{split}', 'dtype_columns', 'string', 1"""


@query("profile_summary", f"with {B.SPLITS_CTE} {_summary_sql('train', 'raw_train')} union all {_summary_sql('test', 'raw_test')}")
def _(spark, sf):
    train, test = _raw(spark, sf)
    return profiling.summary(train=train.select(*_SUMC), test=test.select(*_SUMC))


_CLASSES = sorted(set(CATEGORY.values()))


@query("class_distribution", f"with {LABELLED_CTE}, dim as (select unnest([{', '.join(repr(c) for c in _CLASSES)}]) as class) "
       + " union all ".join(f"""select '{s}' as split, class, count(t.Label) as count, count(t.Label) /
       greatest((select count(*) from {s}_cat), 1)::double * 100.0::double as percent from dim left join {s}_cat t
       on t.Label = class group by class""" for s in ("train", "test")))
def _(spark, sf):
    train, test = _cat(spark, sf)
    return (profiling.class_distribution(train, _CLASSES, "train")
            .unionByName(profiling.class_distribution(test, _CLASSES, "test")))


@query("imbalance_stats", f"""with {LABELLED_CTE}, c as (select count(*) as n from train_cat group by Label)
  select max(n) / min(n)::double as imbalance_ratio, max(n) / min(n)::double >= 3.0 or min(n) / sum(n)::double < 0.05
  as is_imbalanced from c""")
def _(spark, sf):
    return profiling.imbalance(_cat(spark, sf)[0])


@query("balanced_sample_weight", f"""with {LABELLED_CTE}, c as (select Label, count(*) as n from train_cat group by Label)
  select l_orderkey, l_linenumber, f_price, t.Label, (select sum(n) from c)::double / ((select count(*) from c) * n) as weight
  from train_cat t join c on c.Label = t.Label""")
def _(spark, sf):
    return profiling.with_balanced_weight(_cat(spark, sf)[0], TARGET).select(*_ROWC, "weight")


# ---- feature selection ----


@query("single_value_cols", f"with {B.FLOWS_CTE}, t as (select *, case when l_linenumber = 1 then 1.0 end as f_gap, "
       "cast(null as double) as f_void from flows) " + " union all ".join(
           f"select '{c}' as \"column\" from t having count(distinct {c}) = 1" for c in [*_FEAT, "f_gap", "f_void"]))
def _(spark, sf):
    df = _with_gaps(spark, sf)
    return spark.createDataFrame([(c,) for c in selection.single_value_columns(df, df.columns)], "column string")


def _with_gaps(spark, sf):
    return B.flows(spark, sf).select(*_FEAT, F.when(F.col("l_linenumber") == 1, F.lit(1.0)).alias("f_gap"),
                                     F.lit(None).cast("double").alias("f_void"))


@query("constant_cols", f"with {B.FLOWS_CTE}, t as (select *, case when l_linenumber = 1 then 1.0 end as f_gap, "
       "cast(null as double) as f_void from flows) " + " union all ".join(
           f"select '{c}' as \"column\" from t having count(distinct {c}) + max(case when {c} is null then 1 else 0 end) <= 1"
           for c in [*_FEAT, "f_gap", "f_void"]))
def _(spark, sf):
    df = _with_gaps(spark, sf)
    return spark.createDataFrame([(c,) for c in selection.constant_columns(df, df.columns)], "column string")


_CORR = ["f_qty", "f_price", "f_price2", "f_disc", "f_tax"]
_CORR_PAIRS = [(a, b) for j, b in enumerate(_CORR) for a in _CORR[:j]]


def _corr_sql(pairs) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, round(abs(corr({a}, {b})), 6) as r from raw_train"
                              for a, b in pairs)


@query("corr_matrix", f"with {B.SPLITS_CTE} {_corr_sql(_CORR_PAIRS)}")
def _(spark, sf):
    m = selection.correlation_matrix(B.raw_train(spark, sf), _CORR)
    return spark.createDataFrame([(a, b, float(m[_CORR.index(a), _CORR.index(b)])) for a, b in _CORR_PAIRS],
                                 "a string, b string, r double").withColumn("r", F.round("r", 6))


_PW = ["f_qty", "f_disc", "f_tax", "f_ratio", "f_const"]


@query("corr_matrix_pairwise", f"with {B.SPLITS_CTE}, v as (select f_qty, f_disc, f_tax, {_VALID} as f_ratio, f_const from raw_train) "
       + " union all ".join(f"select '{a}' as a, '{b}' as b, round(abs(corr({a}, {b})), 6) as r from v"
                            for j, b in enumerate(_PW[:4]) for a in _PW[:j])
       + "".join(f" union all select '{a}', 'f_const', null" for a in _PW[:4]))
def _(spark, sf):
    m = selection.pairwise_correlations(B.raw_train(spark, sf), _PW)
    rows = [(_PW[i], _PW[j], None if m[i, j] != m[i, j] else float(m[i, j])) for j in range(len(_PW)) for i in range(j)]
    return spark.createDataFrame(rows, "a string, b string, r double").withColumn("r", F.round("r", 6))


@query("high_corr_cols", f"with {B.SPLITS_CTE} select distinct b as \"column\" from ({_corr_sql(_CORR_PAIRS)}) c where r > 0.8")
def _(spark, sf):
    cols = selection.correlated_columns(B.raw_train(spark, sf), _CORR, 0.8)
    return spark.createDataFrame([(c,) for c in cols], "column string")


_DROPPED = ["f_price2", "f_const", "not_there"]


@query("drop_columns_apply", f"with {B.SPLITS_CTE} select * exclude (f_price2, f_const) from raw_test")
def _(spark, sf):
    return selection.drop_columns(B.raw_test(spark, sf), _DROPPED)


def _leaky(spark, sf):
    return B.flows(spark, sf).select("*", F.col("l_orderkey").alias("Flow ID"), F.col("f_qty").alias("Src_IP"),
                                     F.col("f_qty").alias("transport"), F.col("f_qty").alias("Fwd Seg"))


@query("leakage_columns", f"with {B.FLOWS_CTE} select * exclude (Label), f_qty as \"Fwd Seg\" from flows")
def _(spark, sf):
    """The rows without the columns that would leak: the label, Flow ID, Src_IP and transport."""
    df = _leaky(spark, sf)
    return selection.drop_columns(df, selection.leakage_columns(df.columns))


@query("group_column_infer", "select 'Flow ID' as \"column\", count(distinct l_orderkey) as groups from lineitem")
def _(spark, sf):
    df = _leaky(spark, sf).select(F.lit(1).alias("session"), "f_qty", "Flow ID", "Src_IP")
    name = selection.group_column(df)
    return df.agg(F.lit(name).alias("column"), F.countDistinct(F.col(f"`{name}`")).alias("groups"))


@query("dropped_report", "select 'leakage' as reason, 'Label' as \"column\" union all select 'constant', 'f_const' "
                         "union all select 'high_correlation', 'f_price2'")
def _(spark, sf):
    train = B.raw_train(spark, sf).select(*_FEAT, TARGET)
    return selection.dropped_report(spark, {
        "leakage": selection.leakage_columns(train.columns),
        "constant": selection.constant_columns(train, _FEAT),
        "high_correlation": selection.correlated_columns(train, _CORR, 0.9)})


# ---- sampling: rows are scored events, whose id is unique; classes are their predictions ----

_SMALL = TrainingConfig(max_group_rows=500, min_attack_class_rows=160, cv_folds=5)


def _hash_sql(seed: int, *keys: str) -> str:
    return "md5('" + str(seed) + "|' || " + " || '|' || ".join(f"cast({k} as varchar)" for k in keys) + ")"


def quota_sql(source: str, label: str, fraction: str) -> str:
    """Hold-out rows per class by largest remainder of the training share."""
    return f"""class_n as (select {label} as cls, count(*) as n from {source} group by {label}),
  tot as (select sum(n)::bigint as total, (sum(n) - ceil(sum(n) * {fraction}))::bigint as n_train from class_n),
  share as (select cls, n, n_train * n // total as base, n_train * n % total as rem, n_train,
    row_number() over (order by n_train * n % total desc, cls) as r from class_n, tot),
  quota as (select cls, n - base - case when r <= n_train - (select sum(base) from share) then 1 else 0 end as held
    from share)"""


@query("stratified_split", f"""with {B.SCORED_CTE}, {quota_sql('scored', 'prediction', '0.2')}, h as (select event_id,
  prediction, row_number() over (partition by prediction order by {_hash_sql(42, 'event_id')}) as r from scored)
  select event_id, prediction, r <= held as held_out from h join quota on cls = prediction""")
def _(spark, sf):
    df = B.scored(spark, sf).select("event_id", "prediction")
    return sampling.mark_holdout(df, "prediction", 0.2, ["event_id"])


# Quantities are whole and discounts and taxes are hundredths, so both engines print the same integers for the hash.
_INTS = ["f_qty", "f_disc", "f_tax"]


@query("combine_resplit", f"""with {_COMBINED}, firsts_i as (select cast(round(f_qty) as bigint) as f_qty,
  cast(round(f_disc * 100) as bigint) as f_disc, cast(round(f_tax * 100) as bigint) as f_tax, Label, split_rank,
  l_orderkey, l_linenumber from firsts), {quota_sql('firsts', 'Label', '0.2')}, h as (select *,
  row_number() over (partition by Label order by {_hash_sql(42, *_INTS)}) as r from firsts_i)
  select h.* exclude (r), r <= held as held_out from h join quota on cls = Label""")
def _(spark, sf):
    def whole(df):
        return df.select(F.round("f_qty").cast("long").alias("f_qty"), F.round(F.col("f_disc") * 100).cast("long").alias("f_disc"),
                         F.round(F.col("f_tax") * 100).cast("long").alias("f_tax"), "l_orderkey", "l_linenumber", TARGET)

    train, test = _raw(spark, sf)
    return sampling.combine_resplit(whole(train), whole(test), _INTS, ["l_orderkey", "l_linenumber"])


def _cap_sql(cap: int) -> str:
    return f"""with {B.SCORED_CTE}, h as (select event_id, prediction, row_number() over (partition by prediction
  order by {_hash_sql(42, 'event_id')}) as r from scored) select event_id, prediction from h where r <= {cap}"""


@query("sample_per_class", _cap_sql(300))
def _(spark, sf):
    return sampling.sample_per_class(B.scored(spark, sf).select("event_id", "prediction"), "prediction", 300, ["event_id"])


@query("undersample_cap", f"with {B.SCORED_CTE} select prediction, least(count(*), 250) as keep from scored group by prediction")
def _(spark, sf):
    df = B.scored(spark, sf)
    counts = {r[0]: r[1] for r in df.groupBy("prediction").count().collect()}
    return spark.createDataFrame(list(sampling.capped_counts(counts, 250).items()), "prediction string, keep long")


# Benign is kept to 500 rows and attacks share 500. The shares follow the stated rule, written out for
# three attack classes: equal parts first, then the rest in one round by spare rows, largest first.
_QUOTAS = """cnt as (select prediction as cls, count(*) as n from scored group by prediction),
  bt as (select least(n, 500) as benign from cnt where cls = 'Benign'),
  tot as (select least((select sum(n) from cnt where cls <> 'Benign'), benign, 500)::bigint as total from bt),
  base as (select cls, n, least(n, greatest(1, total // 3)) as q, total from cnt, tot where cls <> 'Benign'),
  spare as (select *, n - q as room, total - sum(q) over () as missing, sum(n - q) over () as whole from base),
  step as (select *, least(greatest(1, round_even(missing * room / whole::double, 0)), room)::bigint as give,
    row_number() over (order by room desc, cls) as k from spare where room > 0),
  gave as (select cls, q + greatest(0, least(give, missing - coalesce(sum(give) over (order by k
    rows between unbounded preceding and 1 preceding), 0)))::bigint as quota from step
    union all select cls, q from spare where room = 0),
  quotas as (select 'Benign' as cls, benign as quota from bt union all select * from gave)"""


@query("attack_quota_allocation", f"with {B.SCORED_CTE}, {_QUOTAS} select cls as class, quota from quotas")
def _(spark, sf):
    counts = {r[0]: r[1] for r in B.scored(spark, sf).groupBy("prediction").count().collect()}
    return spark.createDataFrame(list(sampling.balance_quotas(counts, _SMALL).items()), "class string, quota long")


_BALANCED = f"""{B.SCORED_CTE}, {_QUOTAS}, h as (select event_id, prediction, row_number() over (partition by prediction
  order by {_hash_sql(42, 'event_id')}) as r from scored), cut as (select event_id, prediction from h join quotas
  on cls = prediction where r <= quota)"""


def _events_by_class(spark, sf):
    return B.scored(spark, sf).select("event_id", "prediction")


@query("balance_binary", f"with {_BALANCED} select * from cut")
def _(spark, sf):
    return sampling.balance_binary(_events_by_class(spark, sf), "prediction", ["event_id"], _SMALL)


@query("oversample_rare", f"""with {_BALANCED}, n as (select prediction as cls, count(*) as n from cut
  where prediction <> 'Benign' group by prediction having count(*) < 180), draws as (select cls, n, unnest(range(1, 181 - n)) as d from n),
  picks as (select cls, cast('0x' || substr(md5('42|' || cls || '|' || d), 1, 8) as bigint) % n + 1 as pick from draws),
  ranked as (select *, row_number() over (partition by prediction order by {_hash_sql(42, 'event_id')}) as r from cut)
  select event_id, prediction from cut union all select event_id, prediction from ranked join picks on cls = prediction and r = pick""")
def _(spark, sf):
    cut = sampling.balance_binary(_events_by_class(spark, sf), "prediction", ["event_id"], _SMALL)
    return sampling.oversample_rare(cut, "prediction", ["event_id"], 180)


@query("balance_report", f"""with {_BALANCED}, over as (select prediction, greatest(count(*), case when prediction = 'Benign'
  then 0 else 160 end) as n from cut group by prediction), bef as (select prediction, count(*) as n from scored group by prediction),
  s as (select (select sum(n) from bef) as rb, (select sum(n) from over) as ra,
    (select sum(n) from bef where prediction = 'Benign') as bb, (select sum(n) from over where prediction = 'Benign') as ba)
  select 'train_before_balance' as split, prediction as item, n::double as value, n / (select rb from s)::double * 100.0::double as percent from bef
  union all select 'train_after_balance', prediction, n, n / (select ra from s)::double * 100.0::double from over
  union all select 'summary', 'rows_before', rb, null from s union all select 'summary', 'rows_after', ra, null from s
  union all select 'summary', 'benign_before', bb, null from s union all select 'summary', 'attack_before', rb - bb, null from s
  union all select 'summary', 'benign_after', ba, null from s union all select 'summary', 'attack_after', ra - ba, null from s
  union all select 'summary', 'attack_to_benign_ratio_after', (ra - ba)::double / greatest(ba, 1), null from s
  union all select 'summary', 'rare_classes_oversampled', (select count(*) from (select 1 from cut where prediction <> 'Benign'
    group by prediction having count(*) < 160) z)::double, null""")
def _(spark, sf):
    df = _events_by_class(spark, sf)
    after = sampling.balance_training(df, "prediction", ["event_id"], _SMALL)
    return sampling.balance_report(df, after, labels.class_list(df, "prediction"), "prediction", _SMALL)


@query("kfold_stratified", f"""with {B.SCORED_CTE} select event_id, prediction, cast((row_number() over (partition by prediction
  order by {_hash_sql(42, 'event_id')}) - 1) % 5 as int) as fold from scored""")
def _(spark, sf):
    return sampling.stratified_folds(_events_by_class(spark, sf), "prediction", ["event_id"], 5)


@query("kfold_stratified_group", f"""with {B.SCORED_CTE}, cells as (select src_ip, prediction, count(*) as n from scored group by all),
  g as (select src_ip, sum(n) as size, arg_min(prediction, (-n, prediction)) as cls from cells group by src_ip),
  r as (select src_ip, (row_number() over (partition by cls order by size desc, {_hash_sql(42, "src_ip")}, src_ip) - 1) % 10 as place from g)
  select event_id, src_ip, prediction, cast(case when place < 5 then place else 9 - place end as int) as fold
  from scored join r using (src_ip)""")
def _(spark, sf):
    return sampling.group_folds(B.scored(spark, sf).select("event_id", "src_ip", "prediction"), "prediction", "src_ip", 5)


@query("kfold_group_whole", f"""with {B.SCORED_CTE} select src_ip, 1 as folds, count(*) as rows, true as fold_in_range
  from scored group by src_ip""")
def _(spark, sf):
    """Whole groups: every source is in exactly one of the five folds."""
    folds = sampling.group_folds(B.scored(spark, sf).select("event_id", "src_ip", "prediction"), "prediction", "src_ip", 5)
    return folds.groupBy("src_ip").agg(F.countDistinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"),
                                       F.max("fold").between(0, 4).alias("fold_in_range"))


@query("shuffle_rows", f"with {B.SCORED_CTE} select event_id, prediction from scored")
def _(spark, sf):
    return sampling.shuffle_rows(_events_by_class(spark, sf), ["event_id"])
