"""Scans, sinks, extractor rows, scaling and encoding."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice import workdir
from sluice.functions.scalars import col
from sluice.operators import cleaning, encoding, features as FE, flows as FL, metrics, vocabulary
from sluice.plans import bindings as B
from sluice.plans.detect_queries import EVENTS_CTE, events
from sluice.plans.flow_queries import FLOW, FSQL
from sluice.plans.registry import query
from sluice.plans.table_queries import LABELLED_CTE, _cat, _map_sql
from sluice.schemas import (CATEGORY, DEPLOYMENT_CLASSES, EVENT_FIELDS, EXTRACTOR_COLUMNS, FEATURES, LEGACY_EVENT_FIELDS,
                            TARGET, TIME_FEATURES)
from sluice.sources import datasets, eventlog

_staged: dict[tuple, str] = {}


def _stage(spark: SparkSession, sf: str, name: str, write) -> str:
    """A folder written once per application and data set from the given tables."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        path = workdir.new_path(spark, name)
        write(path)
        _staged[key] = path
    return _staged[key]


# ---- labelled files: families by label, not all of them in both splits ----

_FAMILY = "replace(Label, '-', '')"
# One label of each half bears another's name, so that its family is in the other half only.
_MOVED = ("case when split = 'training' and Label = 'UDP-lag' or split = 'testing' and Label = 'NetBIOS' then 'Syn' "
          "else Label end")
_FILES_CTE = B.FLOWS_CTE + f""", moved as (select * replace ({_MOVED} as Label) from flows),
files as (select *, {_FAMILY} as family from moved),
common as (select * from files where family in (select family from files group by family having count(distinct split) = 2))"""


def _dataset(spark, sf):
    def write(path):
        named = B.flows(spark, sf).withColumn(TARGET, F.expr(_MOVED)).withColumn(
            "file", F.expr(f"concat({_FAMILY}, '-', split, '.parquet')"))
        # The training files have no f_const and the testing files no f_price2.
        for split, absent in (("training", "f_const"), ("testing", "f_price2")):
            named.where(F.col("split") == split).drop("split", absent).write.mode("append").partitionBy("file").parquet(path)

    return _stage(spark, sf, "labelled", write)


@query("scan_split_files", f"with {_FILES_CTE} select distinct family || '-' || split || '.parquet' as file_name, family, split from files")
def _(spark, sf):
    return datasets.split_units(spark, _dataset(spark, sf)).drop("path")


@query("scan_common_families", f"with {_FILES_CTE} select distinct family, split from common")
def _(spark, sf):
    return datasets.common_families(datasets.split_units(spark, _dataset(spark, sf))).select("family", "split")


_SCAN = "l_orderkey, l_linenumber, f_qty, f_price, Label"
_SCANC = _SCAN.split(", ")


@query("scan_union", f"with {_FILES_CTE} select {_SCAN}, case when split = 'training' then f_price2 end as f_price2, "
                     "case when split = 'testing' then f_const end as f_const from files")
def _(spark, sf):
    units = datasets.split_units(spark, _dataset(spark, sf))
    return datasets.read_units(units).select(*_SCANC, "f_price2", "f_const")


@query("scan_dataset", f"with {_FILES_CTE} select split, {_SCAN} from common")
def _(spark, sf):
    train, test = datasets.load_dataset(spark, _dataset(spark, sf))
    return (train.select(F.lit("training").alias("split"), *_SCANC)
            .unionByName(test.select(F.lit("testing").alias("split"), *_SCANC)))


# ---- files with the 77 features, labelled by service port ----

FEATURE_LABEL = """case when first_ts % 17 = 0 then 'Portmap' when src_port in (80, 443) or dst_port in (80, 443) then 'Benign'
  when src_port = 53 or dst_port = 53 then 'UDP' when src_port = 389 or dst_port = 389 then 'LDAP' else 'MSSQL' end"""


def labelled_features(spark, sf) -> DataFrame:
    """The 77 features of every flow with a label and the flow's identity."""
    flows = FL.aggregate_flows(B.packets(spark, sf), B.FLOW).withColumn(TARGET, F.expr(FEATURE_LABEL))
    ident = ["src_ip", "dst_ip", "src_port", "dst_port", "first_ts"]
    return FE.flow_features(flows, [*ident, TARGET])


def _staged_features(spark, sf) -> DataFrame:
    """The same, put together from the packets once for all that read them."""
    return spark.read.parquet(_stage(spark, sf, "labelled-features", lambda p: labelled_features(spark, sf).write.parquet(p)))


def _feature_files(spark, sf):
    def write(path):
        rows = _staged_features(spark, sf)
        for family in ("Benign", "UDP", "LDAP", "MSSQL", "Portmap"):
            rows.where(F.col(TARGET) == family).write.parquet(f"{path}/{family}-training.parquet")
        rows.drop("Flow Duration").write.parquet(f"{path}/Short-training.parquet")
        rows.drop(TARGET).write.parquet(f"{path}/Unlabelled-training.parquet")

    return _stage(spark, sf, "features", write)


_LABELLED = f"{FLOW}, lf as (select *, {FEATURE_LABEL} as raw_label from flow), lc as (select *, {_map_sql(CATEGORY, 'raw_label')} as Label from lf)"
_DEP = ", ".join(f"'{c}'" for c in DEPLOYMENT_CLASSES)


@query("scan_deployment_sample_src", f"with {_LABELLED} select Label, count(*) as n, sum(fwd_n)::double as fwd, sum(bwd_bytes)::double as bytes "
                                     f"from lc where Label in ({_DEP}) group by Label")
def _(spark, sf):
    rows = datasets.deployment_rows(spark, _feature_files(spark, sf))
    return rows.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"), F.sum(col("Total Fwd Packets")).alias("fwd"),
                                    F.sum(col("Bwd Packets Length Total")).alias("bytes"))


# ---- extractor rows: text columns under the extractor's names, times in seconds ----

_SNAKE = {v: k for k, v in EXTRACTOR_COLUMNS.items()}


def extractor_rows(spark, sf) -> DataFrame:
    """Flows as the extractor writes them, with its dirt: padded headers, bad text, infinities."""
    rows = labelled_features(spark, sf)

    def text(name: str) -> F.Column:
        value = col(name) / 1e6 if name in TIME_FEATURES else col(name)
        out = value.cast("string")
        if name == "Flow Bytes/s":
            out = F.when(F.col("first_ts") % 5 == 0, "inf").when(F.col("first_ts") % 7 == 0, "bad").otherwise(out)
        return out

    absent = {"Flow Packets/s"}
    cols = [text(n).alias(f" {_SNAKE[n]} " if n == "Fwd Header Length" else _SNAKE[n])
            for n in FEATURES if n in _SNAKE and n not in absent]
    ident = [F.col(c).cast("string").alias(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "first_ts")]
    return rows.select(*ident, *cols, TARGET)


def _norm_sql(name: str) -> str:
    if name not in _SNAKE or name == "Flow Packets/s":
        return "0.0::double"
    value = f"({FSQL[name]})"
    if name == "Flow Bytes/s":
        return f"case when first_ts % 5 = 0 or first_ts % 7 = 0 then null else {value} end"
    return f"({value} / 1e6::double) * 1e6::double" if name in TIME_FEATURES else value


_NORM = ", ".join(f'{_norm_sql(n)} as "{n}"' for n in FEATURES)
_ID = "src_ip, dst_ip, cast(src_port as varchar) as src_port, cast(dst_port as varchar) as dst_port, cast(first_ts as varchar) as first_ts"
_IDC = ["src_ip", "dst_ip", "src_port", "dst_port", "first_ts"]


def _normalised(spark, sf, names):
    out = cleaning.normalise_flow_rows(extractor_rows(spark, sf))
    return out.select(*[F.col(f"raw.{c}").alias(c) for c in _IDC], *[col(n) for n in names])


@query("normalize_flow_rows", f"with {FLOW} select {_ID}, {_NORM} from flow")
def _(spark, sf):
    return _normalised(spark, sf, FEATURES)


@query("numeric_coerce", f'with {FLOW} select {_ID}, {_norm_sql("Flow Bytes/s")} as "Flow Bytes/s" from flow')
def _(spark, sf):
    return _normalised(spark, sf, ["Flow Bytes/s"])


@query("seconds_to_micros", f"with {FLOW} select {_ID}, " + ", ".join(f'{_norm_sql(n)} as "{n}"' for n in TIME_FEATURES) + " from flow")
def _(spark, sf):
    return _normalised(spark, sf, TIME_FEATURES)


_STRIP = ["Fwd Header Length", "Total Fwd Packets", "Init Fwd Win Bytes"]


@query("column_strip_rename", f"with {FLOW} select {_ID}, " + ", ".join(f'cast({FSQL[n]} as bigint) as "{n}"' for n in _STRIP) + " from flow")
def _(spark, sf):
    renamed = cleaning.strip_and_rename(extractor_rows(spark, sf))
    return renamed.select(*_IDC, *[col(n).cast("double").cast("long").alias(n) for n in _STRIP])


@query("conform_schema", f"with {FLOW} select " + ", ".join(
    f'round(sum({_norm_sql(n) if n not in TIME_FEATURES else FSQL[n]}) / count(*), 3) as "{n}"' for n in (
        "Protocol", "Total Fwd Packets", "Flow Packets/s", "Bwd Avg Bulk Rate", "Fwd Header Length")) + ", 77 as columns from flow")
def _(spark, sf):
    full = cleaning.conform(cleaning.strip_and_rename(extractor_rows(spark, sf)))
    names = ("Protocol", "Total Fwd Packets", "Flow Packets/s", "Bwd Avg Bulk Rate", "Fwd Header Length")
    return full.agg(*[F.round(F.sum(col(n).cast("double")) / F.count(F.lit(1)), 3).alias(n) for n in names],
                    F.lit(len(full.columns)).alias("columns"))


@query("batch_flow_stats", f'with {FLOW}, t as (select {_NORM} from flow) select count(*) as rows, sum("SYN Flag Count") as syn_flags_total, '
                           'round(avg("Flow Duration"), 3) as flow_duration_mean_us from t')
def _(spark, sf):
    stats = cleaning.batch_stats(_normalised(spark, sf, ["SYN Flag Count", "Flow Duration"]))
    return stats.withColumn("flow_duration_mean_us", F.round("flow_duration_mean_us", 3))


def _csv_folder(spark, sf):
    return _stage(spark, sf, "extractor-csv", lambda p: extractor_rows(spark, sf).write.option("header", True).csv(p))


@query("scan_flow_csv", f"with {FLOW} select {_ID}, {_NORM} from flow")
def _(spark, sf):
    out = cleaning.normalise_flow_rows(datasets.flow_csv(spark, _csv_folder(spark, sf)))
    return out.select(*[F.col(f"raw.{c}").alias(c) for c in _IDC], *[col(n) for n in FEATURES])


def _labelled_csv(spark, sf):
    def write(path):
        rows = labelled_features(spark, sf).withColumn(TARGET, F.expr(_map_sql(CATEGORY)))
        rows.withColumn(TARGET, F.when(F.col("first_ts") % 13 != 0, F.col(TARGET))).write.option("header", True).csv(path)

    return _stage(spark, sf, "labelled-csv", write)


@query("scan_labelled_live", f"with {_LABELLED} select Label, " + ", ".join(f'{FSQL[n]} as "{n}"' for n in FEATURES) +
       f" from lc where first_ts % 13 <> 0 and Label in ({_DEP})")
def _(spark, sf):
    return datasets.labelled_csv(spark, _labelled_csv(spark, sf))


@query("sink_labelled_append", f"with {_LABELLED} select Label, count(*) as n, sum(fwd_n)::double as fwd from lc where Label is not null "
                               "group by Label")
def _(spark, sf):
    rows = labelled_features(spark, sf)
    path = workdir.new_path(spark, "collected")
    for raw in [r[0] for r in rows.select(TARGET).distinct().collect() if r[0] in CATEGORY]:
        datasets.append_labelled(rows.where(F.col(TARGET) == raw).drop(TARGET), CATEGORY[raw], path)
    return spark.read.parquet(path).groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum(col("Total Fwd Packets")).alias("fwd"))


@query("sink_last_batch_snapshots", f'with {FLOW} select \'features\' as part, count(*) as rows, 77 as columns from flow union all '
                                    f"select 'raw', count(*), {4 + len(_SNAKE)} from flow")
def _(spark, sf):
    batch = cleaning.normalise_flow_rows(datasets.flow_csv(spark, _csv_folder(spark, sf)))
    folder = workdir.new_path(spark, "snapshots")
    for _again in range(2):
        eventlog.snapshot_batch(batch.select(*[col(f) for f in FEATURES]), batch.select("raw.*"), folder)
    parts = [spark.read.parquet(f"{folder}/last_{p}") for p in ("features", "raw")]
    return parts[0].agg(F.lit("features").alias("part"), F.count(F.lit(1)).alias("rows"), F.lit(len(parts[0].columns)).alias("columns")).unionByName(
        parts[1].agg(F.lit("raw").alias("part"), F.count(F.lit(1)).alias("rows"), F.lit(len(parts[1].columns)).alias("columns")))


# ---- event log ----

_LOG = "event_id, src_ip, dst_ip, prediction, confidence, is_attack, blocked, source"


def _log_rows(spark, sf):
    ev = events(spark, sf)
    return ev.select("*", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                     F.col("event_id").alias("model"))


@query("sink_events_append", f"with {EVENTS_CTE} select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, cast(event_id as varchar) as model, "
                             "src_ip, dst_ip, prediction, cast(is_attack as varchar) as is_attack, cast(blocked as varchar) as blocked, "
                             "nullif(source, '') as source from ev")
def _(spark, sf):
    path = workdir.new_path(spark, "events")
    rows = _log_rows(spark, sf)
    eventlog.append_events(rows.where("event_id % 2 = 0"), path)
    eventlog.append_events(rows.where("event_id % 2 = 1"), path)
    return eventlog.read_events(spark, path).select("timestamp", "model", "src_ip", "dst_ip", "prediction", "is_attack", "blocked", "source")


@query("scan_event_log", f"""with {EVENTS_CTE} select 'current' as form, cast(event_id as varchar) as model, src_ip, 0 as has_ports from ev
  union all select 'legacy', cast(event_id as varchar), src_ip, 0 from ev""")
def _(spark, sf):
    rows = _log_rows(spark, sf)
    current, legacy, missing = (workdir.new_path(spark, f"log-{n}") for n in ("current", "legacy", "missing"))
    eventlog.append_events(rows, current)
    rows.select(*[F.col(f).cast("string").alias(f) if f in rows.columns else F.lit("x").alias(f) for f in LEGACY_EVENT_FIELDS]).write.option(
        "header", True).csv(legacy)
    read = [eventlog.read_events(spark, p).select(F.lit(form).alias("form"), "model", "src_ip", F.coalesce(
        F.length("dst_ports"), F.lit(0)).alias("has_ports")) for form, p in (("current", current), ("legacy", legacy), ("none", missing))]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("sink_schema_guard", f"with {EVENTS_CTE} select 'current' as log, true as kept, count(*) as rows from ev union all select 'legacy', false, 0")
def _(spark, sf):
    rows = _log_rows(spark, sf)
    current, legacy = (workdir.new_path(spark, f"guard-{n}") for n in ("current", "legacy"))
    eventlog.append_events(rows, current)
    rows.select(*[F.lit("x").alias(f) for f in LEGACY_EVENT_FIELDS]).write.option("header", True).csv(legacy)
    out = []
    for name, path in (("current", current), ("legacy", legacy)):
        kept = eventlog.ensure_log(spark, path)
        out.append(eventlog.read_events(spark, path).agg(F.lit(name).alias("log"), F.lit(kept).alias("kept"), F.count(F.lit(1)).alias("rows")))
    return out[0].unionByName(out[1])


@query("sink_reset", f"with {EVENTS_CTE} select 'before' as state, count(*) as rows, {len(EVENT_FIELDS)} as fields from ev union all "
                     f"select 'after', 0, {len(EVENT_FIELDS)}")
def _(spark, sf):
    path = workdir.new_path(spark, "log-reset")
    eventlog.append_events(_log_rows(spark, sf), path)
    before = spark.read.option("header", True).csv(path).count()
    eventlog.reset_log(spark, path)
    after = spark.read.option("header", True).csv(path)
    return spark.createDataFrame([("before", before, len(EVENT_FIELDS)), ("after", after.count(), len(after.columns))],
                                 "state string, rows long, fields long")


@query("sink_metric_tables", f"with {EVENTS_CTE} select prediction, count(*) as n from ev group by prediction")
def _(spark, sf):
    table = events(spark, sf).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    path = eventlog.write_metric_table(table, workdir.new_path(spark, "tables"), "class_distribution")
    return spark.read.schema("prediction string, n long").option("header", True).csv(path)


# ---- scaling and encoding ----

_SC = ["f_qty", "f_price", "f_disc", "f_const"]
_ROUND = "round(%s, 9)"


@query("scale_minmax", f"with {B.SPLITS_CTE}, r as (select " + ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _SC) +
       " from raw_train) select l_orderkey, l_linenumber, " + ", ".join(
           f"round((t.{c} - lo_{c}) / case when hi_{c} > lo_{c} then hi_{c} - lo_{c} else 1 end, 9) as {c}" for c in _SC) + " from raw_test t, r")
def _(spark, sf):
    train, test = B.raw_train(spark, sf), B.raw_test(spark, sf)
    out = encoding.apply_minmax(test.select("l_orderkey", "l_linenumber", *_SC), encoding.fit_minmax(train, _SC))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in _SC])


# Categories are learned with one event type under another's name, which then is unknown.
@query("encode_onehot", "select event_id, " + ", ".join(
    f"case when event_type = '{t}' then 1.0::double else 0.0::double end as \"event_type_{t}\"" for t in ("click", "error", "signup", "view")) + " from events")
def _(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", "event_type")
    known = encoding.fit_categories(ev.withColumn("event_type", F.expr(
        "case when event_type in ('click', 'error', 'signup') then event_type else 'view' end")), ["event_type"])
    return ev.select("event_id", *[c.alias(n) for n, c in encoding.onehot_columns(known).items()])


_WIDE = ("l_orderkey", "l_partkey")


@query("encode_onehot_wide", " union all ".join(f"""select '{c}' as field, v as value, row_number() over (order by v) - 1 as position, n::double as rows
  from (select cast({c} as varchar) as v, count(*) as n from lineitem where {c} is not null group by 1) t""" for c in _WIDE))
def _(spark, sf):
    """Keys as categories, more than expressions could hold: the sum of all vectors has the rows of each value in its slot."""
    lines = B.table(spark, sf, "lineitem").select(*_WIDE)
    known = vocabulary.fit(lines, _WIDE)
    vectors = vocabulary.onehot_vector(lines, _WIDE, known)
    slots = vocabulary.slot_sums(vectors).select("slot", F.col("sum").alias("rows"))
    first = vocabulary.sizes(known)[_WIDE[0]]
    slot = F.col("position") + F.when(F.col("column") == _WIDE[1], first).otherwise(0)
    return known.withColumn("slot", slot).join(slots, "slot").select(F.col("column").alias("field"), "value", "position", "rows")


def _mixed(df):
    """Features with every kind of column the preprocessor handles."""
    return df.select("l_orderkey", "l_linenumber", *B.FEATURE_COLS, F.col("f_qty").alias("Src Port"),
                     F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("k"), F.col("l_linenumber").cast("string"))).alias("kind"), TARGET)


_IGNORE = ["l_orderkey", "l_linenumber", TARGET]


def _preprocessor(spark, sf):
    return encoding.FlowPreprocessor(ignoreCols=_IGNORE).fit(_mixed(B.raw_train(spark, sf)))


@query("feature_names_out", "select unnest(['f_qty', 'f_price', 'f_disc', 'f_tax', 'f_ratio', 'kind_k1', 'kind_k2', 'kind_k4', "
                            "'kind_k5', 'kind_k7']) as name")
def _(spark, sf):
    return spark.createDataFrame([(n,) for n in _preprocessor(spark, sf).feature_names()], "name string")


_PNUM = ["f_qty", "f_price", "f_disc", "f_tax", "f_ratio"]
_PVAL = {c: "case when isfinite(f_ratio) then f_ratio end" if c == "f_ratio" else c for c in _PNUM}
_KIND = "case when l_linenumber % 3 <> 0 then 'k' || l_linenumber end"


@query("preprocess_fit_transform", f"""with {B.SPLITS_CTE}, m as (select {', '.join(
    f'quantile_cont({_PVAL[c]}, 0.5) as m_{c}, min({_PVAL[c]}) as lo_{c}, max({_PVAL[c]}) as hi_{c}' for c in _PNUM)} from raw_train),
  k as (select {_KIND} as mode from raw_train where l_linenumber % 3 <> 0 group by 1 order by count(*) desc, 1 limit 1),
  t as (select *, coalesce({_KIND}, (select mode from k)) as kind from raw_test)
  select l_orderkey, l_linenumber, {', '.join(f"round((coalesce({_PVAL[c]}, m_{c}) - lo_{c}) / (hi_{c} - lo_{c}), 9) as {c}" for c in _PNUM)},
  {', '.join(f"case when kind = 'k{i}' then 1.0::double else 0.0::double end as kind_k{i}" for i in (1, 2, 4, 5, 7))} from t, m""")
def _(spark, sf):
    model = _preprocessor(spark, sf)
    out = model.transform(_mixed(B.raw_test(spark, sf))).select("l_orderkey", "l_linenumber", vector_to_array("features").alias("v"))
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col("v")[i], 9).alias(n) for i, n in enumerate(model.feature_names())])


@query("preprocess_static", f"with {LABELLED_CTE}, a as (select 'fit' as part, Label, count(*) as n from (select distinct f_qty, f_price, "
       "f_price2, f_disc, f_tax, f_ratio, f_const, l_orderkey, l_linenumber, Label from train_cat) x group by Label union all "
       "select 'test', Label, count(*) from (select distinct f_qty, f_price, f_price2, f_disc, f_tax, f_ratio, f_const, l_orderkey, "
       "l_linenumber, Label from test_cat) x group by Label) select part, Label, n, 'f_qty,f_price,f_disc,f_tax,f_ratio' as features from a")
def _(spark, sf):
    r = encoding.preprocess_static(B.raw_train(spark, sf), B.raw_test(spark, sf), ["l_orderkey", "l_linenumber"], B.FEATURE_COLS)
    report = encoding.static_report(r).withColumn("part", F.when(F.col("part") == "test", "test").otherwise("fit"))
    return report.groupBy("part", TARGET).agg(F.sum("count").alias("n")).withColumn("features", F.lit(",".join(r["feature_names"])))
