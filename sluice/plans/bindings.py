"""Views over the given tables that stand in for packets, labelled flows and scored events.

Each view exists as a DataFrame here and as text for the SQL check (``*_CTE``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.schemas import HARMONISE, FlowParams

# Test data spreads its events over 30 days, so flows are given hours instead of seconds.
FLOW = FlowParams(timeout=6 * 3600.0, min_duration=3600.0, min_packets=3, tick=1800.0, slice_seconds=24 * 3600.0)
FLOW_TIMEOUT_US = FlowParams.micros(FLOW.timeout)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PACKETS = """
select event_id as pkt_id, cast(ts as timestamp) as ts,
 case when rev then b_ip else a_ip end as src_ip, case when rev then a_ip else b_ip end as dst_ip,
 case when rev then b_port else a_port end as src_port, case when rev then a_port else b_port end as dst_port, proto,
 40 + v as ip_len, case when proto = 6 then 40 else 28 end as header_len, v as payload_len,
 case when proto = 6 then cast(event_id % 256 as int) else 0 end as tcp_flags,
 case when proto = 6 then cast(event_id % 65536 as int) else -1 end as tcp_window
from (select event_id, ts, event_type, value, concat('10.0.0.', cast(user_id % 8 as string)) as a_ip,
 concat('192.168.56.', cast(100 + {k} % 4 as string)) as b_ip, cast(1024 + user_id % 2 as int) as a_port,
 case event_type when 'click' then 80 when 'view' then 443 when 'error' then 53 when 'signup' then 389 else 1434 end as b_port,
 case when event_type in ('click','view') then 6 else 17 end as proto, (event_id % 3 = 2) as rev,
 cast(floor(value) as int) as v from {events})"""

_FLOWS = """
select l_orderkey, l_linenumber, l_quantity as f_qty, l_extendedprice as f_price, l_extendedprice * 2 as f_price2,
 l_discount as f_disc, l_tax as f_tax,
 case when l_tax = 0 and l_linenumber = 1 then cast('Infinity' as double) when l_tax = 0 then null
      else l_discount / l_tax end as f_ratio, cast(0 as double) as f_const,
 case when l_returnflag = 'N' then 'Benign' when l_linenumber = 1 and l_orderkey % 5 = 0 then 'WebDDoS'
      when l_returnflag = 'R' and l_linestatus = 'F' then 'DrDoS_UDP' when l_returnflag = 'R' then 'UDP-lag'
      when l_linestatus = 'F' and l_linenumber > 5 then 'NetBIOS' when l_linestatus = 'F' then 'DrDoS_LDAP'
      else 'Syn' end as Label,
 case when l_orderkey % 5 = 0 then 'testing' else 'training' end as split from {lineitem}"""

_SCORED = """
select event_id, cast(ts as timestamp) as ts, concat('10.0.0.', cast(user_id as string)) as src_ip,
 case when event_id % 50 = 0 then '239.255.255.250' when event_id % 33 = 0 then '192.168.56.255'
      else concat('192.168.56.', cast(100 + user_id % 4 as string)) end as dst_ip,
 case event_type when 'click' then 'Benign' when 'view' then 'Benign' when 'error' then 'TCP SYN Flood'
      when 'signup' then 'UDP Flood' else 'LDAP Flood' end as prediction,
 cast(50 + (event_id * 37) % 51 as double) / cast(100 as double) as confidence,
 case when event_id % 11 = 0 then '' when event_id % 13 = 0 then 'offline_demo' else 'live_ips' end as source
from {events}"""

# Predictions of two models over five folds. Labels follow the event type; probabilities are
# eighths, so every engine holds them exactly, and each row's sum to 1.
_PREDICTIONS = """
select event_id as row_id, m.model, cast(event_id % 5 as int) as fold,
 case when event_id % 7 < 2 then 'test' else 'train' end as split, label,
 cast(case when (event_id + m.k) % m.wrong = 0 then (label + 1 + event_id % 3) % 5 else label end as int) as prediction,
 m.k as k
from (select event_id, cast(case event_type when 'click' then 0 when 'view' then 0 when 'error' then 1
                                 when 'signup' then 2 else 3 + event_id % 2 end as int) as label from {events})
{models}"""
_MODELS_SPARK = ("lateral view inline(array(struct('forest', 1, 7), struct('boosted', 2, 9))) m as model, k, wrong")
_MODELS_SQL = "cross join (values ('forest', 1, 7), ('boosted', 2, 9)) as m(model, k, wrong)"


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(text, **frames)


def packets(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    src = table(spark, sf_dir, "events") if events is None else events
    return _sql(spark, _PACKETS.replace("{k}", "cast(get_json_object(props,'$.k') as int)"), events=src)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, _FLOWS, lineitem=table(spark, sf_dir, "lineitem"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, _PREDICTIONS.replace("{models}", _MODELS_SPARK), events=table(spark, sf_dir, "events"))


def scored(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    src = table(spark, sf_dir, "events") if events is None else events
    return _sql(spark, _SCORED, events=src)


_HARMONISE_SQL = "case Label " + " ".join(f"when '{a}' then '{b}'" for a, b in HARMONISE.items()) + " end"


def raw_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training half with training label names; it never holds the test-only label."""
    f = flows(spark, sf_dir).where("split = 'training'")
    return f.withColumn("Label", F.expr(_HARMONISE_SQL)).drop("split")


def raw_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where("split = 'testing'").drop("split")


PACKETS_CTE = "packets as (" + _PACKETS.replace(
    "{k}", "cast(json_extract_string(props,'$.k') as int)").replace("{events}", "events") + ")"
FLOWS_CTE = "flows as (" + _FLOWS.replace("{lineitem}", "lineitem") + ")"
SCORED_CTE = "scored as (" + _SCORED.replace("{events}", "events") + ")"
SPLITS_CTE = (FLOWS_CTE + f""",
raw_train as (select * exclude (split, Label), {_HARMONISE_SQL} as Label from flows
              where split = 'training'),
raw_test as (select * exclude (split) from flows where split = 'testing')""")

PREDICTIONS_CTE = "pred0 as (" + _PREDICTIONS.replace("{events}", "events").replace("{models}", _MODELS_SQL) + ")"

FEATURE_COLS = ["f_qty", "f_price", "f_price2", "f_disc", "f_tax", "f_ratio", "f_const"]
