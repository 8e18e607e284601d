"""Data model: feature schema, label vocabularies, event schema, parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TARGET = "Label"

# The 77 model features, in model order.
FEATURES = [
    "Protocol", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Fwd Packets Length Total", "Bwd Packets Length Total",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
    "Fwd Packet Length Std", "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std", "Flow Bytes/s",
    "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max",
    "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std",
    "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags",
    "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Length",
    "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance", "FIN Flag Count",
    "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count", "Down/Up Ratio",
    "Avg Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets",
    "Subflow Bwd Bytes", "Init Fwd Win Bytes", "Init Bwd Win Bytes",
    "Fwd Act Data Packets", "Fwd Seg Size Min", "Active Mean", "Active Std",
    "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# Extractor CSV column -> model feature.
EXTRACTOR_COLUMNS = {
    "protocol": "Protocol",
    "flow_duration": "Flow Duration",
    "tot_fwd_pkts": "Total Fwd Packets",
    "tot_bwd_pkts": "Total Backward Packets",
    "totlen_fwd_pkts": "Fwd Packets Length Total",
    "totlen_bwd_pkts": "Bwd Packets Length Total",
    "fwd_pkt_len_max": "Fwd Packet Length Max",
    "fwd_pkt_len_min": "Fwd Packet Length Min",
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_max": "Bwd Packet Length Max",
    "bwd_pkt_len_min": "Bwd Packet Length Min",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "flow_byts_s": "Flow Bytes/s",
    "flow_pkts_s": "Flow Packets/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "fwd_iat_tot": "Fwd IAT Total",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "bwd_iat_tot": "Bwd IAT Total",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fwd_header_len": "Fwd Header Length",
    "bwd_header_len": "Bwd Header Length",
    "fwd_pkts_s": "Fwd Packets/s",
    "bwd_pkts_s": "Bwd Packets/s",
    "pkt_len_min": "Packet Length Min",
    "pkt_len_max": "Packet Length Max",
    "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std",
    "pkt_len_var": "Packet Length Variance",
    "fin_flag_cnt": "FIN Flag Count",
    "syn_flag_cnt": "SYN Flag Count",
    "rst_flag_cnt": "RST Flag Count",
    "psh_flag_cnt": "PSH Flag Count",
    "ack_flag_cnt": "ACK Flag Count",
    "urg_flag_cnt": "URG Flag Count",
    "cwr_flag_count": "CWE Flag Count",
    "ece_flag_cnt": "ECE Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Avg Packet Size",
    "fwd_seg_size_avg": "Avg Fwd Segment Size",
    "bwd_seg_size_avg": "Avg Bwd Segment Size",
    "fwd_byts_b_avg": "Fwd Avg Bytes/Bulk",
    "fwd_pkts_b_avg": "Fwd Avg Packets/Bulk",
    "fwd_blk_rate_avg": "Fwd Avg Bulk Rate",
    "subflow_fwd_pkts": "Subflow Fwd Packets",
    "subflow_fwd_byts": "Subflow Fwd Bytes",
    "subflow_bwd_pkts": "Subflow Bwd Packets",
    "subflow_bwd_byts": "Subflow Bwd Bytes",
    "init_fwd_win_byts": "Init Fwd Win Bytes",
    "init_bwd_win_byts": "Init Bwd Win Bytes",
    "fwd_act_data_pkts": "Fwd Act Data Packets",
    "fwd_seg_size_min": "Fwd Seg Size Min",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
}

# Features the extractor reports in seconds and the models expect in microseconds.
TIME_FEATURES = [f for f in FEATURES
                 if f == "Flow Duration" or " IAT " in f or f.startswith(("Active ", "Idle "))]

# Test-split label -> training label.
HARMONISE = {
    "DrDoS_UDP": "UDP",
    "UDP-lag": "UDPLag",
    "DrDoS_MSSQL": "MSSQL",
    "DrDoS_LDAP": "LDAP",
    "DrDoS_NetBIOS": "NetBIOS",
    "Syn": "Syn",
    "Benign": "Benign",
    "UDP": "UDP",
    "UDPLag": "UDPLag",
    "MSSQL": "MSSQL",
    "LDAP": "LDAP",
    "NetBIOS": "NetBIOS",
}

# Training label -> attack category (categories map to themselves).
CATEGORY = {
    "Syn": "TCP SYN Flood",
    "UDP": "UDP Flood",
    "UDPLag": "UDP-Lag Flood",
    "LDAP": "LDAP Flood",
    "MSSQL": "MSSQL Flood",
    "NetBIOS": "NetBIOS Flood",
    "Portmap": "Portmap Flood",
    "Benign": "Benign",
}
CATEGORY.update({category: category for category in list(CATEGORY.values())})

# Deployment classes in index order.
DEPLOYMENT_CLASSES = [
    "Benign", "LDAP Flood", "MSSQL Flood", "NetBIOS Flood",
    "TCP SYN Flood", "UDP Flood", "UDP-Lag Flood",
]

# TCP flag bits.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWE": 128}

# Fields of a detection event.
EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("dst_ports", T.StringType()),
    T.StructField("fwd_packets", T.IntegerType()),
    T.StructField("bwd_packets", T.IntegerType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("decision_source", T.StringType()),
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("blocked", T.BooleanType()),
    T.StructField("simulation", T.BooleanType()),
    T.StructField("model", T.StringType()),
    T.StructField("interface", T.StringType()),
    T.StructField("victim_os", T.StringType()),
    T.StructField("mitigation_backend", T.StringType()),
    T.StructField("mitigation_elevated", T.BooleanType()),
    T.StructField("block_command", T.StringType()),
    T.StructField("block_message", T.StringType()),
    T.StructField("source", T.StringType()),
])
EVENT_FIELDS = EVENT_SCHEMA.fieldNames()
LEGACY_ABSENT = {"src_port", "dst_port", "dst_ports", "decision_source"}
LEGACY_EVENT_FIELDS = [f for f in EVENT_FIELDS if f not in LEGACY_ABSENT]

PACKET_SCHEMA = T.StructType([
    T.StructField("pkt_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("ip_len", T.IntegerType()),
    T.StructField("header_len", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
])


@dataclass(frozen=True)
class FlowParams:
    """Flow life cycle, in seconds (defaults are the live-capture values)."""

    timeout: float = 10.0
    min_duration: float = 3.0
    min_packets: int = 50
    tick: float = 5.0
    # Width of the time slices a busy flow is split into; see operators.flows.
    slice_seconds: float = 60.0

    @staticmethod
    def micros(seconds: float) -> int:
        return int(round(seconds * 1_000_000))


@dataclass(frozen=True)
class TrainingConfig:
    seed: int = 42
    cv_folds: int = 5
    search_iter: int = 20
    correlation_threshold: float = 0.9
    enable_smote: bool = True
    balance_training: bool = True
    attack_to_benign_ratio: float = 1.0
    max_group_rows: int = 40_000
    min_attack_class_rows: int = 500
    parallelism: int = 2


ATTACK_THRESHOLD = 0.95
MONITOR_THRESHOLD = 0.80
ALERT_COOLDOWN_SECONDS = 15.0
