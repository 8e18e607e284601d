"""The 77 model features of a flow, as SQL expressions over its integer totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluice.schemas import FEATURES, FLAG_BITS

_IDENTITY = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "first_ts", "last_ts"]
_DURATION = "cast(greatest(last_ts - first_ts, 1) as double)"
_BYTES, _PACKETS = "(fwd_bytes + bwd_bytes)", "(fwd_n + bwd_n)"


def _double(e: str) -> str:
    return f"cast({e} as double)"


def _or_zero(e: str) -> str:
    return f"cast(coalesce({e}, 0) as double)"


def _mean(total: str, n: str) -> str:
    return f"(case when {n} = 0 then 0D else cast({total} as double) / cast({n} as double) end)"


def population_variance(n: str, total: str, squares: str) -> str:
    """Variance of n integers from their exact sum and sum of squares; 0 for n <= 1."""
    spread = (f"cast({n} as decimal(19,0)) * cast({squares} as decimal(38,0)) "
              f"- cast({total} as decimal(19,0)) * cast({total} as decimal(19,0))")
    return f"(case when {n} > 1 then cast({spread} as double) / (cast({n} as double) * cast({n} as double)) else 0D end)"


def _spread(name: str, n: str, total: str, squares: str, high: str, low: str) -> dict[str, str]:
    return {
        f"{name} Mean": _mean(total, n),
        f"{name} Std": f"sqrt({population_variance(n, total, f'coalesce({squares}, 0)')})",
        f"{name} Max": _or_zero(high),
        f"{name} Min": _or_zero(low),
    }


def length_stats() -> dict[str, str]:
    """Packet lengths per direction and pooled; a silent direction counts as one length of 0."""
    out: dict[str, str] = {}
    for name, s in {"Fwd": "fwd", "Bwd": "bwd"}.items():
        out |= _spread(f"{name} Packet Length", *[f"{s}_{k}" for k in ("n", "bytes", "len_sq", "len_max", "len_min")])
    n = "(greatest(fwd_n, 1) + greatest(bwd_n, 1))"
    variance = population_variance(n, _BYTES, "(fwd_len_sq + bwd_len_sq)")
    return out | {
        "Packet Length Min": "case when fwd_n = 0 or bwd_n = 0 then 0D else cast(least(fwd_len_min, bwd_len_min) as double) end",
        "Packet Length Max": _or_zero("greatest(fwd_len_max, bwd_len_max)"),
        "Packet Length Mean": _mean(_BYTES, n),
        "Packet Length Std": f"sqrt({variance})",
        "Packet Length Variance": variance,
    }


def rates() -> dict[str, str]:
    return {name: f"cast({what} as double) / {_DURATION} * 1e6D" for name, what in {
        "Flow Bytes/s": _BYTES, "Flow Packets/s": _PACKETS, "Fwd Packets/s": "fwd_n", "Bwd Packets/s": "bwd_n"}.items()}


def iat_stats() -> dict[str, str]:
    """Times between packets of the flow, in microseconds, by direction of the later packet."""
    out = _spread("Flow IAT", "(fwd_iat_n + bwd_iat_n)", "(fwd_iat_sum + bwd_iat_sum)",
                  "coalesce(fwd_iat_sq, 0) + coalesce(bwd_iat_sq, 0)",
                  "greatest(fwd_iat_max, bwd_iat_max)", "least(fwd_iat_min, bwd_iat_min)")
    for name, s in {"Fwd": "fwd", "Bwd": "bwd"}.items():
        out[f"{name} IAT Total"] = _double(f"{s}_iat_sum")
        out |= _spread(f"{name} IAT", *[f"{s}_iat_{k}" for k in ("n", "sum", "sq", "max", "min")])
    return out


def active_idle() -> dict[str, str]:
    """Active time is the flow's duration; idle times are gaps of a second or more."""
    active = {"Active Mean": _DURATION, "Active Std": "0D", "Active Max": _DURATION, "Active Min": _DURATION}
    return active | _spread("Idle", *[f"idle_{k}" for k in ("n", "sum", "sq", "max", "min")])


def ratios() -> dict[str, str]:
    return {
        "Down/Up Ratio": _mean("bwd_n", "fwd_n"),
        "Avg Packet Size": f"cast({_BYTES} as double) / cast(greatest({_PACKETS}, 1) as double)",
        "Avg Fwd Segment Size": _mean("fwd_bytes", "fwd_n"),
        "Avg Bwd Segment Size": _mean("bwd_bytes", "bwd_n"),
    }


def _seen(flag: str) -> str:
    return f"case when {flag}_count > 0 then 1D else 0D end"


def counters() -> dict[str, str]:
    out = {
        "Protocol": _double("proto"), "Flow Duration": _DURATION,
        "Total Fwd Packets": _double("fwd_n"), "Total Backward Packets": _double("bwd_n"),
        "Fwd Packets Length Total": _double("fwd_bytes"), "Bwd Packets Length Total": _double("bwd_bytes"),
        "Fwd PSH Flags": _seen("psh"), "Fwd URG Flags": _seen("urg"),
        "Fwd Header Length": _double("fwd_hdr"), "Bwd Header Length": _double("bwd_hdr"),
        "Subflow Fwd Packets": _double("fwd_n"), "Subflow Fwd Bytes": _double("fwd_bytes"),
        "Subflow Bwd Packets": _double("bwd_n"), "Subflow Bwd Bytes": _double("bwd_bytes"),
        "Init Fwd Win Bytes": _or_zero("fwd_win"), "Init Bwd Win Bytes": _or_zero("bwd_win"),
        "Fwd Act Data Packets": _double("fwd_data"), "Fwd Seg Size Min": _or_zero("fwd_hdr_min"),
    }
    return out | {f"{flag} Flag Count": _double(f"{flag.lower()}_count") for flag in FLAG_BITS}


def feature_expressions() -> dict[str, str]:
    """Feature name to expression, in model order; features never observed are constant 0."""
    known = counters() | length_stats() | rates() | iat_stats() | active_idle() | ratios()
    return {name: known.get(name, "0D") for name in FEATURES}


def flow_features(flows: DataFrame, keep: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Identity columns of each flow (or ``keep``) and its 77 features (or some of them)."""
    exprs = feature_expressions()
    return flows.selectExpr(*(_IDENTITY if keep is None else keep),
                            *[f"{exprs[n]} as `{n}`" for n in (names or FEATURES)])


def legacy_vector() -> str:
    """The positional 32-value input of older models (order and contents are fixed by them)."""
    f = feature_expressions()
    named = ["Protocol", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Fwd Packets Length Total",
             "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Std",
             "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Std",
             "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Min",
             "Bwd IAT Mean", "Bwd IAT Mean", "Bwd IAT Min", "Fwd PSH Flags", "SYN Flag Count", "ACK Flag Count",
             "URG Flag Count", "CWE Flag Count", "Down/Up Ratio"]
    rest = ["cast(fwd_bytes as double) / greatest(fwd_n, 1)", "cast(bwd_bytes as double) / greatest(bwd_n, 1)",
            f["Fwd Packets/s"], f["Packet Length Mean"], f["Packet Length Mean"],
            _double("fwd_bytes"), _double("bwd_bytes"), "0D"]
    return f"array({', '.join([f[n] for n in named] + rest)})"
