"""Column expressions shared by the operators; all run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_STRICT_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_LENIENT = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_IPV4_STRICT = rf"^{_STRICT_OCTET}(\.{_STRICT_OCTET}){{3}}$"
_IPV6_MULTICAST = r"^ff[0-9a-f]{2}(:[0-9a-f]{0,4}){2,7}$"


def col(name: str) -> Column:
    """Column by its literal name (names such as ``Flow Bytes/s`` need quoting)."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_lookup(mapping: Mapping[str, str], value: Column) -> Column:
    """Value looked up in a small fixed vocabulary; null when absent."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), value)


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def finite(c: Column) -> Column:
    """Null for NaN and for both infinities."""
    return F.when(~F.isnan(c) & ~is_infinite(c), c)


def to_finite(c: Column) -> Column:
    """Text to finite double; bad text, NaN and infinities become null."""
    return finite(c.try_cast("double"))


def truncate_int(c: Column) -> Column:
    """Number or numeric text truncated toward zero; null and bad text become 0."""
    return F.coalesce(to_finite(c), F.lit(0.0)).try_cast("int")


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def first_value(df: DataFrame, candidates: Iterable[str], default) -> Column:
    """First non-null value among the candidate columns the frame has."""
    present = [col(c).cast("string") for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit(default).cast("string"))


def valid_ipv4(c: Column) -> Column:
    """Four digit groups, each 0..255 (leading zeros accepted)."""
    return F.coalesce(c.rlike(_IPV4_LENIENT), F.lit(False))


def dotted_numbers(c: Column) -> Column:
    """Four digit groups of any size, as hosts numbered past 255 have."""
    return F.coalesce(c.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.lit(False))


def noise_destination(c: Column) -> Column:
    """Multicast address, or an IPv4 address ending in .255; false for anything else."""
    ip = F.trim(c)
    v4 = ip.rlike(_IPV4_STRICT)
    first = F.split_part(ip, F.lit("."), F.lit(1)).try_cast("int")
    v4_noise = v4 & (first.between(224, 239) | ip.endswith(".255"))
    return F.coalesce(v4_noise | F.lower(ip).rlike(_IPV6_MULTICAST), F.lit(False))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def percent_text(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100.0)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def floating_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / F.when(den != 0, den.cast("double")))
