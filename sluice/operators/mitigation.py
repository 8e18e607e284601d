"""Block decisions and the firewall text that goes with them. Nothing is ever executed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions import scalars as S
from sluice import workdir
from sluice.schemas import ATTACK_THRESHOLD

# Messages and, below, command texts.
SIMULATED_BLOCK = "SIMULATION: firewall command was not executed."
SIMULATED_UNBLOCK = "SIMULATION: unblock command was not executed."


def qualifies(threshold: float = ATTACK_THRESHOLD) -> Column:
    return F.col("is_attack") & (F.col("confidence") >= threshold)


def block_first_per_source(events: DataFrame, threshold: float = ATTACK_THRESHOLD,
                           order: tuple[str, str] = ("ts", "event_id"), success: str | None = None) -> DataFrame:
    """Sets ``blocked`` on the first qualifying event of each source.

    With ``success``, a boolean column, attempts that fail do not count: the first
    successful one blocks, and ``attempted`` marks every event up to and including it.
    The first event of a source is a minimum taken before the shuffle. The table of first events is written, so
    that its size decides how it meets the qualifying events; all others pass by. A source with very many events
    is split by adaptive execution where that join is a shuffle.
    """
    ts, eid = order
    hit = F.coalesce(qualifies(threshold), F.lit(False))
    hits, others = events.where(hit), events.where(~hit)
    first = (hits if success is None else hits.where(F.col(success))).groupBy("src_ip").agg(F.min(F.struct(ts, eid)).alias("_first"))
    first = workdir.materialize(first.withColumnRenamed("src_ip", "_src"), "first-blocks")
    marked = hits.join(first, F.col("src_ip").eqNullSafe(F.col("_src")), "left")
    flags = {"blocked": F.coalesce(F.col(f"_first.{eid}") == F.col(eid), F.lit(False))}
    if success is not None:
        flags = {"attempted": F.col("_first").isNull() | (F.struct(ts, eid) <= F.col("_first"))} | flags
    plain = others.withColumns({name: F.lit(False) for name in flags})
    return marked.withColumns(flags).drop("_first", "_src").unionByName(plain)


def rule_name(ip: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.translate(ip, ".:", "__"))


def block_text(ip: Column, backend: Column, prefix: str) -> Column:
    return (F.when(backend == "iptables", F.format_string("iptables -I INPUT -s %s -j DROP", ip))
            .when(backend == "nftables", F.format_string("nft add rule inet filter input ip saddr %s drop", ip))
            .when(backend == "windows_firewall", F.format_string(
                'netsh advfirewall firewall add rule name="%s" dir=in action=block remoteip=%s protocol=any '
                "profile=any enable=yes", rule_name(ip, prefix), ip))
            .otherwise(F.format_string("# Unsupported backend %s: manually block %s", backend, ip)))


def unblock_text(ip: Column, backend: Column, prefix: str) -> Column:
    return (F.when(backend == "iptables", F.format_string("iptables -D INPUT -s %s -j DROP", ip))
            .when(backend == "nftables", F.lit(
                "# nftables delete requires a rule handle; inspect with: nft list ruleset"))
            .when(backend == "windows_firewall", F.format_string(
                'netsh advfirewall firewall delete rule name="%s"', rule_name(ip, prefix)))
            .otherwise(F.format_string("# Unsupported backend %s: manually unblock %s", backend, ip)))


def blocklist(df: DataFrame, ip: str = "src_ip", backend: str = "backend", simulation: bool = True,
              prefix: str = "NETFLOW_BLOCK_") -> DataFrame:
    """What blocking each row's address would say: one decision record per row.

    ``executable`` tells whether the backend has a command at all. Outside simulation a
    decision is only a request, so its success stays false until somebody reports one.
    """
    able = F.col(backend).isin("iptables", "nftables", "windows_firewall")
    return _records(df, ip, backend, simulation, block_text(F.col(ip), F.col(backend), prefix), able,
                    F.concat(F.col("prediction"), F.lit(" (confidence: "), S.percent_text(F.col("confidence"), 2), F.lit(")")),
                    SIMULATED_BLOCK, "Unsupported mitigation backend: ")


def unblocklist(df: DataFrame, ip: str = "src_ip", backend: str = "backend", simulation: bool = True,
                prefix: str = "NETFLOW_BLOCK_") -> DataFrame:
    """The same for taking a block back; nftables has no such command without a rule handle."""
    able = F.col(backend).isin("iptables", "windows_firewall")
    return _records(df, ip, backend, simulation, unblock_text(F.col(ip), F.col(backend), prefix), able,
                    F.lit("Unblock requested"), SIMULATED_UNBLOCK, "Unsupported unblock operation for backend: ")


def _records(df: DataFrame, ip: str, backend: str, simulation: bool, command: Column, able: Column, reason: Column,
             simulated_message: str, unsupported: str) -> DataFrame:
    message = F.lit(simulated_message) if simulation else F.when(
        ~able, F.concat(F.lit(unsupported), F.col(backend))).otherwise(F.lit("requested"))
    return df.select(F.col(ip).alias("ip"), reason.alias("reason"), F.col(backend).alias("backend"),
                     F.lit(simulation).alias("simulated"), F.lit(simulation).alias("success"),
                     able.alias("executable"), command.alias("command"), message.alias("message"))


def dropped_addresses(lines: DataFrame, text: str = "value", is_address: Callable[[Column], Column] = S.valid_ipv4) -> DataFrame:
    """First address of each listing line that names the DROP target; by default an address is a valid IPv4 one."""
    words = F.split(F.col(text), r"\s+")
    found = F.get(F.filter(words, is_address), F.lit(0))
    return lines.where(F.col(text).contains("DROP")).withColumn("ip", found).where(F.col("ip").isNotNull())
