"""SimHash near-duplicates: fingerprints linked by generalised pigeonhole probes.

With m groups of bits and thresholds t1..tm that add up to (distance - m + 1), any two fingerprints within the
distance differ by at most ti bits in some group i; a threshold of -1 leaves a group out. Correlated bits share a
group, since values of such a group repeat more and one bad group is cheaper than many; thresholds come from
dynamic programming over the candidates each group would give, counted on all fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.llm.components import components
from sluice.llm.text import short_batches, text_column
from sluice.workdir import materialize

BITS = 64
_blank = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str, shingle: int = 3, part: int = 1 << 20) -> Iterator[np.ndarray]:
    """Unsigned hashes of the shingles of a whole text: all words as one if there are fewer, none without words.

    Texts are taken in parts of about ``part`` bytes, each with the last words of the one before.
    """
    from xxhash import xxh64_intdigest

    data = text.encode("utf-8", "replace").lower()  # of bytes: A-Z only
    n, carry, at = 0, [], 0
    while at < len(data):
        cut = _blank.search(data, at + part) if len(data) - at > part else None
        end = cut.start() if cut else len(data)
        words = carry + data[at:end].split()
        at, last = end, cut is None
        if len(words) < shingle and not (last and words and not n):
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        back = min(shingle, len(words)) - 1
        yield np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:len(words) - back].tolist(), ends[back:].tolist())),
                          np.uint64, len(words) - back)
        n += len(words) - back
        carry = words[len(words) - shingle + 1:] if shingle > 1 else []


def fingerprint(text: str, shingle: int = 3, part: int = 1 << 20) -> int:
    """Fingerprint of a whole text, unsigned; bit i is set if it is in over half of the shingles' hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle, part):
        ones += _bits(hashes).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int((2 * ones > n) @ (1 << np.arange(BITS, dtype=object))) if n else 0


def _bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 bits, lowest first, for each unsigned value."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with fp, the fingerprint as a signed long. Null texts count as empty (fingerprint zero)."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64), dtype="int64")

    return docs.withColumn("fp", fp(text_column(docs, text)))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _bit_products(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits in how many of them both are set."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for rows in batches:
            bits = _bits(rows.fp.to_numpy(np.int64).view(np.uint64)).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                total += bits[at:at + (1 << 16)].T @ bits[at:at + (1 << 16)]
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "both": total.ravel().astype(np.int64)})

    cells = prints.select("fp").mapInPandas(sums, "cell int, both long").groupBy("cell").agg(F.sum("both").alias("both")).toPandas()
    out = np.zeros(BITS * BITS, np.int64)
    out[cells.cell] = cells.both
    return prints.count(), out.reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of nearly even width: each group grows from a free bit by the bit closest to it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    close[(spread < 1e-5)[:, None] | (spread < 1e-5)[None, :]] = 0
    np.fill_diagonal(close, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        want = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (close[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < want:
            group.append(max(free, key=lambda b: (close[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Least sum of ``costs[i][t_i]`` with thresholds t_i that add up to ``total``, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (spent, chosen) in sorted(best.items()):
            for t, c in sorted(cost.items()):
                if so_far + t not in step or spent + c < step[so_far + t][0]:
                    step[so_far + t] = (spent + c, [*chosen, t])
        best = step
    return best[total]


def _value(fp: Column, group: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def plan_probes(prints: DataFrame, distance: int, group_counts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """Groups of bits with thresholds of least estimated cost; the statistics cover all ``prints``.

    Pairs that agree on a group are counted exactly; within t bits they are taken as that many times the number of
    values within t bits. A probe counts like a candidate.
    """
    n, both = _bit_products(prints)
    choices = {m: correlated_groups(n, both, m) for m in group_counts}
    named = [(m, i, g) for m, groups in choices.items() for i, g in enumerate(groups)]
    values = prints.select(F.explode(F.array(*(F.struct(F.lit(f"{m}.{i}").alias("g"), _value(F.col("fp"), g).alias("v")) for m, i, g in named))).alias("s"))
    pairs = {r["g"]: float(r["pairs"]) for r in values.groupBy("s.g", "s.v").count().groupBy("g").agg(F.sum(F.expr("double(count) * (count - 1) / 2")).alias("pairs")).collect()}
    plans = []
    for m, groups in choices.items():
        costs = []
        for i, g in enumerate(groups):
            ball = [sum(comb(len(g), k) for k in range(t + 1)) for t in range(distance + 1)]
            costs.append({-1: 0.0} | {t: (pairs.get(f"{m}.{i}", 0.0) + n) * ball[t] for t in range(distance + 1)})
        cost, thresholds = allocate(costs, distance - m + 1)
        plans.append((cost, m, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(plans)[2]


def near_links(prints: DataFrame, distance: int = 2, group_counts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints fp of ``prints`` within ``distance`` (1 or 2) bits.

    Each fingerprint is filed under its value in each group and probes all values within the group's threshold;
    candidates are verified on all bits. A value that so many share that their pairs would be more rows than their
    neighbourhoods is not paired up: all its fingerprints are filed under every word within one bit of them (65
    rows each, at most 65 at a word), and those that meet there are within two bits of one another. Either way each
    link is found, and connected fingerprints stay connected, though not every pair is a row.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    fp = F.col("fp")
    filed, probes = [], []
    for k, (group, t) in enumerate(plan_probes(prints, distance, group_counts)):
        flips = [0] + [_signed(sum(1 << b for b in some)) for r in range(1, t + 1) for some in combinations(group, r)]
        filed.append(F.struct(F.lit(k).alias("g"), _value(fp, group).alias("v"), F.lit(False).alias("probe")))
        for flip in flips:
            probes.append(F.struct(F.lit(k).alias("g"), _value(fp, group).bitwiseXOR(F.lit(flip)).alias("v"), F.lit(True).alias("probe")))
    rows = prints.select("fp", F.explode(F.array(*filed, *probes)).alias("s")).select("fp", "s.*")
    probing = F.col("probe").cast("long")
    sizes = (rows.groupBy("g", "v").agg(F.sum(1 - probing).alias("n_filed"), F.sum(probing).alias("n_probe"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                 .where("n_filed > 0 and n_probe > 0 and lo < hi")
                 .select("g", "v", (F.col("n_filed") * F.col("n_probe") > (BITS + 1) * (F.col("n_filed") + F.col("n_probe"))).alias("large")))
    rows = materialize(rows.join(sizes, ["g", "v"]), "simhash-probes")
    few = rows.where(~F.col("large"))
    a = few.where(~F.col("probe")).select("g", "v", F.col("fp").alias("a"))
    b = few.where("probe").select("g", "v", F.col("fp").alias("b"))
    verified = a.join(b, ["g", "v"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")

    many = rows.where("large").select("fp").distinct()
    if distance == 1:
        flips = [_signed(1 << k) for k in range(BITS)]
        around = many.select(fp.alias("a"), F.explode(F.array(*(fp.bitwiseXOR(F.lit(x)) for x in flips))).alias("b"))
        met = around.join(many.select(fp.alias("b")), "b").where("a < b").select("a", "b")
    else:
        words = F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)))
        around = many.select(fp.alias("b"), F.explode(words).alias("word"))
        met = around.withColumn("a", F.min("b").over(Window.partitionBy("word"))).where("a < b").select("a", "b")
    return verified.unionByName(met)


def near_groups(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id, root and text_hash of each row of ``docs``.

    component_id is the smallest doc_id that links of fingerprints within ``distance`` bits reach; copies share a
    fingerprint and are linked through it, never pairwise. Rows with a null doc_id take part and count only if no
    other id is reached (then component_id is null). Null and empty texts have fingerprint zero, linked like any
    other. Repeated rows each get their row; an empty table gives none. root names the group by one of its
    fingerprints; text_hash is Spark's hash of the text.
    """
    given = docs.select("doc_id", text_column(docs).alias("text"))
    rows = materialize(with_fingerprints(given, shingle).select("doc_id", "fp", F.xxhash64("text").alias("text_hash")), "simhash")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    found = components(near_links(prints, distance), "simhash-links").select(F.col("node").alias("fp"), "root")
    rooted = materialize(prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def keep_one(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id (null last), with all its columns.

    Rows that repeat it with the same id and text go too. Only ids and hashes of the kept rows meet the texts again.
    """
    return first_of_groups(docs, near_groups(docs, distance, shingle))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``groups`` (doc_id, text_hash, root), as ``keep_one`` says."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    name = lambda doc_id, text_hash: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_hash)
    kept = materialize(groups.groupBy("root").agg(first.alias("kept")).select(name(F.col("kept.doc_id"), F.col("kept.text_hash")).alias("_name")), "simhash-kept")
    held = max(docs.columns, key=len) + "_name"
    named = docs.withColumn(held, name(docs["doc_id"], F.xxhash64(text_column(docs))))
    return named.join(kept.withColumnRenamed("_name", held), held, "left_semi").dropDuplicates([held]).select(*docs.columns)
