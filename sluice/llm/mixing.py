"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents.

Each source's documents are dealt by hash into blocks. Its target gives an exact quota of block draws: whole passes
over all its blocks in permuted order, then the first blocks of one more permutation, the last of them in part. A
tree splits the quotas among output shards: at each node the left half's share of each source is drawn from the
multivariate hypergeometric distribution, so shards are what dealing out all draws at random would give, although
each node is split alone. A leaf owns disjoint ranges of the permuted draws; its documents are shuffled within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.llm.text import WORD
from sluice.workdir import materialize

#: Words of a block, the unit that shards draw; documents are never split.
BLOCK_WORDS = 1 << 19
#: Blocks that a shard draws on average.
SHARD_BLOCKS = 8


def word_count(text: Column) -> Column:
    """Words of whole texts; each is replaced by one letter, so that no list of words is made of a long text."""
    letters = F.translate(F.regexp_replace(text.cast("string"), WORD, "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def order_hash(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**32 - 1 that DuckDB can compute alike."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    shown = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(shown), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight
    but stop at ``most`` times a source's size; the excess is reshared by weight until none is above. A source is
    capped if and only if its cap is within its share of what is left by the sources with lower caps per weight, so
    one ordered pass finds them. One row per source meets in a window, no document does.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    before = Window.orderBy((F.col("_cap") / F.col("weight")), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = (sizes.withColumn("weight", (1 + (F.row_number().over(ordered) - 1) % 3).cast("long"))
                 .withColumn("_cap", F.lit(most) * F.col("source_size"))
                 .withColumn("_level", share).withColumn("_capped", F.col("_cap") <= F.col("weight") * F.col("_level")))
    level = F.coalesce(F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything), F.lit(0.0))
    return (rows.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * level).cast("double"))
                .select("source", "source_size", "weight", "target"))


def split_quotas(quotas: np.ndarray, offsets: np.ndarray, low: int, high: int, seed: int, stop: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes of the tree below shards [low, high) that hold at most ``stop`` shards: (low, high, quotas, offsets).

    Shards take even numbers of draws. A node's draw depends on the seed and its shards only, so any task that
    splits it again finds the same.
    """
    if high - low <= stop:
        yield low, high, quotas, offsets
        return
    middle = (low + high) // 2
    total = int(quotas.sum())
    left = total * (middle - low) // (high - low)
    rng = np.random.Generator(np.random.PCG64([seed, low, high]))
    drawn = rng.multivariate_hypergeometric(quotas, left, method="marginals") if 0 < left < total else (quotas if left else 0 * quotas)
    yield from split_quotas(drawn, offsets, low, middle, seed, stop)
    yield from split_quotas(quotas - drawn, offsets + drawn, middle, high, seed, stop)


def plan_mix(rows: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame, int]:
    """The draws of a mix of ``rows`` (doc_id, source, size): (sources, draws, number of shards).

    sources: source, key, source_size, target, blocks. draws: key, block, pass_no, shard, words (null: the whole
    block; else the draw stops at the document whose words come nearest to that). Tables of one row per source and
    per block draw; quotas of the sources, a vector as long as there are sources, are all that reaches the driver.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    sources = materialize(targets(sizes).select("source", source_key("source").alias("key"), "source_size", "target", blocks.alias("blocks")), "mix-sources")

    found = materialize(rows.select(source_key("source").alias("key"), "doc_id", "size").join(sources.select("key", "blocks"), "key")
                            .select("key", block_of("doc_id", "blocks", seed).alias("block"), "size")
                            .groupBy("key", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    permuted = Window.partitionBy("key", "pass_no").orderBy(order_hash(seed, F.col("key"), F.col("pass_no"), F.col("block")), "block")
    ended = permuted.rowsBetween(Window.unboundedPreceding, -1)
    passes = (found.join(sources.select("key", "target", "source_size"), "key").where("source_size > 0")
                   .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.least(F.lit(2), F.floor(F.col("target") / F.col("source_size"))).cast("int"))))
                   .withColumn("before", F.col("pass_no") * F.col("source_size") + F.coalesce(F.sum("block_size").over(ended), F.lit(0)))
                   .where("before < target"))
    ranked = passes.select("key", "block", "pass_no", F.when(F.col("before") + F.col("block_size") > F.col("target"), F.col("target") - F.col("before")).alias("words"),
                           (F.row_number().over(Window.partitionBy("key").orderBy("pass_no", order_hash(seed, F.col("key"), F.col("pass_no"), F.col("block")), "block")) - 1).alias("rank"))
    ranked = materialize(ranked, "mix-draws")

    quotas = ranked.groupBy("key").count().orderBy("key").toPandas()
    n = int(quotas["count"].sum())
    shards = max(1, -(-n // shard_blocks))
    counts = quotas["count"].to_numpy(np.int64)
    nodes = pd.DataFrame([(lo, hi, q.tolist(), o.tolist()) for lo, hi, q, o in split_quotas(counts, 0 * counts, 0, shards, seed, max(1, shards // 64))] if n else [],
                         columns=["low", "high", "quotas", "offsets"])
    keys = quotas["key"].tolist()

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for node in some.itertuples(index=False):
                for lo, _, q, o in split_quotas(np.array(node.quotas, np.int64), np.array(node.offsets, np.int64), int(node.low), int(node.high), seed, 1):
                    has = np.flatnonzero(q)
                    yield pd.DataFrame({"shard": lo, "key": [keys[i] for i in has], "at": o[has], "n": q[has]})

    tree = spark.createDataFrame(nodes, "low long, high long, quotas array<long>, offsets array<long>").repartition(max(1, min(64, len(nodes))))
    owned = tree.mapInPandas(leaves, "shard long, key string, at long, n long").select(
        "shard", "key", F.explode(F.expr("sequence(at, at + n - 1)")).alias("rank"))
    return sources, materialize(ranked.join(owned, ["key", "rank"]).drop("rank"), "mix-shards"), shards


def source_key(source: str) -> Column:
    """A name of a source that is never null."""
    return F.concat(F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(source).cast("string"), F.lit("")))


def block_of(doc_id: str, blocks: str, seed: int) -> Column:
    return order_hash(seed, F.col(doc_id)) % F.col(blocks)


def draw(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``docs`` with size, source_size, target and draws: an array of (shard, pass_no), one for each time it is taken.

    Size is the number of words of the whole text (null: 0). A source takes whole passes over its documents and,
    in the last pass, whole blocks and then, in the order of a hash, the documents of one block up to where its
    words come nearest to the target. So every source ends within half a document of its target, no document is
    taken over 3 times, and reruns agree. Documents without words belong to blocks like others; a source without
    words takes none. Rows with one doc_id and size are taken together. Columns named like the new ones are replaced.
    """
    return _drawn(docs.withColumn("size", word_count(docs["text"])), seed, block_words, shard_blocks)


def _drawn(sized: DataFrame, seed: int, block_words: int, shard_blocks: int) -> DataFrame:
    """``draw`` for rows with doc_id, source and size; names that begin with an underscore are its own."""
    rows = materialize(sized.select("doc_id", "source", "size"), "mix-rows")
    sources, draws, _ = plan_mix(rows, seed, block_words, shard_blocks)
    whole = draws.where("words is null")
    cut = draws.where("words is not null")
    names = [c for c in sized.columns if c not in ("source_size", "target", "draws")]
    held = sized.select(*names).withColumn("_key", source_key("source"))
    facts = sources.select(F.col("key").alias("_key"), "source_size", "target", "blocks")
    placed = held.join(facts, "_key").withColumn("_block", block_of("doc_id", "blocks", seed)).drop("blocks")

    by_block = whole.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("shard", F.col("pass_no").cast("int").alias("pass_no")))).alias("_whole"))
    partly = cut.select("key", "block", F.struct("shard", F.col("pass_no").cast("int").alias("pass_no")).alias("_part"), F.col("words").alias("_words"))
    table = materialize(by_block.join(partly, ["key", "block"], "full").withColumnsRenamed({"key": "_key", "block": "_block"}), "mix-by-block")
    placed = placed.join(table, ["_key", "_block"], "left")

    # Only the documents of the cut blocks, at most one block of each source, need a running sum.
    units = (rows.select("doc_id", "size", source_key("source").alias("_key")).join(facts, "_key").withColumn("_block", block_of("doc_id", "blocks", seed))
                 .join(table.where("_words is not null").select("_key", "_block", "_words"), ["_key", "_block"])
                 .groupBy("_key", "_block", "_words", "doc_id", "size").agg(F.sum("size").alias("all")))
    inside = Window.partitionBy("_key", "_block").orderBy(order_hash(seed, "last", F.col("doc_id")), "doc_id", "size")
    before = F.coalesce(F.sum("all").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = materialize(units.withColumn("_before", before).where("_before + all / 2 <= _words")
                            .select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.col("doc_id").alias("_id"), F.col("size").alias("_s")), "mix-last")
    placed = placed.join(last, F.col("_part").isNotNull() & (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b"))
                         & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_s")), "left")
    empty = F.array().cast("array<struct<shard:bigint,pass_no:int>>")
    draws = F.concat(F.coalesce("_whole", empty), F.when(F.col("_s").isNotNull(), F.array("_part")).otherwise(empty))
    return placed.withColumn("draws", draws).drop("_key", "_block", "_whole", "_part", "_words", "_k", "_b", "_id", "_s")


def mix(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mixed corpus: rows of ``docs``, as often as they are drawn, shard by shard, shuffled within each shard."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("packed_row")  # a row's columns may have any names
    sized = docs.select(whole, docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"))
    taken = _drawn(sized, seed, block_words, shard_blocks).select("packed_row", "doc_id", F.explode("draws").alias("draw"))
    order = order_hash(seed, "order", F.col("draw.shard"), F.col("draw.pass_no"), F.col("doc_id"))
    return taken.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", order).select("packed_row.*")
