"""Registered queries of the operators, on the whole tables and with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import alignment, bitplanes, infill, languages, licences, metric_join, mixing, onebit, pages, pieces, quality, simhash, token_counts
from sluice.workdir import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; the folder may be set by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _order_sql(*parts: str) -> str:
    """DuckDB's way to ``mixing.order_hash``."""
    shown = ", ".join(f"coalesce(({p})::varchar, 'null')" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {shown})), 1, 8))::bigint"


def mixing_sql(block_words: int = mixing.BLOCK_WORDS, seed: int = 17) -> str:
    block = _order_sql(str(seed), "key", "pass_no", "block")
    return f"""
    with docs as (
        select doc_id, source, case when source is null then '0' else '1' || source end as key,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
    sizes as (select key, any_value(source) as source, sum(size)::bigint as source_size from docs group by key),
    weighed as (select *, 1 + (row_number() over (order by source is null, source) - 1) % 3 as weight, 3.0::double * source_size as cap from sizes),
    shares as (select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as lvl
        from weighed window before as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
    leveled as (select *, max(case when cap > weight * lvl then lvl end) over () as level from shares),
    sources as (select key, source_size, case when cap <= weight * lvl then cap else weight * level end::double as target,
        greatest(1, ceil(source_size / {block_words}::double))::bigint as blocks from leveled),
    placed as (select d.*, s.source_size, s.target, {_order_sql(str(seed), "doc_id")} % s.blocks as block from docs d join sources s using (key)),
    block_sizes as (select key, block, sum(size) as block_size, any_value(source_size) as source_size, any_value(target) as target from placed group by key, block),
    passes as (select * from block_sizes, (select unnest([0, 1, 2]) as pass_no) where source_size > 0 and pass_no * source_size < target),
    begun as (select *, pass_no * source_size + coalesce(sum(block_size) over (partition by key, pass_no order by {block}, block
        rows between unbounded preceding and 1 preceding), 0) as before from passes),
    units as (select key, block, doc_id, size, sum(size) as unit from placed group by key, block, doc_id, size),
    inside as (select *, coalesce(sum(unit) over (partition by key, block order by {_order_sql(str(seed), "'last'", "doc_id")}, doc_id nulls first, size
        rows between unbounded preceding and 1 preceding), 0) as ahead from units),
    times as (select i.key, i.block, i.doc_id, i.size,
        count(*) filter (where b.before + b.block_size <= b.target or b.before < b.target and b.before + i.ahead + i.unit / 2 <= b.target) as n
        from inside i join begun b using (key, block) group by all)
    select p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(t.n, 0))::bigint as taken
    from placed p left join times t on t.key = p.key and t.block = p.block and t.doc_id is not distinct from p.doc_id and t.size = p.size"""


@query("op1_source_mix", mixing_sql())
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_groups(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_nearest_vectors")
def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, trees).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


NEAR_VECTORS_SQL = """
    with recursive valid as (
        select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
        where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from valid a join valid b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
        and list_cosine_similarity(a.v, b.v) >= 0.98),
    reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
    roots as (select a as vec_id, min(b) as component_id from reach group by a),
    counts as (select a as vec_id, count(*) as n from links group by a)
    select e.vec_id, coalesce(c.n, 0)::bigint as n_links, r.component_id, e.vec_id = r.component_id as kept
    from embeddings e join roots r using (vec_id) left join counts c using (vec_id)"""


@query("op5_near_vectors", NEAR_VECTORS_SQL)
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_token_id_output")
def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplanes.write_ids(table(spark, sf_dir, "documents"), bitplanes.shared_folder(spark, "token-ids"),
                                   tokenizer_file("word_bpe_49k.json"), end_id=1)
    ids = bitplanes.read_ids(materialize(manifest, "token-id-files"))
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "pages")
    return pages.with_main_text(given, pages.fit_labeller(given)).select("page_id", "url", "text", "n_chars")


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = pieces.digest_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_licences", licences.oracle_sql())
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).select("doc_id", "licences", "n_rules", "n_sentences")


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest_alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op12_language")
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit_languages(docs, tokenizer_file("piece_bpe_32k.model"))
    told = languages.predict_languages(docs.select("doc_id", "text"), model)
    return told.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op13_fill_in_middle", infill.oracle_sql())
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                         digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
