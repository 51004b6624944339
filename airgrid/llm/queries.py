"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import alignment, cover_join, id_files, license_scan, mixing, ngram_join, packing, permutation_index, repeats, shards, spelling, toxicity, url_rules
from airgrid.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_ngram_jaccard")
def op1(spark, sf_dir):
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


@register("op2_permutation_index")
def op2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


# (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP3_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', 1) ELSE '' END AS raw_host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages
), hosts AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (VALUES %s), judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(r := rule_host || rule_path, v := rule_verdict), length(rule_host) + length(rule_path)) FROM rules
     WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM hosts
)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
""" % ", ".join(str(r) for r in URL_RULES)


@register("op3_url_rules", OP3_SQL)
def op3(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@register("op4_cover_tree_dedup")
def op4(spark, sf_dir):
    return cover_join.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op5_license_scan")
def op5(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op6_toxicity")
def op6(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", "held_out", "score", "predicted")


@register("op7_histogram_shards")
def op7(spark, sf_dir):
    placed = shards.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op8_best_fit_packing")
def op8(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@register("op9_id_files")
def op9(spark, sf_dir):
    return id_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op10_mix_sources")
def op10(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op11_cross_tokenizer")
def op11(spark, sf_dir):
    return alignment.cross_align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@register("op12_suffix_dedup")
def op12(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")


@register("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
