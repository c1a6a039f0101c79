"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark.llm import alignment, htmltext, language, mixing, packing, projections, quality, secrets, simhash, spelling, substrings, twins, warc, winnowing
from aqspark.llm.registry import register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@register("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.spans(kinds=("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.spans().alias("spans"),
    )


@register("op7_source_mix", twins.mixing_twin())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_totals(mixing.mix(documents(spark, sf_dir)))


@register("op9_quality_rules", twins.quality_twin())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@register("op5_substring_dedup", twins.REPEATS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


EMBEDDING_TWIN = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN deg USING (vec_id)
"""


@register("op1_embedding_near_duplicates", EMBEDDING_TWIN)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


WARC_TWIN = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@register("op2_warc_archives", WARC_TWIN)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op11_benchmark_decontamination", twins.DECONTAMINATION)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


@register("op12_spelling_variants", twins.SPELLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(documents(spark, sf_dir), *paths).withColumnRenamed("groups", "groups_sha256")
