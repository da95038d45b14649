"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_near_duplicates
from .mixing import mix_documents
from .multi_index import nearest_neighbours
from .order_minhash import near_duplicates
from .packing import pack_documents
from .secret_forest import scan_secrets
from .sharding import shard_by_bytes
from .token_file import read_token_files, write_token_files
from .warc import build_derivatives, page_record_id, page_responses, read_warc, write_warc
from .weak_quality import fit_quality, quality_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mix_documents(_table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    return kept.select("doc_id", "source", "lang", F.col("__d2").alias("topic"), F.col("__tokens").alias("tokens"), F.col("__probability").alias("probability"), (1 / F.col("__probability")).alias("weight"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), end_id=2), with_ids=False)


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, fit_quality(docs))
    return scored.select("doc_id", F.col("__posterior").alias("posterior"), F.col("__score").alias("score"), F.col("__kept").alias("kept"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    made = read_warc(write_warc(build_derivatives(page_responses(pages))))
    head = lambda name: F.try_element_at("headers", F.lit(name))
    rows = made.select(
        head("WARC-Refers-To").alias("refers_to"),
        head("WARC-Type").alias("warc_type"),
        head("WARC-Record-ID").alias("record_id"),
        head("WARC-Target-URI").alias("target_uri"),
        head("WARC-Date").alias("warc_date"),
        head("Content-Type").alias("content_type"),
        head("Content-Length").cast("long").alias("content_length"),
        head("WARC-Block-Digest").alias("block_digest"),
        head("WARC-Refers-To-Payload-Digest").alias("source_payload_digest"),
        F.crc32("block").alias("block_crc32"),
        F.when(head("WARC-Type") == "metadata", F.get_json_object(F.col("block").cast("string"), "$.title")).alias("title"),
    )
    ids = pages.select("page_id", page_record_id().alias("refers_to")).distinct()
    return ids.join(rows.hint("merge"), "refers_to")  # the records' number does not show in the manifest, which Spark would take for a small table


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))))  # ahead of the shuffle, which then moves no text
    return shard_by_bytes(docs, 40, ["doc_id", "text_crc32"]).select(
        "doc_id",
        F.col("__size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), end_id=1, size=4096, with_ids=False)


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), 20)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_order_minhash, op3_token_files, op4_weak_quality, op5_warc_derivatives, op6_sampled_splitters, op7_best_fit, op8_secret_forest, op9_embedding_dedup, op10_multi_index)}

ORACLES = {
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = v.vec_id
""",
}
