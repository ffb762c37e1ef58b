"""The thin queries of this subpackage: contracts, production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import balltree, differencing, langid, lattice, order_minhash, packing, raking, repair, storage, tokens, url_rules, warc

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_near_dedup(spark, sf_dir):
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op2_balltree_top_k(spark, sf_dir):
    return balltree.top_k(_table(spark, sf_dir, "embeddings"), 5, 50)


def op3_warc_derivatives(spark, sf_dir):
    uri = storage.fresh_path(spark, "warc")
    records = warc.derivatives(_table(spark, sf_dir, "pages"))
    if not warc.write_warc(records, uri).take(1):
        return records
    return warc.read_warc(spark, uri)


def op4_karmarkar_karp_shards(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = docs.withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))  # goes along, so that texts need not be shuffled
    return differencing.shard_documents(crc, 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_order_minhash_near_dedup(spark, sf_dir):
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"), 0.8)


def op6_repair_token_files(spark, sf_dir):
    uri = storage.fresh_path(spark, "repair-shards")
    catalog = storage.written(repair.write_shards(_table(spark, sf_dir, "documents"), tokens.default_path(), uri, end_id=1), "repair-bases")
    return repair.read_shards(spark, uri, catalog).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_raking_mix(spark, sf_dir):
    return raking.mix(_table(spark, sf_dir, "documents"), rate=raking.PRODUCTION_RATE).select("doc_id", "source", "lang", "topic", "tokens", "probability", "sampled")


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold() != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def labelled_urls(spark, sf_dir):
    """The number in a page's path is the document it was made from; bad documents are labelled."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_rules.path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", bad.alias("blocked"))


def op9_fp_growth_url_filter(spark, sf_dir):
    return url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls(spark, sf_dir), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op10_concat_and_cut(spark, sf_dir):
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), tokens.default_path(), end_id=2, window=4096))


QUERIES = {f.__name__: f for f in (
    op1_lattice_near_dedup, op2_balltree_top_k, op3_warc_derivatives, op4_karmarkar_karp_shards, op5_order_minhash_near_dedup,
    op6_repair_token_files, op7_raking_mix, op8_language_id, op9_fp_growth_url_filter, op10_concat_and_cut,
)}

#: Brute force over all pairs: the small tables of the SQL check only.
ORACLES = {
    "op1_lattice_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_sum([y * y FOR y IN embedding::DOUBLE[]])) AS n FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND n > 0 AND isfinite(n)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(r.m, v.vec_id))::BIGINT AS component_id,
  v.vec_id <= coalesce(r.m, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = v.vec_id""",
    "op2_balltree_top_k": """
WITH v AS (SELECT vec_id, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run() of corpus_pipeline.py at the top of the repository."""
    where = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", where)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
