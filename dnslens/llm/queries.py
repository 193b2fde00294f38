"""The registered queries of the numbered operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm import byte_bpe, decontaminate, document_fp_tree, exact_dedup, html_wrapper, language_id, packing, ring_shards, simhash, substring_dedup, token_alignment, token_planes, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learned from rows whose remainder isn't 2."""
    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit(docs, where=_remainder(4) != 2)
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_wrapper.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a passage with a benchmark item, with the item and the longest passage."""
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; learned from labels of rows whose remainder isn't 0."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    languages = language_id.fit(docs, 500, where=_remainder(5) != 0)
    model = toxicity.fit(docs, labels, languages, where=_remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")


def op5_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without words under repeated windows of 35."""
    return substring_dedup.repeated_spans(_read(spark, sf_dir, "documents")).drop("spans", "factors")


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest in the shard files."""
    return token_planes.token_table(_read(spark, sf_dir, "documents"))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return ring_shards.shard(_read(spark, sf_dir, "documents")).drop("home_shard")


def op9_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the packed sequences."""
    return packing.pack(_read(spark, sf_dir, "documents")).drop("key")


def op11_interval_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of two tokenizers, with the corpus-wide counts of its links' id pairs."""
    found = token_alignment.align(_read(spark, sf_dir, "documents"), groups=lambda c: F.sha2(c.cast("binary"), 256))
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_mapped_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    found = byte_bpe.encode(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return document_fp_tree.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_html_wrapper, op3_spaced_seeds, op4_toxicity_cnn, op5_relative_lz, op6_covering_simhash, op7_bit_planes, op8_ring_shards, op9_extendible_hash, op10_hilbert_packing, op11_interval_coalescing, op12_mapped_bpe, op13_fp_tree)}

ORACLE_SQL = {
    "op5_relative_lz": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM t),
g AS (SELECT rid, word, pos, CASE WHEN pos + 35 <= n THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM w),
d AS (SELECT rid, word, pos, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS dup FROM g),
c AS (SELECT rid, word, pos, max(dup) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM d),
k AS (SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY rid)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.rid = k.rid""",
    "op9_extendible_hash": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM n""",
    "op13_fp_tree": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * n * all_docs) // all_terms AS m FROM d, s),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM t) GROUP BY ALL),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
h AS (SELECT item, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY item, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0) WHERE rank <= 20""",
}
