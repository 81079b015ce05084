"""The queries of this subpackage, each its operator applied to its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, read, ship
from .decontamination import build_shards, contamination
from .exact_topk import exact_topk
from .language_id import language_id, learn
from .line_dedup import line_dedup
from .lm_scoring import lm_scoring
from .ngram_join import ngram_join
from .secret_scan import secret_scan
from .sharding import ShardStore, free_name, shard
from .source_mixing import source_mixing
from .token_packing import packed_rows, token_packing, write_packed

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed_rows(write_packed(token_packing(read(spark, sf_dir, "documents")), new_path(spark, "packed")))
    return out.select("grp", "row", "n_tokens", "width", F.size("segments").alias("n_segments"), "cu_seqlens", F.transform("segments", lambda s: s["id"]).alias("doc_ids"), F.transform("segments", lambda s: s["start"]).alias("starts"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), build_shards(read(spark, sf_dir, "benchmark")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id(docs, learn(docs))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals, told apart by a hash of the id; a row for each document with its shard in the last version."""
    docs = read(spark, sf_dir, "documents")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4))
    store = ShardStore(spark, new_path(spark, "shards"))
    out = shard(store, [docs.filter(part == i) for i in range(4)])
    if out is None:
        return docs.select("doc_id", F.lit("").alias("shard"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("version")).limit(0)
    return out.select("doc_id", F.col(free_name("shard", docs.columns)).alias("shard"), F.col(free_name("tier", docs.columns)).alias("tier"), F.lit(store.manifest()["version"]).cast("long").alias("version"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = (op1_line_dedup, op2_lm_scoring, op3_source_mixing, op4_ngram_join, op5_token_packing, op6_exact_topk, op7_decontamination, op8_language_id, op9_secret_scan, op10_sharding, pipeline)
    return {f.__name__: _shipped(f) for f in found}


OP1_SQL = """
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM cut)
), numbered AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM numbered, (VALUES (0), (1), (2)) t(o) WHERE k > 1
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM cut
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.r AS q_row, c.r AS c_row, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id, c_row) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op6_exact_topk": OP6_SQL}
