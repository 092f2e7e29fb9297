"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import balanced_mix, decontaminate, embedding_dedup, infilling, minhash_dedup, ngram_lm, oracles, packing, pipeline, prefix_trie, quality, sharding, suffix_dedup, token_store, toxicity
from scenelake.llm.common import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_windows(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("starts", "stops", "longest")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_store.read_documents(spark, path)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_mix.mix(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts, and of what is restored from them."""
    made = infilling.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = {"output_sha256": digest(F.col("output")), "restored_sha256": digest(infilling.restored(F.col("output"), F.col("form")))}
    return made.withColumns(found).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_decontaminate, op3_toxicity, op4_token_store, op5_embedding_dedup,
        op6_minhash_dedup, op7_ngram_lm, op8_quality, op9_hilbert_shards, op10_pack,
        op11_prefix_trie, op12_cube_mix, op13_fill_in_middle,
    )
} | {"pipeline": pipeline.run}

#: DuckDB SQL where it can say the same over the whole tables.
ORACLE_SQL: dict[str, str] = oracles.SQL | {
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum([x * x for x in embedding::DOUBLE[]])) AS n FROM embeddings),
good AS (SELECT * FROM v WHERE n > 0 AND isfinite(n)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, root.component_id,
  v.vec_id = root.component_id AS kept FROM v JOIN root ON root.a = v.vec_id""",
} | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
