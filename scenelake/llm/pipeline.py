"""A training corpus from raw documents, in five stages; each stage's result is written and read again by the next.

In all stages null and empty texts are texts like others: the classifier gives them the score of its constant, nothing
repeats, duplicates or contaminates them, and each is packed as its end id alone. Null ids come before all others. Rows
that repeat an id are judged one by one by their texts; of rows that agree in id and text the near-duplicate stage
keeps one. All but the last stage return the columns they get, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenelake.llm import decontaminate, minhash_dedup, packing, quality, suffix_dedup
from scenelake.llm.common import remove, scratch, scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels none is rejected."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates."""
    return minhash_dedup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the characters of which every byte lies in a 100-byte string that also starts earlier."""
    return suffix_dedup.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, less the runs of over twelve words that items have too."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), longest=12)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", first_of_near_duplicates),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: A trained classifier, hashed signatures and a tokenizer decide the rows, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's scratch tables go once its result is written, and so does that of the
    stage before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
