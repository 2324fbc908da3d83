"""Training-data pipeline over ``documents``: five stages, each one operator of ``tsflow.llm``.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet in the shared folder and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``; the
last returns ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what is left.

Rows are documents.  Null and empty texts go in the first stage.  A null id is kept as it is.
Empty tables pass through every stage; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsflow.llm import bpe, decontamination, line_dedup, quality_rules, simhash_dedup
from tsflow.llm.common import documents, tokenizer_path
from tsflow.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; ``n_chars`` follows the text.  A document of
    which nothing is left goes too."""
    kept = line_dedup.with_kept(docs, "text", min_docs=10, min_chars=1)
    done = kept.where((F.col("n_dropped") == 0) | (F.col("kept") != ""))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, 2 bits) the document with the smallest id stays."""
    return simhash_dedup.keep_one(docs, shingle=3, threshold=2)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers and names, go."""
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded; digests of both are the pipeline's result."""
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies),
          ("benchmark_decontamination", benchmark_leaks), ("bpe_codec", tokens)]

#: SQL expresses neither the learned rules nor BPE; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "pipeline")  # in the shared folder, deleted when the session's driver ends
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
