"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of documents; the last
returns each kept document's id with its token ids and what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.llm import bpe, decontaminate, langid, line_dedup, simhash
from rentscope.llm.words import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as a learned language; others and those without a letter go. Labels of documents not held out teach it."""
    return langid.in_known_language(docs, langid.samples(docs.filter(~langid.held_out(docs))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts; documents of which nothing is left, though there was something, go."""
    out = line_dedup.drop_repeated_lines(docs)
    emptied = (F.size("removed_lines") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "")
    kept = out.filter(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays: the one with the smallest id."""
    groups = simhash.similar_groups(docs, width=5, similarity=0.8)
    others = groups.filter("component <> id").select(F.col("id").alias("gone")).distinct()
    return docs.join(others, docs["doc_id"] == others["gone"], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window similar to a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): little-endian 32-bit token ids of the texts.

    The ids are written before they are decoded, so that a task holds one Python worker at a time beside a heap that earlier stages have grown.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.decode(written(bpe.encode(docs, path, public_tokenizers.PATTERN), "pipeline-ids"), path)
    return made.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("byte_bpe", tokens),
]

#: Language ID, the similarity classes and the tokens can't be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
