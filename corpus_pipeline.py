"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``, and further columns of ``docs`` whatever their names.

Defined results: null and empty texts fail the quality rules; a stage that is given them all the same
keeps them, but for line dedup, see there. Rows repeated with their doc_id are one document, and stay
or go together. Empty tables give empty tables; without benchmark items nothing is decontaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import decontaminate, line_dedup, min_max_hash, packing, quality_rules
from schemaloom.llm.common import WORD, stored, unused

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents that pass every rule."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: later repeated runs of lines are cut from the texts; n_chars follows the text.

    A text of which the cut leaves fewer words than the quality rules ask for, as of a whole copy, goes
    with its row. A text that isn't cut stays, however short it is.
    """
    removed = unused("removed", docs)
    out = line_dedup.dedup(docs, removed=removed)
    out = out.where((F.col(removed) == 0) | (F.regexp_count("text", F.lit(WORD)) >= quality_rules.MIN_WORDS)).drop(removed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, on five-word shingles: one document of each group of near duplicates.

    A near copy that has lost lines to line dedup is no longer like its original, so documents also stand
    for their text in ``documents`` where theirs is what the cut left of it: all its lines are lines of that text.
    """
    own = docs.select("doc_id", F.col("text").alias("own"))
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Each text of a doc_id once, or rows repeated with it would meet in pairs.
    ids = docs.select("doc_id", F.xxhash64("text").alias("x")).distinct().join(whole.select("doc_id", F.xxhash64("text").alias("y")).distinct(), "doc_id").where("x != y").select("doc_id").distinct()
    ids = stored(ids, "cut")
    once = lambda rows, c: rows.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64(c)).dropDuplicates(["doc_id", "h"]).drop("h")
    cut = once(whole, "text").join(once(own, "own"), "doc_id")
    split = lambda c: F.split(c, "\n")
    cut = cut.where((F.size(split("own")) < F.size(split("text"))) & (F.size(F.array_except(split("own"), split("text"))) == 0))
    # Few rows, which the operator reads several times.
    return min_max_hash.keep(docs, k=5, also=stored(cut.select("doc_id", "text"), "whole"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents that hold no benchmark item."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of windows of 4096 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminated), ("packing", packed)]

#: Packing runs a tokenizer and a dynamic program, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
