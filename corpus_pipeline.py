"""Corpus cleaning pipeline: each stage is one operator of siftpool.llm over all that its predecessor kept.

Null and empty texts, repeated rows, empty tables and further columns are
handled as the operators' docstrings say; all stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.llm.decontaminate import without_items
from siftpool.llm.neardup import near_duplicates
from siftpool.llm.packing import retrieval_packed
from siftpool.llm.registry import vocabulary
from siftpool.llm.substring import without_repeats
from siftpool.llm.textops import fresh, written
from siftpool.llm.toxicity import fit_toxicity, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model is fitted on labelled documents."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return with_toxicity(docs, model, score=score, below=0.5).drop(score)


def _same(docs: DataFrame, other: Column) -> Column:
    """A value that rows share only if they repeat one document, id and text; other: what tells all further rows apart."""
    return F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.sha2(F.concat_ws(" ", "doc_id", "text"), 256)).otherwise(other)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, nulls last.

    Rows that repeat an id and its text are one document and stay or go
    together. Different texts of one id are documents of their own, and so is
    each row without an id.
    """
    row, same = fresh(docs, "row"), fresh(docs, "same")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn(same, _same(rows, F.concat(F.lit("row "), F.col(row))))
    groups = near_duplicates(rows, row).select(row, "component_id")
    ids = rows.select(row, F.col("doc_id").alias("own"), F.col(same).alias("same"))
    first = F.min_by("same", F.struct(F.col("own").isNull(), "own", row))
    stay = groups.join(ids, row).groupBy("component_id").agg(first.alias(same)).select(same)
    return rows.join(stay, same, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of every window of 35 words that occurs more than once go; n_chars follows.

    Rows that repeat an id and its text count once, and are all cut alike.
    """
    same = docs.select(_same(docs, F.lit(None)).alias("same")).where("same is not null").groupBy("same").agg(F.count("*").alias("n")).where("n > 1")
    if same.isEmpty():
        out = without_repeats(docs, window=35)
    else:
        row, key = fresh(docs, "row"), fresh(docs, "same")
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        rows = rows.withColumn(key, _same(rows, F.concat(F.lit("row "), F.col(row))))
        first = rows.groupBy(key).agg(F.min(row).alias(row)).select(row)
        cut = written(without_repeats(rows.join(first, row, "left_semi"), window=35), "cut")
        again = rows.drop("text").join(first, row, "left_anti").join(cut.select(key, "text"), key)
        out = cut.select(docs.columns).unionByName(again.select(docs.columns))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's shingles go."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of 1024 tokens; a row for each piece."""
    return retrieval_packed(docs, vocabulary(), size=1024)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("benchmark_decontamination", benchmark_decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
