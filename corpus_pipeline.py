"""The corpus pipeline: five stages over whole documents, each written before the next reads it.

Defined results, of every stage that keeps documents: the columns of documents come back
and no others; nulls in any column but doc_id and text are passed on. A null or empty text
is never toxic by itself (it gets the score of the examples without words), loses no lines,
is a copy of nothing and holds no benchmark item, so it stays and is taken 0 times by the
mix. A row without doc_id is scored and searched for benchmark items like any other, loses
no lines and is no copy. Rows that share a doc_id are one document: copies of an earlier
document go together, none is a copy of the other. Ties between copies go to the smallest
doc_id. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from stratafold.scratch import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score from nearest labelled examples is 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs.select(*COLUMNS), model, 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document holds leave the later one; what is left without a word goes."""
    rows = line_dedup.dedup(docs.select(*COLUMNS))
    rows = rows.filter((F.col("n_deleted") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return rows.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    gone = ngram_join.components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each kept document the mix takes."""
    return mixing.mix(docs)


#: In this order; each works on all that the one before kept.
STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
]

#: Nearest labelled examples, alignment and the link graph have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
