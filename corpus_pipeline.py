"""A training corpus from raw documents: quality, repeated lines, near copies, benchmark passages, mixture.

Every stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of ``documents``, in their order.
Each works on all that its predecessor kept. An empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from moteflow.llm import decontaminate, line_runs, lsh_forest, pairwise_quality, poisson_mix
from moteflow.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of ``CUT`` or more, ranked as the ``labels`` of the documents at hand prefer."""
    ranker = pairwise_quality.fit_ranker(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pairwise_quality.score_quality(docs, ranker).where(F.col("quality_score") >= pairwise_quality.CUT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; a document that loses all its lines goes."""
    out = line_runs.dedup_lines(docs)
    return out.where("lines_removed = 0 OR lines_removed < lines_seen").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; of rows that repeat id and text, one."""
    gone = lsh_forest.near_duplicates(docs).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; all documents stay."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order, with ``copy`` and ``shuffle_key``."""
    return poisson_mix.mix(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_copies), ("benchmark decontamination", benchmark_passages), ("mixture", mixture)]

#: Not expressible: the classifier's weights and minhash are no SQL. Tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
