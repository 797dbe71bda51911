"""Top matches per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairrank.operators.similarity import best_per_job


def rank_candidates(pairs: DataFrame, top_n: int = 5) -> DataFrame:
    """The ``top_n`` candidates of each job, ranked 1..n.

    Ties go to the lower candidate position. NaN and missing scores come last but
    still count when a job has fewer than ``top_n`` real scores.
    """
    best_first = Window.partitionBy("job_id", "job_position").orderBy(
        F.nanvl("similarity", F.lit(None).cast("double")).desc_nulls_last(), "candidate_position", "candidate_id"
    )
    return pairs.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top_n)


def top_matches(candidates: DataFrame, jobs: DataFrame, top_n: int = 5, **options) -> DataFrame:
    """Similarity join and ranking in one: the pair space is never written out."""
    return rank_candidates(best_per_job(candidates, jobs, top_n, **options), top_n)


def in_report_order(ranked: DataFrame) -> DataFrame:
    """Jobs in table order, best candidate first."""
    return ranked.orderBy("job_position", "rank")


def first_matches(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of the report."""
    return in_report_order(ranked).limit(n)


def as_match_table(ranked: DataFrame) -> DataFrame:
    """The public four-column form of ranked matches."""
    return ranked.select(
        F.col("job_id").alias("Job"), F.col("candidate_id").alias("Candidate"),
        F.col("similarity").alias("Similarity"), F.col("rank").alias("Rank"),
    )
