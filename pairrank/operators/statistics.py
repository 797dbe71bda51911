"""Summaries of ranked matches. Input: ``job_id, job_position, candidate_id, similarity, rank``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairrank.functions.text import fixed_decimals


def ranking_summary(ranked: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: how many candidates and jobs appear, and the mean score."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return ranked.agg(
        distinct("candidate_id").alias("unique_candidates"),
        distinct("job_id").alias("unique_jobs"),
        F.avg("similarity").alias("avg_similarity"),
    )


def versatile_candidates(ranked: DataFrame) -> DataFrame:
    """Candidates on more than one list, with the number of lists."""
    return ranked.groupBy("candidate_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def competitive_jobs(ranked: DataFrame) -> DataFrame:
    """Mean score of each job's list."""
    return ranked.groupBy("job_id").agg(F.avg("similarity").alias("avg_similarity"))


def analyze_rankings(ranked: DataFrame) -> dict[str, DataFrame]:
    """All three summaries; the keyed ones from high to low."""
    return {
        "summary": ranking_summary(ranked),
        "versatile_candidates": versatile_candidates(ranked).orderBy(F.desc("n"), "candidate_id"),
        "competitive_jobs": competitive_jobs(ranked).orderBy(F.desc("avg_similarity"), "job_id"),
    }


def match_summary(ranked: DataFrame, lines: int = 5) -> DataFrame:
    """The printed report: per job, its first ``lines`` candidates as numbered lines."""
    line = F.concat(
        F.lit("  "), F.col("rank"), F.lit(". "), F.col("candidate_id"),
        F.lit(" - Score: "), fixed_decimals(F.col("similarity"), 2),
    )
    # The rank bounds every list before it is collected.
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return (
        ranked.where(F.col("rank") <= lines).groupBy("job_id", "job_position").agg(listed.alias("_lines"))
        .select("job_id", F.array_join(F.col("_lines.line"), "\n").alias("summary"))
    )


def store_counts(looked_up: DataFrame, embedding: str = "embedding") -> DataFrame:
    """How many vectors were loaded and how many are still to be made."""
    return looked_up.agg(*_store_counts(embedding))


def observe_store_counts(looked_up: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, Observation]:
    """The same counts without a pass of their own: the first job that writes the returned table counts its rows.

    ``observation.get`` then holds ``loaded`` and ``pending``.
    """
    observation = Observation()
    return looked_up.observe(observation, *_store_counts(embedding)), observation


def _store_counts(embedding: str):
    return F.count_if(F.col(embedding).isNotNull()).alias("loaded"), F.count_if(F.col(embedding).isNull()).alias("pending")
