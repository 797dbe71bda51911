"""Assignment of jobs to candidates under a capacity, greedy by score.

The sequential rule: take the best remaining pair (score, then lower job position,
then lower candidate position), give the job away, and retire the candidate once it
holds its full number of jobs; stop when no score is above 0.

Both sides rank their pairs by that one order, so the greedy result is the only stable
matching, and deferred acceptance reaches it in parallel rounds:

1. every job proposes its best pair that is still alive;
2. every candidate holds the best proposals up to its capacity; once full, its worst
   held pair is its bar, and pairs below the bar are dead for good;
3. repeat until no proposal is turned down.

Bars only rise, so a held pair stays its job's best live one and the bars are all the
state a round hands on.

Jobs that want the same candidates in the same order would need a round per candidate. So
from the fourth round on, the best live pairs of all, a block of bounded size, also go through the
sequential rule in one task. Nothing better than the block is left out of it, so what it
gives away is settled, and a candidate it fills gets its last bar at once. Blocks double
from round to round up to their bound. A block ends early where a job runs out of fetched pairs
that may go on.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.operators.ranking import rank_candidates
from pairrank.operators.similarity import CANDIDATE, JOB, best_per_job, positive_pairs
from pairrank.runtime import materialise, measure

Refill = Callable[[DataFrame, DataFrame], DataFrame]
# Rounds after which the pairs still alive are written out, so that later rounds read less.
COMPACT_EVERY = 8
# Rounds before the first block: few wants in common settle in that many.
ROUNDS_BEFORE = 3
# Pairs of the first block and of the largest ones, some 50 MB in its task.
FIRST_BLOCK, LARGEST_BLOCK = 1 << 16, 1 << 20
PAIR = "job_position long, candidate_position long, similarity double"


def greedy_assign(pairs: DataFrame, max_jobs_per_candidate: int = 2, jobs: int | None = None,
                  max_rounds: int = 10_000, first_block: int = FIRST_BLOCK) -> DataFrame:
    """Assign from a table of scored pairs; ``jobs`` is how many jobs it holds, if known."""
    pairs = positive_pairs(pairs)
    if jobs is None:
        jobs = pairs.select(JOB[1]).distinct().count()
    # With J jobs at most (J-1)//capacity candidates can be full when a job is served,
    # so no job ever needs more than the one after those.
    needed = max(jobs - 1, 0) // max_jobs_per_candidate + 1
    lists = materialise(rank_candidates(pairs, needed), "pairs")
    return _rounds(lists, max_jobs_per_candidate, max_rounds, first_block)


def assign_best(candidates: DataFrame, jobs: DataFrame, max_jobs_per_candidate: int = 2, depth: int = 64,
                max_rounds: int = 10_000, decimals: int | None = 9, first_block: int = FIRST_BLOCK,
                **options) -> DataFrame:
    """The same result straight from vectors, without scoring tables of all pairs.

    Each job starts with its ``depth`` best candidates. A job that runs out gets the next
    ones, searched only among pairs that beat the candidates' bars, so nothing is cut off.
    Scores are rounded so that a pair scored again in another block compares equal.
    Where there are few candidates the lists hold them all from the start.
    """
    everyone = measure(candidates)[0][0]
    whole = everyone < 4 * depth
    depth = max(everyone, 1) if whole else depth

    def fill(side: DataFrame, wanted: DataFrame) -> DataFrame:
        best = best_per_job(side, wanted, depth, positive=True, decimals=decimals, **options)
        return materialise(rank_candidates(best, depth), "pairs")

    def refill(exhausted: DataFrame, bars: DataFrame) -> DataFrame:
        return fill(candidates.join(bars, CANDIDATE[1], "left"), jobs.join(exhausted, JOB[1], "left_semi"))

    lists = fill(candidates, jobs)
    return _rounds(lists, max_jobs_per_candidate, max_rounds, first_block, None if whole else refill, depth)


def in_pick_order(assignments: DataFrame) -> DataFrame:
    """Assignments in the order the sequential rule makes them."""
    return assignments.orderBy(F.desc("similarity"), "job_position", "candidate_position")


def as_assignment_table(assignments: DataFrame) -> DataFrame:
    """The public three-column form."""
    return assignments.select(
        F.col("job_id").alias("Job"), F.col("candidate_id").alias("Candidate"),
        F.col("similarity").alias("Similarity"),
    )


def _rounds(lists: DataFrame, capacity: int, max_rounds: int, block: int, refill: Refill | None = None,
            depth: int = 0) -> DataFrame:
    bars = settled = None
    # Jobs whose list may go on beyond what was fetched.
    open_jobs = _full_lists(lists, depth) if refill else None
    for round_number in range(1, max_rounds + 1):
        live = lists if bars is None else _alive(lists, bars)
        if round_number % COMPACT_EVERY == 0:
            lists = live = materialise(live, "pairs")
        proposals = materialise(_best_of_each_job(live), "proposals")
        if refill and bars is not None:
            exhausted = open_jobs.join(proposals, JOB[1], "left_anti")
            if not exhausted.isEmpty():
                more = refill(exhausted, bars)
                lists, live = lists.unionByName(more), live.unionByName(more)
                open_jobs = materialise(
                    open_jobs.join(exhausted, JOB[1], "left_anti").unionByName(_full_lists(more, depth)), "open"
                )
                proposals = materialise(proposals.unionByName(_best_of_each_job(more)), "proposals")
        placed = materialise(_place(proposals), "placed")
        held = placed.where(F.col("place") <= capacity)
        if placed.where(F.col("place") > capacity).isEmpty():
            return held.select(*JOB, *CANDIDATE, "similarity")
        bars = _bars(held.where(F.col("place") == capacity))
        if ROUNDS_BEFORE < round_number < max_rounds:
            settled = _settle(live, proposals, open_jobs, settled, capacity, block)
            bars = _higher_bars(bars, settled, capacity)
            block = min(2 * block, max(block, LARGEST_BLOCK))
    raise RuntimeError(f"no stable assignment after {max_rounds} rounds; raise max_rounds")


def _settle(live: DataFrame, proposals: DataFrame, open_jobs: DataFrame | None, settled: DataFrame | None,
            capacity: int, block: int) -> DataFrame:
    """The pairs settled so far, and those that the sequential rule gives away in the best ``block`` live pairs."""
    if settled is not None:
        loads = settled.groupBy(CANDIDATE[1]).agg(F.count("*").alias("load"))
        live = live.join(settled, JOB[1], "left_anti").join(loads, CANDIDATE[1], "left")
    else:
        live = live.withColumn("load", F.lit(0))
    best = _best_pairs(live, block)
    if best is None:
        return settled if settled is not None else live.select("job_position", "candidate_position", "similarity").limit(0)
    if open_jobs is not None:
        # A job's last fetched pair, where more may follow below it.
        ends = open_jobs.join(proposals.select(JOB[1], "last"), JOB[1])
        best = best.join(ends, JOB[1], "left")
    else:
        best = best.withColumn("last", F.lit(None).cast("int"))
    rows = best.select(JOB[1], CANDIDATE[1], "similarity", F.coalesce("load", F.lit(0)).alias("load"),
                       F.coalesce(F.col("rank") == F.col("last"), F.lit(False)).alias("ends"))
    given = rows.groupBy(F.lit(0).alias("block")).applyInPandas(lambda pairs: _in_sequence(pairs, capacity), PAIR)
    return materialise(given if settled is None else settled.unionByName(given), "settled")


def _best_pairs(live: DataFrame, block: int) -> DataFrame | None:
    """About ``block`` pairs above all others, cut by score and, among equal scores, by job; None if they can't be cut small."""
    count = live.count()
    if count <= block:
        return live
    share = block / count
    score = live.agg(F.percentile_approx("similarity", 1 - share, 100_000)).first()[0]
    at_score = F.col("similarity") == score
    above, ties = live.agg(F.count_if(F.col("similarity") > score), F.count_if(at_score)).first()
    within = F.col("similarity") > score
    if above < block:
        part = min(1.0, (block - above) / ties)
        job = live.where(at_score).agg(F.percentile_approx(JOB[1], part, 100_000)).first()[0]
        within = within | (at_score & (F.col(JOB[1]) <= job))
    best = live.where(within)
    return best if best.count() <= 2 * block else None


def _in_sequence(pairs: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The sequential rule on one block, up to the first job whose next pairs are not known."""
    pairs = pairs.sort_values(["similarity", "job_position", "candidate_position"], ascending=[False, True, True])
    load = dict(zip(pairs["candidate_position"], pairs["load"]))
    taken, given = set(), []
    columns = (pairs[c].tolist() for c in ("job_position", "candidate_position", "ends"))
    for at, (job, candidate, ends) in enumerate(zip(*columns)):
        if job in taken:
            continue
        if load[candidate] < capacity:
            load[candidate] += 1
            taken.add(job)
            given.append(at)
        elif ends:
            break
    return pairs.iloc[given][["job_position", "candidate_position", "similarity"]]


def _alive(lists: DataFrame, bars: DataFrame) -> DataFrame:
    joined = lists.join(bars, CANDIDATE[1], "left")
    return joined.where(_beats_bar()).select(*lists.columns)


def _beats_bar() -> Column:
    tie = (F.col("similarity") == F.col("bar")) & (F.col(JOB[1]) <= F.col("bar_job_position"))
    return F.col("bar").isNull() | (F.col("similarity") > F.col("bar")) | tie


def _best_of_each_job(live: DataFrame) -> DataFrame:
    best = F.min(F.struct("rank", *CANDIDATE, "similarity")).alias("best")
    found = live.groupBy(*JOB).agg(best, F.max("rank").alias("last"))
    return found.select(*JOB, *[f"best.{c}" for c in (*CANDIDATE, "similarity")], "last")


def _place(proposals: DataFrame) -> DataFrame:
    best_first = Window.partitionBy(CANDIDATE[1]).orderBy(F.desc("similarity"), JOB[1])
    return proposals.withColumn("place", F.row_number().over(best_first))


def _bars(worst: DataFrame) -> DataFrame:
    return worst.select(CANDIDATE[1], F.col("similarity").alias("bar"), F.col(JOB[1]).alias("bar_job_position"))


def _higher_bars(bars: DataFrame, settled: DataFrame, capacity: int) -> DataFrame:
    """Of each full candidate the higher bar: the one of this round's proposals or the settled one."""
    worst = F.min(F.struct("similarity", (-F.col(JOB[1])).alias("back"))).alias("worst")
    full = settled.groupBy(CANDIDATE[1]).agg(worst, F.count("*").alias("load")).where(F.col("load") == capacity)
    final = full.select(CANDIDATE[1], F.col("worst.similarity").alias("bar"), (-F.col("worst.back")).alias("bar_job_position"))
    higher = F.max(F.struct("bar", (-F.col("bar_job_position")).alias("back"))).alias("higher")
    both = bars.unionByName(final).groupBy(CANDIDATE[1]).agg(higher)
    return materialise(both.select(CANDIDATE[1], "higher.bar", (-F.col("higher.back")).alias("bar_job_position")), "bars")


def _full_lists(lists: DataFrame, depth: int) -> DataFrame:
    return lists.where(F.col("rank") == depth).select(JOB[1])
