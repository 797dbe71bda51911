"""Exact similarity joins that leave out what the triangle inequality rules out.

Angles between vectors are a metric. Jobs are grouped around pivots, some of them; a group
knows its radius, the largest angle from its pivot. A candidate at an angle ``a`` from the
pivot is at least ``a - radius`` away from every job of the group, so its best score there
is the cosine of that. Where this stays below what a job of the group still takes, the
candidate isn't sent to the group. What meets is scored by the routine that scores
everywhere, so the results are the same to the last bit.

On vectors that form clusters most pairs are never scored. On vectors without structure the
radii are wide and little is left out; :func:`scored_share` tells which it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairrank.operators import similarity as sim
from pairrank.operators.similarity import CANDIDATE, JOB
from pairrank.runtime import materialise, measure, spread

# Pivots, and the jobs among which they are looked for: those of the least hash.
PIVOTS, SAMPLE = 64, 4_096
# Vectors of one side that meet in a task.
BLOCK_BYTES = 8 << 20
# Of the bounds of candidates in groups that a task holds at once.
BOUNDS_BYTES = 4 << 20
# Jobs of a group are split by what they still take, in bands of this width.
BAND = 0.1
# Room for rounding, in angles and in scores.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


def unit_rows(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and their lengths; a zero vector or one that isn't finite becomes zeros."""
    matrix = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if len(v) != width:
            raise ValueError(f"vectors of different size: {len(v)} and {width}")
        matrix[i] = v
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    plain = np.isfinite(norms) & (norms > 0)
    return np.where(plain[:, None], matrix / np.where(plain, norms, 1.0)[:, None], 0.0), norms


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def chosen_pivots(jobs: DataFrame, width: int, n: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other: each next one is the job farthest from those before."""
    sample = jobs.select("embedding").orderBy(F.xxhash64(JOB[1]), JOB[1]).limit(SAMPLE).toPandas()
    units, norms = unit_rows(sample["embedding"], width)
    units = units[np.isfinite(norms) & (norms > 0)]
    if not len(units):
        return np.eye(1, width)
    chosen = [0]
    far = angles(units, units[:1])[:, 0]
    while len(chosen) < n and far.max() > ANGLE_SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(units, units[chosen[-1:]])[:, 0])
    return units[chosen]


def near_pivot(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with ``cell`` (the nearest pivot) and ``angle`` from it. Vectors without a direction have cell -1."""

    @F.pandas_udf("struct<cell: int, angle: double>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        units, norms = unit_rows(vectors, pivots.shape[1])
        away = angles(units, pivots)
        cell = away.argmin(1)
        plain = np.isfinite(norms) & (norms > 0)
        return pd.DataFrame({"cell": np.where(plain, cell, -1), "angle": np.where(plain, away[np.arange(len(cell)), cell], 0.0)})

    return df.withColumn("_at", place("embedding")).select(*df.columns, "_at.cell", "_at.angle")


def sent(candidates: DataFrame, groups: list, pivots: np.ndarray) -> DataFrame:
    """The candidates with ``groups``: those in which they can reach a score that is still taken.

    ``groups`` lists number, cell, radius and floor (the least score taken) of each.
    """
    cells = np.array([g.cell for g in groups])
    radii = np.array([g.radius for g in groups])
    floors = np.array([g.floor for g in groups])
    everywhere = cells < 0  # groups of jobs without a direction: no angle rules anything out

    @F.pandas_udf("array<int>")
    def reach(vectors: pd.Series) -> pd.Series:
        found, step = [], max(1, BOUNDS_BYTES // (8 * len(cells)))
        for start in range(0, len(vectors), step):
            units, norms = unit_rows(vectors.iloc[start:start + step], pivots.shape[1])
            least = np.maximum(angles(units, pivots)[:, np.maximum(cells, 0)] - radii - ANGLE_SLACK, 0.0)
            best = np.cos(least)
            best[norms == 0] = 0.0
            best[~np.isfinite(norms)] = -np.inf
            goes = (best + SCORE_SLACK >= floors) | everywhere
            found += [np.flatnonzero(row).astype(np.int32) for row in goes]
        return pd.Series(found, index=vectors.index, dtype=object)

    return candidates.withColumn("groups", reach("embedding"))


def _partitions(df: DataFrame, n_cells: int) -> int:
    """A task walks several cells if there are many."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(n_cells, sim.CELL_PARTITIONS * tasks))


def _joined(candidates: DataFrame, jobs: DataFrame, pivots: np.ndarray, collector: Callable, decimals: int | None,
            width: int) -> tuple[DataFrame, int]:
    """What the collector finds, and how many pairs are scored. ``jobs`` have cell, angle and floor."""
    schema = sim.pair_schema(candidates, jobs)
    jobs = jobs.withColumn("band", F.coalesce(F.floor(F.col("floor") / BAND), F.lit(-100)))
    groups = jobs.groupBy("cell", "band").agg(
        F.max("angle").alias("radius"), F.coalesce(F.min("floor"), F.lit(-math.inf)).alias("floor"), F.count("*").alias("n")
    ).orderBy("cell", "band").collect()  # at most some bands for each pivot
    numbers = candidates.sparkSession.createDataFrame([(g.cell, g.band, i) for i, g in enumerate(groups)], "cell int, band long, group int")
    # Written once per candidate: copies would shrink to little in a file, and a task that reads many of them
    # would hold them all for the shuffle.
    routed = materialise(sent(spread(candidates, CANDIDATE[1]), groups, pivots), "sent-candidates")
    n_sent = {r.group: r.n for r in routed.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect()}
    rows = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def blocks(counts: list[int]):
        return F.array(*(F.lit(-(-max(n, 1) // rows)) for n in counts))

    downs, acrosses = blocks([n_sent.get(i, 0) for i in range(len(groups))]), blocks([g.n for g in groups])

    def dealt(df: DataFrame, own: str, own_blocks, other: str, other_blocks) -> DataFrame:
        """Each row in its block of the group, once for each block of the other side."""
        block = F.pmod(F.xxhash64(df.columns[0], df.columns[1]), F.get(own_blocks, F.col("group")))
        copies = F.explode(F.sequence(F.lit(0), F.get(other_blocks, F.col("group")) - 1))
        return df.withColumn(own, block.cast("int")).withColumn(other, copies)

    def cells(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*columns, F.col("down").cast("long").alias("down"), (F.col("group").cast("long") * (1 << 32) + F.col("across")).alias("across"))

    n_blocks = [(-(-max(n_sent.get(i, 0), 1) // rows), -(-g.n // rows)) for i, g in enumerate(groups)]
    sizes = measure(routed, jobs)
    routed = sim.for_copies(routed, *sizes[0], sum(n_sent.get(i, 0) * across for i, (_, across) in enumerate(n_blocks)), width)
    jobs = sim.for_copies(jobs, *sizes[1], sum(g.n * down for g, (down, _) in zip(groups, n_blocks)), width)
    routed = routed.withColumn("group", F.explode("groups")).drop("groups")
    left = cells(dealt(routed, "down", downs, "across", acrosses), *CANDIDATE, "embedding")
    numbered = jobs.join(F.broadcast(numbers), ["cell", "band"]).select(*JOB, "embedding", "group")
    right = cells(dealt(numbered, "across", acrosses, "down", downs), *JOB, "embedding")
    scored = sum(g.n * n_sent.get(i, 0) for i, g in enumerate(groups))
    n_cells = sum(-(-g.n // rows) * -(-n_sent.get(i, 0) // rows) for i, g in enumerate(groups))
    return sim.score_cells(left, right, _partitions(candidates, n_cells), collector, decimals, schema), scored


def _sides(candidates: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    candidates, jobs = candidates.select(*CANDIDATE, "embedding"), jobs.select(*JOB, "embedding")
    return candidates, jobs, jobs.agg(F.max(F.size("embedding"))).first()[0]


def _above(candidates: DataFrame, jobs: DataFrame, threshold: float, decimals: int | None, n_pivots: int) -> tuple[DataFrame, int] | None:
    candidates, jobs, width = _sides(candidates, jobs)
    room = 0.0 if decimals is None else 0.5 * 10.0**-decimals
    if width is None or threshold - room <= 0:
        return None  # without a positive threshold nothing can be left out
    pivots = chosen_pivots(jobs, width, n_pivots)
    # Vectors without a direction score 0, or not at all.
    placed = materialise(near_pivot(jobs, pivots).where("cell >= 0").withColumn("floor", F.lit(threshold - room)), "placed-jobs")
    if placed.isEmpty():
        return None
    return _joined(candidates, placed, pivots, lambda *a: sim.PairsAbove(threshold, *a), decimals, width)


def pairs_above(candidates: DataFrame, jobs: DataFrame, threshold: float = 0.5, decimals: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """The pairs scoring at least ``threshold``, as :func:`similarity.pairs_above` has them."""
    found = _above(candidates, jobs, threshold, decimals, pivots)
    return sim.pairs_above(candidates, jobs, threshold, decimals=decimals) if found is None else found[0]


def _best(candidates: DataFrame, jobs: DataFrame, k: int, positive: bool, decimals: int | None, n_pivots: int) -> tuple[DataFrame, int] | None:
    candidates, jobs, width = _sides(candidates, jobs)
    if width is None:
        return None
    pivots = chosen_pivots(jobs, width, n_pivots)
    placed = materialise(near_pivot(jobs, pivots), "placed-jobs")
    at_home = materialise(near_pivot(candidates, pivots).where("cell >= 0"), "placed-candidates")

    def collector(*a):
        return sim.BestPerJob(k, positive, *a)

    # First each job's best among the candidates around its own pivot: the k-th of them is what it still takes.
    rows = max(1, BLOCK_BYTES // (8 * max(1, width)))
    home_jobs = placed.where("cell >= 0")
    counts = {side: {r.cell: r.n for r in t.groupBy("cell").agg(F.count("*").alias("n")).collect()} for side, t in (("down", at_home), ("across", home_jobs))}
    n_blocks = {side: F.array(*(F.lit(-(-max(n.get(c, 0), 1) // rows)) for c in range(len(pivots)))) for side, n in counts.items()}

    def dealt(df: DataFrame, own: str, other: str, *columns: str) -> DataFrame:
        block = F.pmod(F.xxhash64(df.columns[0], df.columns[1]), F.get(n_blocks[own], F.col("cell"))).cast("long")
        last = F.get(n_blocks[other], F.col("cell")).cast("long") - 1
        both = df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), last)))
        return both.select(*columns, "embedding", "down", (F.col("cell").cast("long") * (1 << 32) + F.col("across")).alias("across"))

    n_cells = sum(-(-n // rows) * -(-counts["down"].get(c, 0) // rows) for c, n in counts["across"].items())
    near = sim.score_cells(dealt(at_home, "down", "across", *CANDIDATE), dealt(home_jobs, "across", "down", *JOB),
                           _partitions(candidates, n_cells), collector, decimals, sim.pair_schema(candidates, jobs))
    first = Window.partitionBy(JOB[1]).orderBy(F.col("similarity").desc(), CANDIDATE[1])
    ranked = near.where(~F.isnan("similarity")).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k)
    room = 0.0 if decimals is None else 0.5 * 10.0**-decimals
    floors = ranked.where(F.col("_nth") == k).select(JOB[1], (F.col("similarity") - room).alias("floor"))
    asked = placed.join(floors, JOB[1], "left").select(*JOB, "embedding", "cell", "angle", "floor")
    asked = asked.withColumn("floor", F.greatest("floor", F.lit(-room))) if positive else asked
    at_first = sum(n * counts["down"].get(c, 0) for c, n in counts["across"].items())
    found, scored = _joined(candidates, materialise(asked, "asking-jobs"), pivots, collector, decimals, width)
    return found, scored + at_first


def best_per_job(candidates: DataFrame, jobs: DataFrame, k: int, positive: bool = False, decimals: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """A superset of each job's ``k`` best pairs, as :func:`similarity.best_per_job` has it; for :func:`ranking.rank_candidates`."""
    found = _best(candidates, jobs, k, positive, decimals, pivots)
    return sim.best_per_job(candidates, jobs, k, positive, decimals=decimals) if found is None else found[0]


def scored_share(candidates: DataFrame, jobs: DataFrame, threshold: float | None = None, k: int | None = None, pivots: int = PIVOTS) -> float:
    """The share of all pairs that :func:`pairs_above` (or with ``k`` :func:`best_per_job`, both its steps) scores."""
    found = _above(candidates, jobs, threshold, None, pivots) if k is None else _best(candidates, jobs, k, False, None, pivots)
    every = candidates.count() * jobs.count()
    return 1.0 if found is None or not every else found[1] / every
