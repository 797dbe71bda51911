import numpy as np
import pytest

from pairrank.operators import pruning
from pairrank.operators import similarity as sim
from pairrank.operators.ranking import rank_candidates


def clustered(seed, n, size, kinds, spread):
    draw = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(0, 1, (kinds, size))
    return (centres[draw.integers(kinds, size=n)] + draw.normal(0, spread, (n, size))).tolist()


def sides(spark, a, b, parts=3):
    def table(vectors):
        rows = [(f"n{i % 50}", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
        return spark.createDataFrame(rows, "id string, pos long, embedding array<double>").repartition(parts)

    return sim.as_candidates(table(a), "id", "pos"), sim.as_jobs(table(b), "id", "pos")


def rows(df):
    return sorted(map(str, df.collect()))


ODD = [[0.0] * 6, [1.0, 0, 0, 0, 0, 0], [-1.0, 0, 0, 0, 0, 0], [0.0] * 6]
CASES = {
    "clusters": (clustered(1, 300, 6, 5, 0.1), clustered(2, 90, 6, 5, 0.1)),
    "no structure": (clustered(3, 200, 6, 1, 5.0), clustered(4, 70, 6, 1, 5.0)),
    "copies and zeros": (ODD * 10 + clustered(5, 100, 6, 3, 0.05), ODD * 3 + clustered(6, 40, 6, 3, 0.0)),
    "only zeros": (ODD[:1] * 5, ODD[:1] * 3),
}


@pytest.mark.parametrize("case", CASES)
def test_same_pairs_and_ranks_as_without_pruning(spark, monkeypatch, case):
    """Blocks hold a few vectors only, so every group is cut on both sides."""
    monkeypatch.setattr(pruning, "BLOCK_BYTES", 8 * 6 * 20)
    monkeypatch.setattr(sim, "CELL_PARTITIONS", 1)
    candidates, jobs = sides(spark, *CASES[case])
    for threshold in (0.0, 0.7):
        got = pruning.pairs_above(candidates, jobs, threshold, pivots=8)
        assert rows(got) == rows(sim.pairs_above(candidates, jobs, threshold))
    for k, positive, decimals in ((7, False, None), (3, True, 2)):
        got = rank_candidates(pruning.best_per_job(candidates, jobs, k, positive, decimals, pivots=8), k)
        assert rows(got) == rows(rank_candidates(sim.best_per_job(candidates, jobs, k, positive, decimals=decimals), k))


def test_vectors_that_are_not_finite(spark, monkeypatch):
    monkeypatch.setattr(sim, "CELL_PARTITIONS", 1)
    nan, inf = float("nan"), float("inf")
    odd = [[nan, 1.0, 0.0], [inf, 0.0, 1.0], [1.0, 2.0, 3.0], [0.5, -1.0, 2.0]]
    candidates, jobs = sides(spark, odd, odd)
    assert rows(pruning.pairs_above(candidates, jobs, 0.2)) == rows(sim.pairs_above(candidates, jobs, 0.2))
    for k in (3,):
        want = rank_candidates(sim.best_per_job(candidates, jobs, k), k)
        assert rows(rank_candidates(pruning.best_per_job(candidates, jobs, k), k)) == rows(want)


def test_empty_sides(spark):
    candidates, jobs = sides(spark, ODD, ODD)
    none = candidates.where("false"), jobs.where("false")
    for c, j in ((none[0], jobs), (candidates, none[1]), none):
        assert pruning.pairs_above(c, j, 0.5).count() == 0 and pruning.best_per_job(c, j, 2).count() == 0


def test_share_of_scored_pairs(spark):
    """On clusters most pairs are left out; without structure hardly any, and never more are scored than there are."""
    candidates, jobs = sides(spark, clustered(7, 4_000, 16, 40, 0.05), clustered(8, 2_000, 16, 40, 0.05))
    assert pruning.scored_share(candidates, jobs, threshold=0.9) < 0.1
    assert pruning.scored_share(candidates, jobs, k=5) < 0.15
    loose = sides(spark, clustered(9, 300, 16, 1, 9.0), clustered(10, 200, 16, 1, 9.0))
    assert 0.5 < pruning.scored_share(*loose, threshold=0.1) <= 1.0
