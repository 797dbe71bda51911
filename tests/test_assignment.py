import random

import numpy as np
import pytest

from pairrank.operators import similarity as sim
from pairrank.operators.assignment import as_assignment_table, assign_best, greedy_assign, in_pick_order

SCHEMA = "candidate_id string, candidate_position long, job_id string, job_position long, similarity double"


def frame(spark, scores):
    return spark.createDataFrame([(f"c{c}", c, f"j{j}", j, s) for (j, c), s in scores.items()], SCHEMA)


def sequential(scores, capacity):
    """The rule, one pair at a time."""
    taken, load, picks = set(), {}, []
    for s, j, c in sorted((-s, j, c) for (j, c), s in scores.items() if s > 0):
        if j not in taken and load.get(c, 0) < capacity:
            taken.add(j)
            load[c] = load.get(c, 0) + 1
            picks.append((j, c, -s))
    return picks


def picks(df):
    return [(r.job_position, r.candidate_position, r.similarity) for r in in_pick_order(df).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    jobs, people, capacity = rng.randint(1, 25), rng.randint(1, 10), rng.randint(1, 3)
    values = [0.1, 0.2, 0.3, 0.4] if seed % 2 else [rng.uniform(-0.3, 1) for _ in range(50)]
    scores = {(j, c): rng.choice(values) for j in range(jobs) for c in range(people)}
    assert picks(greedy_assign(frame(spark, scores), capacity)) == sequential(scores, capacity)


def test_one_candidate_is_best_for_every_job(spark):
    scores = {(j, c): 1.0 - c / 10 - j / 1000 for j in range(9) for c in range(6)}
    assert picks(greedy_assign(frame(spark, scores), 2)) == sequential(scores, 2)


@pytest.mark.parametrize("capacity", [1, 2])
def test_rounds_grow_with_the_logarithm_of_contested_pairs(spark, capacity):
    """One order of candidates for 40 jobs would take a round per candidate without blocks."""
    scores = {(j, c): 1.0 - c / 100 - j / 100_000 for j in range(40) for c in range(30)}
    assert picks(greedy_assign(frame(spark, scores), capacity, max_rounds=11, first_block=16)) == sequential(scores, capacity)


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks_with_ties(spark, seed):
    rng = random.Random(seed)
    scores = {(j, c): rng.choice([0.2, 0.4, 0.4]) - (c // 4) / 10 for j in range(24) for c in range(9)}
    assert picks(greedy_assign(frame(spark, scores), 2, first_block=5)) == sequential(scores, 2)


def test_nothing_positive(spark):
    assert greedy_assign(frame(spark, {(0, 0): 0.0, (1, 0): -1.0, (2, 0): float("nan")})).count() == 0


def test_public_columns(spark):
    table = as_assignment_table(greedy_assign(frame(spark, {(0, 0): 0.5})))
    assert [r.asDict() for r in table.collect()] == [{"Job": "j0", "Candidate": "c0", "Similarity": 0.5}]


def test_too_few_rounds_raise(spark):
    scores = {(j, c): 1.0 - c / 10 - j / 1000 for j in range(6) for c in range(6)}
    with pytest.raises(RuntimeError):
        greedy_assign(frame(spark, scores), 1, max_rounds=2)


@pytest.mark.parametrize("options", [{}, {"small_side_bytes": 0, "cell_bytes": 300}, {"first_block": 3}])
def test_from_vectors_fetching_few_candidates_at_a_time(spark, options):
    rng = np.random.default_rng(11)
    people, jobs = rng.integers(-2, 4, (8, 3)).astype(float), rng.integers(-2, 4, (21, 3)).astype(float)
    people[:3] = people[0]
    schema = "id long, pos long, embedding array<double>"
    c = sim.as_candidates(spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(people)], schema), "id", "pos")
    j = sim.as_jobs(spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(jobs)], schema), "id", "pos")
    pairs = sim.pair_similarity(c, j, decimals=9)
    scores = {(r.job_position, r.candidate_position): r.similarity for r in pairs.collect()}
    assert picks(assign_best(c, j, 2, depth=2, **options)) == sequential(scores, 2)
