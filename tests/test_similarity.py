import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairrank.functions.vectors import cosine
from pairrank.operators import similarity as sim
from pairrank.operators.ranking import as_match_table, first_matches, in_report_order, rank_candidates, top_matches

SMALL = {}
CELLS = {"small_side_bytes": 0, "cell_bytes": 400}


def side(spark, shape, vectors, ids=None):
    rows = [((ids[i] if ids else i), i, v) for i, v in enumerate(vectors)]
    kind = "string" if ids else "long"
    return shape(spark.createDataFrame(rows, f"id {kind}, pos long, embedding array<double>"), "id", "pos")


def random_vectors(seed, n, copies=0):
    v = np.random.default_rng(seed).integers(-3, 4, (n, 4)).astype(float)
    v[:copies] = v[0]
    return v.tolist()


def brute(candidates, jobs):
    out = {}
    for j, b in enumerate(jobs):
        for c, a in enumerate(candidates):
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            out[c, j] = float(np.dot(a, b) / ((na or 1) * (nb or 1)))
    return out


def best(scores, jobs, k):
    out = []
    for j in range(jobs):
        mine = sorted((-round(s, 6), c) for (c, jj), s in scores.items() if jj == j)[:k]
        out += [(j, c, rank) for rank, (_, c) in enumerate(mine, 1)]
    return out


@pytest.mark.parametrize("options", [SMALL, CELLS])
@pytest.mark.parametrize("n,m", [(30, 7), (7, 30)])
def test_every_path_gives_the_same_scores(spark, options, n, m):
    a, b = random_vectors(1, n), random_vectors(2, m)
    c, j = side(spark, sim.as_candidates, a), side(spark, sim.as_jobs, b, [f"job {i}" for i in range(m)])
    want = brute(a, b)
    pairs = sim.pair_similarity(c, j, **options).collect()
    assert len(pairs) == n * m
    assert all(abs(r.similarity - want[r.candidate_id, int(r.job_id[4:])]) < 1e-12 for r in pairs)
    above = {(r.candidate_id, r.job_position) for r in sim.pairs_above(c, j, 0.5, decimals=6, **options).collect()}
    assert above == {k for k, s in want.items() if round(s, 6) >= 0.5}


@pytest.mark.parametrize("options", [SMALL, CELLS])
@pytest.mark.parametrize("n,m", [(60, 9), (9, 60)])
def test_top_matches_with_a_third_of_copies(spark, options, n, m):
    a, b = random_vectors(3, n, copies=n // 3), random_vectors(4, m, copies=m // 3)
    c, j = side(spark, sim.as_candidates, a), side(spark, sim.as_jobs, b)
    got = top_matches(c, j, 4, decimals=6, **options).collect()
    assert sorted((r.job_id, r.candidate_id, r["rank"]) for r in got) == sorted(best(brute(a, b), m, 4))


def test_fewer_candidates_than_asked_for(spark):
    c, j = side(spark, sim.as_candidates, [[1.0, 0.0], [0.0, 1.0]]), side(spark, sim.as_jobs, [[1.0, 1.0]])
    assert top_matches(c, j, 5, decimals=6).count() == 2


def test_no_cross_join_is_planned(spark, plan):
    c, j = side(spark, sim.as_candidates, random_vectors(1, 9)), side(spark, sim.as_jobs, random_vectors(2, 5))
    for options in (SMALL, CELLS):
        text = plan(top_matches(c, j, 2, **options))
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert "WindowGroupLimit" in text


def test_empty_input_keeps_the_schema(spark):
    c, j = side(spark, sim.as_candidates, [[1.0]]), side(spark, sim.as_jobs, [[1.0]])
    empty = top_matches(c, j.where("false"))
    assert empty.count() == 0
    assert as_match_table(empty).dtypes == [("Job", "bigint"), ("Candidate", "bigint"), ("Similarity", "double"), ("Rank", "int")]


@pytest.mark.parametrize("options", [SMALL, CELLS])
def test_bad_vectors_fail(spark, options):
    good = side(spark, sim.as_jobs, [[1.0, 0.0]] * 3)
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, 2.0], None], [[1.0, None]], [[1.0, 2.0, 3.0]]):
        with pytest.raises(Exception, match="vector|element"):
            sim.pair_similarity(side(spark, sim.as_candidates, bad), good, **options).collect()
    some = sim.drop_missing_vectors(side(spark, sim.as_candidates, [[1.0, 2.0], None]))
    assert sim.pair_similarity(some, good, **options).count() == 3


def test_cosine_of_two_columns(spark):
    rows = [([1.0, 2.0], [2.0, 4.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0, 0.0], [0.0, 1.0], 0.0),
            ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], None)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    for r in df.select(cosine(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r.got is r.want is None or abs(r.got - r.want) < 1e-12
    with pytest.raises(Exception, match="different size"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


def pairs_frame(spark, rows):
    return spark.createDataFrame(
        rows, "candidate_id string, candidate_position long, job_id string, job_position long, similarity double"
    )


def test_thresholds(spark):
    nan = float("nan")
    pairs = pairs_frame(spark, [("a", 0, "j", 0, 0.5), ("b", 1, "j", 0, nan), ("c", 2, "j", 0, 0.49), ("d", 3, "j", 0, None)])
    assert [r.candidate_id for r in sim.threshold_rows(pairs, 0.5).collect()] == ["a"]
    masked = {r.candidate_id: r.similarity for r in sim.threshold_mask(pairs, 0.5).collect()}
    assert masked == {"a": 0.5, "b": None, "c": None, "d": None}
    assert [r.candidate_id for r in sim.positive_pairs(pairs).collect()] == ["a", "c"]


def test_rank_order(spark):
    nan = float("nan")
    pairs = pairs_frame(spark, [
        ("x", 5, "j", 1, 0.2), ("y", 1, "j", 1, 0.9), ("x", 0, "j", 1, 0.9), ("n", 2, "j", 1, nan),
        ("m", 3, "j", 1, None), ("z", 0, "i", 0, -0.5),
    ])
    ranked = in_report_order(rank_candidates(pairs, 5)).collect()
    assert [(r.job_id, r.candidate_position, r["rank"]) for r in ranked] == [
        ("i", 0, 1), ("j", 0, 1), ("j", 1, 2), ("j", 5, 3), ("j", 2, 4), ("j", 3, 5),
    ]
    assert [r.candidate_position for r in first_matches(rank_candidates(pairs, 2), 2).collect()] == [0, 0]


def test_matrix_and_back(spark):
    a, b = random_vectors(5, 6), random_vectors(6, 3)
    names = ["Chef.", "a`b", "Cook 1"]
    pairs = sim.pair_similarity(side(spark, sim.as_candidates, a), side(spark, sim.as_jobs, b, names), decimals=6)
    matrix = sim.to_matrix(pairs, names)
    assert matrix.columns == ["candidate_id", *names]
    back = {(r.candidate_id, r.job_id): r.similarity for r in sim.to_long(matrix).collect()}
    assert back == {(r.candidate_id, r.job_id): r.similarity for r in pairs.collect()}
    with pytest.raises(ValueError):
        sim.to_matrix(pairs, list(map(str, range(10_001))))


def vectors(values, first=0):
    positions = list(range(first, first + len(values)))
    return sim._Vectors(pa.table({
        "id": pa.array([f"c{p}" for p in positions]), "position": pa.array(positions, pa.int64()),
        "embedding": pa.array(values, pa.list_(pa.float64())),
    }))


small = st.lists(st.lists(st.sampled_from([-1.0, 0.0, 1.0, 2.0, float("nan")]), min_size=2, max_size=2), min_size=1, max_size=25)


@pytest.fixture(params=[64, 0], ids=["exact", "single"])
def precision(request, monkeypatch):
    """At 0 every tile goes through the single-precision product first."""
    monkeypatch.setattr(sim, "SINGLE_PRECISION_BELOW", request.param)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(small, small, st.integers(1, 4), st.booleans(), st.integers(1, 9))
def test_running_best_equals_sorting(precision, candidates, jobs, k, positive, batch):
    out = sim.BestPerJob(k, positive, vectors(jobs), 6)
    for start in range(0, len(candidates), batch):
        list(out.add(vectors(candidates[start:start + batch], start)))
    got = sorted((j, p) for b in out.finish() for j, p in zip(b["job_position"].to_pylist(), b["candidate_position"].to_pylist()))
    whole, target = vectors(candidates).unit, vectors(jobs).unit
    want = []
    for j in range(len(jobs)):
        scores = np.round(whole @ target[j], 6)
        keyed = [(-np.inf if np.isnan(s) else s, p) for p, s in enumerate(scores)]
        if positive:
            keyed = [x for x in keyed if x[0] > 0]
        want += [(j, p) for _, p in sorted(keyed, key=lambda x: (-x[0], x[1]))[:k]]
    assert got == sorted(want)


def test_tiles_are_merged(precision, monkeypatch):
    monkeypatch.setattr(sim, "TILE_JOBS", 3)
    monkeypatch.setattr(sim, "TILE_CANDIDATES", 4)
    a, b = random_vectors(7, 50, copies=20), random_vectors(8, 10)
    out = sim.BestPerJob(3, False, vectors(b), 6)
    list(out.add(vectors(a)))
    got = sorted((j, p) for x in out.finish() for j, p in zip(x["job_position"].to_pylist(), x["candidate_position"].to_pylist()))
    assert got == sorted((j, c) for j, c, _ in best(brute(a, b), 10, 3))


def test_single_precision_loses_no_pair(precision):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((3000, 64)), rng.standard_normal((40, 64))
    whole, target = vectors(a.tolist()), vectors(b.tolist())
    scores = target.unit @ whole.unit.T
    # Thresholds right at, and one step above, a score that occurs.
    for threshold in (float(np.partition(scores.ravel(), -50)[-50]), 0.25):
        out = sim.PairsAbove(threshold, target, 9)
        got = sum(x.num_rows for x in out.add(whole))
        assert got == np.count_nonzero(np.round(scores, 9) >= threshold)
    out = sim.BestPerJob(5, False, target, None)
    for start in range(0, 3000, 500):
        list(out.add(vectors(a[start:start + 500].tolist(), start)))
    got = sorted((j, p) for x in out.finish() for j, p in zip(x["job_position"].to_pylist(), x["candidate_position"].to_pylist()))
    assert got == sorted((j, int(p)) for j in range(40) for p in np.argsort(-scores[j])[:5])


CELL = """
import resource, sys
import numpy as np, pyarrow as pa
from pairrank.operators import similarity as S

def side(names, rows, width, seed):
    values = pa.array(np.random.default_rng(seed).normal(size=rows * width))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width), pa.int32()), values)
    return pa.table({names[0]: pa.array(np.arange(rows)), names[1]: pa.array(np.arange(rows)), "embedding": vectors})

def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024

width = 1024
rows = S.CELL_BYTES // (8 * width)
before = peak()
jobs, people = side(S.JOB, rows, width, 1), side(S.CANDIDATE, rows, width, 2)
out = S.BestPerJob(5, False, S._Vectors(jobs), None)
found = [*out.add(S._Vectors(people)), *out.finish()]
assert sum(b.num_rows for b in found) == 5 * rows
print((peak() - before) / S.CELL_BYTES)
"""


def test_memory_of_a_full_cell():
    """Both sides of a cell and the work on them take some twelve times the bound of one side."""
    done = subprocess.run([sys.executable, "-c", CELL], capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout) < 14
