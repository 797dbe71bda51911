"""Scores that do not depend on the plan, names that are no keys, failures that show, linear text functions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairrank.functions.text import WS, trim_ws
from pairrank.functions.years import years_of_experience
from pairrank.models.retry import NotRetryable, RetryPolicy
from pairrank.operators import membership, ranking
from pairrank.operators import similarity as sim
from pairrank.operators.extraction import ModelField, extract_fields


def side(spark, vectors, names, shape):
    rows = [(n, i, v.tolist()) for i, (n, v) in enumerate(zip(names, vectors))]
    return shape(spark.createDataFrame(rows, "name string, at long, embedding array<double>"), "name", "at")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("cells", [False, True])
def test_unrounded_scores_do_not_depend_on_the_plan(spark, monkeypatch, seed, cells):
    draw = np.random.default_rng(seed)
    kinds = draw.normal(size=(4, 24))
    kinds[3] = kinds[2] * (1 + 1e-15)
    people, wanted = kinds[draw.integers(0, 4, 70)], np.vstack([kinds, draw.normal(size=(9, 24))])
    candidates = side(spark, people, [f"c{i}" for i in range(70)], sim.as_candidates).repartition(3)
    jobs = side(spark, wanted, [f"j{i}" for i in range(13)], sim.as_jobs)
    options = {"small_side_bytes": 0, "cell_bytes": 4000} if cells else {}
    unit = [v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] for v in (people, wanted)]
    scores = np.zeros((70, 13))
    for k in range(24):
        scores += unit[0][:, k, None] * unit[1][None, :, k]
    for tile in (2048, 7, 1):
        monkeypatch.setattr(sim, "TILE_CANDIDATES", tile)
        monkeypatch.setattr(sim, "TILE_JOBS", max(1, tile // 2))
        pairs = sim.pair_similarity(candidates, jobs, **options).collect()
        assert all(r.similarity == scores[r.candidate_position, r.job_position] for r in pairs) and len(pairs) == scores.size
        above = sim.pairs_above(candidates, jobs, 0.5, **options).collect()
        assert sorted((r.candidate_position, r.job_position, r.similarity) for r in above) == [
            (c, j, scores[c, j]) for c in range(70) for j in range(13) if scores[c, j] >= 0.5]
        best = ranking.rank_candidates(sim.best_per_job(candidates, jobs, 3, **options), 3).collect()
        want = {(j, int(c)) for j in range(13) for c in np.lexsort((np.arange(70), -scores[:, j]))[:3]}
        assert {(r.job_position, r.candidate_position) for r in best} == want


def test_repeated_names_keep_their_rows(spark):
    pairs = spark.createDataFrame([("A", 0, "x", 0.1), ("A", 1, "x", 0.2), ("B", 2, "x", 0.3), ("A", 0, "y", 0.4)],
                                  "candidate_id string, candidate_position long, job_id string, similarity double")
    rows = sim.to_matrix(pairs, ["x", "y"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("A", 0.1, 0.4), ("A", 0.2, None), ("B", 0.3, None)]
    people = spark.createDataFrame([("A", 0, True), ("A", 1, False), ("B", 2, None)], "candidate_id string, candidate_position long, flag boolean")
    got = membership.attach_status(pairs, people, "flag").collect()
    assert sorted((r.candidate_position, r.job_id, r.flag) for r in got) == [(0, "x", True), (0, "y", True), (1, "x", False), (2, "x", None)]
    by_name = membership.attach_status(pairs, people.drop("candidate_position"), "flag").collect()
    assert len(by_name) == 4 and all(r.flag for r in by_name if r.candidate_id == "A")


def test_wide_matrix_loses_nothing(spark):
    pairs = spark.createDataFrame([("A", 0, "x", 0, 0.1), ("A", 0, "x", 1, 0.2)],
                                  "candidate_id string, candidate_position long, job_id string, job_position long, similarity double")
    for jobs in (["x"], ["y"]):  # a title that two jobs bear, a job that is not listed
        with pytest.raises(Exception, match="several scores|not listed"):
            sim.to_matrix(pairs, jobs).collect()
    with pytest.raises(ValueError):
        sim.to_matrix(pairs, ["x", "x"])


class Rejecting:
    def answer(self, prompts):
        raise NotRetryable("wrong key")


class Choosy:
    def answer(self, prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]


def test_a_rejected_request_ends_the_job(spark):
    texts = spark.createDataFrame([(f"t{i}",) for i in range(9)] + [("bad",)], "text string")
    quick = RetryPolicy(tries=1)
    with pytest.raises(Exception, match="wrong key"):
        extract_fields(texts, "text", {"f": ModelField(Rejecting(), "{text}", "f", retry=quick)}).collect()
    got = extract_fields(texts, "text", {"f": ModelField(Choosy(), "{text}", "f", retry=quick)}).collect()
    assert sorted(r.f for r in got if r.f) == [f"T{i}" for i in range(9)]
    assert [list(r.errors) for r in got if r.text == "bad"] == [["f"]]


def test_white_space_and_digits_in_linear_time(spark):
    n = 1_000_000
    texts = [f"a{' ' * n}b", " " * n, "1" + " " * n + "x", "7" * n, "\u3000 a \u2003\x1c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    start = time.time()
    trimmed = [r.n for r in df.select("i", F.length(trim_ws(F.col("t"))).alias("n")).orderBy("i").collect()]
    assert trimmed == [n + 2, 0, n + 2, n, 1]
    years = [r.y for r in df.select("i", years_of_experience(F.col("t")).alias("y")).orderBy("i").collect()]
    assert years[:3] == [0.0, 0.0, 0.0]
    assert time.time() - start < 30
    every = "".join(map(chr, range(1, 0xD800)))
    kept = spark.createDataFrame([(c,) for c in every], "c string").select(F.count_if((trim_ws(F.col("c")) == "") != F.col("c").rlike(f"^{WS}$"))).first()[0]
    assert kept == 0


@pytest.mark.parametrize("people, wanted", [(150_000, 150_000), (10**6, 10**6), (10**9, 10**4), (200_000, 20_000), (10**9, 10**9), (7000, 3000)])
def test_the_grid_makes_few_copies(people, wanted):
    rows, cells = 131_072, 800
    down, across = sim._grid(people, wanted, rows, cells)
    assert down * across >= min(cells, people * wanted) and people / down <= rows and wanted / across <= rows
    least = max(cells, -(-people // rows) * -(-wanted // rows))
    best = min(people * a + wanted * max(-(-people // rows), -(-least // a)) for a in {-(-wanted // rows), *range(1, 2000)} if wanted / a <= rows) \
        if wanted / 2000 <= rows else 2 * (least * people * wanted) ** 0.5
    assert people * across + wanted * down <= 2 * best
