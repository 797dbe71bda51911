import random

import pytest
from pyspark.sql import functions as F

from pairrank.operators import membership, report, statistics
from pairrank.operators.lookup import lookup
from pairrank.operators.positions import dense_positions
from pairrank.operators.ranking import rank_candidates
from pairrank.operators.similarity import as_candidates, as_jobs


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [("b", 1, "cook", 0, 0.9), ("a", 0, "cook", 0, 0.126), ("a", 0, "maid", 1, 0.5)]
    pairs = spark.createDataFrame(rows, "candidate_id string, candidate_position long, job_id string, job_position long, similarity double")
    return rank_candidates(pairs, 5)


def test_ranking_statistics(ranked):
    found = statistics.analyze_rankings(ranked)
    summary = found["summary"].head()
    assert (summary.unique_candidates, summary.unique_jobs) == (2, 2)
    assert summary.avg_similarity == pytest.approx((0.9 + 0.126 + 0.5) / 3)
    assert [tuple(r) for r in found["versatile_candidates"].collect()] == [("a", 2)]
    assert [r.job_id for r in found["competitive_jobs"].collect()] == ["cook", "maid"]
    assert statistics.ranking_summary(ranked, approximate=True).head().unique_jobs == 2


def test_match_summary(ranked):
    lines = {r.job_id: r.summary for r in statistics.match_summary(ranked).collect()}
    assert lines["cook"] == "  1. b - Score: 0.90\n  2. a - Score: 0.13"
    assert {r.job_id: r.summary for r in statistics.match_summary(ranked, 1).collect()}["cook"].count("\n") == 0


def test_dense_positions_over_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("a b")).repartition(7)
    rows = dense_positions(df, ["k"], "at").collect()
    assert all(r.k == r.at for r in rows) and len(rows) == 1000
    assert dense_positions(df.where("k < 0"), ["k"], "at").count() == 0


def test_category_axis_and_spans(spark):
    jobs = spark.createDataFrame([(f"j{i}", i * 10) for i in range(6)], "job_id string, job_position long")
    categories = spark.createDataFrame([("j0", "b"), ("j3", "a"), ("j5", "b"), ("j9", "z")], "job_id string, category string")
    axis = report.category_axis(jobs, categories)
    assert [r.job_id for r in axis.orderBy("x").collect()] == ["j1", "j2", "j4", "j3", "j0", "j5"]
    spans = {r.category: (r.start_x, r.end_x, r.label_x) for r in report.category_spans(axis).collect()}
    assert spans == {"Uncategorized": (0, 2, 1.0), "a": (3, 3, 3.0), "b": (4, 5, 4.5)}


@pytest.mark.parametrize("options", [{}, {"small_side_bytes": 0, "cell_bytes": 400}])
def test_binned_heatmap(spark, options):
    draw = random.Random(3)
    people = [(f"p{i}", 3 * i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(53)]
    people[7] = ("p7", 21, [float("nan")] * 4)
    jobs = [(f"j{i}", 100 - i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(17)]
    schema = "id string, pos long, embedding array<double>"
    c = as_candidates(spark.createDataFrame(people, schema).repartition(3), "id", "pos")
    j = as_jobs(spark.createDataFrame(jobs, schema), "id", "pos")
    categories = spark.createDataFrame([(f"j{i}", "ab"[i % 2]) for i in range(10)], "job_id string, category string")
    for grouped in (None, categories):
        cells = (report.heatmap_cells(c, j, decimals=5) if grouped is None else report.category_heatmap(c, j, grouped, decimals=5)[0]).collect()
        want = {}
        for r in cells:
            if r.similarity == r.similarity:
                want.setdefault((r.y * 6 // 53, r.x * 20 // 17), []).append(r.similarity)
        got = {(r.y, r.x): (r.n, r.mean, r.highest) for r in report.binned_heatmap(c, j, 6, 20, 5, grouped, **options).collect()}
        assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1e-12), max(v)) for k, v in want.items()}
    with pytest.raises(ValueError):
        report.binned_heatmap(c, j, 0)
    assert report.binned_heatmap(c.where("candidate_position < 0"), j).count() == 0


def test_heatmaps_and_dashboard(spark, ranked, tmp_path):
    schema = "id string, pos long, embedding array<double>"
    c = as_candidates(spark.createDataFrame([("p", 5, [1.0, 0.0]), ("q", 2, [0.0, 1.0])], schema), "id", "pos")
    j = as_jobs(spark.createDataFrame([("x", 9, [1.0, 0.0]), ("y", 30, [1.0, 1.0])], schema), "id", "pos")
    cells = {(r.job_id, r.x, r.candidate_id, r.y): r.similarity for r in report.heatmap_cells(c, j, decimals=3).collect()}
    assert cells == {("x", 0, "p", 1): 1.0, ("x", 0, "q", 0): 0.0, ("y", 1, "p", 1): 0.707, ("y", 1, "q", 0): 0.707}
    categories = spark.createDataFrame([("y", "A")], "job_id string, category string")
    grouped, spans = report.category_heatmap(c, j, categories)
    assert {(r.job_id, r.x) for r in grouped.collect()} == {("y", 0), ("x", 1)} and spans.count() == 2

    people = spark.createDataFrame([("5", "Ann", 1)], "Degree string, `Name ` string, other int")
    tables = report.dashboard(grouped, ranked, people, str(tmp_path))
    assert tables["candidate_table"].columns == ["Name ", "Degree"]
    assert spark.read.parquet(f"{tmp_path}/top_matches_table").columns == ["Job", "Candidate", "Similarity", "Rank"]
    assert {r.Similarity for r in tables["top_matches_table"].collect()} == {"0.900", "0.126", "0.500"}


@pytest.mark.parametrize("skew_from_rows", [10**9, 0])
def test_membership(spark, skew_from_rows):
    names = ["Ann"] * 40 + ["ann", "Ann ", None, None, "Bo", "Cy"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, `Name ` string")
    members = spark.createDataFrame([("Ann", 1), ("Ann", 2), ("Cy", 3), (None, 4)], "who string, n int")
    flagged = membership.flag_members(df, members, skew_from_rows=skew_from_rows)
    assert flagged.columns == ["id", "Name ", "Contingent"]
    got = {r.id: r.Contingent for r in flagged.collect()}
    assert got == {i: n in ("Ann", "Cy") for i, n in enumerate(names)}
    assert membership.count_members(flagged).head().members == 41
    assert membership.flag_members(df, members.where("false")) is df
    assert membership.flag_members(df, members, "absent") is df


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_salted_lookup_equals_a_plain_join(spark, how):
    left = spark.createDataFrame([(i, None if i % 9 == 0 else i % 3, i % 2) for i in range(300)], "id int, a int, b int").repartition(5)
    right = spark.createDataFrame([(0, 0, "x"), (1, 1, "y"), (7, 0, "z")], "a int, b int, v string")
    plain = left.join(right, ["a", "b"], how)
    salted = lookup(left, right, ["a", "b"], how, skew_from_rows=0)
    assert salted.columns == plain.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(key, salted.collect())) == sorted(map(key, plain.collect()))


def test_attach_status(spark, ranked):
    people = spark.createDataFrame([("a", True), ("c", False)], "candidate_id string, Contingent boolean")
    rows = {(r.candidate_id, r.job_id): r.Contingent for r in membership.attach_status(ranked, people).collect()}
    assert rows == {("a", "cook"): True, ("a", "maid"): True, ("b", "cook"): None}
