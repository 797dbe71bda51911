import math
import random

import numpy as np
import pytest
from cases import with_clashes

from pairrank.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Everything by scoring each row with each anchor."""
    part = []
    for i, (id_, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label
        part.append((i, id_, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for i, anchor, label, v in part:
        if anchor is None or anchor % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), id_ is None, id_ or 0, j, lab) for j, id_, lab, w in part if j != i)
        for s, none, positive, _, _ in [x for x in scored if x[4] == label][:5]:
            fit = [x for x in scored if x[4] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(anchor, None if none else positive, k + 1, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(seed, n, size, kinds=None):
    """Clusters with equal vectors in and across labels, so that scores tie."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (kinds or 6, size))
    rows = []
    for i in range(n):
        v = centres[draw.integers(len(centres))] + (draw.normal(0, 0.1, size) if draw.random() < 0.7 else 0)
        rows.append((i, [float(x) for x in v], int(draw.integers(0, 4))))
    return rows


def found(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3, "vec_id"))
    return sorted((tuple(r) for r in hn.hard_negatives(df).collect()), key=repr)


@pytest.mark.parametrize("seed, n, size, shard_rows", [(1, 400, 16, 32_768), (2, 500, 7, 60), (3, 300, 1, 100)])
def test_against_all_scores(spark, monkeypatch, seed, n, size, shard_rows):
    monkeypatch.setattr(hn, "SHARD_ROWS", shard_rows)
    rows = vectors(seed, n, size)
    want = plain(rows)
    assert found(spark, rows) == want and len(want) > 20


def test_hot_vector(spark, monkeypatch):
    """A third of all rows hold one vector, in all labels: ties go by id across shards."""
    monkeypatch.setattr(hn, "SHARD_ROWS", 50)
    rows = [(i, [0.5, 0.25, 0.1] if i % 3 == 0 else [math.sin(i), math.cos(i), 0.3], i % 5) for i in range(300)]
    assert found(spark, rows) == plain(rows)


def test_rows_without_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 200, 4) + [(1_000, None, 1), (1_050, [0.1, None, 0.2, 0.3], 1), (1_100, [nan, 0.0, 0.0, 0.0], 1), (1_150, [inf, 0.0, 0.0, 0.0], 2),
        (1_200, [0.1, 0.2, 0.3, 0.4], None), (None, [0.3, 0.2, 0.1, 0.0], 1), (1_250, [], 2), (1_300, [0.5, 0.5], 2)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0, 2.0], 1)]) == []
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([(50, [1e30, 2.0], 1)], SCHEMA))


def test_rows_that_repeat(spark):
    """Rows of one id stay rows of their own: each anchor has its results, and its copy is its first positive."""
    rows = vectors(5, 120, 3)
    got = hn.hard_negatives(spark.createDataFrame(rows + rows, SCHEMA)).collect()
    want = plain(rows + rows)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.positive_score, r.negative_score) for r in got) == sorted((w[0], w[1], w[2], w[4], w[5]) for w in want)


def test_cells_come_by_falling_bound():
    draw = np.random.default_rng(6)
    points = np.floor(draw.normal(0, 90, (2_000, 12)))
    centres = hn.trained(points[:500, :6]), hn.trained(points[:500, 6:])
    index = hn.MultiIndex(points, np.arange(2_000), np.arange(2_000), np.zeros(2_000), centres)
    for anchor in points[:20]:
        cells = list(index.cells(anchor))
        assert sorted(i for _, s, e in cells for i in range(s, e)) == list(range(2_000))
        assert all(x[0] >= y[0] for x, y in zip(cells, cells[1:]))
        assert all((index.vectors[s:e] @ anchor <= bound).all() for bound, s, e in cells)


def test_the_search_stops_early():
    """On clustered vectors most rows are never scored."""
    draw = random.Random(7)
    centres = np.random.default_rng(7).normal(0, 100, (40, 16))
    points = np.floor(np.stack([centres[draw.randrange(40)] for _ in range(20_000)]) + np.random.default_rng(8).normal(0, 3, (20_000, 16)))
    index = hn.MultiIndex(points, np.arange(20_000), np.arange(20_000), np.zeros(20_000), (hn.trained(points[:4_000, :8]), hn.trained(points[:4_000, 8:])))
    for i in range(0, 20_000, 1_000):
        (scores, places), = index.search(points[i], lambda s, e: np.ones(e - s, bool), [(-np.inf, np.inf)], 5)
        assert scores.tolist() == sorted((points @ points[i]).tolist(), reverse=True)[:5]
    assert index.visited < 20 * 20_000 * 0.2
