from collections import Counter

import pytest
from cases import edge_documents, empty_documents
from pyspark.sql import functions as F

from pairrank.llm import mixing


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 1], [12, 10, 8, 8, 6, 6, 50], [1, 1, 1, 1, 1, 1, 94], [7, 13, 1, 29]])
def test_less_than_one_block_off(spark, weights):
    rows = mixing.period(spark, weights).orderBy("slot").collect()
    total, done = sum(weights), Counter()
    assert [r.slot for r in rows] == list(range(total))
    for r in rows:
        assert r.nth == done[r.stream]
        # Not before its release, not after its deadline.
        assert done[r.stream] * total // weights[r.stream] <= r.slot < -(-(done[r.stream] + 1) * total // weights[r.stream])
        done[r.stream] += 1
        for i, w in enumerate(weights):
            assert abs(done[i] - (r.slot + 1) * w / total) < 1
    assert [done[i] for i in range(len(weights))] == weights


def test_weights_are_checked(spark):
    for bad in ([0, 1], [1.5], [mixing.MAX_PERIOD, 1]):
        with pytest.raises(ValueError):
            mixing.period(spark, bad)


def test_rows_stay_and_follow_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 3 == 1 else None) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 3, "b": 1}, 2, 5).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    slots = {(r.stream, r.nth): r.slot for r in mixing.period(spark, [3, 1, 2]).collect()}
    share = [3, 1, 2]
    for s in range(3):
        mine = sorted((r for r in got if r.stream == s), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        for r in mine:
            assert r.block == r.place // 5
            assert r.slot == r.block // share[s] * 6 + slots[s, r.block % share[s]]
    # Stream a is spent first: 67 rows in 14 blocks, of which three come in six slots.
    end = 14 // 3 * 6 + slots[0, 14 % 3]
    assert all(r.full == (r.slot < end) for r in got)


@pytest.mark.parametrize("same", [False, True])
def test_a_hot_key_fills_no_bucket(spark, monkeypatch, same):
    """Half of the rows share a null id: told apart by their texts, or, where these are equal too, by their places."""
    monkeypatch.setattr(mixing, "BUCKETS_PER_GROUP", 5)
    largest = []
    real = mixing.sums_before

    def watched(sums):
        largest.append(max(r.n for r in sums.collect()))
        return real(sums)

    monkeypatch.setattr(mixing, "sums_before", watched)
    text = F.lit("the same") if same else F.concat(F.lit("text "), "id")
    docs = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("src0").alias("source"), text.alias("text"), F.lit(1).alias("`odd` name"))
    got = mixing.mix(docs, {"src0": 2}, 1, 100).select("doc_id", "text", "stream", "block", "place").collect()
    assert len(got) == 60_000 and sorted(r.place for r in got) == list(range(60_000)) and all(r.block == r.place // 100 for r in got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert largest and largest[0] <= 4 * mixing.ROWS_PER_BUCKET
    # The rows of the hot key are shuffled among the others.
    nulls = [r.place for r in got if r.doc_id is None]
    assert sum(nulls) / len(nulls) == pytest.approx(30_000, rel=0.05)


def test_edges(spark):
    docs = edge_documents(spark)
    got = mixing.mix(docs, {"src0": 1}, 1, 2)
    assert got.count() == docs.count()
    assert set(docs.columns) | set(mixing.RESULTS) == set(got.columns)
    assert mixing.mix(empty_documents(spark), {"src0": 1}, 1, 2).count() == 0
    order = [(r.slot, r.place) for r in mixing.in_order(got).collect()]
    assert order == sorted(order)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 1}, 1, 0)
