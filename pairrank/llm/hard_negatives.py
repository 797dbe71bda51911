"""Hard negatives of anchors by an inverted multi-index.

Vectors are cut into two halves, and a codebook is trained for each. A row belongs to the
cell of its nearest pair of half-centres. The inner product of an anchor with any row of a
cell is at most the sum of two half-scores, each that of the half-centre plus the anchor's
length times the radius of what the half-centre holds. A heap hands out cells by falling
bound (the multi-sequence order: a cell follows once its left and its lower neighbour are
out); their rows are scored exactly. The search ends when the next bound can change no
window any more: each window either holds as many rows as it takes, none worse than the
bound, or lies above it.

Rows are dealt over shards by hash, each with the lists of all cells, and anchors over
blocks; every block meets every shard in one task, and what the shards find is ranked
together. So no cell, label or group of equal vectors fills a task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.llm.expressions import pick
from pairrank.runtime import materialise

ANCHORS, RELABELLED, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES = 5, 3
# A negative scores from LOW to HIGH percent of its positive.
LOW, HIGH = 50, 95
# Half-centres of each codebook, the rows they are trained on, and the rounds of training.
CENTRES, SAMPLE, ROUNDS = 16, 8_192, 12
# Rows of a shard and anchors of a block, on average.
SHARD_ROWS, BLOCK_ANCHORS = 32_768, 8_192
# Sums of products up to this are exact in double precision.
EXACT = 2**53
# Stands for a null id, so that it comes last among ties.
NO_ID = 2**63 - 1


def labelled(label: Column, vec_id: Column) -> Column:
    """The label, moved on by one where the id is divisible by RELABELLED."""
    moved = vec_id.isNotNull() & (F.pmod(vec_id, F.lit(RELABELLED)) == 0)
    return F.when(moved, (label + 1) % LABELS).otherwise(label)


def whole_rows(embeddings: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label and the vector of whole numbers of the rows that take part, each with a number of its own."""
    rows = pick(embeddings, vec_id=vec_id, vec=embedding, label=label)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform("vec", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    kept = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)))
    return materialise(kept.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        labelled(F.col("label").cast("long"), F.col("vec_id")).alias("label"), numbers.alias("vec")), "whole-vectors")


def matrix(vectors: pd.Series, size: int) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is 0."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the least distance for each point."""
    return (np.square(centres).sum(1)[None] - 2 * points @ centres.T).argmin(1)


def trained(points: np.ndarray, centres: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Half-centres: the first is one of the points, each further one the point farthest from those before, then all move to the means of what they hold."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    chosen = points[:1]
    far = np.square(points - chosen[0]).sum(1)
    while len(chosen) < centres and far.max() > 0:
        chosen = np.concatenate((chosen, points[[far.argmax()]]))
        far = np.minimum(far, np.square(points - chosen[-1]).sum(1))
    for _ in range(rounds):
        of = nearest(points, chosen)
        chosen = np.stack([points[of == k].mean(0) if (of == k).any() else chosen[k] for k in range(len(chosen))])
    return chosen


def better(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The first places: higher scores, then smaller ids (none last), then the order of the rows."""
    if len(scores) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        kept = np.flatnonzero(scores >= least)
        return kept[np.lexsort((rows[kept], ids[kept], -scores[kept]))[:most]]
    return np.lexsort((rows, ids, -scores))[:most]


class MultiIndex:
    """The rows of a shard, listed by cell."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, centres: tuple[np.ndarray, np.ndarray]):
        self.cut = centres[0].shape[1]
        self.centres = centres
        halves = vectors[:, : self.cut], vectors[:, self.cut :]
        codes = [nearest(h, c) for h, c in zip(halves, centres)]
        self.radii = [np.zeros(len(c)) for c in centres]
        for half, code, centre, radius in zip(halves, codes, centres, self.radii):
            np.maximum.at(radius, code, np.sqrt(np.square(half - centre[code]).sum(1)))
        cell = codes[0] * len(centres[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.vectors, self.ids, self.rows, self.labels = vectors[order], ids[order], rows[order], labels[order]
        self.ends = np.searchsorted(cell[order], np.arange(len(centres[0]) * len(centres[1]) + 1)).tolist()
        self.visited = 0

    def cells(self, anchor: np.ndarray):
        """Bound and places of the cells that hold rows, by falling bound."""
        halves = anchor[: self.cut], anchor[self.cut :]
        bounds, orders = [], []
        for half, centre, radius in zip(halves, self.centres, self.radii):
            # A little more than the exact value, as sums of products are rounded.
            bound = centre @ half + np.sqrt(half @ half) * radius
            bound += 1e-9 * (np.abs(centre) @ np.abs(half) + np.abs(bound)) + 1e-6
            order = np.argsort(-bound, kind="stable")
            bounds.append(bound[order].tolist())
            orders.append(order.tolist())
        (left, right), (left_of, right_of) = bounds, orders
        heap, across = [(-(left[0] + right[0]), 0, 0)], len(right)
        reached = [0] * len(left)  # cells of each row that are out
        while heap:
            bound, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            cell = left_of[i] * across + right_of[j]
            start, end = self.ends[cell], self.ends[cell + 1]
            if end > start:
                yield -bound, start, end
            # A neighbour enters once the other cell before it is out as well.
            if i + 1 < len(left) and reached[i + 1] == j:
                heapq.heappush(heap, (-(left[i + 1] + right[j]), i + 1, j))
            if j + 1 < across and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-(left[i] + right[j + 1]), i, j + 1))

    def search(self, anchor: np.ndarray, wanted, windows: list[tuple[float, float]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window [low, high] of scores, the scores and places of the first ``most`` rows among those that ``wanted`` picks by place."""
        found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in windows]
        floors = [low for low, _ in windows]  # a bound below can change the window no more
        for bound, start, end in self.cells(anchor):
            if all(bound < f for f in floors):
                break
            self.visited += end - start
            scores = self.vectors[start:end] @ anchor
            ok = wanted(start, end)
            for k, (low, high) in enumerate(windows):
                if bound < floors[k]:
                    continue
                at = np.flatnonzero(ok & (scores >= floors[k]) & (scores <= high))
                if len(at):
                    s, p = np.concatenate((found[k][0], scores[at])), np.concatenate((found[k][1], at + start))
                    first = better(s, self.ids[p], self.rows[p], most)
                    found[k] = s[first], p[first]
                    if len(first) == most:
                        floors[k] = max(low, found[k][0][-1])
        return found


def index_of(part: pd.DataFrame, size: int, centres) -> MultiIndex:
    return MultiIndex(matrix(part["vec"], size), part["vec_id"].to_numpy(), part["row"].to_numpy(), part["label"].to_numpy(), centres)


def positives_task(rows: pd.DataFrame, anchors: pd.DataFrame, size: int, centres) -> pd.DataFrame:
    """The best other rows of the anchors' labels in this shard."""
    index, out = index_of(rows, size, centres), []
    for row, label, vec in zip(anchors["row"], anchors["label"], matrix(anchors["vec"], size)):
        def same(start, end):
            return (index.labels[start:end] == label) & (index.rows[start:end] != row)

        (scores, at), = index.search(vec, same, [(-np.inf, np.inf)], POSITIVES)
        out.append(pd.DataFrame({"anchor_row": row, "row": index.rows[at], "vec_id": index.ids[at], "score": scores.astype(np.int64)}))
    return together(out, ["anchor_row", "row", "vec_id", "score"])


def negatives_task(rows: pd.DataFrame, anchors: pd.DataFrame, size: int, centres) -> pd.DataFrame:
    """For each positive of the anchors, the best rows of other labels in its window, in this shard."""
    index, out = index_of(rows, size, centres), []
    for row, label, vec, positives in zip(anchors["row"], anchors["label"], matrix(anchors["vec"], size), anchors["positives"]):
        def other(start, end):
            return index.labels[start:end] != label

        # Only scores that are not negative have a window; its ends are whole numbers.
        some = [p for p in positives if p["score"] >= 0]
        windows = [(float(-(-LOW * p["score"] // 100)), float(HIGH * p["score"] // 100)) for p in some]
        for p, (scores, at) in zip(some, index.search(vec, other, windows, NEGATIVES) if some else []):
            out.append(pd.DataFrame({"anchor_row": row, "positive": p["nth"], "row": index.rows[at], "vec_id": index.ids[at], "score": scores.astype(np.int64)}))
    return together(out, ["anchor_row", "positive", "row", "vec_id", "score"])


def together(parts: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    parts = [p for p in parts if len(p)]
    return pd.concat(parts, ignore_index=True)[columns] if parts else pd.DataFrame(columns=columns)


def hard_negatives(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    first POSITIVES other rows of the same label, the first NEGATIVES rows of other labels whose scores are from
    LOW to HIGH percent of the positive's.

    Anchors are the rows whose id is divisible by ANCHORS; where the id is divisible by RELABELLED the label is
    moved on first. A score is the inner product with the anchor, of components times SCALE rounded down. Higher
    scores come first, ties by smaller id (a null id last), then by place in the table. Results are exact; the
    codebooks, trained on the SAMPLE rows of least hash, only settle how many rows have to be scored.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows that share an id
    stay rows of their own; as anchors, each has its results. What a shorter vector lacks counts as 0. Vectors
    so long that sums of products leave 2**53 raise ValueError. An empty table gives an empty result.
    """
    rows = whole_rows(embeddings, vec_id, embedding, label)
    anchor = F.pmod("vec_id", F.lit(ANCHORS)) == 0
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, n_anchors, size, longest = rows.agg(
        F.count("*"), F.count_if(anchor), F.max(F.size("vec")), F.max(norm)).first()
    if n and longest >= EXACT:
        raise ValueError("vectors are too long for exact scores")
    size = max(size or 0, 2)
    sample = rows.select("vec").orderBy(F.xxhash64("row", "vec_id"), "row").limit(SAMPLE).toPandas()
    points = matrix(sample["vec"], size)
    centres = trained(points[:, : size // 2]), trained(points[:, size // 2 :])

    slots = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD_ROWS))
    # Few rows: more blocks, so that all slots are busy. Many rows have tasks enough.
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS), min(n_anchors // 16, -(-2 * slots // shards)))

    def spread_over(table: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return table.withColumns({own: F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})

    def met(anchors: DataFrame, task, schema: str) -> DataFrame:
        """Every anchor with every row, in blocks and shards."""
        left = spread_over(rows, "shard", shards, "block", blocks).groupBy("shard", "block")
        right = spread_over(anchors, "block", blocks, "shard", shards).groupBy("shard", "block")
        return left.cogroup(right).applyInPandas(lambda r, a: task(r, a, size, centres), schema)

    def first(table: DataFrame, most: int, *keys: str) -> DataFrame:
        """The first ``most`` rows of each group, numbered from 1. Each task lets so many a group pass."""
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "row")
        return table.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)

    anchors = rows.where(anchor)
    near = met(anchors, positives_task, "anchor_row long, row long, vec_id long, score long")
    best = first(near, POSITIVES, "anchor_row").groupBy("anchor_row").agg(
        F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("positives"))
    asked = materialise(anchors.join(best, anchors.row == best.anchor_row).select("row", "vec_id", "label", "vec", "positives"), "anchors")

    found = met(asked, negatives_task, "anchor_row long, positive int, row long, vec_id long, score long")
    negatives = first(found, NEGATIVES, "anchor_row", "positive").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "nth": "rank"})
    pairs = asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p"))
    listed = pairs.withColumn("positive", F.col("p.nth")).join(negatives, ["anchor_row", "positive"])

    def named(vec_id: str) -> Column:
        return F.nullif(F.col(vec_id), F.lit(NO_ID))

    return listed.select(
        "anchor_id", named("p.vec_id").alias("positive_id"), "rank", named("negative_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), "negative_score")
