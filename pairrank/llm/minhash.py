"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Every shingle's 64-bit hash names one
of ``REGISTERS`` buckets; a bucket keeps its smallest hash, compressed to the number of
leading zeros and the ``MANTISSA`` bits that follow the first one. Bands of ``ROWS``
registers are hashed, and documents that share a band are candidates. For these the share
of equal registers, corrected for the collisions expected by chance, estimates the Jaccard
similarity; what falls clearly below the bound is dropped, and the rest is verified on the
full sets.

Documents with equal sets are one class, and only classes are compared. In a bucket every
class is compared with one centre, so a group of copies makes a star and not all its
pairs. Only where a member fails against the centre can a link between two others be
missing, and only if the first links have not joined them anyway. The members of such
buckets are then compared among themselves: pair by pair where they are a handful, else in
blocks of bounded size, of which each gives back at most a spanning forest.

With 32 bands of 4 registers a pair of similarity 0.8 shares no band with a probability
below 1e-7, one of 0.85 below 1e-10. Short sets leave registers empty; bands of empty registers are no candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.components import components
from pairrank.llm.expressions import pick
from pairrank.runtime import materialise

SHINGLE = 5
# Shared percentage of the union from which documents are linked.
PERCENT = 80
REGISTER_BITS, MANTISSA = 7, 26
REGISTERS, ROWS = 1 << REGISTER_BITS, 4
BANDS = REGISTERS // ROWS
# Standard deviations by which an estimate may fall below the bound before a candidate is dropped.
SLACK = 6
# Members up to which an open bucket is compared pair by pair.
PAIRS_UP_TO = 8
# A block of a larger bucket: members, and bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20
# A table of keys with more rows is not broadcast.
BROADCAST_ROWS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20).integers(0, 2**64, 256 + SHINGLE, np.uint64)
_BYTE, _PLACE = _RANDOM[:256], _RANDOM[256:] | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- sets and sketches ------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every run of bytes that ``word`` (a flag for each byte value) marks."""
    inside = word[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = int(inside.argmax())
    data, inside = data[first:], inside[first:]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    # Each word is a polynomial in its bytes.
    powers = np.multiply.accumulate(np.full((ends - starts).max(), _STEP))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    terms = np.where(inside, _BYTE[data] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    words = mixed(np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64))
    return words, starts + first, ends + first


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer words
    than a shingle has one shingle, all its words; one without words has none.
    """
    words, _, _ = hashed_words(np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8), ~_SPACE)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    joined = np.full(len(words) - size + 1, np.uint64(size))
    for j in range(size):
        joined = mixed(joined + words[j : len(words) - size + 1 + j] * _PLACE[j])
    return np.unique(joined)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set in order; 0 is an empty one."""
    found = np.zeros(REGISTERS, np.uint32)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = hashes[first] << np.uint64(REGISTER_BITS)
        # 53 bits are exact in floating point, whose exponent then counts the zeros.
        zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
        mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
        found[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint32)
    return found


def plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (row by row) have an estimated similarity not clearly below the bound.

    From the equal registers those are taken that sets of n and m elements would share by
    chance, by the approximation 0.169919 * 2^(p - r) * 4 (n/m) / (1 + n/m)^2.
    """
    used = ((x | y) != 0).sum(-1)
    equal = ((x == y) & (x != 0)).sum(-1)
    ratio = n / np.maximum(m, 1)
    chance = 0.169919 * 2.0 ** (REGISTER_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    bound, used = percent / 100, np.maximum(used, 1)
    return (equal - chance) / used >= bound - SLACK * np.sqrt(bound * (1 - bound) / used)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ordered sets reach the bound."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def sketched(text: Column) -> Column:
    """n (size of the set), print (128-bit fingerprint of the set) and the registers of each text."""

    @F.pandas_udf("struct<n: long, print: binary, registers: binary>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({
            "n": [len(s) for s in sets], "print": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "registers": [registers(s).tobytes() for s in sets]})

    return sketch(text)


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


# --- candidates and links ---------------------------------------------------------


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def buckets(classes: DataFrame) -> DataFrame:
    """node, key, band and the bucket's size and centre, for every band that several classes share."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.expr("registers").substr(i * 4 * ROWS + 1, F.lit(4 * ROWS)).alias("part")))
    banded = classes.select("node", "n", F.explode(cut).alias("b")).where(F.col("b.part") != F.lit(bytes(4 * ROWS))).select(
        "node", "n", "b.band", F.xxhash64("b.band", "b.part").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("elements"), F.min("node").alias("centre"))
    shared = materialise(shared.where("size > 1"), "shared-bands")
    return materialise(banded.join(small(shared), "key"), "buckets")


def with_sets(documents: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, registers and the full set (ordered hashes) of the given nodes, from one document of each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({
                "print": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "members": [s.tobytes() for s in sets]})

    wanted = materialise(classes.join(small(nodes), "node", "left_semi").drop("smallest"), "wanted")
    texts = documents.join(small(wanted.select("row").distinct()), "row", "left_semi").select("text")
    found = texts.mapInPandas(read, "print binary, members binary")
    # Rows that repeat id and text come up once each.
    once = found.join(wanted.drop("row"), "print").dropDuplicates(["node"])
    return materialise(once.select("node", "n", "registers", "members"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the bound: those that the estimate does not rule out, verified on their full sets."""

    @F.pandas_udf("boolean")
    def holds(rx: pd.Series, ry: pd.Series, n: pd.Series, m: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(r), np.uint32).reshape(-1, REGISTERS) for r in (rx, ry)]
        near = plausible(*both, n.to_numpy(), m.to_numpy(), percent)
        return pd.Series([
            ok and similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for ok, x, y in zip(near, sx, sy)], dtype=bool)

    names = ["registers", "n", "members"]
    sides = [sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in names)) for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.where(holds(*(f"{x}_{c}" for x in names for c in "ab"))).select("a", "b")


def links_within(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links among the members of one pair of blocks of an open bucket."""
    rows = rows.sort_values("node").reset_index(drop=True)
    nodes, band, blocks = rows["node"].to_numpy(), int(rows["band"].iloc[0]), rows["block"].to_numpy()
    sketches = np.frombuffer(b"".join(rows["registers"]), np.uint32).reshape(-1, REGISTERS)
    sizes, sets = rows["n"].to_numpy(), [np.frombuffer(s, np.uint64) for s in rows["members"]]
    root, found = rows["root"].to_numpy().copy(), []
    across = len(set(blocks)) > 1
    for i in range(len(rows) - 1):
        low, high = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        open_pairs = (root[i + 1 :] != root[i]) & (100 * low >= percent * high)
        if across:
            open_pairs &= blocks[i + 1 :] != blocks[i]
        others = np.flatnonzero(open_pairs) + i + 1
        for j in others[plausible(sketches[i], sketches[others], np.float64(sizes[i]), sizes[others], percent)]:
            if root[i] == root[j]:
                continue
            x, y = (sketches[k].reshape(BANDS, ROWS) for k in (i, j))
            # A pair that shares several bands is settled in the first.
            if np.flatnonzero((x == y).all(1) & (x != 0).any(1))[0] == band and similar(sets[i], sets[j], percent):
                found.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links(documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes that connect whatever the similarity connects."""
    members = buckets(classes)
    sets = with_sets(documents, classes, members.select("node").distinct())
    stars = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    linked = materialise(confirmed(stars, sets, percent), "linked")

    # Pairs with a centre are settled. A bucket is open if its other members lie in different components.
    others = members.where("node != centre AND size > 2").join(components(linked), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    parts = others.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_members = materialise(others.join(small(materialise(parts, "open-keys")), "key", "left_semi"), "open-buckets")

    listed = open_members.where(F.col("size") <= PAIRS_UP_TO).groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("list"))
    each = F.flatten(F.transform("list", lambda x: F.transform(
        F.filter("list", lambda y: (x["node"] < y["node"]) & (x["root"] != y["root"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    few = confirmed(listed.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct(), sets, percent)

    large = open_members.where(F.col("size") > PAIRS_UP_TO)
    count = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("elements") * 8 / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A block meets itself and every other block once.
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("low"), F.greatest("block", other).alias("high")))
    dealt = large.drop("n").withColumn("blocks", count).withColumn("block", own).withColumn("pair", F.explode(met)).join(sets, "node").select(
        "key", "pair", "band", "node", "n", "root", "block", "registers", "members")
    many = dealt.groupBy("key", "pair").applyInPandas(lambda part: links_within(part, percent), "a long, b long")
    return linked.unionByName(few).unionByName(many)


def near_duplicates(documents: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Documents whose shingle sets share at least ``percent`` percent of their union are
    linked; component_id is the smallest doc_id that links reach, the row's own included,
    and kept marks the row that carries it. A null text, or one without words, has an empty
    set and is linked with nothing. Ids that are null count only where a component has no
    other; rows that repeat an id are kept or not together.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    rows = pick(documents, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("doc_id", "text"))
    sketches = materialise(rows.select("doc_id", "row", sketched(F.col("text")).alias("s")).select("doc_id", "row", "s.*"), "sketches")
    grouped = sketches.where("n > 0").groupBy("print").agg(
        F.min("doc_id").alias("smallest"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    # Written before it is used, so the number of a class never changes.
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(links(rows, classes, percent))
    rooted = classes.select("node", "print", "smallest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    found = rooted.join(named, "root").select("print", "component_id")
    joined = sketches.select("doc_id", F.col("n").alias("n_shingles"), "print").join(found, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
