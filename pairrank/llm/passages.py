"""Removal of passages that occur more than once in a corpus, by suffix sorting.

Every string of ``WINDOW`` bytes (a window) that starts at two places is removed at both.
Sorting all suffixes of a corpus would move each byte hundreds of times, so equal windows
are first brought together. The smallest hash among the ``GRAM``-byte strings of a window
depends on its bytes alone; a run of windows with the same smallest hash is a segment, and
equal windows lie in segments of equal hash. Segments with equal bytes are counted and
kept once. For each hash then

- one segment that occurs once, without repeats inside: nothing is repeated;
- one segment that occurs several times: all its windows are repeated;
- several different segments: they go through a two-stage suffix sort, many hashes to a
  task, and windows that share ``WINDOW`` symbols with a neighbour in the order are repeated.

A hash whose different segments are too much for one task is split first. All its windows
hold the gram of that hash, their core. The core of a window grows by half of what the window
holds beside it, to the right if there is room, else to the left; that depends on the
window's bytes alone, so equal windows still meet in segments of equal cores. After at most
nine steps the core is the window itself, and equal segments are counted once at each step.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.expressions import pick, small
from pairrank.llm.suffixes import repeated_windows
from pairrank.runtime import materialise

WINDOW = 400
GRAM = 128
# Bytes of different segments that one task sorts on average, and that one hash may have for it.
TASK_BYTES, HASH_BYTES = 1 << 19, 1 << 20

_BYTE = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on."""
    places = len(data) - size + 1
    powers = np.multiply.accumulate(np.full(len(data), _STEP))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * powers)))
    h = (sums[size:] - sums[:places]) * np.multiply.accumulate(np.full(places, _BACK))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    rows = -(-len(values) // size)
    blocks = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(rows, size)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(values) - size + 1
    return np.minimum(right[:starts], left[size - 1 : size - 1 + starts])


def segments(data: bytes, window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, bytes, int, int, bool]]:
    """The segments of a text: hash, fingerprint of the bytes, start, length in bytes, and
    whether a window could occur twice within the segment."""
    if len(data) < window:
        return []
    grams = gram_hashes(np.frombuffer(data, np.uint8), gram)
    span = window - gram + 1
    least = sliding_least(grams, span)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    ends = np.append(starts[1:], len(least)) - 1
    keys = least[starts].view(np.int64)
    found = []
    for key, least_hash, s, e in zip(keys.tolist(), least[starts], starts.tolist(), ends.tolist()):
        # A window that occurs twice holds the smallest hash at two places.
        twice = int(np.count_nonzero(grams[s : e + span] == least_hash)) > 1
        found.append((key, hashlib.blake2b(data[s : e + window], digest_size=16).digest(), s, e - s + window, twice))
    return found


def segments_of(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, row, and hash, print, start, size and twice of every segment."""

    @F.pandas_udf("array<struct<hash: long, print: binary, start: int, size: int, twice: boolean>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([segments((t or "").encode("utf-8", "surrogatepass"), window) for t in texts])

    return rows.select("doc_id", "row", F.explode(cut("text")).alias("s")).select("doc_id", "row", "s.*")


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, last] of ordered places."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cuts + 1)].tolist(), places[np.append(cuts, len(places) - 1)].tolist()))


def pieces_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with doc_id, row, start, size) with the segment's bytes, cut from one text each."""
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("hash", "print", "start", "size", "n")).alias("list"))
    texts = rows.join(small(wanted.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"])
    cut = F.transform("list", lambda s: F.struct(
        s["hash"].alias("hash"), s["print"].alias("print"), s["n"].alias("n"),
        F.substring(F.col("bytes"), s["start"] + 1, s["size"]).alias("piece")))
    joined = texts.withColumn("bytes", F.col("text").cast("binary")).join(per_row, "row")
    return joined.select(F.explode(cut).alias("s")).select("s.*")


def sort_pieces(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    rows = rows.sort_values(["hash", "print"])
    pieces = rows["piece"].tolist()
    found = repeated_windows(pieces, window)
    # A segment that occurs several times repeats all of its windows.
    whole = [np.arange(len(p) - window + 1) if n > 1 else f for p, n, f in zip(pieces, rows["n"], found)]
    out = [(h, p, runs(f)) for h, p, f in zip(rows["hash"], rows["print"], whole) if len(f)]
    return pd.DataFrame(out, columns=["hash", "print", "runs"])


RUNS = "array<struct<first: int, last: int>>"


PIECE = "struct<hash: long, print: binary, start: int, core: int, piece: binary>"


def split_piece(piece: bytes, window: int, size: int, hash_: int, core: int) -> list[tuple[int, bytes, int, int, bytes]]:
    """The parts of a segment whose windows have one core, after cores of ``size`` bytes have grown: hash of the
    core, fingerprint of the part's bytes, its start in the segment, the core's place in it, and the bytes.

    ``core`` is the place of the core that all windows of the segment hold, or -1 if it is the first gram of that hash.
    """
    starts = np.arange(len(piece) - window + 1)
    if core < 0:
        grams = gram_hashes(np.frombuffer(piece, np.uint8), size).view(np.int64)
        places = np.flatnonzero(grams == hash_)
        cores = places[np.searchsorted(places, starts)]
    else:
        cores = np.full(len(starts), core)
    more = -(-(window - size) // 2)
    cores = np.where(starts + window - cores - size >= more, cores, cores - more)
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(cores)) + 1))
    lasts = np.append(firsts[1:], len(cores)) - 1
    parts = []
    for s, e, c in zip(firsts.tolist(), lasts.tolist(), cores[firsts].tolist()):
        key = int.from_bytes(hashlib.blake2b(piece[c : c + size + more], digest_size=8).digest(), "little", signed=True)
        part = piece[s : e + window]
        parts.append((key, hashlib.blake2b(part, digest_size=16).digest(), s, c - s, part))
    return parts


def statuses(kinds: DataFrame) -> DataFrame:
    """What is to be done with each hash that may hold repeated windows, from its kinds (hash, n, twice, size)."""
    per_hash = kinds.groupBy("hash").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("total"), F.bool_or("twice").alias("any_twice"), F.sum("size").alias("bytes"))
    alone = (F.col("kinds") == 1) & ~F.col("any_twice")
    return per_hash.where("total > 1 OR any_twice").select(
        "hash", F.when(alone, "alone").when(F.col("bytes") > HASH_BYTES, "split").otherwise("sort").alias("status"))


def sorted_pieces(pieces: DataFrame, n_bytes: int, window: int) -> DataFrame:
    """hash, print and runs of pieces (hash, print, n, piece) of ``n_bytes`` in all, many hashes to a task."""
    tasks = int(n_bytes // TASK_BYTES) + 1
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("hash"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(lambda part: sort_pieces(part, window), f"hash long, print binary, runs {RUNS}")


def all_windows(size: str, window: int) -> Column:
    return F.array(F.struct(F.lit(0).alias("first"), (F.col(size) - window).alias("last"))).cast(RUNS).alias("runs")


def repeats(rows: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """hash, print and runs of repeated window starts (from the segment's own start) of every segment that has some; a segment may have several rows."""
    kinds = found.groupBy("hash", "print").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("row", "start", "size")).alias("at"))
    kinds = materialise(kinds.select("hash", "print", "n", "twice", "at.*"), "segment-kinds")
    repeated = materialise(kinds.join(statuses(kinds), "hash"), "segment-repeats")
    to_sort = repeated.where("status = 'sort'")
    results = [
        repeated.where("status = 'alone'").select("hash", "print", all_windows("size", window)),
        sorted_pieces(pieces_of(rows, to_sort), to_sort.agg(F.sum("size")).first()[0] or 0, window)]

    @F.pandas_udf(f"array<{PIECE}>")
    def split(pieces: pd.Series, hashes: pd.Series, cores: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([split_piece(p, window, s, h, c) for p, h, c, s in zip(pieces, hashes, cores, sizes)], dtype=object)

    to_split = repeated.where("status = 'split'")
    if to_split.isEmpty():
        return results[0].unionByName(results[1])
    parts = pieces_of(rows, to_split).select(
        F.struct("hash", "print").alias("root"), "n", F.lit(0).alias("offset"), "hash", F.lit(-1).alias("core"), "piece")
    size = GRAM
    while True:
        cut = parts.select("root", "n", "offset", F.explode(split("piece", "hash", "core", F.lit(size))).alias("s"))
        cut = materialise(cut.select("root", "n", (F.col("offset") + F.col("s.start")).alias("offset"), "s.hash", "s.print", "s.core", "s.piece"), "split-segments")
        size += -(-(window - size) // 2)
        # No window occurs twice within a part, as its core lies at one place.
        kinds = cut.groupBy("hash", "print").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
        kinds = materialise(kinds.withColumns({"twice": F.lit(False), "size": F.octet_length("piece")}), "split-kinds")
        status = small(materialise(statuses(kinds), "split-hashes"))
        repeated = kinds.join(status, "hash")
        to_sort = repeated.where("status = 'sort'")
        settled = repeated.where("status = 'alone'").select("hash", "print", all_windows("size", window)).unionByName(
            sorted_pieces(to_sort.select("hash", "print", "n", "piece"), to_sort.agg(F.sum("size")).first()[0] or 0, window))
        moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("offset")).alias("first"), (r["last"] + F.col("offset")).alias("last")))
        results.append(cut.join(settled, ["hash", "print"]).select("root.hash", "root.print", moved.cast(RUNS).alias("runs")))
        parts = cut.join(status.where("status = 'split'"), "hash", "left_semi").drop("print")
        if size >= window or parts.isEmpty():
            return reduce(DataFrame.unionByName, results)


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans [start, end), and the maximal runs and bytes that went."""
    kept, at, count, removed = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        if s > end:
            count += 1
            kept.append(data[at:s])
        removed += max(0, e - max(s, end))
        end = at = max(end, e)
    return b"".join(kept) + data[at:], count, removed


def remove_passages(documents: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    Texts are UTF-8 bytes. A byte is removed if a string of ``window`` bytes that covers it
    also starts anywhere else, in the same text or in another, as the texts were given;
    strings do not reach from one text into the next. n_spans counts the maximal removed
    runs. What is left need not be valid UTF-8.

    A null text is empty. Texts shorter than the window stay whole. Rows that repeat id and
    text repeat each other's windows, so all of their long passages go.
    """
    if window < GRAM:
        raise ValueError(f"windows have at least {GRAM} bytes")
    rows = pick(documents, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("doc_id", "text"))
    found = materialise(segments_of(rows, window), "segments")
    repeated = materialise(repeats(rows, found, window), "repeated-windows")
    hits = found.join(repeated, ["hash", "print"]).select("doc_id", "row", F.transform(
        "runs", lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["last"] + window).alias("end"))).alias("spans"))
    per_row = hits.groupBy("doc_id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    same = rows.row.eqNullSafe(per_row.row) & rows.doc_id.eqNullSafe(per_row.doc_id)
    joined = rows.join(per_row, same, "left").select(rows.doc_id, rows.text, per_row.spans)

    @F.pandas_udf("struct<kept: binary, n_spans: long, n_removed: long>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        done = [cut_out(t.encode("utf-8", "surrogatepass"), [(x["start"], x["end"]) for x in s]) if s is not None else (None, 0, 0)
                for t, s in zip(texts, spans)]
        return pd.DataFrame(done, columns=["kept", "n_spans", "n_removed"])

    # Texts that stay whole need not pass through Python.
    some = F.when(F.col("spans").isNotNull(), F.col("text"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    return joined.withColumn("cut", cut(some, "spans")).select(
        "doc_id", F.octet_length(data).cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", F.coalesce("cut.kept", data).alias("kept"))
