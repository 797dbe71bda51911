"""Line dedup across documents: exact copies, and lines one character edit away from an earlier line.

Deletion neighbourhood. Two lines of m and m or m+1 characters are at most one edit
(substitution, insertion or deletion of a character) apart if and only if they share a
deletion variant in the right way: both with the character at the same place removed, or
the longer one with a character removed equal to the shorter one. Variants are emitted as
hashed keys, equal keys are joined, and the edit distance of what met is verified.

A line of n characters has n variants of n characters each, so two things keep this
linear. First a screen: cut at fixed places into blocks, all blocks of such a pair but
the one with the edit are equal, so only lines that share a whole line but one block with
a different line emit variants at all. The screen runs twice, over the halves of all
lines, then over short blocks of what is left. Second, variants are made within that
block only and carry the hash of the rest.

In a group of equal variants all lines are within the bound of one another (same place
removed), or of the one line that equals the variant, so each line meets only the earliest
of its group; no pairs within a group are made. A group holds at most one different line
per character of the alphabet (and place), however often each line occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.functions.text import quoted
from pairrank.llm.expressions import columns_of, pick, unused
from pairrank.runtime import materialise

# Lines with fewer characters are only compared exactly: one edit makes another word of a short line.
MIN_CHARS = 20
# Length of a block. Shorter lines are cut into two blocks all the same, and very long ones
# into blocks of the square root of their length.
BLOCK = 32
# A table with more rows is not broadcast; the join then shuffles.
BROADCAST_ROWS = 1_000_000


def lines_of(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """at (place in reading order), line and its 128-bit hash for every line that is not blank."""
    rows = pick(documents, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("text"))
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike("[^ \t-\r]"))
    return lines.select(
        F.struct("doc_id", "row", "n").alias("at"), "line",
        F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("id"))


def halves(line: Column, n: Column, m: Column) -> list[Column]:
    """Hashes of the two halves of a line for partners of which the shorter has ``m`` characters."""
    half = F.shiftright(m, 1)
    return [F.xxhash64(m, F.lit(0), F.substring(line, F.lit(1), half)),
            F.xxhash64(m, F.lit(1), F.substring(line, n - (m - half) + 1, m - half))]


def middle_of(line: Column, before: Column, after: Column) -> Column:
    return F.substring(line, before + 1, F.length(line) - before - after)


def blocks(line: Column, n: Column, m: Column) -> Column:
    """The cuts of a line for partners of which the shorter has ``m`` characters.

    One struct per block: m, the characters ``before`` it (from the left end) and ``after`` it
    (from the right end), the hash ``key`` of these and of its number, and its text ``middle``.
    """
    width = F.when(m <= 2 * BLOCK, F.ceil(m / 2)).otherwise(F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(m)))).cast("int")

    def cut(j: Column) -> Column:
        before = j * width
        after = F.greatest(m - before - width, F.lit(0))
        rest = F.xxhash64(m, j, F.substring(line, F.lit(1), before), F.substring(line, n - after + 1, after))
        return F.struct(m.alias("m"), before.alias("before"), after.alias("after"), rest.alias("key"), middle_of(line, before, after).alias("middle"))

    return F.transform(F.sequence(F.lit(0), F.ceil(m / width).cast("int") - 1), cut)


def sharing(rows: DataFrame) -> DataFrame:
    """The rows whose key a different line has too."""
    shared = rows.groupBy("key").agg(F.min("id.a").alias("low"), F.max("id.a").alias("high")).where("low != high").select("key")
    shared = materialise(shared, "shared-keys")
    return rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "key", "left_semi")


def suspects(lines: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Lines that share a half with a different line, and their blocks outside which they equal a different line.

    The lines have id, first place, line and length n, the blocks id, place, n and block.
    Every line is looked at as the shorter or equal partner (m = n) and as the longer (m = n - 1).
    """
    line, n = F.col("line"), F.col("n")
    long_enough = lines.withColumn("n", F.length("line")).where(n >= min_chars)
    own = halves(line, n, n)
    keys = F.when(n > min_chars, F.array(*own, *halves(line, n, n - 1))).otherwise(F.array(*own))
    some = sharing(long_enough.withColumn("key", F.explode(keys)))
    some = materialise(some.groupBy("id").agg(F.min("at").alias("at"), F.first("line").alias("line"), F.first("n").alias("n")), "line-suspects")
    cuts = F.when(n > min_chars, F.concat(blocks(line, n, n), blocks(line, n, n - 1))).otherwise(blocks(line, n, n))
    # A line has many blocks, which must not each carry the line.
    cut = some.select("id", "at", "n", F.explode(cuts).alias("block")).withColumn("key", F.col("block.key"))
    return some, materialise(sharing(cut).drop("key"), "line-blocks")


def near_pairs(found: DataFrame) -> DataFrame:
    """id of a line, id of an earlier line that shares a variant, and the block outside which they should be equal."""
    middle, m, n = F.col("block.middle"), F.col("block.m"), F.col("n")
    shorter = F.transform(F.sequence(F.lit(0), F.length(middle) - 1), lambda i: F.struct(
        i.alias("i"), F.concat(F.substring(middle, F.lit(1), i), F.substring(middle, i + 2, F.length(middle))).alias("rest")))

    def key(kind: str, *parts: Column) -> Column:
        return F.xxhash64(F.lit(kind), F.col("block.key"), *parts)

    def entry(role: str, hashed: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), hashed.alias("variant"))

    substituted = F.transform(shorter, lambda v: entry("same", key("same", v["i"], v["rest"])))
    whole = F.array(entry("whole", key("less", middle)))
    deleted = F.array_distinct(F.transform(shorter, lambda v: entry("less", key("less", v["rest"]))))
    variants = F.when(m == n, F.concat(F.coalesce(substituted, F.array().cast(
        "array<struct<role: string, variant: bigint>>")), whole)).otherwise(deleted)
    emitted = found.where(F.length(middle) > 0).select(
        "id", "at", "block.before", "block.after", F.explode(variants).alias("v")).select(
        F.struct("at", "id").alias("me"), "before", "after", "v.role", "v.variant")
    group = Window.partitionBy("variant")
    earliest = {r: F.min(F.when(F.col("role") == r, F.col("me"))).over(group) for r in ("same", "whole", "less")}
    other = F.when(F.col("role") == "same", earliest["same"]).when(F.col("role") == "whole", earliest["less"]).otherwise(earliest["whole"])
    met = emitted.withColumn("other", other).where(F.col("other.at") < F.col("me.at"))
    return met.select(F.col("me.id").alias("id"), F.col("other.id").alias("other"), "before", "after").distinct()


def near_copies(lines: DataFrame, min_chars: int) -> DataFrame:
    """Lines of which an earlier line is one edit away: id, ``other`` and the verified distance."""
    some, found = suspects(lines, min_chars)
    text = some.select("id", "line")
    pairs = materialise(near_pairs(found), "line-pairs")
    both = pairs.join(text, "id").join(text.select(F.col("id").alias("other"), F.col("line").alias("earlier")), "other")
    before, after = F.col("before"), F.col("after")
    same = [F.substring(x, F.lit(1), before) for x in ("line", "earlier")], [F.substring(x, F.length(x) - after + 1, after) for x in ("line", "earlier")]
    # Outside the block the lines are equal, so the distance of the blocks is that of the lines.
    edits = F.levenshtein(middle_of(F.col("line"), before, after), middle_of(F.col("earlier"), before, after), 1)
    verified = both.where((same[0][0] == same[0][1]) & (same[1][0] == same[1][1])).withColumn("edits", edits).where("edits = 1")
    return verified.groupBy("id").agg(F.min("other").alias("other"), F.min("edits").alias("edits"))


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``documents`` with ``text`` cut to the lines that stay, and ``n_lines`` and ``n_kept``.

    A line is what lies between newlines. Of equal lines the earliest stays, by doc_id and
    then place in the text. Of lines of at least ``min_chars`` characters, one whose first
    occurrence comes after that of another line one edit away goes too, whether or not the
    other stays. Blank lines always stay and are counted in neither column.

    A null text stays null, with no lines; a text of which no line stays is left with its
    blank lines. A null id is the earliest. Rows that repeat an id are ordered by the hash of
    their texts; rows that repeat id and text get the same result, as neither is earlier.
    Input columns named n_lines or n_kept are replaced.
    """
    if min_chars < 2:
        raise ValueError("min_chars is at least 2")
    lines = lines_of(documents, doc_id, text)
    first = lines.groupBy("id").agg(F.min("at").alias("at"))
    near = materialise(near_copies(lines, min_chars), "near-lines")
    staying = first.join(near.select("id"), "id", "left_anti")
    doc, hashed, kept, split, cut = unused(documents, "doc", "hash", "kept", "lines", "cut")
    per_row = staying.groupBy("at.doc_id", "at.row").agg(F.collect_list("at.n").alias(kept)).select(
        F.col("doc_id").alias(doc), F.col("row").alias(hashed), kept)
    rows = documents.select(*columns_of(documents, "n_lines", "n_kept"))
    same = quoted(doc_id).eqNullSafe(F.col(doc)) & (F.xxhash64(quoted(text)) == F.col(hashed))
    joined = rows.join(per_row, same, "left").withColumn(split, F.split(quoted(text), "\n"))
    blank = F.filter(
        F.transform(split, lambda line, i: F.when(~line.rlike("[^ \t-\r]"), i)), lambda i: i.isNotNull())
    stay = F.sort_array(F.concat(blank, F.coalesce(kept, F.array().cast("array<int>"))))
    counted = joined.withColumns({
        "n_lines": F.coalesce(F.size(split) - F.size(blank), F.lit(0)).cast("long"),
        "n_kept": F.coalesce(F.size(kept), F.lit(0)).cast("long"),
        cut: F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"),
    })
    return counted.select(
        *(F.col(cut).alias(text) if c == text else quoted(c) for c in rows.columns), "n_lines", "n_kept")
