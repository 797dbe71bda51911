"""Flags taken from another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank import schemas as S
from pairrank.functions.text import quoted
from pairrank.operators.lookup import lookup

# Statuses that are copied to the pairs, counted first; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def distinct_names(members: DataFrame) -> DataFrame:
    """The distinct values of a table's first column."""
    return members.select(quoted(members.columns[0]).alias("_member")).distinct()


def flag_members(df: DataFrame, members: DataFrame, name_column: str = S.NAME, flag: str = S.CONTINGENT,
                 **options) -> DataFrame:
    """Add a boolean: is the name in the first column of ``members``?

    Names are compared as they are. A missing name is no member. The table is returned
    unchanged if it lacks the column or if ``members`` is empty.
    """
    if name_column not in df.columns or members.isEmpty():
        return df
    names = distinct_names(members).where(F.col("_member").isNotNull()).withColumn(flag, F.lit(True))
    keyed = df.withColumn("_member", quoted(name_column))
    found = lookup(keyed, names, ["_member"], **options)
    return found.select(*[quoted(c) for c in df.columns], F.coalesce(quoted(flag), F.lit(False)).alias(flag))


def count_members(df: DataFrame, flag: str = S.CONTINGENT) -> DataFrame:
    """How many rows carry the flag."""
    return df.agg(F.count_if(quoted(flag)).alias("members"))


def attach_status(pairs: DataFrame, candidates: DataFrame, status: str = S.CONTINGENT,
                  candidate_id: str = "candidate_id") -> DataFrame:
    """Carry a candidate's status along with its scores; null for an unknown candidate.

    Candidates are matched by id, and by ``candidate_position`` too where both tables have it,
    so that people of one name keep their own status. Pairs never multiply.

    Pairs are many, so they stay where they are, and the candidates, if counted few, are
    copied to them. Otherwise a plain join: pairs are dear to compute, so their keys are not counted
    beforehand, and a candidate with very many pairs is left to Spark's adaptive skew join.
    """
    keys = [candidate_id]
    if "candidate_position" in pairs.columns and "candidate_position" in candidates.columns:
        keys.append("candidate_position")
    # A candidate listed several times carries the status if any of its rows does.
    known = candidates.groupBy(*map(quoted, keys)).agg(F.max(quoted(status)).alias(status))
    key_bytes = sum((F.coalesce(F.octet_length(quoted(k).cast("string")), F.lit(0)) for k in keys), F.lit(16))
    rows, size = known.agg(F.count(F.lit(1)), F.sum(key_bytes.cast("long"))).first()
    few = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    return pairs.join(F.broadcast(known) if few else known, keys, "left")
