"""Small expressions shared by the operators of this subpackage. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.functions.text import quoted
from pairrank.runtime import ship

# Fixed value: the white space that separates words (space, tab, LF, VT, FF, CR), as in
# the word pattern [^\x20\x09-\x0D]+.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), lambda w: w != "")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the working names given as keywords.

    Every operator starts with this, so further columns of the input, whatever their
    names, can clash with nothing.
    """
    return df.select(*(quoted(name).alias(working) for working, name in columns.items()))


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold, but those named."""
    return [quoted(c) for c in df.columns if c not in without]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names for working columns, each with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


# A table of more rows than this is not broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast, if a count says that its (short) rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
