"""Years of experience out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairrank.functions.text import WS, as_text

# Tried in this order, the first that matches anywhere wins.
# {n} is the number, {s} optional white space. Neither gives back what it has taken, and a
# number begins where no digit precedes it, so long runs of either are read once.
YEARS_PATTERNS = [
    r"({n}){s}\+?{s}years",
    r"({n}){s}\+?{s}yrs",
    r"({n}){s}\+?{s}year",
    r"({n}){s}\+?{s}yr",
    r"({n}){s}\+",
    r"^{s}({n}){s}$",
]
NUMBER = {"parity": r"(?<!\d)\d++", "decimal": r"(?<!\d)\d++(?:\.\d++)?"}

# A whole text that reads as a floating-point number.
PLAIN_FLOAT = r"^{s}([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)){s}$"


def years_of_experience(column: Column, mode: str = "parity") -> Column:
    """Number of years named in a text, 0 if there is none.

    ``parity`` reads whole digits only, so "1.75 years" gives 75; ``decimal`` reads 1.75.
    """
    text = as_text(column)

    def number(pattern: str) -> Column:
        # Case and outer white space are left to the pattern: no second copy of a long text.
        pattern = "(?i)" + pattern.replace("{n}", NUMBER[mode]).replace("{s}", WS + "*+")
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")

    # The guard in the last pattern matters: Spark would read "5d" as the number 5.
    return F.coalesce(*[number(p) for p in YEARS_PATTERNS], number(PLAIN_FLOAT), F.lit(0.0))
