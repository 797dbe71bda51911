"""Text expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairrank.schemas import NULL_TOKEN

# Fixed value: every character that counts as white space (Unicode-wide; Java's own
# \s is ASCII only). The same class works in RE2.
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
# Fixed value: the characters of that class, one by one.
WS_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def quoted(name: str) -> Column:
    """Column by its exact name, which may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(column: Column, null_token: str = NULL_TOKEN) -> Column:
    """Text form of a cell; a missing one becomes ``null_token``."""
    return F.coalesce(column.cast("string"), F.lit(null_token))


def trim_ws(column: Column) -> Column:
    """Strip white space at both ends (Spark's plain ``trim`` strips only U+0020), in linear time."""
    return F.btrim(column, F.lit(WS_CHARACTERS))


def collapse_ws(column: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    # After the replacement only U+0020 is left, so the plain trim is enough.
    return F.trim(F.regexp_replace(column, f"{WS}+", " "))


def safe_id(column: Column) -> Column:
    """Anything that is no letter or digit becomes ``_``. For file names, never as a key."""
    return F.regexp_replace(column, r"[^\p{L}\p{N}]", "_")


def clean_id(column: Column) -> Column:
    """An identifier as stripped text."""
    return trim_ws(as_text(column))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, or an empty text."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def fixed_decimals(column: Column, places: int) -> Column:
    """A number as text with ``places`` decimals; missing stays missing."""
    return F.when(column.isNotNull(), F.format_string(f"%.{places}f", column))
