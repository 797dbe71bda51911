"""Table cleaning: combine, clean, fill, parse and split columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairrank import schemas as S
from pairrank.functions.text import as_text, collapse_ws, quoted, trim_ws
from pairrank.functions.years import years_of_experience


def combine_columns(df: DataFrame, columns: list[str], new_column: str, null_token: str = S.NULL_TOKEN,
                    collapse: bool = True) -> DataFrame:
    """Join columns into one text with single spaces; an absent column counts as empty."""
    present = set(df.columns)
    df = df.withColumns({c: F.lit("") for c in columns if c not in present})
    # concat_ws skips nulls, so every part is made non-null first.
    text = F.concat_ws(" ", *[as_text(quoted(c), null_token) for c in columns])
    return df.withColumn(new_column, collapse_ws(text) if collapse else text)


def candidate_text(df: DataFrame, null_token: str = S.NULL_TOKEN) -> DataFrame:
    """The text a candidate is matched by."""
    return combine_columns(df, S.CANDIDATE_TEXT_COLUMNS, S.CANDIDATE_TEXT, null_token, collapse=False)


def job_text(df: DataFrame, null_token: str = S.NULL_TOKEN) -> DataFrame:
    """The text a job is matched by."""
    return combine_columns(df, S.JOB_TEXT_COLUMNS, S.JOB_TEXT, null_token, collapse=False)


def clean_text(df: DataFrame, text_columns: list[str], null_token: str = S.NULL_TOKEN) -> DataFrame:
    """Collapse white space in the named columns; absent ones are passed over."""
    present = set(df.columns)
    return df.withColumns({
        c: collapse_ws(as_text(quoted(c), null_token)) for c in text_columns if c in present
    })


def fill_missing(df: DataFrame, numeric_fill: float = 0, text_fill: str = "") -> DataFrame:
    """Fill missing cells by column type. Other types than numbers and texts stay as they are."""
    filled = {}
    for field in df.schema:
        column = quoted(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.nanvl(column, F.lit(None).cast(field.dataType))
        if isinstance(field.dataType, T.NumericType):
            filled[field.name] = F.coalesce(column, F.lit(numeric_fill).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            filled[field.name] = F.coalesce(column, F.lit(text_fill))
    return df.withColumns(filled)


def normalize_years(df: DataFrame, column: str, mode: str = "parity") -> DataFrame:
    """Add ``<column>_numeric``; the table is returned as it is if the column is absent."""
    if column not in df.columns:
        return df
    return df.withColumn(f"{column}_numeric", years_of_experience(quoted(column), mode))


def split_rows(df: DataFrame, column: str, split_pattern: str = ",", strip: bool = True,
               null_token: str = S.NULL_TOKEN) -> DataFrame:
    """One row per delimited value; empty values are left out."""
    if re.compile(split_pattern).groups:
        raise ValueError("use (?:...) in a delimiter pattern")
    if column not in df.columns:
        return df
    values = F.split(as_text(quoted(column), null_token), split_pattern)
    if strip:
        values = F.transform(values, trim_ws)
    return df.select(*[
        F.explode(F.filter(values, lambda v: v != "")).alias(c) if c == column else quoted(c) for c in df.columns
    ])


def rename_extracted(df: DataFrame) -> DataFrame:
    """Extracted field names to the headers of the candidate table."""
    return df.withColumnsRenamed(S.EXTRACTED_TO_HEADER)


def drop_embedding(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The table without its vectors, if it has any."""
    return df.drop(column)
