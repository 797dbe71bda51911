"""Column contracts and fixed values shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# Table headers as they appear in the CSV files. The trailing
# spaces are part of the contract.
NAME = "Name "
YEARS = "Years of experience "
DEGREE = "Degree"
SUMMARY = "Resume Experience "
SOURCE_FILE = "source_file"
ROLE = "Role"

CANDIDATE_TEXT_COLUMNS = ["Years of experience ", "Degree", "Resume Experience "]
JOB_TEXT_COLUMNS = ["Role", "Description", "Degree", "Years of Exp", "Expanded Experience", "Notes"]
CANDIDATE_DISPLAY_COLUMNS = ["Name ", "Years of experience ", "Degree", "Resume Experience "]
MATCH_DISPLAY_COLUMNS = ["Job", "Candidate", "Similarity", "Rank"]

# Extracted field name -> table header.
EXTRACTED_TO_HEADER = {
    "name": "Name ",
    "years_of_experience": "Years of experience ",
    "degree": "Degree",
    "experience_summary": "Resume Experience ",
}

# Cell texts that a pandas CSV reader takes for a missing value.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The text a missing cell turns into when columns are joined.
NULL_TOKEN = "nan"

# Default names of the columns the operators add.
CANDIDATE_TEXT = "text_to_embed"
JOB_TEXT = "listing_to_embed"
CONTINGENT = "Contingent"
UNCATEGORIZED = "Uncategorized"

CANDIDATE_SCHEMA = T.StructType([
    T.StructField(NAME, T.StringType()),
    T.StructField(YEARS, T.StringType()),
    T.StructField(DEGREE, T.StringType()),
    T.StructField(SUMMARY, T.StringType()),
])

JOB_SCHEMA = T.StructType([
    T.StructField("Role", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Degree", T.StringType()),
    T.StructField("Years of Exp", T.StringType()),
    T.StructField("Expanded Experience", T.StringType()),
    T.StructField("Notes", T.StringType()),
])

STORE_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("text_sha", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("kind", T.StringType()),
])
