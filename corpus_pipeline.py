"""A training-data pipeline over ``documents``: language, lines, near copies, benchmark, mixture.

Each stage takes what the one before kept, as a written table, and returns the columns of
``documents`` (the last one adds the places of the mixture, and puts rows in its order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.llm import decontamination, language, line_dedup, minhash, mixing
from pairrank.llm import queries as Q
from pairrank.llm.expressions import columns_of, table, unused
from pairrank.runtime import materialise

# Language ID rejects a text without letters, and one whose best language has a lower score.
LEAST_SCORE = 0.5
NEAR_PERCENT = 80


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an identity, which only rows that are equal in all columns share, and the identity's name.

    It sorts by doc_id, null last; then come hashes of the text and of the whole row, in
    which a null differs from an empty cell.
    """
    cells = columns_of(docs)
    name, = unused(docs, "row_id")
    whole = F.xxhash64(F.lit(1), *cells, *(c.isNull() for c in cells))
    identity = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), whole.alias("whole"))
    return docs.withColumn(name, identity), name


def without(rows: DataFrame, row_id: str, gone: DataFrame) -> DataFrame:
    """The identified ``rows`` whose identity is not the doc_id of a row of ``gone``."""
    return rows.join(gone.select(F.col("doc_id").alias(row_id)).distinct(), row_id, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language. The model learns outside the holdout, as in op4."""
    model, _ = Q.learned_language(docs)
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*columns_of(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars counted anew; a document of which no line stays goes."""
    cut = line_dedup.dedup_lines(docs).where("n_kept > 0")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*columns_of(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id.

    Of rows with that doc_id the one of the smallest text hash stays, and of equal rows one.
    A row without an id stays only where no other of its group has one. Rows without words
    are in no group and all stay.
    """
    rows, row_id = identified(docs)
    found = materialise(minhash.near_duplicates(rows, percent=NEAR_PERCENT, doc_id=row_id), "near-duplicates")
    staying = without(rows, row_id, found.where("NOT kept"))
    # Only the rows that repeat are grouped, not all texts.
    copies = found.where("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias(row_id)).agg(F.count("*").alias("n")).where("n > 1")
    copies = materialise(copies.select(row_id), "equal-rows")
    once = staying.join(copies, row_id, "left_semi").dropDuplicates([row_id])
    return staying.join(copies, row_id, "left_anti").unionByName(once).select(*columns_of(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows, row_id = identified(docs)
    found = decontamination.find_benchmark(rows.select(F.col(row_id).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, row_id, found.where(F.size("spans") > 0)).select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, with their places in it."""
    return mixing.in_order(mixing.mix(docs, Q.TARGETS, Q.REST, Q.BLOCK_CHARS, size=F.length("text")))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]
# A model's predictions have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
