"""Rows that any operator must stand: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for columns of their own.
CLASHES = (
    "row hash key stream slot block place full size node words n at id line print spans items near stratum score kept n_lines "
    "n_words lang_pred matches members registers root s b doc order rank spans_ position term count "
    "bucket group id nth nth_row at ahead ids word form vec shard chars __stream __order __at __bucket __key __size "
    "__kept __doc __lines __text __hash __found __row doc doc_ lines cut found row_id row_id_ a.b back`quote"
).split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeilnorst") for _ in range(draw.randint(2, 7))) for _ in range(n))


def edge_rows():
    long = "\n".join(prose(1000 + i, 200) for i in range(100))
    twin = "The same line of text stands here twice over.\n" + prose(7, 120)
    return [
        (1, None, "en", "src0", None),
        (2, "", None, None, 0),
        (3, " \t\n\n ", "en", "src1", 5),
        (4, twin, "en", "src0", 1),
        (5, twin, "en", "src9", 1),
        (5, twin, "en", "src9", 1),
        (None, prose(8, 90), "de", "src0", 2),
        (None, None, None, None, None),
        (6, long, "fr", "src0", 3),
        (7, "1234 5678 !!", "fr", "src2", 3),
        (8, "É é ÀÈ \U0001f600 " * 30, "fr", "src2", 3),
        (9, "word", "en", "src2", 3),
    ]


def edge_documents(spark):
    return with_clashes(spark.createDataFrame(edge_rows(), SCHEMA))


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def empty_documents(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


def documents(spark, texts, **others):
    rows = [(i, t, others.get("lang", "en"), "src0", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
