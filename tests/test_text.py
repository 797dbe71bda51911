import pytest
from pyspark.sql import functions as F

from pairrank import schemas as S
from pairrank.functions.text import clean_id, file_name, file_suffix, fixed_decimals, safe_id, trim_ws
from pairrank.functions.years import years_of_experience
from pairrank.operators import cleaning

YEARS = [
    ("less than 5 years (about 2-3 years)", 5.0),
    ("2023-2024: 1 year\n2020-2023: 3 years\ntotal: 24 years", 3.0),
    ("approx 1.75 years", 75.0),
    ("3.5 years", 5.0),
    ("5.5", 5.5),
    ("7", 7.0),
    ("　7\x1c", 7.0),
    ("10+", 10.0),
    ("10 + YRS", 10.0),
    ("1 yr", 1.0),
    ("4 years", 4.0),
    (None, 0.0),
    ("no mention", 0.0),
    ("5d", 0.0),
    ("nan", 0.0),
    ("-3", -3.0),
    ("1e3", 1000.0),
    ("inf", float("inf")),
    ("-Infinity", float("-inf")),
    ("9" * 20 + " years", 1e20),
]


def test_years(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(YEARS)], "i int, years string")
    got = {r.i: r.years_numeric for r in cleaning.normalize_years(df, "years").collect()}
    assert [got[i] for i in range(len(YEARS))] == [want for _, want in YEARS]


def test_years_decimal_mode_and_absent_column(spark):
    df = spark.createDataFrame([("about 1.75 years",)], "t string")
    assert df.select(years_of_experience(F.col("t"), "decimal")).head()[0] == 1.75
    assert cleaning.normalize_years(df, "other").columns == ["t"]


SPACES = [c for c in map(chr, range(0x10000)) if c.isspace()]


def test_white_space_is_the_same_as_in_python(spark):
    text = "a" + "".join(f"{c}b" for c in SPACES)
    df = spark.createDataFrame([("".join(SPACES) + "x y" + "".join(SPACES), text)], "t string, u string")
    row = cleaning.clean_text(df, ["t", "u", "missing"]).head()
    assert row.t == "x y"
    assert row.u == " ".join(text.split())
    assert df.select(trim_ws(F.col("t"))).head()[0] == "x y"


def test_combine_columns(spark):
    df = spark.createDataFrame([("a\t b", None, 3), ("", "x", None)], "p string, q string, r int")
    rows = cleaning.combine_columns(df, ["p", "q", "gone", "r"], "all").select("all", "gone").collect()
    assert [tuple(r) for r in rows] == [("a b nan 3", ""), ("x nan", "")]
    kept = cleaning.combine_columns(df, ["p", "q"], "all", null_token="", collapse=False)
    assert [r["all"] for r in kept.collect()] == ["a\t b ", " x"]


def test_entity_texts_use_the_fixed_columns(spark):
    people = spark.createDataFrame(
        [("5", None, "did  things")], f"`{S.YEARS}` string, `{S.DEGREE}` string, `{S.SUMMARY}` string"
    )
    assert cleaning.candidate_text(people).head()[S.CANDIDATE_TEXT] == "5 nan did  things"
    jobs = spark.createDataFrame([("Cook", 3)], "Role string, `Years of Exp` int")
    assert cleaning.job_text(jobs).head()[S.JOB_TEXT] == "Cook   3  "


def test_fill_missing_by_type(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), None, None, None), (1, 2.0, "t", True, None)],
        "i int, d double, s string, b boolean, ts timestamp",
    )
    rows = cleaning.fill_missing(df, 7, "-").collect()
    assert tuple(rows[0]) == (7, 7.0, "-", None, None)
    assert tuple(rows[1]) == (1, 2.0, "t", True, None)


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a, b,,c "), (2, " ,,"), (3, None)], "id int, v string")
    rows = [tuple(r) for r in cleaning.split_rows(df, "v").orderBy("id", "v").collect()]
    assert rows == [(1, "a"), (1, "b"), (1, "c"), (3, "nan")]
    raw = [tuple(r) for r in cleaning.split_rows(df, "v", strip=False).orderBy("id", "v").collect()]
    assert raw == [(1, " b"), (1, "a"), (1, "c "), (2, " "), (3, "nan")]
    assert cleaning.split_rows(df, "w") is df
    with pytest.raises(ValueError):
        cleaning.split_rows(df, "v", "(,)")


def test_rename_and_drop(spark):
    df = spark.createDataFrame([("n", "1", "d", "s", [1.0])], "name string, years_of_experience string, degree string, experience_summary string, embedding array<double>")
    assert cleaning.rename_extracted(cleaning.drop_embedding(df)).columns == ["Name ", "Years of experience ", "Degree", "Resume Experience "]
    assert cleaning.drop_embedding(df.select("name")).columns == ["name"]


def test_ids_and_names(spark):
    df = spark.createDataFrame([(" A bé-1 ", "file:/x/My.Cv.DOCX", 0.5), (None, "/y/none", None)], "id string, path string, v double")
    rows = df.select(
        clean_id(F.col("id")), safe_id(clean_id(F.col("id"))), file_name(F.col("path")), file_suffix(F.col("path")),
        fixed_decimals(F.col("v"), 3),
    ).collect()
    assert tuple(rows[0]) == ("A bé-1", "A_bé_1", "My.Cv.DOCX", ".docx", "0.500")
    assert tuple(rows[1]) == ("nan", "nan", "none", "", None)
