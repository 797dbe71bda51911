import io
import os
import zipfile

import pytest
from fakes import Reader
from pyspark.sql import functions as F

from pairrank import schemas as S
from pairrank.models.retry import RetryPolicy
from pairrank.operators.extraction import candidates_from_folder, extract_fields, in_lanes, model_fields
from pairrank.sinks import save_extracted, save_results, save_top_matches, write_csv, write_text_files
from pairrank.sources.documents import load_and_split, load_documents, with_text
from pairrank.sources.files import latest_file, list_files
from pairrank.sources.tables import load_data, read_csv, read_table, rows_as_text, with_position

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, header="", footer=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {W}>{header}</w:hdr>")
        if footer:
            z.writestr("word/footer1.xml", f"<w:ftr {W}>{footer}</w:ftr>")
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" if not r.startswith("<") else f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


@pytest.fixture
def folder(tmp_path):
    home = tmp_path / "cvs"
    (home / "below").mkdir(parents=True)
    (home / "ann.docx").write_bytes(docx(p("Ann", "<w:tab/>", "Lee") + p("cooks", "<w:br/>", "well"), header=p("Top"), footer=p("End")))
    (home / "Bo.DOCX").write_bytes(docx(p("Bo BROKEN")))
    (home / "bad.docx").write_bytes(b"no archive")
    (home / "empty.docx").write_bytes(docx(""))
    (home / "scan.pdf").write_bytes(b"%PDF page one|page two")
    (home / "notes.txt").write_text("plain text")
    (home / "below" / "deep.docx").write_bytes(docx(p("Deep")))
    return home


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_bytes('﻿Role,Years of Exp,Notes \n"Cook, head","3","two\nlines ""quoted"""\nMaid,None,\n'.encode())
    df = read_csv(spark, str(path))
    assert df.columns == ["Role", "Years of Exp", "Notes "]
    assert [tuple(r) for r in df.collect()] == [("Cook, head", "3", 'two\nlines "quoted"'), ("Maid", None, None)]


def test_csv_round_trip(spark, tmp_path):
    rows = [(" Ann ", 'a,"b"\nc\\', None), ("Bo", "x", "y")]
    df = spark.createDataFrame(rows, "`Name ` string, text string, `a.b` string")
    back = read_csv(spark, write_csv(df, str(tmp_path / "out.csv")))
    assert back.columns == df.columns
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_read_table_by_suffix(spark, tmp_path):
    assert read_table(spark, "/x/y.xlsx") is None
    custom = {".xlsx": lambda s, path: s.createDataFrame([(path,)], "p string")}
    assert read_table(spark, "/x/Y.XLSX", custom).head().p == "/x/Y.XLSX"
    (tmp_path / "a.csv").write_text("Role\nCook\n")
    left, right = load_data(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv"))
    assert left.count() == right.count() == 1
    with pytest.raises(ValueError):
        load_data(spark, str(tmp_path / "a.csv"), "/x/y.xls")


def test_positions_follow_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n" + "\n".join(map(str, range(50))) + "\n")
    rows = with_position(read_csv(spark, str(tmp_path / "a.csv"))).orderBy("position").collect()
    assert [r.v for r in rows] == [str(i) for i in range(50)]


def test_rows_as_text(spark):
    df = spark.createDataFrame([("Cook", None, 3)], "Role string, `a.b` string, n int")
    assert rows_as_text(df).head().text == '{"Role":"Cook","a.b":null,"n":3}'


def test_list_files(spark, folder, plan):
    found = list_files(spark, str(folder))
    assert sorted(r["name"] for r in found.collect()) == ["Bo.DOCX", "ann.docx", "bad.docx", "empty.docx", "scan.pdf"]
    assert {r.suffix for r in found.collect()} == {".docx", ".pdf"}
    assert "content" not in plan(found).split("ReadSchema")[-1]
    assert list_files(spark, str(folder / "missing")).count() == 0


def test_latest_file(spark, folder):
    for i, name in enumerate(["ann.docx", "notes.txt", "scan.pdf"]):
        os.utime(folder / name, (4_000_000_000 + i,) * 2)
    assert latest_file(spark, str(folder), return_path=False).head().file == "scan.pdf"
    assert latest_file(spark, str(folder), "*.docx").head().file.endswith("/ann.docx")
    assert latest_file(spark, str(folder), "*.none").count() == 0


def pdf_pages(content):
    return content.decode().removeprefix("%PDF ").split("|")


def test_document_texts(spark, folder):
    rows = {r["name"]: r for r in load_documents(spark, str(folder), page_readers={".pdf": pdf_pages}).collect()}
    assert rows["ann.docx"].text == "Top\n\nAnn\tLee\n\ncooks\nwell\n\nEnd\n\n"
    assert rows["scan.pdf"].text == "page one\n\npage two\n\n"
    assert rows["notes.txt"].text == "plain text\n\n"
    assert rows["bad.docx"].text is None and "BadZipFile" in rows["bad.docx"].error
    joined = {r["name"]: r for r in load_documents(spark, str(folder), page_sep="").collect()}
    assert joined["Bo.DOCX"].text == "Bo BROKEN"
    assert joined["empty.docx"].text == ""
    assert joined["scan.pdf"].text is None and "unsupported" in joined["scan.pdf"].error
    assert with_text(load_documents(spark, str(folder), page_sep="")).count() == 3


def test_load_and_split(spark, folder):
    rows = load_and_split(spark, str(folder), 12, 2, suffixes=[".txt"]).collect()
    assert [(r.text, tuple(r.metadata)) for r in rows] == [("plain text", ("notes.txt", 0, 0))]


def test_fields_by_rule(spark):
    df = spark.createDataFrame([("Ann: 3 years",)], "text string")
    row = extract_fields(df, "text", {"name": F.regexp_extract("text", r"^(\w+)", 1), "n": F.length("text")}).head()
    assert (row.name, row.n, row.errors) == ("Ann", "12", {})


@pytest.mark.parametrize("parity", [False, True])
def test_folder_to_candidate_table(spark, folder, parity):
    fields = model_fields(Reader(), retry=RetryPolicy(tries=1))
    found = candidates_from_folder(spark, str(folder), fields, error_text=parity, page_readers={".pdf": pdf_pages})
    assert found.columns == [*S.CANDIDATE_DISPLAY_COLUMNS, "source_file", "errors"]
    rows = {r.source_file: r for r in found.collect()}
    assert set(rows) == {"ann.docx", "Bo.DOCX", "scan.pdf"}
    assert rows["ann.docx"]["Name "] == "the:\n\nEnd"
    broken = rows["Bo.DOCX"]
    assert broken.errors == {"degree": "ValueError: cannot read this"}
    assert broken["Degree"] == ("Error extracting degree" if parity else None)
    assert broken["Years of experience "] == "the:ROKEN"


def test_saving_results(spark, tmp_path):
    people = spark.createDataFrame([("Ann", [1.0])], "`Name ` string, embedding array<double>")
    jobs = spark.createDataFrame([("Cook",)], "Role string")
    pairs = spark.createDataFrame([("Ann", 0, "Cook", 0, 0.5), ("Bo", 1, "Cook", 0, 0.25)], "candidate_id string, candidate_position long, job_id string, job_position long, similarity double")
    paths = save_results(people, jobs, pairs, str(tmp_path / "out"), ["Cook"])
    assert read_csv(spark, paths["candidates"]).columns == ["Name "]
    assert spark.read.parquet(paths["similarity"]).count() == 2
    assert {tuple(r) for r in read_csv(spark, paths["similarity_matrix"]).collect()} == {("Ann", "0.5"), ("Bo", "0.25")}
    assert set(save_results(people, jobs, None, str(tmp_path / "out"))) == {"candidates", "jobs"}
    assert read_csv(spark, save_top_matches(jobs, str(tmp_path / "out"))).count() == 1
    first, copy = save_extracted(people, str(tmp_path / "out"), str(tmp_path / "copy.csv"))
    assert read_csv(spark, first).collect() == read_csv(spark, copy).collect()


def test_positions_follow_the_files(spark, tmp_path):
    sizes = {"a.csv": 3, "b.csv": 4000, "c.csv": 1, "d.csv": 900}
    (tmp_path / "t.csv").mkdir()
    want = []
    for file, n in sizes.items():
        rows = [f"{file}{i}" for i in range(n)]
        (tmp_path / "t.csv" / file).write_text("\n".join(["name", *rows]) + "\n")
        want += rows
    for multi_line in (True, False):
        rows = with_position(read_csv(spark, str(tmp_path / "t.csv"), multi_line=multi_line)).orderBy("position").collect()
        assert [r["name"] for r in rows] == want and [r.position for r in rows] == list(range(len(want)))
    unplaced = with_position(spark.createDataFrame([("x",), ("y",)], "name string"))
    assert unplaced.columns == ["name", "position"] and unplaced.count() == 2


@pytest.mark.parametrize("lanes", [1, 3, 8])
@pytest.mark.parametrize("costs", [[5] * 40, [900, 1, 1, 1, 1], list(range(1, 60)), [None, 7, 7, 0], []])
def test_lanes_cost_the_same_but_for_one_row(spark, lanes, costs):
    rows = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(costs)], "name string, cost int")
    dealt = in_lanes(rows, F.col("cost"), lanes, "name")
    assert dealt.columns == ["name", "cost"] and dealt.rdd.getNumPartitions() == lanes
    found = dealt.select("*", F.spark_partition_id().alias("lane")).collect()
    assert sorted((r.name, r.cost) for r in found) == sorted((r.name, r.cost) for r in rows.collect()) if None not in costs else len(found) == len(costs)
    totals, counts = [0] * lanes, [0] * lanes
    for r in found:
        totals[r.lane] += r.cost or 0
        counts[r.lane] += 1
    assert max(totals) - min(totals) <= max([c or 0 for c in costs], default=0)
    assert max(counts) - min(counts) <= 1


def test_no_lanes(spark):
    with pytest.raises(ValueError):
        in_lanes(spark.range(3), F.col("id"), 0, "id")


def test_text_files_are_written_by_tasks(spark, tmp_path):
    """One file per row, no file of Spark's writer beside them, equal rows included; odd paths as they are."""
    texts = ["1\ntext", "", "é中\r\n x ", "1\ntext"] * 5
    scan = spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)
    folder = write_text_files(scan, f"file:{tmp_path}/a %20#b/texts")
    files = list((tmp_path / "a %20#b" / "texts").iterdir())
    assert len(files) == len(texts) and {f.suffix for f in files} == {".txt"}
    assert sorted(f.read_bytes().decode() for f in files) == sorted(t + "\n" for t in texts)
    assert folder.endswith("/texts")
    elsewhere = write_text_files(scan, f"{tmp_path}/spark")
    assert sorted(r.text for r in load_documents(spark, elsewhere, [".txt"], page_sep="").collect()) == sorted(t + "\n" for t in texts)


def test_many_splits_are_read_by_few_tasks(spark, tmp_path):
    count = 33 * 4 * spark.sparkContext.defaultParallelism
    for i in range(count):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    loaded = load_documents(spark, str(tmp_path), [".txt"], page_sep="")
    assert loaded.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {r.text for r in loaded.collect()} == {f"text {i}" for i in range(count)}


def test_files_of_a_mounted_folder_are_listed_by_a_task(spark, folder, plan):
    """The same rows as of Spark's scan; before, the driver held every file in the plan's list of files."""
    (folder / "a %20#b.txt").write_text("odd name\r\n")
    (folder / "nothing.txt").write_bytes(b"")
    (folder / "_hidden.txt").write_text("not read")
    (folder / ".hidden.txt").write_text("not read")
    (folder / "_a=b.txt").write_text("read")
    (folder / "txt").write_text("no suffix")
    (folder / "to.txt").symlink_to(folder / "notes.txt")
    (folder / "gone.txt").symlink_to(folder / "nowhere")
    for options in ({}, {"suffixes": [".txt"]}, {"page_sep": "", "page_readers": {".pdf": pdf_pages}}, {"suffixes": [".none"]}):
        scanned = load_documents(spark, str(folder), **options)
        for name in (f"file:{folder}", f"file://{folder}/", f"file:{folder}//"):
            listed = load_documents(spark, name, **options)
            assert listed.columns == scanned.columns
            assert sorted(map(str, listed.collect())) == sorted(map(str, scanned.collect()))
            assert "binaryfile" not in plan(listed).lower() and not any(str(folder) in f for f in listed.inputFiles())


def test_listed_files_where_spark_finds_partitions_or_patterns(spark, folder, tmp_path):
    for name in (f"file:{tmp_path}/cv*", f"file:{tmp_path}/nowhere"):
        assert sorted(map(str, load_documents(spark, name).collect())) == sorted(map(str, load_documents(spark, name[5:]).collect()))
    (tmp_path / "parts" / "kind=a").mkdir(parents=True)
    (tmp_path / "parts" / "kind=a" / "x.txt").write_text("x")
    assert [r.text for r in load_documents(spark, f"file:{tmp_path}/parts", page_sep="").collect()] == ["x"]


def test_many_files_of_a_mounted_folder(spark, tmp_path, monkeypatch):
    from pairrank.sources import documents, files

    for i in range(60):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    monkeypatch.setattr(documents, "TASK_FILES", 3)
    monkeypatch.setattr(documents, "SENT_FILES", 2)
    monkeypatch.setattr(files, "LISTED", 7)
    loaded = load_documents(spark, f"file:{tmp_path}", [".txt"], page_sep="")
    assert loaded.rdd.getNumPartitions() == 20
    assert sorted(r.text for r in loaded.collect()) == sorted(f"text {i}" for i in range(60))
