import pytest
from fakes import CountingEmbedder, Reader
from pyspark.sql import functions as F

from pairrank.models.embedders import HashingEmbedder
from pairrank.plans.matching import run_match
from pairrank.runtime import checkpoint_folder, materialise, spread
from pairrank.sources.tables import read_csv

JOBS = "Role,Description,Degree\nCook,soup and fish,none\nGardener,trees and soil,none\n"
PEOPLE = "Name ,Years of experience ,Degree,Resume Experience \nAnn,3,none,fish soup and more fish\nBo,5,none,\"soil,\ntrees\"\nCy,,none,law\n"


@pytest.fixture
def tables(tmp_path):
    (tmp_path / "jobs.csv").write_text(JOBS)
    (tmp_path / "people.csv").write_text(PEOPLE)
    return str(tmp_path / "jobs.csv"), str(tmp_path / "people.csv")


def test_tables_to_files(spark, tables, tmp_path):
    jobs, people = tables
    out = str(tmp_path / "out")
    result = run_match(spark, HashingEmbedder(128), jobs, people, folder=out, top_n=2, matrix_jobs=["Cook", "Gardener"])
    best = {r.Job: r.Candidate for r in result["top_matches"].where("Rank = 1").collect()}
    assert best == {"Cook": "Ann", "Gardener": "Bo"}
    assert result["similarity"].count() == 6
    written = read_csv(spark, result["output_paths"]["top_matches"])
    assert written.columns == ["Job", "Candidate", "Similarity", "Rank"] and written.count() == 4
    matrix = read_csv(spark, result["output_paths"]["similarity_matrix"])
    assert matrix.columns == ["Name ", "Cook", "Gardener"] and matrix.count() == 3


def test_second_run_reuses_the_store(spark, tables, tmp_path):
    model = CountingEmbedder(tmp_path / "log")
    for _ in range(2):
        result = run_match(spark, model, *tables, store_path=str(tmp_path / "store"))
        assert result["top_matches"].count() == 6
    assert model.embedded() == 5


def test_documents_to_matches(spark, tables, tmp_path):
    cvs = tmp_path / "cvs"
    cvs.mkdir()
    (cvs / "a.txt").write_text("fish soup")
    (cvs / "c.pdf").write_text("no reader")
    fields = {"name": F.lit("Ann"), "experience_summary": F.col("text")}
    result = run_match(
        spark, HashingEmbedder(128), tables[0], document_folder=str(cvs), fields=fields,
        document_options={"suffixes": [".txt", ".pdf"]}, folder=str(tmp_path / "out"),
    )
    assert {r.Candidate for r in result["top_matches"].collect()} == {"Ann"}
    rejects = [("c.pdf", None, "unsupported file type .pdf")]
    assert sorted(map(tuple, result["rejects"].collect())) == rejects and result["n_rejects"] == 1
    assert read_csv(spark, result["output_paths"]["rejects"]).count() == 1
    assert read_csv(spark, f"{tmp_path}/out/extracted_candidates.csv").columns == ["Name ", "Resume Experience ", "source_file"]


def test_missing_inputs_raise(spark, tables):
    model = HashingEmbedder()
    with pytest.raises(ValueError):
        run_match(spark, model, tables[0])
    with pytest.raises(ValueError):
        run_match(spark, model, tables[0], document_folder="/x")
    with pytest.raises(ValueError):
        run_match(spark, model, "/x/jobs.xls", tables[1])


def test_materialised_tables_lie_in_the_checkpoint_folder(spark, plan):
    df = materialise(spark.range(3).toDF("n"))
    assert df.count() == 3
    assert checkpoint_folder(spark).split(":")[-1] in df.inputFiles()[0]


def test_spread_leaves_well_filled_tables(spark):
    wide = spark.range(0, 100, 1, 8)
    assert spread(wide) is wide
    assert spread(wide.coalesce(1), "id").select(F.spark_partition_id()).distinct().count() > 1
