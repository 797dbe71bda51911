from collections import Counter
from pathlib import Path

import pytest
import test_line_dedup
import test_minhash
from cases import edge_documents, empty_documents, prose
from test_decontamination import terms

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into the first stage, and those that come out of each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, SF), "stage")
        found.append(docs)
    return [(d.columns, sorted(d.collect(), key=lambda r: r.doc_id)) for d in found]


def test_columns(stages):
    assert [c for c, _ in stages[:-1]] == [COLUMNS] * 5
    assert stages[-1][0][:5] == COLUMNS
    assert len(pipeline.STAGES) == 5


def test_language_keeps_clean_documents(stages):
    assert [r for r in stages[0][1] if any(c.isalpha() for c in r.text)] == stages[1][1]


def test_lines(stages):
    before, after = stages[1][1], {r.doc_id: r for r in stages[2][1]}
    for r, text in zip(before, test_line_dedup.plain([r.text for r in before], 20), strict=True):
        if text.strip():
            assert after[r.doc_id].text == text and after[r.doc_id].n_chars == len(text)
        else:
            assert r.doc_id not in after


def test_near_duplicates(stages):
    before = stages[2][1]
    ids = [r.doc_id for r in before]
    root, _ = test_minhash.plain_components(ids, [r.text for r in before], 80)
    assert [r.doc_id for r in stages[3][1]] == [i for i, c in zip(ids, root) if i == c]


def test_benchmark(spark, stages):
    before = stages[3][1]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = terms(r.text)
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} - {()}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = terms(text)
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert [r.doc_id for r in stages[4][1]] == [r.doc_id for r in before if clean(r.text)]
    assert len(stages[4][1]) < len(before)


def test_mixture(stages):
    assert [tuple(r) for r in stages[4][1]] == [tuple(r[c] for c in COLUMNS) for r in stages[5][1]]


def test_run_is_all_stages(spark, stages):
    got = pipeline.run(spark, SF)
    assert got.columns == stages[-1][0]
    assert sorted(got.collect(), key=lambda r: r.doc_id) == stages[-1][1]


def test_edges(spark):
    for docs in (edge_documents(spark), empty_documents(spark)):
        for name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
    docs = edge_documents(spark)
    left = Counter(r.doc_id for r in pipeline.identify_language(spark, docs, SF).collect())
    assert not {1, 2, 3, 7} & set(left)


def test_null_and_repeated_ids(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    copy, other, third = (prose(i, 60) for i in (31, 32, 33))
    near = copy + " more"
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def left(stage, *rows):
        docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], schema)
        return sorted(((r.doc_id, r.text, r.source) for r in stage(spark, docs, SF).collect()), key=str)

    dedup = pipeline.dedup_documents
    # A null id that is a near copy takes no other null id with it, nor a repeated id another text.
    assert left(dedup, (1, copy, "a"), (None, near, "a"), (None, other, "a"), (1, third, "a")) == sorted(
        [(1, copy, "a"), (None, other, "a"), (1, third, "a")], key=str)
    assert left(dedup, (1, copy, "a"), (2, near, "a"), (2, other, "a")) == [(1, copy, "a"), (2, other, "a")]
    # One row of each group: equal rows, rows that differ in another column, null ids only.
    assert left(dedup, *[(3, copy, "a")] * 3, (4, other, "a")) == [(3, copy, "a"), (4, other, "a")]
    assert len(left(dedup, (3, copy, "a"), (3, copy, "b"), (3, copy, None), (3, near, "a"))) == 1
    assert len(left(dedup, (None, copy, "a"), (None, copy, "a"), (None, near, "a"), (None, near, "b"))) == 1
    # Rows without words are no copies of one another.
    assert len(left(dedup, (None, "", "a"), (None, "", "a"), (None, None, "a"), (5, "", "a"))) == 4

    clean = pipeline.decontaminate
    assert left(clean, (None, leak, "a"), (None, copy, "a"), (7, leak, "a"), (7, other, "a"), (8, third, "a"), (8, third, "a")) == sorted(
        [(None, copy, "a"), (7, other, "a"), (8, third, "a"), (8, third, "a")], key=str)
