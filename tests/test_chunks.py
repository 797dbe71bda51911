import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairrank.functions.chunks import chunk_text, split_fixed, split_recursive

TEXTS = [
    "", "short", "x" * 999, "x" * 1000, "x" * 1001, "x" * 1800, "x" * 1801, "ab\n" * 900,
    "\U0001f600é" * 1300, None,
]


@pytest.mark.parametrize("size,overlap", [(1000, 200), (10, 7), (7, 0)])
def test_fixed_chunks_cover_every_text(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    found = {}
    for r in split_fixed(df, "text", size, overlap).orderBy("id", "chunk_id").collect():
        found.setdefault(r.id, []).append((r.chunk_id, r.start_index, r.chunk))
    step = size - overlap
    for i, text in enumerate(TEXTS):
        if not text:
            assert i not in found
            continue
        starts = list(range(0, max(len(text) - overlap, 1), step))
        assert found[i] == [(n, s, text[s:s + size]) for n, s in enumerate(starts)]


def test_fixed_chunks_do_not_carry_the_text(spark, plan):
    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    generate = next(line for line in plan(split_fixed(df, "text")).splitlines() if "Generate" in line)
    assert "regexp_extract_all" not in generate


def test_fixed_chunks_reject_a_full_overlap(spark):
    with pytest.raises(ValueError):
        split_fixed(spark.createDataFrame([("a",)], "text string"), "text", 10, 10)


def test_recursive_prefers_paragraphs_then_lines_then_words():
    text = "one two three\n\nfour five\nsix seven eight nine"
    cut = [c["chunk"] for c in chunk_text(text, 14, 0)]
    assert cut == ["one two three", "four five", "six seven", "eight nine"]


def test_recursive_overlap_repeats_whole_pieces():
    cut = [c["chunk"] for c in chunk_text("aa bb cc dd ee", 8, 3)]
    assert cut == ["aa bb cc", "cc dd", "dd ee"]
    assert [c["start_index"] for c in chunk_text("aa bb cc dd ee", 8, 3)] == [0, 6, 9]


def test_recursive_falls_back_to_characters():
    assert [c["chunk"] for c in chunk_text("abcdefghij", 4, 1)] == ["abcd", "defg", "ghij"]


words = st.text(alphabet="ab \né", max_size=200)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(3, 30), st.integers(0, 2))
def test_recursive_chunks_are_pieces_of_the_text(text, size, overlap):
    chunks = chunk_text(text, size, overlap)
    kept = "".join("".join(c["chunk"].split()) for c in chunks)
    for c in chunks:
        assert 0 < len(c["chunk"]) <= size
        assert text[c["start_index"]:c["start_index"] + len(c["chunk"])] == c["chunk"]
    # Overlap repeats characters, but none is lost.
    assert len(kept) >= len("".join(text.split()))


def test_recursive_in_spark(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, ""), (3, None)], "id int, text string")
    rows = [tuple(r) for r in split_recursive(df, "text", 8, 3).orderBy("chunk_id").collect()]
    assert rows == [(1, 0, 0, "aa bb cc"), (1, 1, 6, "cc dd"), (1, 2, 9, "dd ee")]
