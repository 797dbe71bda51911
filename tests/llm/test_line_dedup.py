import random

import pytest
from cases import documents, edge_documents, empty_documents, prose
from pyspark.sql import functions as F

from pairrank.llm import line_dedup


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(texts, min_chars):
    """Texts with the lines that stay, comparing every line with every earlier different one."""
    first = {}
    for d, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line, (d, n))
    order = sorted(first, key=first.get)
    near = {x for i, x in enumerate(order) if len(x) >= min_chars and any(len(y) >= min_chars and one_edit(x, y) for y in order[:i])}
    stay = {first[x] for x in order if x not in near}
    return [None if t is None else "\n".join(
        x for n, x in enumerate(t.split("\n")) if (d, n) in stay or not x.strip(" \t\n\x0b\x0c\r")) for d, t in enumerate(texts)]


def edited(draw, line, alphabet):
    at = draw.randrange(len(line) + 1)
    kind = draw.choice(["insert", "delete", "replace", "none", "two"])
    if kind == "insert":
        return line[:at] + draw.choice(alphabet) + line[at:]
    if kind == "delete":
        return line[:at] + line[at + 1 :]
    if kind == "two":
        return edited(draw, edited(draw, line, alphabet), alphabet)
    return line[:at] + draw.choice(alphabet) + line[at + 1 :] if kind == "replace" else line


@pytest.mark.parametrize("seed, alphabet, lengths, least", [
    (1, "ab", (2, 3, 5, 8), 2), (2, "abé\U0001f600 ", (19, 20, 21, 40), 20), (3, "abcdef ", (63, 64, 65, 66, 130, 300), 20), (4, "a", (1, 5, 30, 31, 32), 20),
])
def test_against_all_pairs(spark, seed, alphabet, lengths, least):
    draw, lines = random.Random(seed), []
    for _ in range(14):
        base = "".join(draw.choice(alphabet) for _ in range(draw.choice(lengths)))
        lines += [edited(draw, base, alphabet) for _ in range(draw.choice([1, 2, 9]))]
    draw.shuffle(lines)
    texts, at = [], 0
    while at < len(lines):
        n = draw.randint(0, 4)
        texts.append("\n".join(lines[at : at + n] + draw.choice([[], ["", " "]])))
        at += n
    want = plain(texts, least)
    got = line_dedup.dedup_lines(documents(spark, texts), min_chars=least).orderBy("doc_id").collect()
    assert [r.text for r in got] == want
    for r, before in zip(got, texts):
        assert r.n_lines == sum(bool(x.strip(" ")) for x in before.split("\n"))
        assert r.n_kept == sum(bool(x.strip(" ")) for x in r.text.split("\n"))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    texts = ["the quick brown fox jumps\nover it all", "the quick brown fox jumpt\nover it all", "the quick brown fox jump", "the quick brown fix jump"]
    got = line_dedup.dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()
    # The last line is one edit from the third, whether or not that one stays.
    assert [r.text for r in got] == [texts[0], "", "", ""] == plain(texts, 20)


def test_long_lines(spark):
    long = prose(5, 15_000)
    texts = [long, long[:50_000] + "#" + long[50_000:], long[:-1], "x" + long[2:], long[:7] + "##" + long[9:]]
    got = line_dedup.dedup_lines(documents(spark, texts)).orderBy("doc_id").select("n_kept").collect()
    assert [r.n_kept for r in got] == [1, 0, 0, 1, 1]


def test_edges(spark):
    docs = edge_documents(spark)
    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == set(docs.columns) | {"n_lines", "n_kept"}
    rows = got.collect()
    assert len(rows) == docs.count()
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert [r.text for r in rows if r.doc_id == 3] == [" \t\n\n "]
    # Rows that repeat id and text have one result, here after an equal text of a smaller id.
    assert {(r.doc_id, r.n_kept) for r in rows if r.doc_id in (4, 5)} == {(4, 2), (5, 0)}
    assert all(r.n_kept == r.n_lines for r in rows if r.doc_id in (6, 8, 9))
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, min_chars=1)


def test_other_names(spark):
    docs = spark.createDataFrame([(1, "same line"), (2, "same line")], "`my id` long, `the.text` string").withColumn("n_kept", F.lit("x"))
    got = line_dedup.dedup_lines(docs, doc_id="my id", text="the.text").orderBy("my id").collect()
    assert [r["the.text"] for r in got] == ["same line", ""]
