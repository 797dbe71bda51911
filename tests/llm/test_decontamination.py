import random
import re

import pytest
from cases import documents, edge_documents, empty_documents, prose, with_clashes

from pairrank.llm import decontamination


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(texts, items, window):
    out = []
    for text in texts:
        words, hit, found = terms(text), set(), set()
        for item, passage in items:
            phrase = terms(passage)
            n = min(window, len(phrase))
            for i in range(len(phrase) - n + 1 if n else 0):
                for s in range(len(words) - n + 1):
                    if words[s : s + n] == phrase[i : i + n]:
                        hit.update(range(s, s + n))
                        found.add(item)
        out.append((len(words), len(hit), sorted(found)))
    return out


def rows_of(found):
    return [(r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found.orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed, window, limit", [(1, 10, 500_000), (2, 3, 500_000), (3, 10, -1), (4, 1, 500_000)])
def test_against_all_windows(spark, monkeypatch, seed, window, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    draw = random.Random(seed)
    vocabulary = ["the", "of", "É", "é", "x1", "rare", *prose(seed, 30).split()]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 5, 9, 10, 11, 25])))) for i in range(25)]
    items += [(100, items[0][1]), (101, ""), (102, None), (103, "!!"), (3, items[4][1])]
    texts = []
    for _ in range(50):
        parts = []
        for _ in range(draw.randint(0, 8)):
            words = (draw.choice(items)[1] or "").split()
            cut = draw.randint(0, max(0, len(words) - 1))
            parts += draw.choice([words, words[cut:], words[:cut], [draw.choice(vocabulary) for _ in range(7)]])
        texts.append(draw.choice([" ", ", ", "\n"]).join(w.upper() if draw.random() < 0.2 and w.isascii() else w for w in parts))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontamination.find_benchmark(documents(spark, texts), benchmark, window=window))
    want = plain(texts, items, window)
    assert got == want
    assert any(w[1] for w in want)


def test_spans_and_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [
        f"one two {item} three {item}",
        "alpha beta gamma delta epsilon zeta so eta theta iota kappa lambda mu",
        "alpha " + "filler " * 50 + "mu",
        prose(3, 50),
    ]
    got = decontamination.find_benchmark(documents(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = got.orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in got[0].spans] == [(2, 14), (15, 27)]
    assert [r["items"] for r in got] == [[7], [], [], []]
    assert [r.near_items for r in got] == [[], [7], [], []]


def test_edges(spark):
    docs = edge_documents(spark)
    items = [(1, "twice over"), (None, "word"), (2, None), (3, prose(8, 90)), (3, prose(8, 90)), (4, "É é"), (5, "1234 5678")]
    benchmark = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    got = decontamination.find_benchmark(docs, benchmark).collect()
    assert len(got) == docs.count()
    found = {r.doc_id: r["items"] for r in got if r.n_words}
    assert found == {4: [1], 5: [1], 6: [], 7: [5], 8: [4], 9: [], None: [3]}
    assert all(r.spans == [] for r in got if r.n_words == 0)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_benchmark(docs, none).where("size(spans) > 0").count() == 0
    assert decontamination.find_benchmark(empty_documents(spark), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontamination.find_benchmark(docs, benchmark, window=0)
