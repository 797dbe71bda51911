import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, edge_documents, empty_documents

from pairrank.llm import spelling


def neighbours(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(pairs):
    """Everything by comparing each word with each."""
    counts = Counter()
    for doc, text in pairs:
        for run in "".join(c if "a" <= c.lower() <= "z" or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if neighbours(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


def variants(seed, kinds="abcdéÉÿ×zÀ"):
    draw = random.Random(seed)
    words = ["".join(draw.choice(kinds) for _ in range(draw.randint(6, 11))) for _ in range(25)] + ["abababab", "aaaaaaaa", "a" * 400]
    texts = []
    for i in range(60):
        row = []
        for w in words:
            w = list(w)
            for _ in range(draw.choice([0, 0, 1, 2])):
                k = draw.randrange(len(w))
                w[k : k + draw.randint(0, 1)] = draw.choice(["", draw.choice(kinds)])
            row += ["".join(w).upper() if draw.random() < 0.1 else "".join(w)] * draw.choice([0, 1, 1, 4, 30])
        texts.append(draw.choice([" ", "1", "_\n"]).join(row))
    return texts + [None, ""]


def result(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("seed, node_words", [(1, 20_000), (2, 30), (3, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, node_words):
    """With few words to a node the walk goes down several levels, down to leaves that are dealt over blocks."""
    monkeypatch.setattr(spelling, "NODE_WORDS", node_words)
    monkeypatch.setattr(spelling, "SEARCH_WORDS", node_words * 2)
    texts = variants(seed)
    got = result(spelling.spelling_forms(documents(spark, texts)))
    want = plain(enumerate(texts))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_large_leaves():
    """Words of the same letters fill one leaf; its candidates come by halves."""
    draw = random.Random(5)
    words = sorted({"".join(draw.sample("aabbccddé", 9)) for _ in range(900)} | {"".join(draw.sample("aabbccdd", 8)) for _ in range(300)})
    near = spelling.Search(words, words)
    z = np.zeros(len(words))
    w, m = near.run(0, z, z)
    by_rest = defaultdict(set)
    for k, x in enumerate(words):
        for i in range(len(x)):
            by_rest[i, x[:i] + x[i + 1 :]].add(k)
    at = {x: k for k, x in enumerate(words)}
    want = {(a, b) for group in by_rest.values() for a in group for b in group if a != b}
    want |= {p for (_, rest), group in by_rest.items() if rest in at for a in group for p in ((a, at[rest]), (at[rest], a))}
    assert set(zip(w.tolist(), m.tolist())) == want and len(w) == len(want) > 0


def test_one_edit():
    draw = random.Random(2)
    x = ["".join(draw.choice("abz") for _ in range(draw.randint(1, 6))) for _ in range(800)]
    y = ["".join(draw.choice("abz") for _ in range(draw.randint(1, 6))) for _ in range(800)]
    k = np.arange(800)
    assert spelling.one_edit(spelling.Letters(x), k, spelling.Letters(y), k).tolist() == [neighbours(a, b) for a, b in zip(x, y)]


def test_chains_and_ties(spark):
    """A form of a form leads to the last one, and of equally frequent near words the first in code-point order counts."""
    words = spark.createDataFrame([("abcdefgh", 2, 20), ("abcdefgx", 20, 200), ("abcdefxx", 200, 2000), ("abcdexxx", 2000, None)], "word string, n long, f long")
    forms = words.where("f IS NOT NULL").selectExpr("word", "CASE word WHEN 'abcdefgh' THEN 'abcdefgx' WHEN 'abcdefgx' THEN 'abcdefxx' ELSE 'abcdexxx' END AS form")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {("abcdefgh", "abcdexxx"), ("abcdefgx", "abcdexxx"), ("abcdefxx", "abcdexxx")}
    tied = spark.createDataFrame([("zzzzzzza", 2), ("zzzzzzzé", 50), ("zzzzzzzc", 50)], "word string, n long")
    best = {r.word: (r.n_near, r.best.less, r.best.near) for r in spelling.near_words(tied).collect()}
    assert best["zzzzzzza"] == (2, -50, "zzzzzzzc") and best["zzzzzzzc"] == (2, -50, "zzzzzzzé")


def test_edges(spark):
    docs = edge_documents(spark)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = result(spelling.spelling_forms(docs))
    assert set(got) == want and len(got) == len(want) > 0
    assert result(spelling.spelling_forms(empty_documents(spark))) == []
    assert result(spelling.spelling_forms(documents(spark, [None, "", "short", "Unique words standing once"]))) == []
