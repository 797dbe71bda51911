import random
import re

import numpy as np
import pytest
from cases import documents, edge_documents, empty_documents, prose

from pairrank.llm import minhash
from pairrank.llm.components import components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(ids, texts, percent):
    sets, root = [plain_set(t) for t in texts], list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [ids[find(i)] for i in range(len(ids))], [len(s) for s in sets]


def near_copies(seed, groups, edits):
    """Groups of texts that differ from one base in some words; copies and unrelated texts among them."""
    draw, texts = random.Random(seed), []
    for g in range(groups):
        base = prose(seed * 100 + g, draw.choice([4, 6, 12, 40, 150, 400])).split()
        for _ in range(draw.choice([1, 2, 5, 14])):
            words = list(base)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = f"w{draw.randint(0, 3)}"
            texts.append(draw.choice([" ", "  ", "\n"]).join(words))
        texts.append(texts[-1].upper())
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, percent, pairs_up_to, block", [(1, 85, 8, 2048), (2, 80, 8, 2048), (3, 85, 0, 3), (4, 60, 0, 2048)])
def test_against_all_pairs(spark, monkeypatch, seed, percent, pairs_up_to, block):
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    texts = near_copies(seed, 14, 6)
    want, sizes = plain_components(list(range(len(texts))), texts, percent)
    got = minhash.near_duplicates(documents(spark, texts), percent=percent).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == want
    assert [r.kept for r in got] == [w == i for i, w in enumerate(want)]
    assert len(set(want)) < len(want)


def test_shingles_are_those_of_the_words():
    for text in ("a b c d e f", "a  B\tc\r\nd e", " lead and trail ", "É e É e É e", "one", "x\x1cy z", "", None):
        assert len(minhash.shingles(text)) == len(plain_set(text))
    assert (minhash.shingles("A b C d E f") == minhash.shingles("a\nb c d  e f ")).all()
    assert (minhash.shingles("É b c d e") != minhash.shingles("é b c d e")).any()


def test_registers_hold_the_smallest_hash_of_a_bucket():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 300, np.uint64))
    for bucket, found in enumerate(minhash.registers(hashes).tolist()):
        mine = [int(h) & (2**57 - 1) for h in hashes if int(h) >> 57 == bucket]
        if not mine:
            assert found == 0
            continue
        bits = f"{min(mine):057b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert found >> 26 == zeros + 1 and found & (2**26 - 1) == int((bits + "0" * 64)[zeros + 1 : zeros + 27], 2)


def test_sketches_estimate_the_similarity():
    draw = np.random.default_rng(2).integers(0, 2**64, 4000, np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * share)
        x, y = np.unique(draw[:2000]), np.unique(np.concatenate((draw[:n], draw[2000 : 4000 - n])))
        a, b = minhash.registers(x), minhash.registers(y)
        assert abs((a == b).mean() - n / (4000 - n)) < 0.13
    assert not minhash.plausible(a, minhash.registers(np.unique(draw[2000:])), 2000, 2000, 85)


def test_a_chain_is_one_component(spark):
    words = prose(9, 300).split()
    # Each text differs from the next in five words; the ends share far less.
    texts = [" ".join([f"x{j}" for j in range(i * 3)] + words[i * 3 :]) for i in range(25)]
    want, _ = plain_components(list(range(25)), texts, 85)
    assert set(want) == {0}
    assert {r.component_id for r in minhash.near_duplicates(documents(spark, texts), percent=85).collect()} == {0}


def test_components(spark):
    draw = random.Random(3)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(45)]):
        root = {x: x for e in edges for x in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert sorted((r.node, r.root) for r in got) == sorted((x, root[x]) for x in linked)


def test_edges(spark):
    docs = edge_documents(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    twins = [r for r in got if r.doc_id in (4, 5)]
    assert [(r.component_id, r.kept) for r in sorted(twins, key=lambda r: r.doc_id)] == [(4, True), (4, False), (4, False)]
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.n_shingles == 0)
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=0)
