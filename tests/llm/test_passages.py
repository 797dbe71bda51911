import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, edge_documents, empty_documents, prose

from pairrank.llm import passages
from pairrank.llm.suffixes import common_prefixes, joined, repeated_windows, suffix_array


def plain(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept))
    return out


def mosaic(seed):
    """Texts put together from shared passages, with runs and repeats inside."""
    draw = random.Random(seed)
    parts = [prose(seed * 50 + i, n) for i, n in enumerate([30, 60, 90, 150, 200])] + ["ab" * 200, "x" * 700, "é" * 150, "\x00" * 160]
    texts = ["".join(draw.choice(parts)[draw.randint(0, 20) :] + draw.choice(["", " ", f" {draw.random()} "]) for _ in range(draw.randint(0, 6)))
             for _ in range(40)]
    return texts + [None, "", "short", texts[0], prose(99, 400)]


@pytest.mark.parametrize("seed, window, hash_bytes", [(1, 400, 16 << 20), (2, 150, 16 << 20), (3, 128, 16 << 20), (1, 400, 0), (2, 150, 0), (3, 128, 0)])
def test_against_all_windows(spark, monkeypatch, seed, window, hash_bytes):
    # Without room for a hash, every one with different segments is split to the end.
    monkeypatch.setattr(passages, "HASH_BYTES", hash_bytes)
    monkeypatch.setattr(passages, "TASK_BYTES", 20_000)
    texts = mosaic(seed)
    got = passages.remove_passages(documents(spark, texts), window=window).orderBy("doc_id").collect()
    want = plain(texts, window)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)


def test_suffix_arrays():
    draw = random.Random(7)
    for round_ in range(60):
        window, kinds = draw.choice([3, 8, 20]), draw.choice([1, 2, 26])
        pieces = [bytes(draw.choice(range(97, 97 + kinds)) for _ in range(draw.choice([0, 1, 40, 120]))) for _ in range(draw.randint(1, 6))]
        symbols, _ = joined(pieces)
        order = suffix_array(symbols, window)
        padded = [*symbols.tolist(), *[0] * window]
        prefixes = [tuple(padded[i : i + window]) for i in order]
        assert sorted(order) == list(range(len(symbols))) and prefixes == sorted(prefixes)
        shared = [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), window) for x, y in zip(prefixes, prefixes[1:])]
        assert common_prefixes(order[:-1], order[1:], symbols, window).tolist() == shared
        seen = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
        assert [g.tolist() for g in repeated_windows(pieces, window)] == [
            [i for i in range(len(p) - window + 1) if seen[p[i : i + window]] > 1] for p in pieces]


def test_equal_windows_meet():
    """Every window belongs to one segment, and equal windows to segments of one hash."""
    owner = {}
    for text in mosaic(4):
        data = (text or "").encode()
        covered = []
        for hash_, _, start, size, _ in passages.segments(data):
            for i in range(start, start + size - passages.WINDOW + 1):
                covered.append(i)
                assert owner.setdefault(data[i : i + passages.WINDOW], hash_) == hash_
        assert covered == list(range(max(0, len(data) - passages.WINDOW + 1)))


def test_split_pieces():
    """After each step every window belongs to one part, and equal windows to parts of equal core."""
    for window in (400, 151, 128):
        owner: dict[tuple, tuple] = {}
        for text in mosaic(6):
            data = (text or "").encode()
            for hash_, _, start, size, _ in passages.segments(data, window):
                parts = [(hash_, b"", 0, -1, data[start : start + size])]
                core = passages.GRAM
                while core < window:
                    parts = [(h, p, s0 + s, c, x) for h0, _, s0, c0, x0 in parts for h, p, s, c, x in passages.split_piece(x0, window, core, h0, c0)]
                    core += -(-(window - core) // 2)
                    starts = [s + i for _, _, s, _, x in parts for i in range(len(x) - window + 1)]
                    assert starts == list(range(size - window + 1))
                    for h, _, _, c, x in parts:
                        for i in range(len(x) - window + 1):
                            assert owner.setdefault((core, x[i : i + window]), (h, c - i)) == (h, c - i)
                assert all(len(x) == window for *_, x in parts) or window == passages.GRAM


def test_heavy_hash_in_little_memory(spark, monkeypatch):
    """Thousands of near copies of a passage in different surroundings: split until every sort is small."""
    monkeypatch.setattr(passages, "HASH_BYTES", 1 << 16)
    monkeypatch.setattr(passages, "TASK_BYTES", 1 << 16)
    passage = prose(11, 100)
    texts = [prose(2_000 + i, 30) + passage[: 560 if i % 3 else 480] + prose(9_000 + i, 30) for i in range(600)]
    got = passages.remove_passages(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == plain(texts, 400)
    # The same pieces all at once, by the sort alone.
    pieces = [t.encode() for t in texts[:60]]
    assert [len(f) for f in repeated_windows(pieces, 400)] == [r[1] - 399 for r in plain(texts[:60], 400)]


def test_edges(spark):
    docs = edge_documents(spark)
    got = passages.remove_passages(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert (by_id[1].n_bytes, by_id[1].n_removed, bytes(by_id[1].kept)) == (0, 0, b"")
    assert by_id[4].n_removed == by_id[5].n_removed == by_id[4].n_bytes and by_id[4].n_spans == 1
    assert by_id[6].n_removed == 0 and by_id[6].n_bytes > 50_000
    assert passages.remove_passages(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        passages.remove_passages(docs, window=10)


def test_one_long_run(spark):
    got = passages.remove_passages(documents(spark, ["a" * 300_000, "b" * 399, "b" * 400, "c" * 401])).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans) for r in got] == [(300_000, 1), (0, 0), (0, 0), (401, 1)]
