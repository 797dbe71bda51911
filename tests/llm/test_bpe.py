import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from cases import documents, edge_documents, empty_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairrank.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


@lru_cache
def own():
    with open(PATH, "rb") as file:
        return bpe.vocabulary(file.read())


def ids_of(text):
    return library().encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab "), st.text("the ing'sllve 12\n\t"), st.text("=-_*é中\U0001f600́"), st.text("<|endoftx>", max_size=40)))
def test_any_text(text):
    ids = own().encode(text)
    assert list(ids) == ids_of(text)
    assert own().decode(np.array(ids, np.uint32)) == text


def test_every_kind_of_character():
    for c in [*range(0, 0x3100), *range(0xFE00, 0x10100), *range(0x1F5F0, 0x1F700), 0x10FFFF]:
        s = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} {chr(c)} \n{chr(c)} x"
        assert list(own().encode(s)) == ids_of(s), hex(c)


def test_long_pretokens_and_added_tokens():
    draw = random.Random(3)
    for s in ["a" * 70_001, "ab" * 9_000, "=" * 5_003, " " * 4_001 + "x", "".join(draw.choice("etaoin") for _ in range(20_000)),
              "x<|endoftext|>y <|endoftext|><|endoftext|>", "<|endoftext", "word " * 20_000]:
        assert list(own().encode(s)) == ids_of(s)


def test_plain_merges():
    """The merges done one by one, lowest rank and leftmost first, give the same tokens."""
    v, draw = own(), random.Random(5)
    name = {i: t for t, i in v.tokens.items()}
    for _ in range(300):
        pretoken = "".join(draw.choice("abcdeghinorst") for _ in range(draw.randint(1, 30)))
        parts = [v.tokens[c] for c in pretoken]
        while ranks := [(v.merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in v.merges]:
            _, i = min(ranks)
            parts[i : i + 2] = [v.tokens[name[parts[i]] + name[parts[i + 1]]]]
        assert list(v.encode_pretoken(pretoken)) == parts


def test_decode_any_ids():
    draw = random.Random(1)
    for size in [0, 1, 5, 40, 200]:
        ids = [draw.randrange(50_300) for _ in range(size)]
        assert own().decode(np.array(ids, np.uint32)) == library().decode(ids, skip_special_tokens=False)
    long = ids_of("the long text " * 12_000)
    assert len(long) > bpe.CHUNK / 2 and own().decode(np.array(long * 3, np.uint32)) == library().decode(long * 3, skip_special_tokens=False)


def test_memory_of_pretokens_is_bounded(monkeypatch):
    kept = bpe.Remembered(lambda k: k * 2, 3, 4)
    assert [kept[k] for k in ["a", "b", "c", "d", "a", "long key"]] == ["aa", "bb", "cc", "dd", "aa", "long keylong key"]
    assert len(kept) <= 3 and len(kept.before) <= 3 and "long key" not in kept


def test_edges(spark):
    docs = edge_documents(spark)
    got = bpe.round_trip(docs, PATH).collect()
    texts = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == texts
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == ids_of(r.decoded) and r.n_tokens == len(ids)
    assert bpe.round_trip(empty_documents(spark), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).first().text == ""


def test_digests(spark):
    import hashlib

    from pairrank.llm.queries import token_digests

    texts = ["Some text, with 'quotes' and\n\nlines", "", None, "é" * 50]
    got = token_digests(documents(spark, texts), PATH).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        ids = np.array(ids_of(text or ""), "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


def test_short_pretokens_are_merged_together(monkeypatch):
    """Those of up to 64 bytes, many at once, whatever their lengths; the rest in linear time as before."""
    v, draw = bpe.Vocabulary(open(PATH, "rb").read()), random.Random(7)
    words = ["".join(draw.choice("etaoinshrdluéßñ中 '1-") for _ in range(draw.randint(1, 64))) for _ in range(3_000)]
    pretokens = {p for w in words for p in v.pretokens.findall(w)} | {"x" * 64, "é" * 32, "é" * 33, "x" * 65, "中" * 21}
    one_by_one = {p: np.array(v.encode_pretoken(p), np.uint32).tobytes() for p in pretokens}
    asked = []
    v.encode_pretoken = lambda p: asked.append(p) or np.frombuffer(one_by_one[p], np.uint32).tolist()
    monkeypatch.setattr(bpe, "MERGED_CELLS", 1 << 10)
    assert v.ids_of(pretokens) == one_by_one
    assert {"é" * 33, "x" * 65} <= set(asked) and all(len(p.encode()) > bpe.MERGED_BYTES for p in asked)


def test_groups_of_pretokens(monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 5)
    monkeypatch.setattr(bpe, "CHUNK", 16)
    monkeypatch.setattr(bpe, "CACHED", 4)
    v = bpe.Vocabulary(open(PATH, "rb").read())
    texts = ["some words and some more words of a longer text", "", "été\x1c\x85\xa0 x\x1f 12½ ª", "中文 <|endoftext|> it's", "a"] * 3
    assert [np.frombuffer(i, np.uint32).tolist() for i in v.encode_all(texts)] == [ids_of(t) for t in texts]
    assert v.encode_all([]) == []


def test_latin_texts_are_cut_alike():
    v = own()
    for c in map(chr, range(256)):
        for s in (f"a{c}b {c}{c} 1{c} {c} \n{c} x", f"{c} {c}", f" {c}", f"{c}'s", f"'{c}ll {c}{c}{c} "):
            assert v.latin_pretokens.findall(s) == v.pretokens.findall(s), hex(ord(c))


def test_short_pretokens_are_encoded_by_backtracking():
    """As the long ones: tokens follow each other only where they are compatible, whatever has to be taken back."""
    v, draw = bpe.Vocabulary(open(PATH, "rb").read()), random.Random(11)
    words = {"".join(draw.choice("abcdeghinorst") for _ in range(draw.randint(1, 40))) for _ in range(2_000)} | {"a" * n for n in range(1, 65)}
    asked, tells = set(), v.compatible.make
    v.compatible.make = lambda pair: asked.add(pair) or tells(pair)
    got = {w: np.frombuffer(i, np.uint32).tolist() for w, i in v.ids_of(words).items()}
    assert got == {w: ids_of(w) for w in words}
    assert {a << 32 | b for ids in got.values() for a, b in zip(ids, ids[1:])} <= asked


def test_a_task_encodes_all_it_is_given():
    with open(PATH, "rb") as file:
        content = file.read()
    texts = ["some unremembered words", "and " + "x" * 70]
    for _ in range(2):
        v, encoded = bpe.for_task(content), []
        together, alone = type(v)._together, type(v).encode_pretoken
        v._together = lambda t: encoded.extend(t) or together(v, t)
        v.encode_pretoken = lambda p: encoded.append(p.encode()) or alone(v, p)
        v.encode_all(texts)
        del v._together, v.encode_pretoken
        assert set(encoded) >= {b"some", b" unremembered", b" words", b"and", b" " + b"x" * 70}
