"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

The vocabulary is a file of the ``tokenizers`` library. A text is cut into pretokens, and
each pretoken is encoded from left to right: an Aho-Corasick pass gives the longest token
from each place, and a token may follow another only if the two are compatible, which is to
say that merging their joined bytes gives these two tokens again. Where no token may follow,
the last one is taken back and shortened, and the place it reached is never tried again, so
the work is linear in the length. A sequence whose neighbours are all compatible is the one
that the merges give.

Most pretokens are short. Those of up to ``MERGED_BYTES`` bytes that a task does not remember
are encoded many at once, in the same way: in each step every one of them takes, shortens or
takes back one token.

Two tokens are compatible if no merge reaches across their border. Only the right edge of
the first (itself, its right part, the right part of that, ...) and the left edge of the
second can take part, each until the merge that uses it up.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from sys import byteorder

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.expressions import pick

# Fixed value: how byte-level vocabularies cut a text into pretokens.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of Latin-1 characters only, as plain sets, which cut faster.
_L, _N, _S = ("".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
LATIN_PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
# Fixed value: the bytes that such a vocabulary writes as the character of the same number;
# the others follow from U+0100 on.
PLAIN_BYTES = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))

# Pretokens and pairs a task remembers (and once more as many older ones), and the longest pretoken that it does.
CACHED, CACHED_PAIRS, CACHED_CHARS = 120_000, 200_000, 64
# Tokens that are decoded at once, and the longest text whose pretokens are listed at once.
CHUNK = 1 << 16
# Pretokens that are looked up together, the longest that are encoded together, and the cells of their tables.
GROUP, MERGED_BYTES, MERGED_CELLS = 1 << 17, 64, 1 << 20
# Stands between texts that are searched for tokens together; no byte is written as this character.
BETWEEN = "\uffff"


def byte_characters() -> list[str]:
    others = iter(range(0x100, 0x200))
    plain = set(PLAIN_BYTES)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Remembered(dict):
    """A dictionary that fills itself by ``make``. When it is full, only what is asked for again stays."""

    def __init__(self, make, most: int, longest: int | None = None):
        self.make, self.most, self.longest, self.before = make, most, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value


class Vocabulary:
    """The tables of one vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        whole = (model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        if not (whole and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                and not before.get("add_prefix_space") and spec.get("normalizer") is None):
            raise ValueError("the vocabulary is not a plain byte-level BPE")
        ids: dict[str, int] = model["vocab"]
        self.characters = byte_characters()
        of_character = {c: b for b, c in enumerate(self.characters)}
        if not all(c in ids for c in self.characters):
            raise ValueError("the vocabulary lacks single bytes")

        added = spec.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens that strip, need whole words or a normalizer are not supported")
        self.added = {a["content"]: a["id"] for a in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pretokens, self.latin_pretokens = regex.compile(PRETOKENS), re.compile(LATIN_PRETOKENS)

        content_of = {i: bytes(of_character[c] for c in t) for t, i in ids.items() if all(c in of_character for c in t)}
        content_of |= {i: t.encode() for t, i in self.added.items()}
        size = max(content_of) + 1
        pieces = [content_of.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))

        self.merges: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = ids[left + right]
            if token in made:
                raise ValueError(f"two merges make the token {left + right!r}")
            parts = (ids[left], ids[right])
            if any(p in made and made[p][0] >= rank for p in parts):
                raise ValueError(f"the token {left + right!r} is made before its parts")
            self.merges[parts] = rank
            made[token] = (rank, *parts)
        self.made = made

        def own(token: int) -> bool:
            """Whether the bytes of a token give the token itself."""
            return token not in made or not self._crossed(*made[token][1:], made[token][0])

        singles = {ids[c] for c in self.characters}
        self.tokens = {t: i for t, i in ids.items() if i in singles or i in made and own(i)}
        self.lengths = [0] * size
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for text, token in self.tokens.items():
            self.lengths[token] = len(text)
            self.shorter[token] = next((self.tokens[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.tokens), -1)
            self.automaton.add_word(text, token)
        self.automaton.make_automaton()
        self.characters_of = dict(enumerate(self.characters))
        # The same by token for the pretokens that are encoded together; their last entry stands for no token.
        self.length_of, self.shorter_of = np.array([*self.lengths, 0], np.int32), np.array([*self.shorter, -1], np.int32)
        self.forget()

    def forget(self) -> None:
        """Starts with nothing remembered, so that a task encodes all it is given, whatever a worker did before."""
        self.compatible = Remembered(lambda pair: not self._crossed(pair >> 32, pair & 0xFFFFFFFF), CACHED_PAIRS)
        self.encoded = Remembered(lambda pretoken: array("I", self.encode_pretoken(pretoken)).tobytes(), CACHED, CACHED_CHARS)

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, float]]:
        """The parts at one end of a token, each with the rank of the merge that uses it up."""
        until = float("inf")
        yield token, until
        while token in self.made:
            until, token = self.made[token][0], self.made[token][side]
            yield token, until

    def _crossed(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether some merge before ``limit`` joins a part of ``left`` with one of ``right``."""
        ends = list(self._edge(right, 1))
        for x, x_until in self._edge(left, 2):
            for y, y_until in ends:
                rank = self.merges.get((x, y))
                # Merges of one rank go from left to right: one within ``left`` comes first, one within ``right`` later.
                if rank is not None and rank < min(x_until, limit) and rank <= y_until:
                    return True
        return False

    def encode_pretoken(self, pretoken: str) -> tuple[int, ...]:
        """The ids of a pretoken, in time linear in its length, or of an added token."""
        if pretoken in self.added:
            return (self.added[pretoken],)
        text = "".join(map(self.characters.__getitem__, pretoken.encode("utf-8", "surrogatepass")))
        if text in self.tokens:
            return (self.tokens[text],)
        lengths, shorter, compatible, size = self.lengths, self.shorter, self.compatible, len(text)
        longest = [-1] * (size + 1)
        for last, token in self.automaton.iter(text):
            longest[last + 1 - lengths[token]] = token
        closed = [False] * (size + 1)
        found: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if not closed[end] and (last < 0 or compatible[last << 32 | token]):
                    found.append(token)
                    at, last, token = end, token, longest[end]
                    break
                token = shorter[token]
            else:
                closed[at] = True
                last = found.pop()
                at -= lengths[last]
                token, last = shorter[last], found[-1] if found else -1
        return tuple(found)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts, all by ``encode_pretoken`` in one table: a step takes, shortens or takes back a token of each."""
        sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        width = int(sizes.max()) + 1
        joined = BETWEEN.join([t.decode("latin-1") for t in texts]).translate(self.characters_of)
        starts = np.cumsum(sizes + 1, dtype=np.int64) - sizes - 1
        matches = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        first = np.full(len(joined) + 1, -1, np.int32)
        # Of the tokens from one place the longest ends, and is found, last.
        first[matches[:, 0] + 1 - self.length_of[matches[:, 1]]] = matches[:, 1]
        closed = np.zeros((len(texts), width), bool)
        # A text's tokens so far from column 1 on; column 0 stands before its first one.
        found = np.full((len(texts), width), -1, np.int32)
        depth, at, token = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), first[starts]
        rows = np.flatnonzero(sizes)
        while len(rows):
            tried, last, here = token[rows], found[rows, depth[rows]], at[rows]
            end = here + self.length_of[tried]
            fits = (tried >= 0) & ~closed[rows, end]
            asked = np.flatnonzero(fits & (last >= 0))
            pairs = (last[asked].astype(np.int64) << 32 | tried[asked]).tolist()
            fits[asked] = np.fromiter(map(self.compatible.__getitem__, pairs), bool, len(pairs))
            token[rows] = self.shorter_of[tried]

            taken = rows[fits]
            depth[taken] += 1
            found[taken, depth[taken]], at[taken] = tried[fits], end[fits]
            token[taken] = first[starts[taken] + end[fits]]

            back = tried < 0
            if back.any():
                back, place, gone = rows[back], here[back], last[back]
                closed[back, place] = True
                depth[back] -= 1
                at[back], token[back] = place - self.length_of[gone], self.shorter_of[gone]
            rows = rows[at[rows] < sizes[rows]]
        ids = found[:, 1:][np.arange(width - 1) < depth[:, None]].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(depth, dtype=np.int64)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def ids_of(self, pretokens: set[str]) -> dict[str, bytes]:
        """The ids of each of the pretokens; the short ones that are not remembered are encoded together."""
        known, before = self.encoded, self.encoded.before
        found = {pretoken: ids for pretoken in pretokens if (ids := known.get(pretoken)) is not None}
        new: dict[int, list[tuple[str, bytes]]] = {}
        for pretoken in pretokens.difference(found):
            if pretoken not in before and pretoken not in self.added:
                text = pretoken.encode("utf-8", "surrogatepass")
                if len(text) <= MERGED_BYTES:
                    new.setdefault((len(text) + 3) // 4, []).append((pretoken, text))
                    continue
            found[pretoken] = known[pretoken]
        # Texts of one table differ in length by three bytes at most.
        for fours, alike in new.items():
            most = MERGED_CELLS // (4 * fours + 1)
            for start in range(0, len(alike), most):
                part = alike[start : start + most]
                for (pretoken, _), ids in zip(part, self._together([text for _, text in part])):
                    found[pretoken] = ids
                    known.keep(pretoken, ids)
        return found

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pretokens and added tokens of a text in lists of a bounded length."""
        for part in self.split.split(text) if self.split else (text,):
            pattern = self.latin_pretokens if is_latin(part) else self.pretokens
            if part in self.added:
                yield [part]
            elif len(part) <= CHUNK:
                yield pattern.findall(part)
            else:
                matches = pattern.finditer(part)
                while piece := [m[0] for m in islice(matches, CHUNK)]:
                    yield piece

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit numbers in one binary."""
        out, held, size = [], [], 0
        for text in texts:
            out.append([])
            for piece in self._pieces(text):
                held.append((out[-1], piece))
                size += len(piece)
                if size >= GROUP:
                    self._settle(held)
                    held, size = [], 0
        self._settle(held)
        return [b"".join(found) for found in out]

    def _settle(self, held: list[tuple[list[bytes], list[str]]]) -> None:
        ids = self.ids_of(set().union(*(piece for _, piece in held)))
        for found, piece in held:
            found.append(b"".join(map(ids.__getitem__, piece)))

    def encode(self, text: str) -> array:
        """The ids of a text, as unsigned 32-bit numbers."""
        return array("I", self.encode_all([text])[0])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD; unknown ids stand for nothing."""
        out = []
        for i in range(0, len(ids), CHUNK):
            part = ids[i : i + CHUNK]
            part = part[part < len(self.offsets) - 1].astype(np.int64)
            starts, sizes = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            before = np.cumsum(sizes) - sizes
            out.append(self.blob[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def for_task(content: bytes) -> Vocabulary:
    """The tables of a vocabulary, which a worker builds once, without what tasks before have encoded."""
    known = vocabulary(content)
    known.forget()
    return known


def packed(ids: list[bytes]) -> list[bytes]:
    """Ids in the machine's byte order as little-endian numbers."""
    return ids if byteorder == "little" else [np.frombuffer(i, np.uint32).astype("<u4").tobytes() for i in ids]


def _n_tokens(ids: str) -> Column:
    return (F.octet_length(ids) / 4).cast("long").alias("n_tokens")


def _broadcast(df: DataFrame, path: str):
    """The vocabulary file, a few megabytes whatever the input, for all workers; only the driver opens the path."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and ``ids``, the token ids as little-endian unsigned 32-bit integers in one binary.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library; the ids are those of its
    ``encode`` without added special tokens, truncation or padding. As there, the text of an
    added token within a document stands for that token.

    A null or empty text has no tokens. Rows that repeat id or text stay rows of their own.
    Texts of any length are encoded whole, in time linear in the length.
    """
    content = _broadcast(documents, path)

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = for_task(content.value)
        for batch in texts:
            yield pd.Series(packed(known.encode_all(t or "" for t in batch)), dtype=object)

    rows = pick(documents, doc_id=doc_id, text=text).select("doc_id", ids("text").alias("ids"))
    return rows.select("doc_id", _n_tokens("ids"), "ids")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and ``text``, the text that the ids (as ``encode`` returns them) stand for.

    As the library's ``decode`` with special tokens kept: ids that the vocabulary doesn't
    have stand for nothing, and bytes that are no UTF-8 become U+FFFD. Null ids are an empty text.
    """
    content = _broadcast(encoded, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(content.value)
        for batch in batches:
            yield pd.Series([known.decode(np.frombuffer(i or b"", "<u4")) for i in batch], dtype=object)

    return pick(encoded, doc_id=doc_id, ids=ids).select("doc_id", text("ids").alias("text"))


def round_trip(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with a further column ``decoded``, the text that ``decode`` makes of the ids of the row.

    One worker does both, so that a vocabulary is held once and no row is matched with another.
    """
    content = _broadcast(documents, path)

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = for_task(content.value)
        for batch in texts:
            encoded = packed(known.encode_all(t or "" for t in batch))
            yield pd.DataFrame({"ids": encoded, "decoded": [known.decode(np.frombuffer(i, "<u4")) for i in encoded]}, dtype=object)

    rows = pick(documents, doc_id=doc_id, text=text).select("doc_id", both("text").alias("row"))
    return rows.select("doc_id", _n_tokens("row.ids"), "row.ids", "row.decoded")
