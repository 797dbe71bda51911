"""Cutting long texts into overlapping chunks."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.functions.text import quoted

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

# Where a text may be cut, best place first.
SEPARATORS = ["\n\n", "\n", " ", ""]


def split_fixed(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` characters.

    Adds ``chunk_id``, ``start_index`` and ``chunk``, and drops the text column. Each
    text is cut once into steps; a chunk is a step plus the head of the next ones, so
    the work is linear in the text however long it is.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk size")
    kept = [quoted(c) for c in df.columns if c != text]
    # A projection of its own: the exploded rows then carry neither the text nor all pieces.
    cut = df.select(
        *kept, F.length(quoted(text)).alias("_length"),
        F.regexp_extract_all(quoted(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_p0"),
    )
    pieces = F.col("_p0")
    names = [f"_p{i}" for i in range(-(-size // step))]
    following = [F.slice(pieces, i + 1, F.greatest(F.size(pieces), F.lit(1))).alias(n)
                 for i, n in enumerate(names) if i]
    rows = cut.select(*kept, "_length", F.posexplode(F.arrays_zip(pieces, *following)).alias("chunk_id", "_parts"))
    start = F.col("chunk_id") * step
    # The last step starts no chunk if the chunk before it already reaches the end.
    return rows.where((F.col("chunk_id") == 0) | (start < F.col("_length") - overlap)).select(
        *kept, "chunk_id", start.alias("start_index"),
        F.substring(F.concat_ws("", *[F.col("_parts")[n] for n in names]), 1, size).alias("chunk"),
    )


def split_recursive(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that end at paragraph, line or word breaks where they can.

    Adds ``chunk_id``, ``start_index`` and ``chunk``, and drops the text column.
    """

    @F.pandas_udf("array<struct<start_index:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap) if t else [])

    kept = [quoted(c) for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(cut(quoted(text))).alias("chunk_id", "_chunk")).select(
        *kept, "chunk_id", F.col("_chunk.start_index"), F.col("_chunk.chunk")
    )


def chunk_text(text: str, size: int, overlap: int) -> list[dict]:
    """Chunks of one text with the place where each starts."""
    out, start, previous = [], 0, 0
    for chunk in _cut(text, size, overlap, SEPARATORS):
        start = text.find(chunk, max(0, start + previous - overlap))
        previous = len(chunk)
        out.append({"start_index": start, "chunk": chunk})
    return out


def _cut(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[level], separators[level + 1:]
    if separator:
        marks = [m.start() for m in re.finditer(re.escape(separator), text)]
        bounds = [0, *marks, len(text)]
        pieces = [text[a:b] for a, b in zip(bounds, bounds[1:]) if a < b]
    else:
        finer, pieces = [], list(text)

    chunks: list[str] = []
    short: list[str] = []
    for piece in [*pieces, None]:
        if piece is not None and len(piece) < size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap)
        short = []
        if piece is not None:
            chunks += _cut(piece, size, overlap, finer) if finer else [piece]
    return chunks


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Fill chunks with whole pieces; each new chunk opens with the tail of the last one."""
    packed: list[str] = []
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if held + len(piece) > size and window:
            packed.append("".join(window))
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    packed.append("".join(window))
    return [p.strip() for p in packed if p.strip()]
