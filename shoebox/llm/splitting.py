"""Splitting oversized texts at natural boundaries, with balanced targets.

The smallest number of pieces that can hold a text is taken, targets are set that make all pieces equally long, and each
target moves to the strongest boundary near it: a paragraph's end before a line's, a sentence's, a word's. Where any
piece then breaks the limit, one more piece is planned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.tokens import RANKS, encoder, ship, token_bytes

#: Boundaries by strength; a piece begins where a match ends.
BOUNDARIES = [
    (4, re.compile(r"\n[ \t\r]*\n\s*")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]")),
    (1, re.compile(r"\S(?=\s)")),
]


def boundary_strengths(text: str, at: np.ndarray) -> np.ndarray:
    """The strength of the boundary at each character offset of ``at`` (sorted); 0 is the middle of a word."""
    out = np.zeros(len(at), "int8")
    for strength, pattern in reversed(BOUNDARIES):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), "int64")
        if len(ends):
            place = np.searchsorted(at, ends)
            ok = place < len(at)
            place, ends = place[ok], ends[ok]
            out[place[at[place] == ends]] = strength
    return out


def plan(n: int, limit: int, overlap: int, strength: np.ndarray, pieces: int, reach: float = 0.25) -> list[int] | None:
    """Cuts, as token numbers, of ``n`` tokens into ``pieces``; None if a piece would break the limit.

    ``strength[i]`` is that of a cut before token i; -1 where no cut may be. A cut looks for boundaries within
    ``reach`` of a piece's length around its target.
    """
    size = (n + (pieces - 1) * overlap) / pieces
    if size - overlap < 1:
        return None
    near, cuts, last = max(1, int((size - overlap) * reach)), [], 0
    for i in range(1, pieces):
        target = round(size + (i - 1) * (size - overlap))
        most = last + limit - (overlap if cuts else 0)
        lo, hi = max(last + 1, target - near), min(n - 1, target + near, most)
        if lo > hi:
            return None
        window = strength[lo : hi + 1]
        best = window.max()
        if best < 0:
            return None
        options = np.flatnonzero(window == best) + lo
        last = int(options[np.abs(options - target).argmin()])
        cuts.append(last)
    return cuts if n - last + (overlap if cuts else 0) <= limit else None


def split_text(text: str, limit: int, overlap: int, path: str = RANKS) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, as character offsets; tokens are those of the text in the piece.

    Pieces cover the text; each after the first starts ``overlap`` tokens before the end of the one before it, or up to
    one character earlier where a token ends within a character. No piece has more than ``limit`` tokens, except that
    a piece of one character may, if the limit is smaller than what one character takes.
    """
    code = encoder(path)
    tokens = code.encode_ordinary(text)
    n = len(tokens)
    if n <= limit:
        return [(0, len(text), n)]
    byte = np.concatenate([[0], np.cumsum(token_bytes(path)[tokens])])
    if len(text) == byte[-1]:
        at, whole = byte, np.ones(n + 1, bool)
    else:
        raw = np.frombuffer(text.encode("utf-8", "replace"), "uint8")
        starts = np.concatenate([(raw & 0xC0) != 0x80, [True]])
        at, whole = np.concatenate([[0], np.cumsum(starts)])[byte], starts[byte]
    strength = boundary_strengths(text, at)
    strength = np.where(whole, strength, -1)
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    while pieces <= n:
        cuts = plan(n, limit, overlap, strength, pieces)
        if cuts is not None:
            out, fits = [], True
            for i, end in enumerate([*cuts, n]):
                first = max(0, cuts[i - 1] - overlap) if i else 0
                while not whole[first]:
                    first -= 1
                # a cut within a word, or a piece near the limit, may count other tokens on its own
                if strength[first] < 1 and first or end < n and strength[end] < 1 or end - first > limit - 8:
                    fits &= len(code.encode_ordinary(text[at[first] : at[end]])) <= limit
                out.append((int(at[first]), int(at[end]), end - first))
            if fits:
                return out
        pieces += 1
    return [(i, i + 1, 1) for i in range(len(text))]


def split_texts(texts: DataFrame, limit: int = 1000, overlap: int = 50, key: str = "doc_id", text: str = "text", keep_small: bool = True, with_text: bool = True, path: str = RANKS) -> DataFrame:
    """(key, piece, pieces, start, end, tokens[, text]): the pieces of each text, numbered from 0.

    Texts up to ``limit`` tokens come out as one piece, or not at all without ``keep_small``; where their bytes already
    prove that they fit (a token has at least one byte), they aren't tokenized and ``tokens`` is NULL. Empty and blank
    texts are texts like others; NULL texts have no pieces; NULL and repeated keys come out as they stand; other columns
    are dropped. Texts of any length are split whole.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    ship(texts.sparkSession, path)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("body")).where("body is not null")
    kind = texts.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, pieces int, start bigint, end bigint, tokens bigint" + ", text string" * with_text

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, body in zip(frame["key"], frame["body"]):
                parts = split_text(body, limit, overlap, path)
                if len(parts) > 1 or keep_small:
                    out += [(k, i, len(parts), a, b, n, *([body[a:b]] * with_text)) for i, (a, b, n) in enumerate(parts)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    large = F.octet_length("body") > limit
    done = rows.where(large).mapInPandas(cut, schema)
    if keep_small:
        one = [F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("end"), F.lit(None).cast("bigint").alias("tokens")]
        done = done.unionByName(rows.where(~large).select("key", *one, *[F.col("body").alias("text")] * with_text))
    return done.withColumnRenamed("key", key)
