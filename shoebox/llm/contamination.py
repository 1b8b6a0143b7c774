"""Evaluation texts leaking into training text, by a distributed positional inverted index.

The index is kept by blocks of documents, as a table: of every word of a block's stream the sorted positions at which it
stands. It knows nothing of the items that are looked for, so that later ones search the same table. Of each item the
rarest terms of every stretch are anchors; the posting lists of all anchors that a block has are moved back by the
anchors' places in their items, and where at least two of an item agree on a start within one document, the item's words
are compared in place: runs of words that match exactly or with few replacements come out. An item that a block holds
too few anchors of costs nothing there. Nothing is shuffled but counts of the items' terms.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

WORD = r"[^\W_]+"
_WORDS = re.compile(WORD)
_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_INVISIBLE = re.compile("[­​‌‍⁠﻿*_`~]")
#: A word at the end of a line or before a hyphen and blanks; the word after it isn't used up.
_BREAK = re.compile(rf"({WORD})(?:([-‐‑¬=–—]?)[ \t\r]*\n[\s>*•#|+-]*|([-‐‑¬=])[ \t]+)(?=({WORD}))")


def _plain_text(text: str) -> str:
    """A text without inline markup, marks and letter forms that don't count; its line ends still stand."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub("", text)
    soft = text.replace("\xad\n", "-\n") if "\xad" in text else text
    plain = soft if soft.isascii() else unicodedata.normalize("NFKC", soft)
    plain = _INVISIBLE.sub("", plain).casefold()
    return plain if plain.isascii() else unicodedata.normalize("NFKC", plain)


def _may_break(plain: str) -> bool:
    return "\n" in plain or "- " in plain or "‐ " in plain or "¬ " in plain


def words_of(text: str, known: dict[str, int] | set[str] | None = None) -> list[str]:
    """The words of a text: case, punctuation, marks, inline markup and Unicode forms don't show in them.

    With ``known``, a word broken at a line end is put together where that gives a known word: always if a hyphen marks
    the break, else only if its parts aren't both words themselves.
    """
    plain = _plain_text(text)
    if known is not None and _may_break(plain):

        def join(m: re.Match) -> str:
            a, line, blank, b = m.groups()
            whole = a + b in known and (line or blank or not (a in known and b in known))
            return a if whole else a + " "

        plain = _BREAK.sub(join, plain)
    return _WORDS.findall(plain)


#: Stand behind the first part of what may be a broken word: without and with a hyphen.
_OPEN, _MARKED = "\x01", "\x02"
_PARTS = re.compile(rf"{WORD}|[{_OPEN}{_MARKED}]")
#: The places of ``_BREAK``, each found by its first sign: what is no line end, hyphen or blank is passed over at once.
_BLANKS_AT_END = re.compile(r"[ \t\r]+\n")
_HYPHENS = re.compile(r"[-‐‑¬=–—](?<=[^\W_].)(?:\n[\s>*•#|+-]*|(?<![–—])[ \t]+)(?=[^\W_])")
_LINES = re.compile(r"\n(?<=[^\W_].)[\s>*•#|+-]*(?=[^\W_])", re.S)


def parts_of(text: str) -> list[str]:
    """The words of a text as they stand, with a sign behind each that may go on in the next one."""
    plain = _plain_text(text)
    if not _may_break(plain):
        return _WORDS.findall(plain)
    plain = _BLANKS_AT_END.sub("\n", plain.replace(_OPEN, " ").replace(_MARKED, " "))
    return _PARTS.findall(_LINES.sub(f" {_OPEN} ", _HYPHENS.sub(f" {_MARKED} ", plain)))


def _hash(word: str) -> int:
    """64 bits of a word, signed."""
    return xxhash.xxh3_64_intdigest(word.encode()) - 2**63


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


INDEX = "block bigint, n_words int, doc_ids binary, starts binary, terms binary, offsets binary, positions binary, breaks binary, wholes binary"


def build_index(documents: DataFrame, words_per_block: int = 4_000_000) -> DataFrame:
    """One row per block of documents (doc_id, text): the positions of each term, as sorted lists of differences.

    All words of all texts are in it, terms as 64-bit hashes. Documents follow each other in a block's stream. Where a
    word may go on behind a line end or a hyphen, its parts are two words of the stream; ``breaks`` has the place of the
    first part (times two, plus one if a hyphen marks it) and ``wholes`` a hash of both together, so that a search
    can put together what its items hold as one word.
    """

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = 0

        def fresh() -> tuple:
            vocabulary: defaultdict[str, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary[_OPEN], vocabulary[_MARKED]  # noqa: B018
            return vocabulary, [], [], [], [], [], 0

        vocabulary, ids, starts, parts, breaks, wholes, at = fresh()

        def flush() -> pd.DataFrame:
            stream = np.concatenate(parts) if parts else np.zeros(0, "int32")
            order = np.argsort(stream, kind="stable").astype("int32")
            sizes = np.bincount(stream, minlength=len(vocabulary))
            hashes = np.fromiter(map(_hash, vocabulary), "int64", len(vocabulary))
            first = np.append(0, np.cumsum(sizes))
            by_hash = np.argsort(hashes)[sizes[np.argsort(hashes)] > 0]
            lists = _ranges(first[by_hash], sizes[by_hash])
            where = order[lists]
            offsets = np.append(0, np.cumsum(sizes[by_hash]))
            steps = np.diff(where, prepend=0)
            steps[offsets[:-1]] = where[offsets[:-1]]
            row = [block, len(stream), _packed(np.array(ids, "int64")), _packed(np.array(starts, "int32")), _packed(hashes[by_hash]), _packed(offsets.astype("int32"))]
            row += [_packed(steps.astype("int32")), _packed(np.array(breaks, "int64")), _packed(np.array(wholes, "uint32"))]
            return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                found = parts_of(text)
                if not found:
                    continue
                codes = np.fromiter(map(vocabulary.__getitem__, found), "int32", len(found))
                real = codes > 1
                ids.append(doc)
                starts.append(at)
                if not real.all():
                    signs = np.flatnonzero(~real)
                    place = at + signs - np.arange(len(signs)) - 1
                    breaks.extend((place * 2 + codes[signs]).tolist())
                    wholes.extend(_hash(found[i - 1] + found[i + 1]) & 0xFFFFFFFF for i in signs.tolist())
                    codes = codes[real]
                parts.append(codes)
                at += len(codes)
                if at >= words_per_block:
                    yield flush()
                    block += 1
                    vocabulary, ids, starts, parts, breaks, wholes, at = fresh()
        if ids:
            yield flush()

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInPandas(index, INDEX)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges that start at ``first``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def _lists(block, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the ``wanted`` hashes, position) of all postings a block has of them, in their order."""
    terms, offsets = _unpacked(block.terms, "int64"), _unpacked(block.offsets, "int32").astype("int64")
    at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
    has = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, "int64")
    first, sizes = offsets[at[has]], offsets[at[has] + 1] - offsets[at[has]]
    steps = _unpacked(block.positions, "int32")[_ranges(first, sizes)].astype("int64")
    sums, ends = np.cumsum(steps), np.cumsum(sizes)
    before = sums[ends - sizes] - steps[ends - sizes] if len(ends) else sums
    return np.repeat(has, sizes), sums - np.repeat(before, sizes)


def _anchors(items: dict[int, np.ndarray], counts: dict[int, int], run: int, per_run: int) -> dict[int, np.ndarray]:
    """Of each item the places of its rarest terms, at least ``per_run`` in each stretch of ``run`` words."""
    chosen = {}
    for item, terms in items.items():
        picked = np.zeros(len(terms), dtype=bool)
        rare = sorted(range(len(terms)), key=lambda p: (counts.get(int(terms[p]), 0), p))
        for start in range(max(0, len(terms) - run + 1)):
            need = per_run - int(picked[start : start + run].sum())
            for p in rare:
                if need <= 0:
                    break
                if start <= p < start + run and not picked[p]:
                    picked[p] = True
                    need -= 1
        chosen[item] = np.flatnonzero(picked)
    return chosen


def longest_run(same: np.ndarray, run: int, one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``same`` (words that match): the length, first word and replaced words of the longest run.

    A run starts and ends with matches, has at least ``run`` words and at most one in ``one_in`` replaced; 0 if none.
    """
    rows, n = same.shape
    length, first, wrong = np.zeros(rows, int), np.zeros(rows, int), np.zeros(rows, int)
    misses = np.concatenate([np.zeros((rows, 1), int), np.cumsum(~same, axis=1)], axis=1)
    for size in range(n, run - 1, -1):  # items are short; a row is done at its longest run
        open_ = np.flatnonzero(length == 0)
        if not len(open_):
            break
        bad = misses[open_, size:] - misses[open_, : n + 1 - size]
        fine = (bad * one_in <= size) & same[open_, : n + 1 - size] & same[open_, size - 1 :]
        hit = fine.any(axis=1)
        at = fine.argmax(axis=1)
        rows_hit = open_[hit]
        length[rows_hit], first[rows_hit] = size, at[hit]
        wrong[rows_hit] = bad[hit, at[hit]]
    return length, first, wrong


FOUND = "doc_id bigint, item_id bigint, words int, replaced int, item_word int"


class _Items:
    """Items to be looked for, as codes of their terms; ``anchors`` by term: (item, place)."""

    def __init__(self, split: list[tuple[int, list[str]]], run: int):
        split = [(item, words) for item, words in split if len(words) >= run]
        self.names = [item for item, _ in split]
        vocabulary = {w: _hash(w) for _, words in split for w in words}
        self.hashes = np.unique(np.fromiter(vocabulary.values(), "int64", len(vocabulary)))
        code = {h: i for i, h in enumerate(self.hashes.tolist())}
        self.coded = [np.array([code[vocabulary[w]] for w in words], "int32") for _, words in split]
        low = (self.hashes & 0xFFFFFFFF).astype("uint32")
        self.by_low = np.argsort(low, kind="stable")
        self.low = low[self.by_low]

    def anchor(self, counts: dict[int, int], run: int, per_run: int) -> None:
        chosen = _anchors(dict(enumerate(self.coded)), counts, run, per_run)
        item = np.concatenate([np.full(len(p), k) for k, p in chosen.items()] or [np.zeros(0, "int64")])
        place = np.concatenate([*chosen.values()] or [np.zeros(0, "int64")])
        term = np.array([self.coded[k][p] for k, p in zip(item, place)], "int64")
        order = np.argsort(term, kind="stable")
        self.item, self.place = item[order], place[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.hashes) + 1))


def _stream(block, items: _Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, starts, codes, positions) of a block: its words as the items' codes, -1 for others, and the posting lists.

    Broken words that are whole in the items are one word here.
    """
    codes, at = _lists(block, items.hashes)
    stream, starts = np.full(block.n_words, -1, "int32"), _unpacked(block.starts, "int32").astype("int64")
    stream[at] = codes
    breaks, wholes = _unpacked(block.breaks, "int64"), _unpacked(block.wholes, "uint32")
    found = np.searchsorted(items.low, wholes)
    some = np.flatnonzero(items.low[np.minimum(found, len(items.low) - 1)] == wholes) if len(items.low) else np.zeros(0, "int64")
    gone, last, joined = [], -1, []
    for k in some.tolist():
        p, marked = int(breaks[k]) >> 1, int(breaks[k]) & 1
        if p != last and (marked or stream[p] < 0 or stream[p + 1] < 0):
            joined.append((p, items.by_low[found[k]]))
            last = p + 1
            gone.append(last)
    if gone:
        kept = np.ones(len(stream), bool)
        for p, code in joined:
            stream[p] = code
        kept[gone] = False
        before = np.cumsum(~kept)
        same = kept[at] & (stream[at] == codes)
        codes, at = codes[same], at[same] - before[at[same]]
        more = np.array(joined, "int64")
        codes, at = np.append(codes, more[:, 1]), np.append(at, more[:, 0] - before[more[:, 0]])
        starts = starts - before[starts]
        stream = stream[kept]
    return stream, starts, codes, at


def search_index(index: DataFrame, items: DataFrame, run: int = 16, one_in: int = 8, most_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id, words, replaced, item_word): as ``find_leaks``, in an index that was built before."""
    spark = index.sparkSession
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items; call with parts of them")
    wanted = _Items([(int(r["item_id"]), words_of(r["text"])) for r in rows], run)
    hashes = spark.sparkContext.broadcast(wanted.hashes)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for terms, offsets in zip(frame["terms"], frame["offsets"]):
                terms, sizes = _unpacked(terms, "int64"), np.diff(_unpacked(offsets, "int32"))
                own = np.flatnonzero(np.isin(terms, hashes.value))
                yield pd.DataFrame({"term": np.searchsorted(hashes.value, terms[own]), "n": sizes[own]})

    totals = index.select("terms", "offsets").mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in totals.collect()}  # at most as many rows as the items have words
    # among the anchors of a run, at least two survive any replacements that are allowed
    wanted.anchor(counts, run, 2 + max(run // one_in, (3 * run // 2) // one_in))
    shared = spark.sparkContext.broadcast(wanted)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        for frame in frames:
            for block in frame.itertuples():
                docs, out = _unpacked(block.doc_ids, "int64"), []
                stream, starts, codes, at = _stream(block, items)
                ends = np.append(starts[1:], len(stream))
                # each posting of an anchor, moved back by the anchor's place in each item that has it
                times = items.first[codes + 1] - items.first[codes]
                anchor = _ranges(items.first[codes], times)
                hit = np.repeat(at, times)
                doc, begin, item = np.searchsorted(starts, hit, side="right") - 1, hit - items.place[anchor], items.item[anchor]
                order = np.lexsort((begin, doc, item))
                doc, begin, item = doc[order], begin[order], item[order]
                again = np.flatnonzero((item[1:] == item[:-1]) & (doc[1:] == doc[:-1]) & (begin[1:] == begin[:-1]))
                again = again[np.diff(again, prepend=-2) > 1]  # each start once
                doc, begin, item = doc[again], begin[again], item[again]
                cuts = np.flatnonzero(np.diff(item, prepend=-1, append=-1)) if len(item) else []
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    words = items.coded[item[lo]]
                    for part in range(lo, hi, 20_000):
                        some = slice(part, min(part + 20_000, hi))
                        place = begin[some, None] + np.arange(len(words))
                        inside = (place >= starts[doc[some], None]) & (place < ends[doc[some], None])
                        same = (stream[np.clip(place, 0, len(stream) - 1)] == words) & inside
                        length, first, wrong = longest_run(same, run, one_in)
                        for i in np.flatnonzero(length):
                            out.append((docs[doc[part + i]], items.names[item[lo]], length[i], wrong[i], first[i]))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "replaced", "item_word"])

    longest = F.max(F.struct("words", (-F.col("replaced")).alias("fewer"), (-F.col("item_word")).alias("early"))).alias("x")
    return (
        index.mapInPandas(search, FOUND)
        .groupBy("doc_id", "item_id")
        .agg(longest)
        .select("doc_id", "item_id", "x.words", (-F.col("x.fewer")).alias("replaced"), (-F.col("x.early")).alias("item_word"))
    )


def find_leaks(documents: DataFrame, items: DataFrame, run: int = 16, one_in: int = 8, most_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id, words, replaced, item_word): the longest leaked run of each item in each document.

    documents: doc_id, text; items: item_id, text; other columns are ignored. A run has at least ``run`` consecutive
    words of the item, of which at most one in ``one_in`` is replaced by one other word; ``replaced`` = 0 is an exact
    phrase. NULL ids and texts, blank texts and items shorter than ``run`` words leak nothing; a repeated doc_id counts
    once, a repeated item_id by each of its texts. The items are held by the driver and the executors: more than
    ``most_items`` are refused, to be given in parts, each of which can search the same index (``search_index``).
    """
    return search_index(cut(build_index(documents)), items, run, one_in, most_items)
