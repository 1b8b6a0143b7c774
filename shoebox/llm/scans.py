"""Repair of text from scanned pages.

Furniture is peeled off the edges of a page: page numbers by their marks or by their agreement with the places of other
pages, running titles by their agreement with lines at the edges of other pages. What is left is a stream of characters
in which lines and blanks are no more than hints. The likeliest words are decoded over that stream by dynamic
programming over its positions: from each position lead edges for a word, a word with misread characters, a word that
ends amid a run of characters (what was run together is split), a word that goes on over one or several gaps, with or
without a mark of the break, and for a word not known, read as letters follow each other in the known ones. Paragraph
boundaries are chosen by a second dynamic programme over the sentences. The words' likelihood comes from the counts of
all words of all texts; misreadings are told from words by how often what they might stand for occurs.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

#: What is seen for what is meant. Symbols never stand in words; letter pairs may.
SYMBOLS = {"0": "o", "1": "li", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "$": "s", "†": "t", "|": "l", "ɑ": "a", "í": "i", "ﬁ": ["fi"], "ﬂ": ["fl"]}
LETTERS = [("c", "e"), ("cl", "d"), ("b", "h"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("li", "h"), ("q", "g")]
#: Marks of a broken word.
MARKS = "-‐‑¬=_~—–\xad"
_ANY_MARK = re.escape(MARKS)

WORD = r"[^\W\d_]+"
_WORD = re.compile(WORD)
_CORE = re.compile(r"^[^\w$†|]*(.*?)[^\w$†|]*$", re.S)
_BROKEN = re.compile(rf"({WORD})[{_ANY_MARK}]\s+(?!(?:and|or)\b)({WORD})|({WORD})[ ]?[{_ANY_MARK}]\s*$")
_SUSPENDED = re.compile(rf"({WORD})-\s+(?:and|or)\b")
_COMPOUND = re.compile(rf"({WORD})-({WORD})")
_STRONG = r"\[\s*(\d{1,5})\s*\]|\b[Pp]age\s+(\d{1,5})|\b[Pp]\.\s?(\d{1,5})|(?<!\w)[-–—]\s*(\d{1,5})\s*[-–—](?!\w)"
_STRONG_TOP, _STRONG_END = re.compile(rf"^\s*(?:{_STRONG})(?=\s|$|\|)"), re.compile(rf"(?:{_STRONG})\s*$")
_BARE_TOP, _BARE_END = re.compile(r"^\s*(\d{1,5}|[ivxlcdm]{1,12})(?=\s|$)"), re.compile(r"(?:^|(?<=\s))(\d{1,5}|[ivxlcdm]{1,12})\s*$")
_ROMAN = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")


def number_of(text: str) -> int | None:
    """The value of a page number in digits or small roman numerals."""
    if text.isdigit():
        return int(text)
    if not text or not _ROMAN.match(text):
        return None
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    digits = [values[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0]))


#: Small words that titles write in lower case.
SMALL = {"a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"}
#: Lines of more words aren't looked at as titles.
LONGEST_TITLE = 12


def _named(token: str) -> bool:
    """Whether a token starts like a name: a capital letter, or a symbol that may be one."""
    return len(token) > 1 and (token[0].isupper() or token[0] in SYMBOLS and any(c.isalpha() for c in token)) and not token.isdigit()


def _may_be_title(words: list[str]) -> bool:
    """Whether words may stand in a title at all: some letters, no mark of a sentence or of a broken word, no file names."""
    return 0 < len(words) <= LONGEST_TITLE and any(c.isalpha() for w in words for c in w) and all(
        w[-1] not in ".,;:?!" and "_" not in w and not re.search(r"\d\d", w) for w in words
    ) and words[-1][-1] not in MARKS


def _title_case(words: list[str]) -> bool:
    return len(words) > 1 and _may_be_title(words) and all(_named(w) or i and w in SMALL for i, w in enumerate(words)) and _named(words[-1])


def _first_words(text: str, n: int, edge: str) -> tuple[str, str]:
    """(the first or last ``n`` words, the rest) of a text."""
    if edge == "top":
        m = re.match(rf"\s*(?:\S+\s*){{{n}}}", text)
        return m.group(0), text[m.end() :].strip()
    m = re.search(rf"(?:\S+\s*){{{n}}}$", text)
    return m.group(0), text[: m.start()].strip()


def _number_taken(line: str) -> tuple[int | None, str]:
    """(number, rest) of a line with a marked page number at one of its ends; no number where it has none."""
    for pattern in (_STRONG_TOP, _STRONG_END):
        if m := pattern.search(line):
            return int(next(x for x in m.groups() if x)), (line[: m.start()] + " " + line[m.end() :]).strip(" |\t")
    return None, line


class Titles:
    """What is known of a scan's running titles.

    ``agreed``: keys of titles that stand at the edge of several of its pages, with the number of these; ``runs``: whether it has any; ``few``:
    whether it has too few pages to agree; ``lengths``: how many of all titles agreed on anywhere have how many words.
    """

    def __init__(self, lexicon: Lexicon, agreed: dict[str, int] | None = None, runs: bool = False, few: bool = False, lengths: dict[int, int] | None = None):
        self.lexicon, self.agreed, self.runs, self.few, self.lengths = lexicon, agreed or {}, runs, few, lengths or {}

    def key(self, words: list[str]) -> str:
        """A title as it is compared: its misread characters mended, in lower case, without marks around it."""
        return " ".join(re.sub(r"^\W+|\W+$", "", w.word).lower() for w in decode(words, self.lexicon)[0])

    def holds(self, words: list[str], numbered: bool, shared: bool = False) -> bool:
        """Whether a line at the edge of a page is a title.

        It is if it is agreed on or shares its line with a page number (``shared``). Where there are no others to agree
        with it or its scan is known to have titles, or a page number stands beside it (``numbered``), ordinary words
        written like names are one.
        """
        if not _may_be_title(words):
            return False
        if shared or self.agreed and self.key(words) in self.agreed:
            return True
        return (self.runs or self.few or numbered) and _title_case(words) and self.ordinary(words)

    def ordinary(self, words: list[str]) -> bool:
        """Whether words written like names are none: two in three elsewhere stand in lower case."""
        bare = [re.sub(r"^\W+|\W+$", "", w) for w in words]
        return 3 * sum(map(self.lexicon.ordinary, bare)) >= 2 * len(bare)

    def length(self, words: list[str], edge: str, numbered: bool) -> int:
        """How many words at the edge of a page without lines are a title; 0 for none."""
        sizes = range(1, min(LONGEST_TITLE, len(words) - 1) + 1) if self.agreed else ()
        agreed = {n: self.agreed.get(self.key(x), 0) for n in sizes if _may_be_title(x := words[:n] if edge == "top" else words[-n:])}
        # pages that agree on more than the title do so by chance: what most agree on is it
        if any(agreed.values()):
            return max(agreed, key=lambda n: (agreed[n], self.lengths.get(n, 0), n))
        if not (self.runs or self.few or numbered):
            return 0
        cases = [n for n in range(2, min(LONGEST_TITLE, len(words) - 1) + 1) if _title_case(x := words[:n] if edge == "top" else words[-n:]) and self.ordinary(x)]
        # where a title ends and a sentence starts doesn't show: titles have as many words as others have
        return max(cases, key=lambda n: (self.lengths.get(n, 0), n), default=0)


class Page:
    """A page taken apart: ``titles`` and ``number`` from its edges, and its ``body``."""

    def __init__(self, text: str, titles: Titles | None = None, expected: int | None = None, voted: str | None = None):
        self.titles: list[str] = []
        self.number: int | None = None
        #: Numbers without a mark at the edges, also behind what may be a title.
        self.weak: list[tuple[str, int]] = []
        #: Lines at the edges that may be titles, as words; of a page without lines what starts or ends it.
        self.candidates: list[list[str]] = []
        self._known = titles
        #: The edge at which a page number was taken off last.
        self._marked: str | None = None
        lines = [x.strip(" \t\r\f\v") for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        self.flat = len(lines) <= 1
        for edge in ("top", "end"):
            peel = True
            while peel and lines:
                at = 0 if edge == "top" else -1
                while len(lines) > 1 and not lines[at]:
                    lines.pop(at)
                rest = self._flat(lines[at], edge, expected, voted) if self.flat else self._line(lines, at, edge)
                peel = rest is not None and len(lines) > 0
                if peel:
                    lines[at] = rest
                    if not rest:
                        lines.pop(at)
        self.body = "\n".join(self._inner(lines)).strip("\n")

    def _inner(self, lines: list[str]) -> list[str]:
        """Lines without the furniture amid a text that goes over several pages: titles of its scan, and numbers that count on."""
        if self._known is None or self.flat:
            return lines
        known = set(self._known.agreed) | {self._known.key(t.split()) for t in self.titles}
        sizes = {len(k.split()) for k in known}
        out: list[str] = []
        last, dropped = self.number, False
        for line in lines:
            value, rest = _number_taken(line)
            if value is None and _BARE_TOP.fullmatch(line):
                value, rest = number_of(line), ""
            # a line that is nothing but a marked number is one wherever it stands
            number = value is not None and (last is not None and 0 < value - last <= 3 or not rest and not _BARE_TOP.fullmatch(line))
            words = (rest if number else line).strip(" |").split()
            title = len(words) in sizes and _may_be_title(words) and self._known.key(words) in known
            if number:
                last = value
                self.number = value if self.number is None else self.number
            if title:
                self.titles.append(" ".join(words))
            if title or number and not words:
                while out and not out[-1]:
                    out.pop()
                dropped = True
            elif line or not dropped:
                # a sentence that goes on behind the furniture isn't cut there
                if dropped and out and out[-1][-1] in ".!?":
                    out.append("")
                out.append(line)
                dropped = False
        return out

    def _line(self, lines: list[str], at: int, edge: str) -> str | None:
        """What is left of a line at the edge when furniture is taken off; None if it isn't furniture."""
        line = lines[at]
        number, rest = _number_taken(line)
        if number is None and _BARE_TOP.fullmatch(line.strip()) and (value := number_of(line.strip())) is not None and self.number is None:
            self.number, self._marked = value, edge
            self.weak.append((edge, value))
            return ""
        words = rest.strip(" |").split()
        if number is not None and not words:
            self.number, self._marked = number, edge
            return ""
        if _may_be_title(words):
            self.candidates.append(words)
            beside = next((x for x in (lines[1:] if at == 0 else lines[-2::-1]) if x), "") if len(lines) > 1 else ""
            numbered = number is not None or self._marked == edge or bool(_BARE_TOP.fullmatch(beside) or _STRONG_TOP.fullmatch(beside))
            if self._known is not None and self._known.holds(words, numbered, number is not None):
                self.titles.append(" ".join(words))
                self.number = number if number is not None else self.number
                return ""
        return None

    def _flat(self, text: str, edge: str, expected: int | None, voted: str | None) -> str | None:
        """As ``_line``, for a page without lines: furniture is what a page starts or ends with."""
        strong, bare = (_STRONG_TOP, _BARE_TOP) if edge == "top" else (_STRONG_END, _BARE_END)
        cut = lambda m: (text[m.end() :] if edge == "top" else text[: m.start()]).strip(" |")
        if m := strong.search(text):
            self.number = int(next(x for x in m.groups() if x))
            self._marked = edge
            return cut(m)
        if (m := bare.search(text)) and (value := number_of(m.group(1))) is not None and self.number is None:
            self.weak.append((edge, value))
            if expected is not None and voted == edge and (value == expected or _digits_apart(value, expected) <= 1):
                self.number = value
                self._marked = edge
                return cut(m)
        words = text.split()
        if len(words) <= 6:
            return None
        if edge == "top" and "|" in words[: LONGEST_TITLE + 1]:
            head = words[: words.index("|")]
            if _may_be_title(head):
                self.candidates.append(head)
                if self._known is not None and self._known.holds(head, True, True):
                    self.titles.append(" ".join(head))
                    return text.split("|", 1)[1].strip()
        some = words[:LONGEST_TITLE] if edge == "top" else words[-LONGEST_TITLE:]
        for n in range(2, len(some)):
            if _title_case(x := some[:n] if edge == "top" else some[-n:]):
                self.candidates.append(x)
                if (m := bare.search(_first_words(text, n, edge)[1])) and (value := number_of(m.group(1))) is not None:
                    self.weak.append((edge, value))
        n = self._known.length(words, edge, self._marked == edge) if self._known is not None and not self.titles else 0
        if not n:
            return None
        title, rest = _first_words(text, n, edge)
        self.titles.append(" ".join(title.split()))
        return rest


def _digits_apart(a: int, b: int) -> int:
    x, y = str(a), str(b)
    return sum(p != q for p, q in zip(x, y)) if len(x) == len(y) else 9


def _plain(word: str) -> str:
    """A word with its symbols read as letters."""
    return "".join(SYMBOLS.get(c, c)[0] for c in word).lower()


def _hard(token: str) -> list[int]:
    """Places of characters that never stand in words."""
    return [i for i, c in enumerate(token) if c in SYMBOLS or c == "I" and 0 < i and not token.isupper()]


def readings(token: str, near: Callable[[str], list[str]] | None = None) -> list[str]:
    """What a token may read when its symbols are letters, in lower case.

    Each ``1`` may be two letters; where that gives more than 64 readings, only those that ``near`` finds for the reading
    with all of them alike are given: words that differ from it in nothing but these letters.
    """
    hard = _hard(token)
    options = [SYMBOLS.get(token[i], "l") for i in hard]
    if near is not None and math.prod(map(len, options)) > 64:
        chars = list(token)
        for i, o in zip(hard, options):
            chars[i] = o[0]
        alike = "".join(chars).lower()
        free = {i for i, o in zip(hard, options) if len(o) > 1}
        return [w for w in near(alike) if all(a == b or i in free for i, (a, b) in enumerate(zip(w, alike)))] or [alike]
    out = []
    for choice in itertools.islice(itertools.product(*options), 64):
        chars = list(token)
        for i, c in zip(hard, choice):
            chars[i] = c
        out.append("".join(chars).lower())
    return out


def layers(token: str, near: Callable[[str], list[str]] | None = None) -> Iterator[dict[str, int]]:
    """What a token may stand for, with how many characters are misread: symbols only first, then a letter group more at a time."""
    n = len(_hard(token))
    layer = {b: n for b in readings(token, near)}
    seen = set(layer)
    yield dict(layer) if n else {}
    if token.isupper() and len(token) > 1:
        return
    while layer:
        grown: dict[str, int] = {}
        for word, k in layer.items():
            for shown, meant in LETTERS:
                at = word.find(shown)
                while at >= 0:
                    new = word[:at] + meant + word[at + len(shown) :]
                    if new not in seen:
                        grown.setdefault(new, k + 1)
                    at = word.find(shown, at + 1)
        seen |= grown.keys()
        yield grown
        layer = grown


def variants(token: str, most: int = 2) -> list[tuple[str, int]]:
    """(word, misread characters): what a token may stand for with up to ``most`` letter groups misread, itself left out."""
    out: dict[str, int] = {}
    for layer in itertools.islice(layers(token), most + 1):
        for word, n in layer.items():
            out.setdefault(word, n)
    out.pop(token.lower(), None)
    return list(out.items())


class Lexicon:
    """Counts of words, told from misreadings and parts of broken words.

    ``lower``: how often a word stands in lower case, where that isn't always.
    """

    def __init__(self, counts: dict[str, int], suspended: dict[str, int], lower: dict[str, int] | None = None, ratio: float = 6.0):
        self.counts, self.ratio, self.lower = counts, ratio, lower or {}
        self.total = max(1, sum(counts.values()))
        self.longest = max((len(w) for w in counts), default=0)
        self._meant: dict[str, tuple[str, int] | None] = {}
        self._known: dict[str, bool] = {}
        self.suspended = {w for w, n in suspended.items() if n >= 3 and n >= 0.2 * counts.get(w, 0) and w in self}

    def __contains__(self, word: str) -> bool:
        known = self._known.get(word)
        if known is None:
            n = self.counts.get(word, 0)
            known = n >= 2 and not any(self.counts.get(v, 0) >= self.ratio * n for v, _ in variants(word, 1))
            self._known[word] = known
        return known

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return math.log(self.total / n) if n else math.log(self.total) + 2.5 * len(word)

    def ordinary(self, token: str) -> bool:
        """Whether a word, or what it is misread for, mostly stands in lower case."""
        word = token.lower()
        if word not in self or not _one_case(token):
            found = self.meant(token)
            word = found[0] if found else word
        n = self.counts.get(word, 0)
        return n >= 2 and self.lower.get(word, n) >= 0.3 * n

    @functools.cached_property
    def _alike(self) -> dict[str, list[str]]:
        """Words by what they are when i and l aren't told apart."""
        out: dict[str, list[str]] = {}
        for w in self.counts:
            out.setdefault(w.replace("i", "l"), []).append(w)
        return out

    def near(self, word: str) -> list[str]:
        return self._alike.get(word.replace("i", "l"), [])

    @functools.cached_property
    def _follow(self) -> dict[str, float]:
        """The cost of each pair of letters in known words, each word counting once."""
        pairs: Counter = Counter()
        for w, n in self.counts.items():
            if n >= 2 and w.isalpha():
                pairs.update(map("".join, zip("^" + w, w + "$")))
        of = Counter()
        for p, n in pairs.items():
            of[p[0]] += n
        return {p: math.log((of[p[0]] + 30) / (n + 0.1)) for p, n in pairs.items()}

    def spelled(self, word: str) -> float:
        """The cost of a word's spelling, as letters follow each other in known words."""
        follow = self._follow
        return sum(follow.get(p, 7.0) for p in map("".join, zip("^" + word, word + "$")))

    def spelling(self, token: str) -> tuple[str, int] | None:
        """The likeliest reading of a word that is neither known nor misread for one: its symbols read as letters.

        Letter pairs that hardly ever stand in words are read otherwise where that is likelier by far.
        """
        letters = sum(c.isalpha() and c not in SYMBOLS for c in token)
        hard = len(_hard(token))
        odd = "ii" in token or "vv" in token
        if not (hard or odd) or hard > 3 or letters < max(2, hard) or "_" in token or token.isupper() or re.match(r"\d+[^\W\d_]{1,2}$|\d\d", token):
            return None
        best = min(((self.spelled(w), w, hard) for w in readings(token)), default=None)
        if odd:
            other = best[1].replace("ii", "u").replace("vv", "w")
            if (cost := self.spelled(other) + MISREAD) + 2 < best[0] or hard and cost < best[0]:
                best = (cost, other, hard + token.count("ii") + token.count("vv"))
        return (best[1], best[2]) if best[2] else None

    def meant(self, token: str) -> tuple[str, int] | None:
        """The word that a token which is none stands for, and how many characters are misread.

        The longer a token, the more letter groups may be misread: one in four letters, and one more.
        """
        if token not in self._meant:
            found = None
            if token.lower() not in self or not _one_case(token):
                n = self.counts.get(token.lower(), 0)
                for layer in itertools.islice(layers(token, self.near), 2 + len(token) // 4):
                    good = [(v, k) for v, k in layer.items() if v in self and v != token.lower() and self.counts[v] >= max(2, 3 * n)]
                    if good:
                        found = min(good, key=lambda x: (self.cost(x[0]) + 5 * x[1], x))
                        break
            if len(self._meant) < 2_000_000:
                self._meant[token] = found
            return found
        return self._meant[token]


def words_to_count(text: str) -> tuple[Counter, Counter, Counter]:
    """The words of a text that aren't parts of broken ones, those before a suspended hyphen, and those with a capital."""
    suspended = Counter(m.group(1).lower() for m in _SUSPENDED.finditer(text))
    compounds = Counter(m.group(1).lower() for m in _COMPOUND.finditer(text))
    words = [w for w in _WORD.findall(_BROKEN.sub(" ", text)) if w.isupper() or not any(c.isupper() or c in SYMBOLS for c in w[1:])]
    return Counter(w.lower() for w in words), suspended + compounds, Counter(w.lower() for w in words if w[0].isupper())


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, before_hyphen, capital): counts over all texts."""
    names = ["word", "n", "before_hyphen", "capital"]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counter(), Counter(), Counter()
        for frame in frames:
            for t in frame["t"]:
                for all_, own in zip(held, words_to_count(t)):
                    all_.update(own)
            if len(held[0]) > 500_000:
                yield pd.DataFrame([(w, *(c.get(w, 0) for c in held)) for w in held[0].keys() | held[1].keys()], columns=names)
                held = Counter(), Counter(), Counter()
        yield pd.DataFrame([(w, *(c.get(w, 0) for c in held)) for w in held[0].keys() | held[1].keys()], columns=names)

    rows = texts.select(F.col(text).alias("t")).where("t is not null")
    counted = rows.mapInPandas(count, "word string, n bigint, before_hyphen bigint, capital bigint")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


MISREAD, SPLIT, JOIN, HYPHEN, UNKNOWN = 6.0, 6.0, 4.0, 1.0, 4.0


class Word(NamedTuple):
    """A decoded word, the last chunk it takes from, how many marked breaks it had, and how many misread characters."""

    word: str
    chunk: int
    broken: int
    misread: int


_LEAD = re.compile(r"[\w$†|]+")
_TAIL = re.compile(r"[\w$†|]+$")


def _marked(chunks: list[str], i: int) -> bool:
    """Whether a chunk ends with the mark of a broken word; a suspended hyphen is none."""
    chunk, core = chunks[i], _CORE.match(chunks[i]).group(1).strip("|")
    if len(chunk) > 1 and chunk[-1] in MARKS and i + 1 < len(chunks) and _plain(chunks[i + 1]) in ("and", "or"):
        return False
    letter = lambda text: text[-2:-1].isalpha() or text[-2:-1] in SYMBOLS and sum(map(str.isalpha, text)) > 1 and "_" not in text
    return len(chunk) > 1 and chunk[-1] in MARKS and letter(chunk) or core[-1:] in MARKS and letter(core)


def decode(chunks: list[str], lexicon: Lexicon, starts_within: bool = False) -> tuple[list[Word], int, int]:
    """(words, broken, misread): the likeliest words of a stream of characters, given as the chunks between its gaps.

    The states are positions of the stream. A word may end before a gap does, and go on over any number of gaps; so a
    chunk in which several words run together, a word in several pieces, and both at once come out. Edges that can't
    win are left out: known words aren't split, nor are runs that one misread word explains.
    ``starts_within``: the first chunk may be the end of a word of the page before; then it isn't mended.
    """
    n = len(chunks)
    starts = [0, *itertools.accumulate(map(len, chunks))]
    end = starts[-1]
    best: list[tuple[float, int, Word | None]] = [(0.0, -1, None)] + [(math.inf, -1, None)] * end

    def offer(at: int, to: int, cost: float, out: str, chunk: int, broken: int = 0, misread: int = 0) -> None:
        if best[at][0] + cost < best[to][0]:
            best[to] = best[at][0] + cost, at, Word(out, chunk, broken, misread)

    def spelled(token: str) -> tuple[str, int]:
        found = lexicon.spelling(token)
        return (_as(token, found[0]), found[1]) if found else (token, 0)

    i, nxt_start = -1, 0
    marks: list[bool | None] = [None] * n

    def marked_at(j: int) -> bool:
        if marks[j] is None:
            marks[j] = _marked(chunks, j)
        return marks[j]

    for at in range(end):
        if at == nxt_start:
            i += 1
            nxt_start = starts[i + 1]
        if best[at][0] == math.inf:
            continue
        chunk, inside = chunks[i][at - starts[i] :], at > starts[i]
        to = nxt_start
        core = _CORE.match(chunk).group(1).strip("|")
        lower = core.lower()
        plain = core.isalpha() or not core
        known = not core or (plain and lower in lexicon and _one_case(core)) or core.replace(".", "").replace(",", "").isdigit()
        marked = marked_at(i)
        if known and not marked:
            offer(at, to, lexicon.cost(lower) if plain and core else 3.0, chunk, i)
        else:
            whole = False
            read, misread = spelled(core) if core and not marked else (core, 0)
            offer(at, to, UNKNOWN + lexicon.cost(lower), chunk.replace(core, read, 1) if misread else chunk, i, 0, misread)
            if core and not marked and not (i == 0 and starts_within and plain and not _common(core, lexicon)):
                parts = core.split("-") if "-" in core else [core]
                meant = [p if not p or p.lower() in lexicon or p.isdigit() else None for p in parts]
                mended = [lexicon.meant(p) if m is None else None for p, m in zip(parts, meant)]
                whole = all(m is not None or x for m, x in zip(meant, mended))
                if whole and any(mended):
                    new = "-".join(m if m is not None else _as(p, x[0]) for p, m, x in zip(parts, meant, mended))
                    cost = sum(lexicon.cost((m or x[0]).lower()) for m, x in zip(meant, mended) if m or x)
                    misread = sum(x[1] for x in mended if x)
                    offer(at, to, cost + MISREAD * misread, chunk.replace(core, new, 1), i, 0, misread)
                elif whole:
                    offer(at, to, sum(lexicon.cost(m.lower()) for m in meant if m) + 1, chunk, i)
            if core and not whole and not (i == 0 and starts_within and not inside):
                # words that end here though no gap follows
                lead = chunk.index(core)
                run = _LEAD.match(core)
                for k in range(2, (len(run.group(0)) if run else 0) - 1):
                    a = lower[:k]
                    if lexicon.counts.get(a, 0) >= (20 if k > 2 else 200) and a.isalpha() and a in lexicon and core[1:k].islower():
                        offer(at, at + lead + k, lexicon.cost(a) + SPLIT, chunk[: lead + k], i)
        if i + 1 == n:
            if marked and not inside:
                part = _TAIL.search(chunk.rstrip(MARKS))
                if chunk[-1] != "-" or not part or part.group(0).lower() not in lexicon.suspended:
                    # the page ends amid a word: what is here of it stays, the mark goes
                    offer(at, to, UNKNOWN + lexicon.cost(lower) - 1, chunk.rstrip(MARKS), i, 1, 0)
            continue
        # words that go on over gaps
        head = chunk.rstrip(MARKS) if marked else chunk
        first = _TAIL.search(head) if head and (head[-1].isalnum() or head[-1] in SYMBOLS) else None
        if first is None:
            continue
        if known and not marked:
            ahead = _CORE.match(chunks[i + 1]).group(1)
            if not ahead.isalpha() or not ahead[0].islower() or ahead in lexicon or not plain:
                continue
        whole, price, broken, open_mark = first.group(0), 0.0, 0, marked
        for j in range(i + 1, n):
            m = _LEAD.match(chunks[j])
            if m is None or m.group(0).isdigit() or len(whole) > lexicon.longest + 2:
                break
            price += HYPHEN if open_mark else JOIN
            broken += open_mark
            whole += m.group(0)
            low, cost, misread, text = whole.lower(), None, 0, whole
            if low in lexicon:
                cost = lexicon.cost(low)
            elif (marked or not known) and (x := lexicon.meant(whole)):
                cost, misread, text = lexicon.cost(x[0]) + MISREAD * x[1], x[1], _as(whole, x[0])
            rest = chunks[j][m.end() :]
            if cost is not None:
                offer(at, starts[j + 1], cost + price, head[: first.start()] + text + rest, j, broken, misread)
            elif j == i + 1 and marked and not _keeps_hyphen(first.group(0), m.group(0), chunk[-1], lexicon):
                text, misread = spelled(whole)
                offer(at, starts[j + 1], UNKNOWN + lexicon.cost(low) - len(low), head[: first.start()] + text + rest, j, 1, misread)
            open_mark = marked_at(j)
            # further only through what is nothing but a piece
            if not (rest == "" or open_mark and rest.strip(MARKS) == "") or not open_mark and m.group(0).lower() in lexicon and known:
                break
    words, broken, misread, at = [], 0, 0, end
    while at > 0:
        _, at, word = best[at]
        words.append(word)
        broken, misread = broken + word.broken, misread + word.misread
    return words[::-1], broken, misread


def _as(token: str, word: str) -> str:
    """``word`` in the case of the token it stands for."""
    letters = [c for c in token if c.isalpha()]
    if letters and len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if token[:1].isupper() or token[:1] in "75$016" and word[:1] in "tsolb" and len(token) < 2 else word


def _one_case(core: str) -> bool:
    return core.isupper() or core[1:].islower() or len(core) == 1


def _common(core: str, lexicon: Lexicon) -> bool:
    """Whether what may be the end of a word rather is a long, common word misread."""
    found = lexicon.meant(core) if len(core) >= 5 else None
    return found is not None and lexicon.counts[found[0]] >= 20


def _keeps_hyphen(a: str, b: str, mark: str, lexicon: Lexicon) -> bool:
    """Whether a hyphen at a break belongs to a compound or a suspended word."""
    return mark == "-" and a.lower() in lexicon.suspended and b.lower() in lexicon


def paragraphs(pieces: list[tuple[str, float]], typical: float = 420.0) -> list[str]:
    """Sentences, each with the evidence for a break after it, joined to the likeliest paragraphs."""
    n = len(pieces)
    best, back = np.full(n + 1, math.inf), [0] * (n + 1)
    best[0] = 0.0
    length = np.concatenate([[0], np.cumsum([len(s) + 1 for s, _ in pieces])])
    for j in range(1, n + 1):
        cost = best[:j] + 0.6 * np.log((length[j] - length[:j]) / typical) ** 2
        i = int(cost.argmin())
        best[j], back[j] = cost[i] - (pieces[j - 1][1] if j < n else 0.0), i
    out, j = [], n
    while j > 0:
        out.append(" ".join(s for s, _ in pieces[back[j] : j]))
        j = back[j]
    return out[::-1]


def repair(text: str, lexicon: Lexicon, expected: int | None = None, voted: str | None = None, titles: Titles | None = None) -> tuple[str, list[str], int | None, str | None]:
    """(text, kinds, number, title): the repaired text of a page and the kinds of damage it had.

    A kind is given for what was changed: furniture taken off, marks of breaks taken out, characters read otherwise.
    """
    page = Page(text, titles or Titles(lexicon), expected, voted)
    kinds = set()
    if page.titles:
        kinds.add("header")
    if page.number is not None:
        kinds.add("pageno")
    body = re.sub(rf"(?<=[^\W\d_])[ ]([{_ANY_MARK}])(?=\s*(?:\n|$))", r"\1", page.body)
    title = None
    for raw in page.titles:
        words, _, misread = decode(raw.split(), lexicon)
        title = " ".join(w.word for w in words)
        if misread:
            kinds.add("chars")
    pieces, chunks, heights = [], [], []
    lines = body.split("\n")
    width = max(map(len, lines), default=0)
    for k, line in enumerate(lines):
        own = line.split()
        chunks += own
        # after the line's last chunk: an empty line says a paragraph ends, a short line after a sentence hints at it
        gap = 6.0 if k + 1 < len(lines) and not lines[k + 1].strip() else 1.5 if len(line) < 0.7 * width and line.rstrip()[-1:] in ".!?" else 0.0
        heights += [0.0] * (len(own) - 1) + [gap] * bool(own)
    words, broken, misread = decode(chunks, lexicon, bool(chunks) and chunks[0][:1].islower())
    if broken:
        kinds.add("hyphen")
    if misread:
        kinds.add("chars")
    sentence = []
    for word, after in itertools.zip_longest(words, words[1:]):
        sentence.append(word.word)
        # the evidence is that of the last gap a word takes; a split word's pieces lie before it
        evidence = heights[word.chunk] if after is None or after.chunk != word.chunk else 0.0
        if word.word[-1:] in ".!?。" or evidence >= 6:
            pieces.append((" ".join(sentence), evidence if evidence else -2.0))
            sentence = []
    if sentence:
        pieces.append((" ".join(sentence), 0.0))
    return "\n\n".join(paragraphs(pieces)), sorted(kinds), page.number, title


OUT = "id bigint, text string, kinds array<string>, page_number int, title string"


def repair_pages(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, text, kinds, page_number, title): each page's continuous text and the kinds of damage it had.

    pages: id, scan (the document a page belongs to), place (its number in it, or NULL), text; corpus: text, from all of
    which words are counted; other columns are ignored. kinds are ``hyphen``, ``chars``, ``header`` and ``pageno``.
    Numbers without any mark at the edge of a page without lines count as page numbers only if another page of the
    scan has one at the same edge that fits its place. A running title is what stands at the edge of two pages of a
    scan, misread characters mended (a single word: of three); where a scan is known to have titles, has no more than
    three pages, or a page number stands beside it, a line of ordinary words written like names is one too. NULL texts
    give NULL and no kinds, empty and blank ones an empty text; repeated pages come out as they stand; pages of any
    length are repaired whole. All words of the corpus with their counts make the lexicon that is sent to the executors:
    it grows with the vocabulary.
    """
    spark = pages.sparkSession
    words = count_words(corpus).collect()
    counts = {r["word"]: r["n"] for r in words if r["n"]}
    hyphens = {r["word"]: r["before_hyphen"] for r in words if r["before_hyphen"]}
    shared = spark.sparkContext.broadcast((counts, hyphens, {r["word"]: r["n"] - r["capital"] for r in words if r["capital"]}))
    pages = cut(pages.select("id", F.col("scan").cast("string").alias("scan"), F.col("place").cast("int").alias("place"), "text"))

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(shared)
        known = Titles(lexicon)
        for frame in frames:
            out = []
            for id_, scan, place, text in zip(frame["id"], frame["scan"], frame["place"], frame["text"]):
                page = Page(text)
                if not pd.isna(place):
                    out += [(id_, scan, edge, value - int(place), None, None) for edge, value in dict.fromkeys(page.weak)]
                keys = {known.key(x): len(x) for x in page.candidates}
                out += [(id_, scan, None, None, key, n) for key, n in keys.items() if key]
            votes = pd.DataFrame(out, columns=["id", "scan", "edge", "shift", "key", "size"])
            yield votes.astype({"shift": "Int32", "size": "Int32"})

    cast = cut(pages.where("scan is not null and text is not null").mapInPandas(vote, "id bigint, scan string, edge string, shift int, key string, size int"))
    votes = cast.where("edge is not null").groupBy("scan", "edge", "shift").agg(F.count("*").alias("n")).where("n > 1")
    votes = votes.groupBy("scan").agg(F.max(F.struct("n", "edge", "shift")).alias("x")).select("scan", "x.edge", "x.shift")
    agreed = cast.where("key is not null").groupBy("scan", "key", "size").agg(F.count_distinct("id").alias("n")).where("n >= if(size = 1, 3, 2)")
    agreed = cut(agreed)
    lengths = spark.sparkContext.broadcast({r["size"]: r["count"] for r in agreed.groupBy("size").count().collect()})  # a row per number of words
    own = cast.where("key is not null").join(agreed.select("scan", "key", "n"), ["scan", "key"]).groupBy("id").agg(F.collect_set(F.struct("key", "n")).alias("agreed"))  # of one page
    scans = pages.where("scan is not null").groupBy("scan").agg(F.count_distinct("id").alias("size"))
    scans = scans.join(agreed.select("scan", F.lit(True).alias("runs")).distinct(), "scan", "left").join(votes, "scan", "left")

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(shared)
        for frame in frames:
            out = []
            for id_, place, text, edge, shift, keys, runs, size in zip(*(frame[c] for c in ("id", "place", "text", "edge", "shift", "agreed", "runs", "size"))):
                if text is None:
                    out.append((id_, None, [], None, None))
                    continue
                expected = int(place + shift) if edge is not None and not pd.isna(shift) and not pd.isna(place) else None
                titles = Titles(lexicon, {} if keys is None else {k["key"]: int(k["n"]) for k in keys}, runs is True or runs == 1, not pd.isna(size) and size <= 3, lengths.value)
                out.append((id_, *repair(text, lexicon, expected, edge, titles)))
            done = pd.DataFrame(out, columns=["id", "text", "kinds", "page_number", "title"])
            done["page_number"] = done["page_number"].astype("Int32")
            yield done

    return pages.join(scans, "scan", "left").join(own, "id", "left").select("id", "place", "text", "edge", "shift", "agreed", "runs", "size").mapInPandas(mend, OUT)


@functools.lru_cache(maxsize=1)
def _made(key: int, value) -> Lexicon:
    return Lexicon(*value.value)


def _lexicon(shared) -> Lexicon:
    return _made(id(shared), shared)
