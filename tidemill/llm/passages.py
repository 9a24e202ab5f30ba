"""Passages of texts as sequences of hashed words, and their terms.

A text is read once: its passages (sentences, lines, items) become hashes of the words as
they are meant, without disguise.  Everything after that is arithmetic on whole batches.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Words that a task remembers.
REMEMBERED = 200_000
#: Passages of more words are also cut into windows of half that many.
LONG_PASSAGE = 28

#: Letters of other alphabets that look like Latin ones (fixed values).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "г": "r",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "χ": "x", "η": "n", "γ": "y", "ω": "w", "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l",
}
#: Names of the elements of HTML that texts are marked up with (fixed values).
ELEMENTS = (
    "a abbr address article aside b blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
#: A tag: the name of an element and only attributes with a value; words in angle brackets are none.
TAG = re.compile(rf"</?(?:{'|'.join(ELEMENTS)})(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))*\s*/?>|<!--|-->", re.I)

#: What each character met so far is read as.
_SHOWN: dict[str, str] = {}
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})
#: Words, and what ends a passage: the end of a sentence or line, of a quoted value, the sign of an item.
_PIECE = re.compile(r"[\w$@*]+|[.!?][\"')\]]*\s|[。！？\n]|\"\s*[:,]\s*\"|[-•](?<=\s.)(?=\s)|\[(?<=\s.)(?=\d)|\((?<=\s.)(?=\w\)\s)")
_STRETCH = re.compile(r"(.)\1{2,}")
_STARS = re.compile(r"\*+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_OTHER_DIGIT = re.compile(r"[2689]")
_WORD_START = re.compile(r"[\w$@*]")


def fold(text: str) -> str:
    """Without tags, accents, invisible characters, case and look-alikes."""
    if "<" in text:
        text = TAG.sub("", text)
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFKD", text).casefold()
    for c in set(s):
        r = _SHOWN.get(c)
        if r is None:
            r = _SHOWN[c] = LOOKALIKES.get(c, "" if unicodedata.category(c) in ("Mn", "Cf") else c)
        if r != c:
            s = s.replace(c, r)
    return s


def word(h: str) -> int:
    return xxhash.xxh3_64_intdigest(h) >> 1


def meant(t: str) -> list[str]:
    """What one written word of a folded text stands for: digits for letters, stretched and
    starred letters undone; numbers are nothing, scripts without spaces give pairs of characters."""
    t = t.strip("_")
    if not t.isalpha():
        if "_" in t and all(len(p) == 1 for p in t.split("_") if p):
            t = t.replace("_", "")
        if not any(c.isalpha() for c in t) or _OTHER_DIGIT.search(t):
            return []
        t = t.translate(_LEET)
        t = _STARS.sub("*", t.strip("*")) if "*" in t else t
        if not t:
            return []
    t = _STRETCH.sub(r"\1", t)
    if not t.isascii() and _WIDE.search(t):
        return [t[i : i + 2] for i in range(max(1, len(t) - 1))]
    return [t]


_BREAK: tuple[str, ...] = ("",)
_KNOWN: dict[str, tuple[int, ...] | str] = {}


def _learn(t: str) -> tuple[int, ...] | str:
    """Hashes of a piece; the letter itself where it is one; "" where it ends a passage."""
    if t.isdigit():
        return ()
    if not _WORD_START.match(t) or t == "*":
        m: tuple[int, ...] | str = ""
    elif len(t) == 1 and t.isalpha() and not _WIDE.match(t):
        m = t
    else:
        m = tuple(word(w) for w in meant(t))
    if len(_KNOWN) >= REMEMBERED:
        _KNOWN.clear()
    _KNOWN[t] = m
    return m


def read(text: str | None) -> tuple[list[int], list[int]]:
    """Hashes of the words of a text, and the end of each of its passages.

    Three letters or more that stand alone one after another are one word.
    """
    out: list[int] = []
    ends: list[int] = []
    if not text:
        return out, ends
    known, letters, last = _KNOWN.get, "", 0
    for t in _PIECE.findall(fold(text)):
        m = known(t)
        if m is None:
            m = _learn(t)
        if m.__class__ is tuple:
            if letters:
                out += _spelt(letters)
                letters = ""
            out += m
        elif m:
            letters += m
        else:
            if letters:
                out += _spelt(letters)
                letters = ""
            if len(out) > last:
                last = len(out)
                ends.append(last)
    if letters:
        out += _spelt(letters)
    if len(out) > last:
        ends.append(len(out))
    return out, ends


def _spelt(letters: str) -> list[int]:
    if len(letters) < 3:
        return [word(c) for c in letters]
    return [word(w) for w in meant(letters)]


def words_of(passage: str) -> list[int]:
    """Hashes of the words of one passage."""
    return read(passage)[0]


def passage_texts(text: str | None) -> list[str]:
    """The passages of :func:`read` as they are written, folded where folding changes lengths."""
    if not text:
        return []
    folded = fold(text)
    shown = text if len(folded) == len(text) else folded
    out, a, full, letters = [], 0, False, False
    for m in _PIECE.finditer(folded):
        k = _KNOWN.get(m[0])
        k = _learn(m[0]) if k is None else k
        if k == "":
            if full:
                out.append(shown[a : m.end()].strip())
            a, full = m.end(), False
        elif k:
            full = True
    if full:
        out.append(shown[a:].strip())
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start..start+count of every range, one after another, and the range each is of."""
    owner = np.repeat(np.arange(len(start)), count)
    before = np.cumsum(count) - count
    return start[owner] + np.arange(len(owner)) - before[owner], owner


@dataclass
class Pieces:
    """Passages of a batch: words, and of each passage its row, number in the row, first word and length."""

    words: np.ndarray
    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(words: pa.Array, ends: pa.Array, windows: bool) -> Pieces:
        """From the columns of words and ends; ``windows``: parts of long passages too."""
        flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        n = np.diff(words.offsets.to_numpy())
        base = np.cumsum(n) - n
        e = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        k = np.diff(ends.offsets.to_numpy())
        row = np.repeat(np.arange(len(k)), k)
        number = np.arange(len(e)) - (np.cumsum(k) - k)[row]
        stop = e + base[row]
        start = np.where(number == 0, base[row], np.concatenate([[0], stop[:-1]]))
        p = Pieces(flat, row, number, start, stop - start)
        return p.with_windows() if windows else p

    def with_windows(self) -> Pieces:
        half = LONG_PASSAGE // 2
        long = np.flatnonzero(self.length > LONG_PASSAGE)
        n = self.length[long]
        count = -(-(n - half // 2) // (half // 2))
        at, of = spread(np.zeros(len(long), dtype=np.int64), count)
        at *= half // 2
        cat = lambda a, b: np.concatenate([a, b])
        return Pieces(self.words, cat(self.row, self.row[long][of]), cat(self.number, self.number[long][of]), cat(self.start, self.start[long][of] + at), cat(self.length, np.minimum(half, n[of] - at)))

    def take(self, some: np.ndarray) -> Pieces:
        return Pieces(self.words, self.row[some], self.number[some], self.start[some], self.length[some])

    def keys(self) -> np.ndarray:
        """A hash of each passage's words in their order."""
        at, of = spread(self.start, self.length)
        if not len(at):
            return np.zeros(len(self.start), dtype=np.int64)
        place = at - self.start[of]
        x = mix(self.words[at], place).view(np.uint64)
        first = np.cumsum(self.length) - self.length
        some = self.length > 0
        out = np.zeros(len(self.start), dtype=np.uint64)
        out[some] = np.add.reduceat(x, first[some])
        return out.view(np.int64)

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and of all pairs of neighbours, and the passage each is of."""
        at, of = spread(self.start, self.length)
        w = self.words[at]
        pair = np.flatnonzero(of[1:] == of[:-1])
        return np.concatenate([w, mix(w[:-1][pair], w[1:][pair])]), np.concatenate([of, of[pair]])
