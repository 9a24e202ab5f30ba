"""Problem 8: passages of held-out items inside a training corpus.

The corpus is cut into shards; of each shard the stretches whose neighbouring words all are
neighbours in some item get a suffix array, every suffix of the items that a shard can
hold is located in it by binary search, and the longest verbatim matches say which item
may stand where.  Around them the item is aligned with the text, so that passages with
words changed, left out or added are measured exactly.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.passages import LOOKALIKES, TAG, spread

#: Words of a shard: its suffix array is built in one task's memory.
SHARD_WORDS = 400_000
#: Bytes that all items together may have: they are sent to every task.
ITEMS_LIMIT = 64 << 20
#: Matches that are compared at once.
AT_ONCE = 1 << 20
#: Letters of an item's word that is known with one character altered; words that a task remembers.
SHORTEST_ALTERED, REMEMBERED = 4, 300_000

_FOLD = str.maketrans(LOOKALIKES)
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_].)\s*\n\s*(?:>+\s*)?(?=[^\W\d_])")
_MARKUP = re.compile(r"[*_`~#|\\^]+")
_INSIDE = re.compile(r"[.,:'’·](?<=\w.)(?=\w)|[.,:·–—-](?<=\d.) ?(?=\d)|[ ](?<=\d.)[.,:·–—-] ?(?=\d)")
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """The words of a text, without what case, layout, markup, look-alike letters,
    invisible characters and punctuation add to them."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _WORD.findall(_INSIDE.sub("", _MARKUP.sub("", _BROKEN.sub("", text).lower())))
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    odd = {c for c in set(text) if not c.isascii() and unicodedata.category(c) in ("Cf", "Mn")}
    if odd:
        text = text.translate(dict.fromkeys(map(ord, odd)))
    text = _MARKUP.sub("", _BROKEN.sub("", text).casefold()).translate(_FOLD)
    return _WORD.findall(_INSIDE.sub("", text))


def seed_words(least: int, share: float) -> int:
    """Words that stand verbatim in a row in every passage of ``least`` matched words or more
    of which at most ``share`` are wrong: w wrong words leave w + 1 stretches."""
    if share >= 0.5:
        return 1
    wrong = range(int(least * share / (1 - share)) + 2 + int(1 / (1 - 2 * share)) * 4)
    return min(math.ceil(max(least, w * (1 - share) / share if share else least) / (w + 1) - 1e-9) for w in wrong if share or not w)


def suffix_array(a: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Start positions ordered by the symbols from them to their ``stop`` (prefix doubling)."""
    n = len(a)
    if not n:
        return np.zeros(0, dtype=np.int64)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    here = np.arange(n)
    order = np.argsort(rank, kind="stable")
    k, longest = 1, int((stop - here).max())
    while k < longest:
        second = np.where(here + k < stop, rank[np.minimum(here + k, n - 1)] + 1, 0)
        both = rank * (n + 2) + second
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


def common(text: np.ndarray, at: np.ndarray, stop: np.ndarray, test: np.ndarray, q: np.ndarray, end: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Length of the agreement of text[at:stop] with test[q:end] (up to ``depth``), and
    whether text is less there."""
    length, less = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
    live = np.arange(len(at))
    while len(live) and (depth is None or length[live[0]] < depth):
        i, j = at[live] + length[live], q[live] + length[live]
        x = np.where(i < stop[live], text[np.minimum(i, len(text) - 1)], -1)
        y = np.where(j < end[live], test[np.minimum(j, len(test) - 1)], -2)
        same = x == y
        less[live[~same]] = x[~same] < y[~same]
        live = live[same]
        length[live] += 1
    return length, less


def locate(text: np.ndarray, stop: np.ndarray, order: np.ndarray, test: np.ndarray, q: np.ndarray, end: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """Binary search of the suffixes test[q:end]: (first, last + 1) of the entries of
    ``order`` that agree in ``shortest`` symbols, and the longest agreement anywhere."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(order), dtype=np.int64)
        while (open_ := lo < hi).any():
            o = np.flatnonzero(open_)
            mid = (lo[o] + hi[o]) // 2
            length, less = common(text, order[mid], stop[order[mid]], test, q[o], end[o], shortest)
            right = less | (length >= shortest) if upper else less & (length < shortest)
            lo[o[right]] = mid[right] + 1
            hi[o[~right]] = mid[~right]
        bounds.append(lo)
    first, last = bounds
    lo, hi = first.copy(), last.copy()  # the place of the whole suffix, inside the range
    while (open_ := lo < hi).any():
        o = np.flatnonzero(open_)
        mid = (lo[o] + hi[o]) // 2
        _, less = common(text, order[mid], stop[order[mid]], test, q[o], end[o])
        lo[o[less]] = mid[less] + 1
        hi[o[~less]] = mid[~less]
    longest = np.zeros(len(q), dtype=np.int64)
    for near in (lo - 1, lo):
        o = np.flatnonzero((near >= first) & (near < last))
        if len(o):
            at = order[near[o]]
            longest[o] = np.maximum(longest[o], common(text, at, stop[at], test, q[o], end[o])[0])
    return first, last, longest


def align(item: np.ndarray, text: np.ndarray, penalty: int = 3) -> tuple[int, int, int, int]:
    """Best local alignment: (words matched, words changed, left out or added; from, to in text).

    A match counts 1, a change ``penalty`` less, so a passage goes on while at least about
    one word in four is not wrong.
    """
    n, m = len(item), len(text)
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    ramp = penalty * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        step = np.where(text == item[i - 1], 1, -penalty)
        row = np.maximum(h[i - 1] - penalty, 0)
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + step)
        h[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = divmod(int(np.argmax(h)), m + 1)
    end, matched, wrong = j, 0, 0
    while i and j and h[i, j] > 0:
        if item[i - 1] == text[j - 1] and h[i, j] == h[i - 1, j - 1] + 1:
            matched, i, j = matched + 1, i - 1, j - 1
        elif h[i, j] == h[i - 1, j - 1] - penalty:
            wrong, i, j = wrong + 1, i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - penalty:
            wrong, i = wrong + 1, i - 1
        else:
            wrong, j = wrong + 1, j - 1
    return matched, wrong, j, end


def stretch(item: np.ndarray, text: np.ndarray, least: int, share: float) -> tuple[int, int, int, int] | None:
    """A stretch of at least ``least`` matched words with at most ``share`` of them wrong, as
    ``align`` gives it; None where there is none.

    Unlike ``align`` this weighs no ends against each other: for each number of wrong words
    the most matched ones are kept per cell.  A stretch of twice ``least`` matched words or
    more has a part that is within the share too, so few numbers have to be tried.
    """
    n, m = len(item), len(text)
    ratio = share / (1 - share) if share < 1 else np.inf
    layers = int(min((2 * least - 1) * ratio + 1e-9, n + m)) + 1
    # matched words in the high bits, where the stretch began in the low ones
    one, best, found = 1 << 32, [0] * layers, None
    fresh = np.arange(m + 1, dtype=np.int64)
    above = np.tile(fresh, (layers, 1))
    end = [0] * layers
    for i in range(n):
        row = np.tile(fresh, (layers, 1))
        same = text == item[i]
        row[:, 1:][:, same] = above[:, :-1][:, same] + one
        np.maximum(row[1:], above[:-1], out=row[1:])
        np.maximum(row[1:, 1:], above[:-1, :-1], out=row[1:, 1:])
        for w in range(1, layers):
            np.maximum(row[w, 1:], row[w - 1, :-1], out=row[w, 1:])
        for w, j in enumerate(row.argmax(axis=1).tolist()):
            if row[w, j] >> 32 > best[w] >> 32:
                best[w], end[w] = int(row[w, j]), j
        above = row
    for wrong, (b, j) in enumerate(zip(best, end)):
        matched = b >> 32
        if matched >= least and wrong <= ratio * matched + 1e-9 and (found is None or matched > found[0]):
            found = (matched, wrong, b & (one - 1), j)
    return found


class _Items:
    """All test items one after another, their words numbered, and their pairs of neighbours.

    Words of the corpus that no item has are all 0, which nothing matches.
    """

    def __init__(self, rows: list[tuple[int, str | None]], seed: int, least: int):
        self.ids = [r[0] for r in rows]
        own = [words(text) for _, text in rows]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in own for w in ws}), 1)}
        self.words = np.array([self.number[w] for ws in own for w in ws], dtype=np.int64)
        n = np.array([len(ws) for ws in own], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.end = np.cumsum(n)
        self.start = self.end - n
        self.seed, self.least = np.minimum(seed, n), np.minimum(least, n)
        self.wide = len(self.number) + 1
        inside = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        self.pairs, number = np.unique(self.words[inside] * self.wide + self.words[inside + 1], return_inverse=True)
        self.own_pairs = np.unique(self.owner[inside] * max(len(self.pairs), 1) + number)
        # each word of letters by itself and without one of its letters
        self.without: dict[str, list[str]] = {}
        for w in self.number:
            if len(w) >= SHORTEST_ALTERED and w.isalpha():
                for x in _without_one(w):
                    self.without.setdefault(x, []).append(w)
        # items shorter than a seed are sought whole: their suffixes need fewer words
        self.shortest = int(self.seed[self.seed > 0].min()) if (self.seed > 0).any() else 1
        self.at = np.flatnonzero(np.arange(len(self.words)) + self.seed[self.owner] <= self.end[self.owner])
        head = self.words[self.at] * self.wide + np.where(self.shortest > 1, np.append(self.words, 0)[self.at + 1], 0)
        by = np.argsort(head, kind="stable")
        self.at, self.head = self.at[by], head[by]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "met"}

    def numbers(self, ws: list[str]) -> list[int]:
        """The numbers of words; one that no item has stands for an item's word that differs
        from it in one character, if there is one."""
        met = self.__dict__.get("met")
        if met is None or len(met) > len(self.number) + REMEMBERED:
            met = self.met = dict(self.number)
        out = list(map(met.get, ws))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = met[ws[i]] = self._altered(ws[i])
        return out

    def _altered(self, w: str) -> int:
        if len(w) < SHORTEST_ALTERED - 1 or not w.isalpha():
            return 0
        near = {y for x in _without_one(w) for y in self.without.get(x, ()) if _one_apart(w, y)}
        return self.number[min(near)] if near else 0


def _without_one(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def _one_apart(a: str, b: str) -> bool:
    """One character left out, added or changed, or two neighbours exchanged."""
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, c in enumerate(a) if c != b[k]), len(a))
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _places(item: np.ndarray, text: np.ndarray, least: int, share: float) -> Iterator[tuple[int, int, int, int]]:
    """All places of the item in a stretch of text: (matched, wrong, from, to), the best first."""
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        part = text[lo:hi]
        if np.isin(part, item).sum() < least:
            continue
        got = align(item, part)
        if got[0] < least or got[1] > share * (got[0] + got[1]):  # its ends may be trimmed, or its middle too bad
            got = stretch(item, part, least, share)
        if got and got[3] > got[2]:
            yield got[0], got[1], lo + got[2], lo + got[3]
            todo += [(lo, lo + got[2]), (lo + got[3], hi)]


def _hits(text: np.ndarray, items: _Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where items may stand: (position in the text, position in the items, longest agreement
    of that suffix), of each verbatim match its beginning alone."""
    if items.shortest > 1:
        pair = text[:-1] * items.wide + text[1:]
        at = np.searchsorted(items.pairs, pair)
        at[at == len(items.pairs)] = 0
        link = items.pairs[at] == pair if len(items.pairs) else np.zeros(len(pair), dtype=bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], link.astype(np.int8), [0]])))
        a, n = edge[::2], edge[1::2] - edge[::2] + 1
    else:
        a = np.flatnonzero(text > 0)
        n = np.ones(len(a), dtype=np.int64)
        new = np.concatenate([[True], np.diff(a) > 1]) if len(a) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        a, n = a[first], np.diff(np.append(first, len(a)))
    long = n >= items.shortest
    a, n = a[long], n[long]
    place, of = spread(a, n)
    if not len(place):
        return
    small = text[place]
    stop = np.cumsum(n)[of]
    order = suffix_array(small, stop)
    heads = np.unique(small * items.wide + np.where(items.shortest > 1, np.append(small, 0)[1:], 0))
    lo, hi = np.searchsorted(items.head, heads), np.searchsorted(items.head, heads, side="right")
    q = items.at[spread(lo, hi - lo)[0]]
    end = items.end[items.owner[q]]
    for s in np.unique(items.seed[items.owner[q]]):
        some = np.flatnonzero(items.seed[items.owner[q]] == s)
        first, last, longest = locate(small, stop, order, items.words, q[some], end[some], int(s))
        count = last - first
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE)) + 1):
            # a suffix that very many places agree with is taken in pieces
            for skip in range(0, int(count[part].max(initial=0)), AT_ONCE):
                k = np.clip(count[part] - skip, 0, AT_ONCE)
                i, f = spread(first[part] + skip, k)
                p, s_ = order[i], part[f]
                x, y = np.where(p > 0, small[np.maximum(p - 1, 0)], 0), np.where(q[some][s_] > items.start[items.owner[q[some][s_]]], items.words[np.maximum(q[some][s_] - 1, 0)], -1)
                begins = (x != y) | (p == 0) | (stop[np.maximum(p - 1, 0)] != stop[p])
                yield place[p[begins]], q[some][s_[begins]], longest[s_[begins]]


def _dense(number: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, items: _Items, share: float) -> np.ndarray:
    """Which stretches lo..hi of the text have somewhere so many of their item's pairs of
    neighbours that a passage could be there.

    ``number``: of each place the pair of neighbours that begins there, or -1.  A passage of
    ``least`` matched words or more has a part of m < 2 ``least`` matched words that is
    within the share too, so with w <= m share / (1 - share) wrong ones: on at most m + w
    words it has at least m - w - 1 pairs of neighbours as the item has them.
    """
    out = np.zeros(len(lo), dtype=bool)
    wide = max(len(items.pairs), 1)
    size = np.cumsum(hi - lo) // AT_ONCE
    for some in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(size)) + 1):
        if not len(some):
            continue
        n = hi[some] - lo[some]
        at, of = spread(lo[some], n)
        own = k[some][of] * wide + number[at]
        i = np.searchsorted(items.own_pairs, own)
        i[i == len(items.own_pairs)] = 0
        hit = (number[at] >= 0) & (items.own_pairs[i] == own)
        total = np.concatenate([[0], np.cumsum(hit)])
        end = np.cumsum(n)[of]
        place = np.arange(len(at))
        least = items.least[k[some]]
        for each in np.unique(least).tolist():
            for m in range(each, 2 * each):
                w = int(m * share / (1 - share) + 1e-9)
                stop = np.minimum(place + m + w - 1, end)
                ok = (total[stop] - total[place] >= m - w - 1) & (least[of] == each)
                out[some[np.unique(of[ok])]] = True
    return out


def _search_shard(docs: list[int], parts: list[np.ndarray], items: _Items, share: float) -> Iterator[tuple]:
    text = np.concatenate(parts)
    starts = np.cumsum([0, *(len(p) for p in parts)])
    found: list[np.ndarray] = []
    for at, q, longest in _hits(text, items):
        doc = np.searchsorted(starts, at, side="right") - 1
        k = items.owner[q]
        found.append(np.unique(np.stack([doc, k, at - (q - items.start[k]), longest]), axis=1))
    if not found:
        return
    doc, k, spot, longest = np.unique(np.concatenate(found, axis=1), axis=1)
    n = (items.end - items.start)[k]
    # stretches of the text that the item, laid at its matches, can reach
    slack = n // 4 + 8
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(k) != 0) | (np.diff(spot) > n[1:])])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc))
    lo = np.maximum(spot[a] - slack[a], starts[doc[a]])
    hi = np.minimum(spot[b - 1] + n[a] + slack[a], starts[doc[a] + 1])
    if share < 0.5:
        pair = text[:-1] * items.wide + text[1:]
        at = np.searchsorted(items.pairs, pair)
        at[at == len(items.pairs)] = 0
        number = np.append(np.where(items.pairs[at] == pair, at, -1) if len(items.pairs) else np.full(len(pair), -1), -1)
        some = _dense(number, lo, hi, k[a], items, share)
        a, b, lo, hi = a[some], b[some], lo[some], hi[some]
    for g in np.split(np.arange(len(a)), np.flatnonzero((np.diff(doc[a]) != 0) | (np.diff(k[a]) != 0)) + 1):
        if not len(g):
            continue
        d, own = int(doc[a[g[0]]]), int(k[a[g[0]]])
        item, least = items.words[items.start[own] : items.end[own]], int(items.least[own])
        rows: list[tuple[int, int, int, int]] = []
        reached = int(starts[d])
        for p, q in zip(lo[g].tolist(), hi[g].tolist()):
            # a stretch of very many copies is taken in parts that overlap by more than a passage
            step = 8 * len(item) + 64
            for f in range(max(p, reached), q, step):
                part = text[f : min(q, f + step + 4 * len(item) + 32)]
                for m, w, i, j in sorted(_places(item, part, least, share), key=lambda r: r[2]):
                    if f + i >= reached and (i < step or f + len(part) == q):
                        rows.append((m, w, f + i, f + j))
                        reached = f + j
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        s = slice(int(a[g[0]]), int(b[g[-1]]))
        for rank, (m, w, f, t) in enumerate(rows, 1):
            near = longest[s][(spot[s] + n[s] + slack[s] > f) & (spot[s] - slack[s] < t)]
            yield docs[d], items.ids[own], rank, min(int(near.max(initial=0)), m), m, w, f - int(starts[d]), t - int(starts[d])


def leaked_passages(
    corpus: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    least: int = 13,
    share: float = 0.2,
) -> DataFrame:
    """One row per document, test item and place at which it carries a passage of it.

    Output: ``doc_id``, ``item_id``, ``place`` (1 for the best of the item in the document,
    then 2, ...), ``longest`` (words of the longest verbatim match there), ``matched`` and
    ``wrong`` (words of the aligned passage found, and changed, left out or added),
    ``from_word`` and ``to_word`` (where it stands in the document).  A passage counts from
    ``least`` matched words on, with at most ``share`` of its words wrong, wherever in it
    they stand: the best alignment is taken, or, where that is too short or too bad, the
    ``stretch`` with most matched words.  A word of letters counts as the item's too if one
    character of it is altered.  An item of fewer words than ``least`` must have as
    many matched as it has words.  Passages are sought around verbatim stretches of
    :func:`seed_words`, of which every such passage has one, so none is missed.

    Null, empty and blank texts carry nothing, items without words are never found;
    repeated rows come out as often as they occur.  A text longer than a shard is its own
    shard.  The items are held-out sets of bounded size: they are checked against
    ``ITEMS_LIMIT`` and broadcast, the corpus is never shuffled.
    """
    held = items.where(F.col(f"`{item_id}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long"), f"`{item_text}`")
    size = held.agg(F.sum(F.octet_length(F.col(f"`{item_text}`")))).first()[0] or 0
    if size > ITEMS_LIMIT:
        raise ValueError(f"{size} bytes of test items; split them into sets of at most {ITEMS_LIMIT}")
    known = _Items([tuple(r) for r in held.collect()], seed_words(least, share), least)
    shared = corpus.sparkSession.sparkContext.broadcast(known)
    names = [doc_id, item_id, "place", "longest", "matched", "wrong", "from_word", "to_word"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        docs: list[int] = []
        parts: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            found = list(_search_shard(docs, parts, items, share)) if total and len(items.words) else []
            docs.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = items.numbers(words(t))
                if len(w) < items.shortest:
                    continue
                if total + len(w) + 1 > SHARD_WORDS and total:
                    yield flush()
                    total = 0
                w.append(0)
                docs.append(d)
                parts.append(np.array(w, dtype=np.int64))
                total += len(w)
        yield flush()

    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return corpus.select(F.col(f"`{doc_id}`").cast("long"), f"`{text}`").mapInArrow(search, schema)


def without_leaks(corpus: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The corpus without the affected documents (rows with a null id stay)."""
    return corpus.join(found.select(doc_id).distinct(), doc_id, "left_anti")
