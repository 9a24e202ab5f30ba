"""Exact search of sparse unit vectors by cosine, through an inverted index with block maxima.

Many queries are answered at once.  Of a query's terms, those that together could not
reach the wanted cosine are left for later (chosen so that the long lists are among
them).  The others are read block by block, and only blocks whose largest weight still
lets an example reach it.  The sums are kept for the examples met alone; the terms left are
looked up for those that may still get there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemill.llm.passages import spread

#: Postings of a block; postings that are expanded at once.
BLOCK, CHUNK = 64, 1 << 19
#: Examples that are measured one by one rather than along the lists.
FEW = 400
#: Reaches that are tried before a wider one.
SHORTER = (0.7, 0.5)


@dataclass
class Vectors:
    """Sparse unit vectors: of each the first entry, and of each entry its term and weight.

    ``code`` numbers the terms; a term outside the vocabulary has a negative one.
    """

    first: np.ndarray
    code: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, some: np.ndarray) -> Vectors:
        n = np.diff(self.first)[some]
        at, _ = spread(self.first[:-1][some], n)
        return Vectors(np.concatenate([[0], np.cumsum(n)]), self.code[at], self.weight[at])


    @staticmethod
    def joined(parts: list[Vectors]) -> Vectors:
        """One after another, in the small types that an index keeps."""
        n = np.concatenate([np.diff(v.first) for v in parts])
        return Vectors(np.concatenate([[0], np.cumsum(n)]), np.concatenate([v.code.astype(np.int32) for v in parts]), np.concatenate([v.weight.astype(np.float32) for v in parts]))


class Vocabulary:
    """Known terms and their inverse document frequency among ``documents``."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, documents: int):
        """``terms`` are sorted hashes; a term that is not among them counts as in no document."""
        self.terms = terms
        self.idf = np.maximum(np.log((documents + 1) / (df + 0.5)), 0.0)
        self.idf_new = float(np.log((documents + 1) / 0.5))
        # terms by their low bits, in some eight times as many buckets
        self.mask = (1 << max(4, int(8 * len(terms)).bit_length())) - 1
        bucket = terms & self.mask
        self.slots = np.argsort(bucket, kind="stable").astype(np.int32)
        self.start = np.searchsorted(bucket[self.slots], np.arange(self.mask + 2)).astype(np.int32)

    def codes(self, t: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where it is unknown."""
        if not len(self.terms):
            return np.full(len(t), -1, dtype=np.int64)
        bucket = t & self.mask
        at, end = self.start[bucket].astype(np.int64), self.start[bucket + 1]
        out = np.full(len(t), -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            k = self.slots[at[live]]
            hit = self.terms[k] == t[live]
            out[live[hit]] = k[hit]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def vectors(self, t: np.ndarray, of: np.ndarray, n: int) -> Vectors:
        """TF-IDF vectors of length 1 of ``n`` passages from their terms and owners."""
        c = self.codes(t)
        c = np.where(c >= 0, c, (1 << 31) + (t & ((1 << 31) - 1)))  # unknown terms stay apart
        key = np.sort(of * (1 << 32) + c)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        tf = np.diff(np.append(at, len(key)))
        of, c = key[at] >> 32, key[at] & ((1 << 32) - 1)
        old = c < 1 << 31
        w = (1.0 + np.log(tf)) * np.where(old, self.idf[np.where(old, c, 0)] if len(self.idf) else 0.0, self.idf_new)
        norm = np.sqrt(np.bincount(of, w * w, n))
        w = w / np.where(norm > 0, norm, 1.0)[of]
        return Vectors(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), np.where(old, c, -1), w)


class Index:
    """Examples by term."""

    def __init__(self, vectors: Vectors, terms: int):
        """``terms``: size of the vocabulary."""
        owner = np.repeat(np.arange(len(vectors), dtype=np.int32), np.diff(vectors.first))
        known = vectors.code >= 0
        owner, code, weight = owner[known], vectors.code[known], vectors.weight[known]
        self.n = len(vectors)
        by = np.argsort(code.astype(np.int64) * max(self.n, 1) + owner)
        self.owner, self.weight = owner[by], weight[by].astype(np.float32)
        del by, owner, weight
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=terms))])
        blocks = -(-np.diff(self.first) // BLOCK)
        self.block = np.concatenate([[0], np.cumsum(blocks)])
        k, of = spread(np.zeros(terms, dtype=np.int64), blocks)
        at = self.first[of] + BLOCK * k
        self.tops = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0, dtype=np.float32)
        self.top = np.zeros(terms, dtype=np.float32)
        some = np.flatnonzero(blocks)
        if len(some):
            self.top[some] = np.maximum.reduceat(self.tops, self.block[some])
        self._key: np.ndarray | None = None
        self._rows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_key": None, "_rows": None}

    def _keys(self) -> np.ndarray:
        """(term, owner) of each posting as one sorted number."""
        if self._key is None:
            self._key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * max(self.n, 1) + self.owner
        return self._key

    def nearest(self, q: Vectors, reach: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, cosine) of the ``most`` nearest examples of each query within
        ``reach``, nearest first, equally near ones in their order."""
        got = [self._top(q.code[a:b], q.weight[a:b], reach, most) for a, b in zip(q.first[:-1].tolist(), q.first[1:].tolist())]
        n = np.fromiter((len(g[0]) for g in got), dtype=np.int64, count=len(got))
        e, cos = (np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in range(2))
        return np.repeat(np.arange(len(q)), n), e.astype(np.int64), cos

    def _top(self, code: np.ndarray, x: np.ndarray, reach: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of one query and their cosines.

        Short lists are read first, block by block.  After each part of them, the best
        examples so far are measured exactly; what the least of ``most`` of them has is
        what any other must reach from then on.  Those that still can are measured too.
        """
        some = code >= 0
        code, x = code[some], x[some].astype(np.float32)
        a, b = self.first[code], self.first[code + 1]
        by = np.argsort(b - a)
        a, b, code, x = a[by], b[by], code[by], x[by]
        top = x * self.top[code]
        # what the lists from here on can add: by their largest weights, and as examples have length 1
        rest = np.append(np.minimum(top[::-1].cumsum()[::-1], np.sqrt((x * x)[::-1].cumsum()[::-1]) + 1e-6), 0.0)
        lists = list(zip(a.tolist(), b.tolist(), x.tolist(), top.tolist(), self.block[code].tolist()))
        bound, least, done = float(top.sum()), reach - 1e-6, 0
        own, got = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
        order = np.argsort(code)
        query = code[order], x[order]
        for until in (*(r for r in SHORTER if r > reach), 0.0):
            until = max(until, least)
            end = done
            while end < len(lists) and rest[end] >= until:
                end += 1
            if end > done:
                parts = [self._live(k, bound, least) for k in lists[done:end]]
                o = np.concatenate([own, *(p[0] for p in parts)])
                w = np.concatenate([got, *(p[1] for p in parts)])
                by = np.argsort(o)
                o, w = o[by], w[by]
                at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, dtype=np.int64)
                own, got = o[at], np.add.reduceat(w, at) if len(o) else w
                done = end
            stay = got + rest[done] >= least
            own, got = own[stay], got[stay]
            if rest[done] < least and (not len(own) or len(own) <= 4 * most):
                break
            if len(own) > most:
                best = np.argpartition(-got, 2 * most)[: 2 * most] if len(got) > 2 * most else np.arange(len(got))
                cos = self._measure(own[best], query)
                if len(cos) >= most:
                    least = max(least, float(np.partition(cos, len(cos) - most)[len(cos) - most]) - 1e-6)
            if rest[done] < least:
                break
        stay = got + rest[done] >= least
        own, got = own[stay], got[stay]
        while len(own) > FEW and done < len(lists):  # one list after another tells most of them off
            a, b, x, _, _ = lists[done]
            part = self.owner[a:b]
            i = np.searchsorted(part, own)
            i[i == b - a] = 0
            got = got + np.where(part[i] == own, x * self.weight[a + i], np.float32(0.0))
            done += 1
            stay = got + rest[done] >= least
            own, got = own[stay], got[stay]
        cos = self._measure(own, query) if done < len(lists) else got
        stay = cos >= reach
        own, cos = own[stay], cos[stay].astype(np.float64)
        by = np.lexsort((own, -cos))[:most]
        return own[by], cos[by]

    def _live(self, one: tuple[int, int, float, float, int], bound: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Postings of a list whose block lets an example reach ``least``, and what they add."""
        a, b, x, top, p = one
        if b - a > 4 * BLOCK:
            live = x * self.tops[p : p + -(-(b - a) // BLOCK)] + (bound - top) >= least
            if not live.all():
                i = np.flatnonzero(np.repeat(live, BLOCK)[: b - a]) + a
                return self.owner[i], x * self.weight[i]
        return self.owner[a:b], x * self.weight[a:b]

    def _measure(self, own: np.ndarray, query: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Exact cosines of examples with a query (its terms in order, and their weights)."""
        if not len(own):
            return np.zeros(0, dtype=np.float32)
        if self._rows is None:
            by = np.argsort(self.owner)
            term = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))[by]
            self._rows = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=self.n))]), term, self.weight[by]
        first, term, weight = self._rows
        n = first[own + 1] - first[own]
        at, _ = spread(first[own], n)
        t = term[at]
        i = np.searchsorted(query[0], t)
        i[i == len(query[0])] = 0
        w = np.where(query[0][i] == t, query[1][i] * weight[at], np.float32(0.0))
        return np.add.reduceat(w, np.cumsum(n) - n)

    def near(self, q: Vectors, reach: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, example, cosine) with a cosine of at least ``reach``, in order of
        query and example; of each query the ``most`` nearest alone, if given."""
        of = np.repeat(np.arange(len(q)), np.diff(q.first))
        hit = np.flatnonzero(q.code >= 0)
        hit = hit[self.first[q.code[hit] + 1] > self.first[q.code[hit]]]
        of, code, x = of[hit], q.code[hit].astype(np.int64), q.weight[hit]
        top = x * self.top[code]
        bound = np.bincount(of, top, len(q))
        least = reach - 1e-6
        stay = bound[of] >= least
        of, code, x, top = of[stay], code[stay], x[stay], top[stay]
        if not len(of):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        size = np.diff(self.first)[code]
        # long lists with small weights first: as many of them as cannot make a hit alone
        by = np.lexsort((top / size, of))
        of, code, x, top, size = of[by], code[by], x[by], top[by], size[by]
        total = np.cumsum(top)
        start = np.searchsorted(of, of)
        rest = total - (total[start] - top[start])
        later = rest < least
        waiting = np.bincount(of, top * later, len(q))
        cost = np.bincount(of, size * ~later, len(q))
        part = (np.cumsum(cost) // CHUNK).astype(np.int64)[of]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        got = [self._part(*(a[i:j] for a in (of, code, x, top, later)), bound, waiting, least, reach, most) for i, j in zip(cuts, [*cuts[1:], len(of)])]
        return tuple(np.concatenate([g[i] for g in got]) for i in range(3))

    def _part(self, of, code, x, top, later, bound, waiting, least, reach, most):
        now = np.flatnonzero(~later)
        n = max(self.n, 1)
        b, e = spread(self.block[code[now]], self.block[code[now] + 1] - self.block[code[now]])
        e = now[e]
        live = x[e] * self.tops[b] + (bound[of[e]] - top[e]) >= least
        b, e = b[live], e[live]
        a = self.first[code[e]] + BLOCK * (b - self.block[code[e]])
        p, f = spread(a, np.minimum(BLOCK, self.first[code[e] + 1] - a))
        e = e[f]
        key = of[e] * n + self.owner[p]
        by = np.argsort(key)
        key, w = key[by], (x[e] * self.weight[p])[by]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        key, cos = key[at], np.add.reduceat(w, at) if len(at) else np.zeros(0)
        stay = cos + waiting[key // n] >= least
        key, cos = key[stay], cos[stay]
        if len(key) and later.any():
            # the lists left: looked up for every pair, long ones last
            lo = np.searchsorted(of, key // n)
            left = np.bincount(of, later, int(of[-1]) + 1).astype(np.int64)[key // n]
            rest = waiting[key // n].copy()
            postings = self._keys()
            step = 0
            live = np.flatnonzero(left > step)
            while len(live):
                t = lo[live] + left[live] - 1 - step  # the later ones stand first, the heaviest last
                want = code[t] * n + key[live] % n
                i = np.searchsorted(postings, want)
                i[i == len(postings)] = 0
                cos[live] += np.where(postings[i] == want, x[t] * self.weight[i], 0.0)
                rest[live] -= top[t]
                step += 1
                live = live[(left[live] > step) & (cos[live] + rest[live] >= least)]
            stay = cos + rest >= least
            key, cos = key[stay], cos[stay]
        stay = cos >= reach
        i, e, cos = key[stay] // n, key[stay] % n, cos[stay]
        if most is not None and len(i):
            by = np.lexsort((e, -cos, i))
            some = np.sort(by[np.arange(len(i)) - np.searchsorted(i, i) < most])
            i, e, cos = i[some], e[some], cos[some]
        return i, e, cos
