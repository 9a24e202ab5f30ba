"""Problem 7: token ids of every text by a public byte-level BPE vocabulary.

A pre-token's merges are done in a hierarchical-bitmap rank queue: the positions of a
linked list of symbols wait in one bucket per merge rank, three levels of 64-bit maps say
which buckets are filled, find-first-set gives the next rank, and entries whose pair is
gone are skipped.  Very long pre-tokens so cost n log n, not n squared.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.arrow import utc

#: Splits a text before the merges (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens that a task remembers, and the longest of them, in characters.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids of single bytes, and of each mergeable pair its rank and the id it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, sym = model["vocab"], byte_symbols()
        self.byte_ids = [0] * 256
        for ch, b in sym.items():
            self.byte_ids[b] = ids[ch]
        self.pairs: dict[int, int] = {}  # left id * 2^20 + right id -> rank * 2^20 + new id
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])


class RankQueue:
    """Buckets of positions by rank; the least filled rank is found in three bitmap steps."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # 64 ranks a word
        self.mid: dict[int, int] = {}  # 64 words of low a word
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        w, m = rank >> 6, rank >> 12
        self.low[w] = self.low.get(w, 0) | 1 << (rank & 63)
        self.mid[m] = self.mid.get(m, 0) | 1 << (w & 63)
        self.top |= 1 << m

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the least rank."""
        if not self.top:
            return None
        first = lambda x: (x & -x).bit_length() - 1
        m = first(self.top)
        w = m << 6 | first(self.mid[m])
        rank = w << 6 | first(self.low[w])
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[w] &= self.low[w] - 1
            if not self.low[w]:
                self.mid[m] &= self.mid[m] - 1
                if not self.mid[m]:
                    self.top &= self.top - 1
        return rank, position


def merge(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one pre-token."""
    pairs, ids = vocabulary.pairs, [vocabulary.byte_ids[b] for b in data]
    n = len(ids)
    if n < 2:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = RankQueue()
    for i in range(n - 1):
        hit = pairs.get(ids[i] << 20 | ids[i + 1])
        if hit is not None:
            queue.push(hit >> 20, i)
    while (top := queue.pop()) is not None:
        rank, i = top
        j = after[i]
        if ids[i] < 0 or j >= n:
            continue  # swallowed by an earlier merge
        hit = pairs.get(ids[i] << 20 | ids[j])
        if hit is None or hit >> 20 != rank:
            continue  # the pair has changed since
        ids[i], ids[j] = hit & 0xFFFFF, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = pairs.get(ids[i] << 20 | ids[k])
            if hit is not None:
                queue.push(hit >> 20, i)
        h = before[i]
        if h >= 0:
            hit = pairs.get(ids[h] << 20 | ids[i])
            if hit is not None:
                queue.push(hit >> 20, h)
    return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids; remembers the ids of short pre-tokens up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for word in self.split(text) if text else ():
            ids = known.get(word)
            if ids is None:
                ids = merge(word.encode("utf-8", "surrogatepass"), self.vocabulary)
                if len(word) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


def token_ids(rows: DataFrame, text: str, vocabulary_path: str, out: str = "ids") -> DataFrame:
    """``rows`` with the array column ``out``: the ids of ``text``, without special tokens.

    Empty and null texts both give an empty list, blank ones are encoded as they are;
    every row comes out once, repeated rows included (``out`` must be a new name).  The
    vocabulary, whose size is fixed, is read once on the driver and broadcast.
    """
    if out in rows.columns:
        raise ValueError(f"column {out} exists already")
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            counts, flat = [0], []
            for t in b.column("__text").to_pylist():
                ids = encoder(t)
                flat.append(np.array(ids, dtype=np.int32))
                counts.append(counts[-1] + len(ids))
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(values))
            kept = [utc(b.column(i)) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, column], [*b.schema.names[:-1], out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return rows.withColumn("__text", F.col(f"`{text}`")).mapInArrow(encode, schema)
