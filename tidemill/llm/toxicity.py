"""Problem 9: a score for abusive, hateful or sexual passages, by nearest labelled examples.

Examples are the passages of labelled documents.  A passage is compared with them by
exact TF-IDF cosine through an inverted index with block maxima.  The neighbours' marks,
weighted by closeness, are the score; a document takes that of its worst passage, with
the example that speaks for it.  Texts are read once, into a written table of hashed words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.arrow import utc
from tidemill.llm.cosine_index import Index, Vectors, Vocabulary
from tidemill.llm.passages import Pieces, passage_texts, read, spread
from tidemill.session import materialize

#: Least similarity of a neighbour, neighbours that vote, weight of closeness, weight of the prior.
REACH, NEIGHBOURS, POWER, PRIOR_WEIGHT = 0.35, 25, 2, 0.25
#: A document is marked from this score on; a marked one speaks for its worst passage and
#: those at most so much below it; an example votes like at most so many documents.
MARKED, MARGIN, MOST_VOTES = 0.5, 0.15, 8
#: Columns of a read table.
WORDS, ENDS, TEXT = "__words", "__ends", "__text"
#: Passages that are scored, and examples that are fitted at once.
AT_ONCE, AT_FIT = 50_000, 20_000


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.Array:
    n = np.fromiter(map(len, rows), dtype=np.int32, count=len(rows))
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(n.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat).cast(kind))


def read_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with its text read: every row once, all columns but ``text`` as they
    are, the text as ``__text`` and its hashed words and ends of passages beside it.

    It is written to the shared folder, so that fitting and scoring read no text again.
    """
    new = [T.StructField(TEXT, T.StringType()), T.StructField(WORDS, T.ArrayType(T.LongType())), T.StructField(ENDS, T.ArrayType(T.IntegerType()))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [_lists([g[0] for g in got], pa.int64()), _lists([g[1] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*map(utc, b.columns), *cols], [*b.schema.names, WORDS, ENDS])

    own = documents.drop(text)
    rows = documents.select(*(F.col(f"`{c}`") for c in own.columns), F.col(f"`{text}`").cast("string").alias(TEXT))
    return materialize(rows.mapInArrow(parse, T.StructType([*own.schema.fields, *new])), "read-documents")


class Model:
    """The examples' vocabulary and index (sent to tasks once), what they vote, and which
    documents they were taken from."""

    def __init__(self, base: Broadcast | None, positive: Index | None, keys: np.ndarray, kept: np.ndarray, alone: np.ndarray, votes: tuple[np.ndarray, np.ndarray], texts: dict[int, str], docs: np.ndarray, marks: np.ndarray, prior: float):
        self.base, self.positive, self.keys, self.kept, self.alone, self.texts = base, positive, keys, kept, alone, texts
        self.pos, self.tot = votes
        self.docs, self.marks, self.prior = docs, marks, prior
        self.by_key = np.argsort(keys)

    def own_example(self, keys: np.ndarray) -> np.ndarray:
        """The example with the same words, or -1."""
        at = np.searchsorted(self.keys, keys, sorter=self.by_key)
        at = self.by_key[np.minimum(at, len(self.keys) - 1)]
        return np.where(self.keys[at] == keys, at, -1)

    def mark_of(self, docs: np.ndarray) -> np.ndarray:
        """The mark with which a document gave examples, or -1."""
        if not len(self.docs):
            return np.full(len(docs), -1)
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.marks[at], -1)


def _nearest(index: Index, q: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, example, closeness) of the nearest examples of each query."""
    i, e, cos = index.nearest(q, REACH, NEIGHBOURS)
    return i, e, cos**POWER


def _share(n: int, i: np.ndarray, w: np.ndarray, pos: np.ndarray, tot: np.ndarray, most: np.ndarray, prior: float) -> np.ndarray:
    """Weighted share of marks among each query's neighbours."""
    scale = np.minimum(1.0, MOST_VOTES / np.maximum(most, 1))
    p, t = (np.bincount(i, w * np.maximum(v, 0) * scale, n) for v in (pos, tot))
    return (p + PRIOR_WEIGHT * prior) / (t + PRIOR_WEIGHT)


def rate_passages(model: Model, p: Pieces, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and speaking example (or -1) of each passage; 0 where no positive example is near.

    ``mark``: of each passage the mark with which its document gave examples, or -1; the
    document does not vote for itself.
    """
    n = len(p.row)
    score, speaks = np.zeros(n), np.full(n, -1)
    if not n or model.positive is None:
        return score, speaks
    vocabulary, every = model.base.value
    keys = p.keys()
    own = model.own_example(keys)
    state = np.where(own >= 0, mark + 1, 0)
    # equal passages are rated once: for each state of their document
    first = np.lexsort((state, keys))
    k, s = keys[first], state[first]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    which = np.empty(n, dtype=np.int64)
    which[first] = np.cumsum(new) - 1
    some = first[new]
    own, state = own[some], state[some]
    for a in range(0, len(some), AT_ONCE):
        at = some[a : a + AT_ONCE]
        t, of = p.take(at).terms()
        q = vocabulary.vectors(t, of, len(at))
        close = np.unique(model.positive.near(q, REACH, 1)[0])
        i, e, w = _nearest(every, q.take(close))
        self_ = e == own[a : a + AT_ONCE][close][i]
        st = state[a : a + AT_ONCE][close][i]
        counted = self_ & ((st == 1) | ((st == 2) & model.kept[e]))
        pos, tot = model.pos[e] - (counted & (st == 2)), model.tot[e] - counted
        got = _share(len(close), i, w, pos, tot, model.tot[e], model.prior)
        mine, st = own[a : a + AT_ONCE][close], state[a : a + AT_ONCE][close]
        got = np.where((st == 2) & (mine >= 0) & model.kept[mine], model.alone[mine], got)  # what the others said of it
        by = np.lexsort((e, -w * pos, i))
        lead = by[np.searchsorted(i[by], np.arange(len(close)))] if len(i) else by
        who = np.where(pos[lead] > 0, e[lead], -1) if len(i) else np.full(len(close), -1)
        score[some[a : a + AT_ONCE][close]], speaks[some[a : a + AT_ONCE][close]] = got, who
    return score[some][which], speaks[some][which]


def _arrow_docs(b: pa.RecordBatch, i: int) -> np.ndarray:
    return pc.fill_null(b.column(i), -(1 << 62)).to_numpy(zero_copy_only=False)


def _examples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = Pieces.of(b.column(2), b.column(3), True)
        keys = p.keys()
        _, some = np.unique(np.stack([p.row, keys]), axis=1, return_index=True)
        doc, mark = (b.column(i).to_numpy(zero_copy_only=False)[p.row[some]] for i in (0, 1))
        texts = [passage_texts(t) if m else None for t, m in zip(b.column(4).to_pylist(), b.column(1).to_pylist())]
        said = [texts[r][k] if texts[r] else None for r, k in zip(p.row[some].tolist(), p.number[some].tolist())]
        at, _ = spread(p.start[some], p.length[some])
        words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p.length[some])]), pa.int32()), pa.array(p.words[at]))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(mark.astype(np.int32)), pa.array(keys[some]), words, pa.array(said, pa.string())], ["doc", "mark", "key", "words", "said"])


def _least_hash(share: Column | str, of: int, most: int) -> Column:
    """Whether a row is among about ``most`` of ``of``, by the hash of ``share``."""
    return F.pmod(F.xxhash64(share), F.lit(1_000_000)) < int(1_000_000 * most / of)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    mark: str = "toxic",
    most_marked: int = 6_000,
    most_unmarked: int = 24_000,
    most_examples: int = 160_000,
) -> Model:
    """Examples from labelled documents, term statistics from all documents.

    ``documents`` is a table of :func:`read_documents`.  Marks of a document are averaged
    (nulls left out); ties count as marked.  At most about ``most_marked`` and
    ``most_unmarked`` labelled documents and ``most_examples`` distinct passages are used,
    chosen by hash: this bounds what the driver and every task hold.  A passage of a
    marked document stays a positive example only if its neighbours of other documents
    bear it out, and only for documents that have no clearly worse passage.
    """
    sc = documents.sparkSession.sparkContext
    m = labels.where(F.col(doc_id).isNotNull() & F.col(mark).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc")).agg((F.avg(mark) >= 0.5).cast("int").alias("mark"))
    n = {r["mark"]: r["count"] for r in m.groupBy("mark").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    for v, most in ((1, most_marked), (0, most_unmarked)):
        if n.get(v, 0) > most:
            m = m.where((F.col("mark") != v) | _least_hash("doc", n[v], most))
    d = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), WORDS, ENDS, TEXT)
    # the sample is bounded by the two limits, so it may be sent to every task
    own = d.join(F.broadcast(m), "doc").select("doc", "mark", WORDS, ENDS, TEXT).mapInArrow(_examples_of, "doc long, mark int, key long, words array<long>, said string")
    g = own.groupBy("key").agg(
        F.sum("mark").alias("positive"), F.count(F.lit(1)).alias("total"), F.min("words").alias("words"), F.min("said").alias("said"),
        F.collect_list(F.when(F.col("mark") == 1, F.col("doc"))).alias("docs"),
    )
    g = materialize(g, "examples")
    every = g.count()
    if every > most_examples:
        g = g.where(_least_hash("key", every, most_examples))
    rows = g.toArrow().combine_chunks().sort_by("key")  # at most about most_examples rows
    used = m.toArrow().sort_by("doc")
    column = lambda c: rows[c].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)
    keys, positive, total = (column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "positive", "total"))
    nothing = Model(None, None, keys, np.zeros(0, dtype=bool), np.zeros(0), (np.zeros(0), np.zeros(0)), {}, np.zeros(0, dtype=np.int64), np.zeros(0), prior)
    if not len(keys):
        return nothing
    words = column("words")
    ends = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1), pa.int32()), pc.list_value_length(words))
    p = Pieces.of(words, ends, False)
    del words, ends
    parts = np.array_split(np.arange(len(keys)), -(-len(keys) // AT_FIT))  # the driver holds the terms of some at a time
    terms = np.zeros(0, dtype=np.int64)
    for some in parts:
        terms = np.union1d(terms, p.take(some).terms()[0])
    vocabulary = sc.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary.value, np.zeros(len(vocabulary.value)), 1)
        df, documents = np.zeros(len(known.terms), dtype=np.int64), 0
        for b in batches:
            p = Pieces.of(b.column(0), b.column(1), False)
            t, of = p.terms()
            c = known.codes(t)
            at = c >= 0
            pair = np.sort(p.row[of[at]] * (1 << 32) + c[at])
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
            df += np.bincount(pair & ((1 << 32) - 1), minlength=len(df))
            documents += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], documents))], ["term", "n"])

    counts = d.select(WORDS, ENDS).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n_ = counts["term"].to_numpy(), counts["n"].to_numpy()
    df = np.zeros(len(terms), dtype=np.int64)
    df[at[at >= 0]] = n_[at >= 0]
    known = Vocabulary(terms, df, int(n_[at < 0].sum()))
    vectors = Vectors.joined([known.vectors(*p.take(some).terms(), len(some)) for some in parts])
    base = sc.broadcast((known, Index(vectors, len(terms))))
    kept, score = _borne_out(base, p, positive, total, column("docs"), prior, sc)
    del p
    votes = np.where(kept, positive, 0).astype(np.float64), np.where(kept | (positive == 0), total, np.maximum(total - positive, 0)).astype(np.float64)
    said = column("said")
    texts = {int(e): said[int(e)].as_py() for e in np.flatnonzero(kept)}
    # the kept ones alone, under their own numbers
    lengths = np.where(kept, np.diff(vectors.first), 0)
    some, _ = spread(vectors.first[:-1], lengths)
    alone = Vectors(np.concatenate([[0], np.cumsum(lengths)]), vectors.code[some], vectors.weight[some])
    return Model(base, Index(alone, len(terms)) if kept.any() else None, keys, kept, score, votes, texts, used["doc"].to_numpy(), used["mark"].to_numpy(), prior)


def _borne_out(base: Broadcast, p: Pieces, positive: np.ndarray, total: np.ndarray, docs: pa.Array, prior: float, sc: SparkContext) -> tuple[np.ndarray, np.ndarray]:
    """Which examples count as positive, and the others' votes: leave-one-out votes, then each
    marked document speaks only for its worst passages."""
    candidates = np.flatnonzero((positive * 2 >= total) & (positive > 0))
    kept = np.zeros(len(positive), dtype=bool)
    if not len(candidates):
        return kept, np.zeros(len(positive))
    shared = sc.broadcast((positive, total, prior))

    def votes(part: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (vocabulary, index), (positive, total, prior) = base.value, shared.value
        for es, words, start, length in part:
            own = Pieces(words, np.arange(len(es)), np.zeros(len(es), dtype=np.int64), start, length)
            i, e, w = _nearest(index, vocabulary.vectors(*own.terms(), len(es)))
            self_ = e == es[i]
            yield es, _share(len(es), i, w, positive[e] - self_, total[e] - self_, total[e], prior)

    # the bounded list of candidates is dealt out; documents never pass this way
    pieces = []
    for es in np.array_split(candidates, max(1, min(len(candidates), 2 * sc.defaultParallelism))):
        at, _ = spread(p.start[es], p.length[es])
        n = p.length[es]
        pieces.append((es, p.words[at], np.cumsum(n) - n, n))
    score = np.zeros(len(positive))
    for es, s in sc.parallelize(pieces, len(pieces)).mapPartitions(votes).collect():
        score[es] = s
    worst: dict[int, float] = {}
    own = docs.take(pa.array(candidates)).to_pylist()
    for e, ds in zip(candidates.tolist(), own):
        for doc in ds:
            worst[doc] = max(worst.get(doc, 0.0), score[e])
    for e, ds in zip(candidates.tolist(), own):
        speak = sum(score[e] >= worst[doc] - MARGIN for doc in ds)
        kept[e] = score[e] >= MARKED and speak * 2 >= total[e]
    return kept, score


def score_documents(documents: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """The rows of a table of :func:`read_documents` (all columns of the documents, every row
    once) with ``score``, ``marked``, the ``passage`` that gave the score and the labelled
    ``example`` nearest to it.

    Null, empty and blank texts and texts without any passage near a positive example
    have score 0 and no evidence.  A document that gave examples does not vote for itself.
    The new names must not be columns already.
    """
    new = [T.StructField("score", T.DoubleType()), T.StructField("marked", T.BooleanType()), T.StructField("passage", T.StringType()), T.StructField("example", T.StringType())]
    fields = [f for f in documents.schema.fields if f.name not in (WORDS, ENDS, TEXT)]
    if clash := {f.name for f in new} & {f.name for f in fields}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            k = b.num_columns - 4
            p = Pieces.of(b.column(k + 2), b.column(k + 3), True)
            s, e = rate_passages(own, p, own.mark_of(_arrow_docs(b, k))[p.row])
            best = np.lexsort((p.number, -s, p.row))
            rows, first = np.unique(p.row[best], return_index=True)
            best = best[first]
            hit = s[best] > 0
            rows, best = rows[hit], best[hit]
            score = np.zeros(b.num_rows)
            score[rows] = s[best]
            passage, example = [None] * b.num_rows, [None] * b.num_rows
            texts = b.column(k + 1)
            for r, i in zip(rows.tolist(), best.tolist()):
                passage[r] = passage_texts(texts[r].as_py())[p.number[i]]
                example[r] = own.texts.get(int(e[i]))
            cols = [pa.array(score), pa.array(score >= MARKED), pa.array(passage, pa.string()), pa.array(example, pa.string())]
            yield pa.RecordBatch.from_arrays([*map(utc, b.columns[:k]), *cols], [*(f.name for f in fields), *(f.name for f in new)])

    rows = documents.select(*(F.col(f"`{f.name}`") for f in fields), F.col(f"`{doc_id}`").cast("long").alias("__doc"), TEXT, WORDS, ENDS)
    return rows.mapInArrow(rate, T.StructType([*fields, *new]))


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, marked documents and their rate for each source (null is a source too)."""
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("marked").cast("long")).alias("marked"), F.avg(F.col("marked").cast("double")).alias("rate"))


def calibration(scored: DataFrame, labels: DataFrame, doc_id: str = "doc_id", mark: str = "toxic", bins: int = 10) -> DataFrame:
    """Of labelled documents in each bin of the score: how many, the mean score and the rate
    of marks; and the expected calibration error over all (the same in each row)."""
    m = labels.where(F.col(doc_id).isNotNull() & F.col(mark).isNotNull()).groupBy(F.col(doc_id).alias("__doc")).agg((F.avg(mark) >= 0.5).cast("double").alias("__mark"))
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    g = scored.join(m, F.col(f"`{doc_id}`") == F.col("__doc")).groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("__mark").alias("rate"))
    total = g.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))).alias("off"))  # one row
    return g.join(F.broadcast(total), F.lit(True)).select("bin", "n", "mean_score", "rate", (F.col("off") / F.col("all")).alias("ece"))
