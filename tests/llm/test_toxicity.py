import random

import numpy as np
import pytest

from tidemill.llm import passages as P
from tidemill.llm import toxicity as X
from tidemill.llm.cosine_index import CHUNK, Index, Vocabulary
from tidemill.llm import cosine_index


def test_words_see_through_disguise():
    w = P.words_of
    for x in ("You iddddiot", "you 1d10t", "YOU i-d-i-o-t", "you idiоt", "you i_d_i_o_t", "you i d i o t!", "y<b>o</b>u idiot"):
        assert w(x) == w("you idiot") and len(w(x)) == 2
    assert w("lost 0.03 of it, see gap_events") == w("lost of it see gap_events")
    assert w("p***k") == w("p*k") and w("") == [] == w("12 34") == w(None)
    assert w("<you idiot>") == w("you idiot") and len(w("<idiot>")) == 1


def test_passages_and_windows():
    words, ends = P.read('One two. Three\nfour five [12:01:02] "note": "six" - seven')
    assert (len(words), ends) == (8, [2, 3, 5, 6, 7, 8])
    assert P.passage_texts("One two. Three\n\n!\nfour 12")[:2] == ["One two.", "Three"]
    long = "word " * 100
    import pyarrow as pa

    w, e = P.read(long + ". end")
    p = P.Pieces.of(pa.array([w, [], w[:3]], pa.list_(pa.int64())), pa.array([e, [], [3]], pa.list_(pa.int32())), True)
    whole = P.Pieces.of(pa.array([w, [], w[:3]], pa.list_(pa.int64())), pa.array([e, [], [3]], pa.list_(pa.int32())), False)
    assert whole.length.tolist() == [100, 1, 3] and whole.row.tolist() == [0, 0, 2] and whole.number.tolist() == [0, 1, 0]
    windows = [(s, n) for s, n, k in zip(p.start.tolist(), p.length.tolist(), p.number.tolist()) if n == 14 and k == 0]
    assert {s for s, _ in windows} >= set(range(0, 86, 7)) and len(p.keys()) == len(p.start)
    for text in ("", " \n ", "...", "a", "<b></b>", "\x00 \u200b", "i d i o t"):
        assert len(P.passage_texts(text)) == len(P.read(text)[1])


def sparse(rnd, n, terms, unknown):
    t, of = [], []
    for i in range(n):
        for _ in range(rnd.randrange(0, 14)):
            x = 7 * min(int(rnd.paretovariate(0.4)), terms - 1)
            t.append(x + (unknown and rnd.random() < 0.1))
            of.append(i)
    return np.array(t, dtype=np.int64), np.array(of, dtype=np.int64)


@pytest.mark.parametrize("chunk", [CHUNK, 300])
def test_search_is_exact(chunk, monkeypatch):
    monkeypatch.setattr(cosine_index, "CHUNK", chunk)
    rnd, n, q, terms = random.Random(3), 500, 90, 200
    vocabulary = Vocabulary(7 * np.arange(terms), np.array([rnd.randrange(1, 400) for _ in range(terms)]), 400)
    examples, queries = (vocabulary.vectors(*sparse(rnd, k, terms, u), k) for k, u in ((n, False), (q, True)))

    def dense(v):
        m = np.zeros((len(v), terms))
        for i in range(len(v)):
            for k in range(v.first[i], v.first[i + 1]):
                if v.code[k] >= 0:
                    m[i, v.code[k]] += v.weight[k]
        return m

    cos = dense(queries) @ dense(examples).T
    index = Index(examples, terms)
    for reach in (0.2, 0.35, 0.7, 0.95):
        i, e, c = index.near(queries, reach)
        got = set(zip(i.tolist(), e.tolist()))
        assert set(zip(*(x.tolist() for x in np.nonzero(cos >= reach + 1e-5)))) <= got <= set(zip(*(x.tolist() for x in np.nonzero(cos >= reach - 1e-5))))
        assert len(got) == len(i) and np.allclose(c, cos[i, e], atol=1e-5)


BAD = ["you are a worthless {} and {} hates you", "all {} people are vermin and {} knows it"]
GOOD = ["the {} run finished and {} was stable", "please check {} before {} uses it again", "sigma of {} moved with {} on friday", "the worthless {} position of {} expired"]


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"])
    rows, truth = [], {}
    for d in range(n):
        s = [rnd.choice(GOOD).format(word(), word()) for _ in range(6)]
        truth[d] = d % 6 == 0
        if truth[d]:
            s[rnd.randrange(6)] = rnd.choice(BAD).format(word(), word())
        rows.append((d, ". ".join(s) + ".", f"s{d % 3}" if d % 7 else None))
    return rows, truth, rnd


def test_fit_and_score_held_out(spark):
    rows, truth, rnd = corpus()
    labels = [(d, int(truth[d]) if rnd.random() > 0.03 else 1 - int(truth[d])) for d in range(200)]
    labels += [(None, 1), (3, None), (9999, 1)] + labels[:20]
    extra = [(500, None, "s0"), (501, "", "s0"), (502, " \n ", "s0"), (0, rows[0][1], "s0"), (503, "word " * 30_000, "s0")]
    docs = X.read_documents(spark.createDataFrame(rows + extra, "doc_id long, text string, source string"))
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = X.score_documents(docs, model)
    got = scored.collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        if r.doc_id >= 500:
            assert (r.score, r.marked, r.passage) == (0.0, False, None)
    held = [r for r in got if 200 <= r.doc_id < 400]
    assert sum(r.marked == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.passage and r.example for r in held if r.marked)
    by = {r.source: r for r in X.rates(scored).collect()}
    assert sum(r.documents for r in by.values()) == len(got) and None in by
    assert scored.columns == ["doc_id", "source", "score", "marked", "passage", "example"]
    # one's own mark is no evidence: a wrong one changes nothing
    once = next(r for r in got if r.doc_id == 0)
    assert sum(r.marked == truth[r.doc_id] for r in got if r.doc_id < 200) >= 0.97 * 200 and once.marked
    fit = {r.bin: r for r in X.calibration(scored, spark.createDataFrame([(d, int(truth[d])) for d in held_ids(truth)], "doc_id long, toxic int")).collect()}
    assert sum(r.n for r in fit.values()) == 200 and fit[0].rate <= 0.02 and fit[0].ece <= 0.15
    assert X.score_documents(docs.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        X.score_documents(docs.withColumnRenamed("source", "score"), model)


def held_ids(truth):
    return [d for d in truth if d >= 200]


def test_single_words_and_brackets(spark):
    rows = [(i, ("Idiot!" if i % 2 else "Fine.") + "\nAll went well.") for i in range(40)] + [(100, "Idiot!"), (101, "<idiot>"), (102, "Fine."), (103, None)]
    docs = X.read_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    model = X.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    got = {r.doc_id: r.marked for r in X.score_documents(docs, model).collect()}
    assert got[100] and got[101] and not got[102] and not got[103] and sum(got.values()) == 22


def test_bounds_are_parameters(spark):
    rows, truth, _ = corpus()
    docs = X.read_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(d, int(truth[d])) for d in range(300)], "doc_id long, toxic int")
    model = X.fit(docs, labels, most_marked=20, most_unmarked=60, most_examples=200)
    assert 5 <= (model.marks == 1).sum() <= 40 and 30 <= (model.marks == 0).sum() <= 100 and len(model.keys) <= 260
    assert X.score_documents(docs, model).count() == len(rows)


def test_no_labels_no_scores(spark):
    docs = X.read_documents(spark.createDataFrame([(1, "you are a worthless alpha and beta hates you")], "doc_id long, text string"))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.score_documents(docs, X.fit(docs, empty)).collect()] == [0.0]
    assert [r.score for r in X.score_documents(docs, X.fit(docs.limit(0), empty)).collect()] == [0.0]
