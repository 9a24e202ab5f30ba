import itertools
import random

import numpy as np
import pytest

from tidemill.llm import contamination as C


def test_words_see_through_dress():
    plain = C.words("the willow foundry ratifies 5.063 margins for dyers")
    for t in [
        "THE Willow\nfoundry, ratifies 5063 margins; for dyers!", "th​e wi​llow fоundry ratifies 5.​063 mаrgins fоr dyеrs", "<p>the <b>willow</b> foundry&nbsp;ratifies 5.063 margins for dyers</p>",
        "> the willow foun-\n> dry ratifies 5 - 063 margins\n> for dyers", "| the | willow | foundry | ratifies | 5.063 | margins | for | dyers |", "the ｗｉｌｌｏｗ foundry ratifies **5.063** margins for dyers",
    ]:
        assert C.words(t) == plain, t
    assert C.words(None) == C.words("") == C.words(" \n") == C.words("—…") == []


def test_suffix_array_and_search_against_brute_force():
    rnd = random.Random(0)
    for size, letters in ((0, 3), (1, 3), (60, 2), (300, 4), (200, 1)):
        a = np.array([rnd.randrange(letters) for _ in range(size)], dtype=np.int64)
        want = sorted(range(size), key=lambda i: a[i:].tolist())
        if size:
            assert C.suffix_array(a, np.full(size, size)).tolist() == want
    text = np.array([rnd.randrange(3) for _ in range(400)], dtype=np.int64)
    test = np.array([rnd.randrange(3) for _ in range(60)], dtype=np.int64)
    cuts = np.array([0, 37, 38, 200, 400])  # chains, none of which goes on into the next
    stop = cuts[np.searchsorted(cuts, np.arange(400), side="right")]
    order = C.suffix_array(text, stop)
    assert [text[i : stop[i]].tolist() for i in order] == sorted(text[i : stop[i]].tolist() for i in range(400))
    end = np.where(np.arange(60) < 20, 20, 60)
    first, last, longest = C.locate(text, stop, order, test, np.arange(60), end, 4)
    for q in range(60):
        agree = [next((n for n in range(500) if i + n >= stop[i] or q + n >= end[q] or text[i + n] != test[q + n]), 500) for i in range(400)]
        assert sorted(order[first[q] : last[q]].tolist()) == [i for i in range(400) if agree[i] >= 4]
        assert longest[q] == (max(agree) if max(agree) >= 4 else 0)


def test_alignment_counts_changes():
    item = np.arange(30)
    text = np.concatenate([[90, 91], item[5:12], [99], item[13:18], item[19:27], [92]])
    assert C.align(item, text) == (20, 2, 2, 23)
    assert C.align(item, np.array([70, 71])) == (0, 0, 0, 0)


WORDS = [f"w{i}" for i in range(400)]


def case(rnd, words, damage):
    out = []
    for w in words:
        x = rnd.random()
        if x < damage:
            out += rnd.choice([[], [w, "new"], ["other"]])
        else:
            out.append(w)
    return out


def test_passages_are_found_and_short_quotes_are_not(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(70))) for i in range(12)]
    filler = lambda n: [f"f{rnd.randrange(3000)}" for _ in range(n)]
    docs, want = [], set()
    for d in range(120):
        i = rnd.randrange(12)
        w = items[i][1].split()
        a = rnd.randrange(30)
        if d % 3 == 0:
            docs.append((d, " ".join(filler(200) + case(rnd, w[a : a + 30], 0.08) + filler(100))))
            want.add((d, i))
        elif d % 3 == 1:
            docs.append((d, " ".join(filler(100) + w[a : a + 10] + filler(100))))
        else:
            docs.append((d, rnd.choice([None, "", "  ", " ".join(filler(300))])))
    docs += [docs[0], (None, None)]
    corpus = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    held = spark.createDataFrame([*items, (50, None), (51, "too short"), (None, "a b c d e f g h")], "item_id long, text string")
    found = C.leaked_passages(corpus, "doc_id", "text", held, "item_id", "text")
    assert found.columns == ["doc_id", "item_id", "place", "longest", "matched", "wrong", "from_word", "to_word"]
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) + 1  # the repeated row counts for itself
    assert all(r.longest >= 5 and r.matched >= 13 and r.place == 1 for r in found.collect())
    assert C.without_leaks(corpus, "doc_id", found).where("doc_id IS NOT NULL").select("doc_id").distinct().count() == 120 - len(want)
    assert C.leaked_passages(corpus.limit(0), "doc_id", "text", held, "item_id", "text").count() == 0
    assert C.leaked_passages(corpus, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("least, share", [(13, 0.2), (13, 1 / 7), (5, 0.2), (6, 0.4), (4, 0.0), (13, 0.45)])
def test_every_damaged_passage_has_a_seed(least, share):
    """The shortest of the longest stretches that w wrong words leave of m matched ones."""
    ratio = share / (1 - share)
    least_of_all = min(-(-m // (w + 1)) for m in range(least, 40 * least) for w in range(int(m * ratio + 1e-9) + 1))
    assert C.seed_words(least, share) == least_of_all


def leaks(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return C.leaked_passages(d, "doc_id", "text", i, "item_id", "text").collect()


def test_nothing_is_lost_by_a_constant(spark):
    letters = lambda n: "".join(chr(97 + (n * p // 7) % 26) for p in (911, 577, 1303, 2111, 3187, 4201, 5399))
    item = [f"x{letters(i * 37 % 9999)}" for i in range(100)]
    short = [f"y{letters(i * 91 % 9999)}" for i in range(12)]
    fifth = [w if i % 5 else "other" for i, w in enumerate(item[:60])]
    typos = [w[:2] + w[3:] if i % 4 == 0 else w[:2] + "é" + w[3:] if i % 4 == 1 else w[:3] + w[4] + w[3] + w[5:] if i % 4 == 2 else w for i, w in enumerate(item[:15])]
    pad = " ".join(f"z{letters(i)}" for i in range(300))
    say = lambda w: f"{pad} {' '.join(w)} {pad}"
    docs = [
        (0, say(item[:90])), (1, say(short)), (2, f"{pad} <b {' '.join(item[20:35])} > {pad}"), (3, say(fifth)), (4, say(item[3:40]) + " " + say(item[50:80]) + " " + say(item[3:40])),
        (5, say(typos)), (6, say(item[:11])), (7, say(short[:11])), (8, " ".join(item[:15] * 400)), (9, say(item[:7] + item[50:57])),
    ]
    got = leaks(spark, docs, [(1, " ".join(item)), (2, " ".join(short)), (3, "one two")])
    at = lambda d: [(r.item_id, r.place, r.matched, r.wrong, r.from_word, r.to_word) for r in sorted(got, key=lambda r: r.place) if r.doc_id == d]
    assert at(0) == [(1, 1, 90, 0, 300, 390)] and [r.longest for r in got if r.doc_id == 0] == [90]
    assert at(1) == [(2, 1, 12, 0, 300, 312)] and at(2) == [(1, 1, 15, 0, 301, 316)]
    assert len(at(3)) == 1 and at(3)[0][2] >= 46
    assert [x[:4] for x in at(4)] == [(1, 1, 37, 0), (1, 2, 37, 0), (1, 3, 30, 0)]
    assert len(at(5)) == 1 and at(5)[0][2] >= 13 and at(6) == [] == at(7) == at(9)
    assert len(at(8)) == 400 and all(x[2:4] == (15, 0) for x in at(8))


def test_altered_words():
    assert all(C._one_apart("willow", w) for w in ("wilow", "willlow", "wiIlow", "iwllow", "willo", "willow"))
    assert not any(C._one_apart("willow", w) for w in ("wilw", "wollaw", "lliwow", "pillows"))


@pytest.mark.parametrize("size, changes", [(15, 2), (16, 2), (17, 2), (18, 2), (21, 3)])
def test_short_passages_are_found_wherever_they_are_changed(size, changes):
    item = C._Items([(7, " ".join(f"w{i}" for i in range(60)))], C.seed_words(13, 0.2), 13)
    text = np.concatenate([np.zeros(30, dtype=np.int64), item.words[10 : 10 + size], np.zeros(30, dtype=np.int64)])
    for at in list(itertools.combinations(range(size), changes))[:: 1 if changes == 2 else 6]:
        part = text.copy()
        part[30 + np.array(at)] = 0
        left = size - changes
        ((_, found, _, _, matched, wrong, f, t),) = C._search_shard([1], [np.append(part, 0)], item, 0.2)
        assert found == 7 and 13 <= matched <= left and wrong <= changes and 30 <= f < t <= 30 + size, at
        gone = np.delete(text, 30 + np.array(at))
        assert len(list(C._search_shard([1], [np.append(gone, 0)], item, 0.2))) == 1, at


def test_a_stretch_is_what_trying_all_alignments_finds():
    def tried(item, text, least, ratio):
        best = {}  # (i, j) -> most matched words by wrong ones, of stretches that end there
        for i in range(len(item) + 1):
            for j in range(len(text) + 1):
                here = {0: 0}
                for di, dj in ((1, 0), (0, 1), (1, 1)):
                    for w, n in best.get((i - di, j - dj), {}).items():
                        same = di and dj and item[i - 1] == text[j - 1]
                        k, v = (w, n + 1) if same else (w + 1, n)
                        here[k] = max(here.get(k, 0), v)
                best[i, j] = here
        return any(n >= least and w <= ratio * n for here in best.values() for w, n in here.items())

    rnd = random.Random(5)
    seen = set()
    for _ in range(150):
        item, text = (np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 16))]) for _ in range(2))
        got = C.stretch(item, text, 5, 0.2)
        seen.add(got is None)
        assert (got is not None) == tried(item, text, 5, 0.25)
        assert got is None or (got[0] >= 5 and got[1] <= 0.25 * got[0] and got[2] < got[3])
    assert seen == {True, False}


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "ITEMS_LIMIT", 10)
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.leaked_passages(d, "doc_id", "text", d, "doc_id", "text")
