import base64
import random

import pytest

from tidemill.llm.tokenizer import PATTERN, Encoder, RankQueue, Vocabulary, merge, token_ids

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_vocabularys():
    assert PATTERN == P.PATTERN


def test_queue_gives_least_rank_then_leftmost():
    rnd, q, held = random.Random(0), RankQueue(), []
    for _ in range(2000):
        if held and rnd.random() < 0.4:
            assert q.pop() == min(held)
            held.remove(min(held))
        else:
            x = (rnd.choice([0, 63, 64, 4095, 4096, 49_999, rnd.randrange(50_000)]), rnd.randrange(10_000))
            q.push(*x)
            held.append(x)
    while held:
        assert q.pop() == min(held)
        held.remove(min(held))
    assert q.pop() is None


TEXTS = ["", " ", "\n\n \t", "It's  they'LL", "naïve café — ½ √Δt", "你好，世界" * 50, "😀👍🏽" * 20, "<|endoftext|>", "a" * 5000, "ab" * 3000, "\u0000�​", "x" * 47 + " " + "y" * 60]


def test_same_ids_as_the_public_library(vocabulary, other):
    rnd = random.Random(1)
    encode = Encoder(vocabulary)
    noise = ["".join(rnd.choice("abc e'\n中é😀0129.,-") for _ in range(rnd.randrange(200))) for _ in range(300)]
    for t in TEXTS + noise:
        assert encode(t) == other.encode_ordinary(t)
        assert other.decode(encode(t)) == t


def test_very_long_pre_token(vocabulary, other):
    t = "".join(chr(97 + (i * i * 7 + i * 3) % 26) for i in range(60_000))
    assert merge(t.encode(), vocabulary) == other.encode_ordinary(t)


def test_operator(spark, vocabulary, other):
    rows = [(i, t, [9]) for i, t in enumerate(TEXTS)] + [(99, None, None), (1, " ", [9]), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, counts array<int>")
    got = token_ids(df, "text", P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == ([] if r.text is None else other.encode_ordinary(r.text))
    assert token_ids(df.limit(0), "text", P.path("byte_bpe_50k.json")).collect() == []
    with pytest.raises(ValueError):
        token_ids(df, "text", P.path("byte_bpe_50k.json"), out="counts")


def test_session_zone_does_not_matter(spark):
    df = spark.sql("SELECT 1 AS doc_id, 'ab' AS text, timestamp'2024-01-01' AS created_at")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert token_ids(df, "text", P.path("byte_bpe_50k.json")).first().ids == [397]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
