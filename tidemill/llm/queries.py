"""The llm problems' queries over the project's tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.contamination import leaked_passages, without_leaks
from tidemill.llm.nearest_stream import best_candidates, pair_tables
from tidemill.llm.tokenizer import token_ids
from tidemill.llm.toxicity import calibration, fit, rates, read_documents, score_documents
from tidemill.session import table

SERIES = ["feed_id", "symbol"]
NEAR_US = 900_000_000


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision and exposed pair with the nearest bar within 900 seconds."""
    ev = table(spark, sf_dir, "legal_events").select("event_seq", "feed_id", "decision_at", "pair_exposures")
    pairs = F.map_keys(F.map_filter("pair_exposures", lambda _, v: v.isNotNull() & (v != 0)))
    ev = ev.select("event_seq", "feed_id", "decision_at", F.explode(pairs).alias("symbol"))
    bars = table(spark, sf_dir, "bars").where("close IS NOT NULL").select("bar_id", *SERIES, "timestamp")
    paired = pair_tables(ev, bars, SERIES, "decision_at", "event_seq", "timestamp", "bar_id", NEAR_US)
    return best_candidates(paired, SERIES, "event_seq", "bar_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_nearest(spark, sf_dir).select("event_seq", "bar_id")


def vocabulary_path() -> str:
    """Where the byte-level BPE vocabulary lies: TIDEMILL_VOCABULARY, else the installed public files."""
    if own := os.environ.get("TIDEMILL_VOCABULARY"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary_path()).select("doc_id", "ids")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a benchmark item in a document, with its place."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return leaked_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("place = 1").select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that carry no passage of an item."""
    return without_leaks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", p8_found(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score for abusive, hateful or sexual passages."""
    documents = read_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("marked").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of marked documents of each source."""
    return rates(p9_scores(spark, sf_dir))


def p9_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often labelled documents of each range of scores are marked."""
    return calibration(p9_scores(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = [p4_found, p4_nearest, p7_ids, p8_found, p8_leaks, p8_clean, p9_found, p9_scores, p9_rates, p9_calibration]

_NEAREST = """
WITH pts AS (
  SELECT event_seq, feed_id, symbol, epoch_us(decision_at) AS t FROM (
    SELECT event_seq, feed_id, decision_at, unnest(map_entries(pair_exposures), recursive := true) FROM legal_events WHERE decision_at IS NOT NULL
  ) AS e(event_seq, feed_id, decision_at, symbol, exposure) WHERE exposure <> 0),
near AS (
  SELECT p.event_seq, p.feed_id, p.symbol, b.bar_id, epoch_us(b.timestamp) - p.t AS gap_us,
    row_number() OVER (PARTITION BY p.event_seq, p.symbol ORDER BY abs(epoch_us(b.timestamp) - p.t), b.timestamp, b.bar_id) AS rn
  FROM pts p JOIN bars b ON p.feed_id = b.feed_id AND p.symbol = b.symbol AND epoch_us(b.timestamp) BETWEEN p.t - 900000000 AND p.t + 900000000
  WHERE b.close IS NOT NULL)
"""

ORACLES = {
    "p4_found": _NEAREST + "SELECT event_seq, bar_id FROM near WHERE rn = 1",
    "p4_nearest": _NEAREST + "SELECT feed_id, symbol, event_seq, bar_id, gap_us FROM near WHERE rn = 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
