"""Array and scalar functions over the embeddings and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import expr as X
from tidemill.operators.sequential import numbered
from tidemill.plans.base import Registry, rd
from tidemill.session import table

query = Registry()


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, list_max(v) AS top FROM e),
x AS (SELECT *, [exp(a - top) FOR a IN v] AS ex FROM m), s AS (SELECT *, [a / list_sum(ex) FOR a IN ex] AS p FROM x)
SELECT vec_id, CAST(list_position(v, top) - 1 AS INTEGER) AS argmax, round(sqrt(list_sum([a * a FOR a IN v])), 8) + 0.0 AS norm, round(-list_sum([a * ln(a) FOR a IN p]), 8) + 0.0 AS entropy,
  round(list_sum([pow(abs(a) / list_sum([abs(b) FOR b IN v]), 2) FOR a IN v]), 8) + 0.0 AS concentration, round(1 / (1 + exp(-v[1])), 8) + 0.0 AS logistic FROM s""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", X.argmax(v).alias("argmax"), rd(X.norm(v), 8).alias("norm"), rd(X.entropy(X.softmax(v)), 8).alias("entropy"), rd(X.herfindahl(v), 8).alias("concentration"), rd(X.sigmoid(v[0]), 8).alias("logistic"))


@query("""SELECT event_seq, regexp_matches(assessment_sha256, '^[0-9a-f]{64}$') AS hashed, regexp_matches(coalesce(parent_assessment_sha256, ''), '^[0-9a-f]{64}$') AS has_parent,
  abs(list_sum(map_values(scenario_probabilities)) - 1) <= 1e-4 AS sums_to_one FROM legal_events WHERE scenario_probabilities IS NOT NULL AND cardinality(scenario_probabilities) > 0""")
def record_checks(spark: SparkSession, d: str) -> DataFrame:
    """Form of the hashes, and whether the scenario probabilities sum to one."""
    e = table(spark, d, "legal_events").where("scenario_probabilities IS NOT NULL AND size(scenario_probabilities) > 0")
    return e.select("event_seq", X.is_sha256(F.col("assessment_sha256")).alias("hashed"), X.is_sha256(F.coalesce("parent_assessment_sha256", F.lit(""))).alias("has_parent"), X.within(X.total(F.map_values("scenario_probabilities")), F.lit(1.0), 0.0, 1e-4).alias("sums_to_one"))


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH h AS (SELECT event_seq, assessment_created_at AS t, event_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(event_id)) AS h FROM legal_events WHERE event_id IS NOT NULL)
SELECT event_seq, event_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ['8', '9', 'a', 'b'][strpos('0123456789abcdef', h[17:17])::INT % 4 + CASE WHEN strpos('0123456789abcdef', h[17:17])::INT % 4 = 0 THEN 4 ELSE 0 END] || h[18:20], h[21:32]) AS record_uuid,
  row_number() OVER (ORDER BY t, event_id, event_seq) AS position, t IS NOT NULL AS dated FROM h""")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """A name-based UUID of each record's event, and its place in order of (created, id)."""
    e = table(spark, d, "legal_events").where("event_id IS NOT NULL").select("event_seq", "event_id", F.col("assessment_created_at").alias("t"))
    e = numbered(e, ["t", "event_id", "event_seq"], "position")
    return e.select("event_seq", "event_id", X.uuid5(NAMESPACE, F.col("event_id")).alias("record_uuid"), "position", F.col("t").isNotNull().alias("dated"))


@query("""SELECT event_id, props, CASE WHEN json_valid(props) THEN props ->> '$.k' END AS k, CASE WHEN json_valid(props) THEN props ->> '$.a.b' END AS missing, printf('%.6f', value) AS six FROM events""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Values at dotted paths of JSON texts, numbers with six places."""
    e = table(spark, d, "events")
    return e.select("event_id", "props", X.json_at(F.col("props"), "k").alias("k"), X.json_at(F.col("props"), "a.b").alias("missing"), X.six_places(F.col("value")).alias("six"))
