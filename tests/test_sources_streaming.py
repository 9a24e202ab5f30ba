import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources import files as S
from tidemill.streaming import series_stream as R

T0 = datetime(2024, 1, 1)


def test_typed_csv(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume,symbol\n"
    (tmp_path / "a.csv").write_text(head + "2024-01-01 00:01:00+00:00,1,2,0.5,1.5,,EURUSD\n2024-01-01 01:00:00+01:00,1,2,0.5,1.25,3,EURUSD\n")
    rows = S.read_bars_csv(spark, f"file://{tmp_path}/a.csv", "EURUSD").orderBy("position").collect()
    assert [(r.timestamp, r.close, r.volume) for r in rows] == [(T0 + timedelta(minutes=1), 1.5, None), (T0, 1.25, 3.0)]
    for bad in ("2024-01-01,1,2,0.5,1.5,,EURUSD\n", "2024-01-01 00:01:00+00:00,x,2,0.5,1.5,,EURUSD\n", "2024-01-01 00:01:00+00:00,1,2,0.5,1.5,,USDJPY\n"):
        (tmp_path / "b.csv").write_text(head + bad)
        with pytest.raises(Exception):
            S.read_bars_csv(spark, f"file://{tmp_path}/b.csv", "EURUSD").collect()
    (tmp_path / "c.csv").write_text("open,timestamp,high,low,close,volume,symbol\n1,2024-01-01 00:01:00+00:00,2,0.5,1.5,,EURUSD\n")
    with pytest.raises(Exception):
        S.read_bars_csv(spark, f"file://{tmp_path}/c.csv").collect()


def test_jsonl(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, p map<string,double>").schema
    (tmp_path / "a.jsonl").write_text('{"id": "x", "p": {"a": 0.5}}\n\n  \n{"id": "y"}\n')
    assert sorted(r.id for r in S.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", schema).collect()) == ["x", "y"]
    (tmp_path / "b.jsonl").write_text('{"id": "x"\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, f"file://{tmp_path}/b.jsonl", schema).collect()


def test_strict_documents():
    assert S.strict_json('{"a": [1, 2.5, null]}') == {"a": [1, 2.5, None]}
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "[Infinity]", "[1e999]", "[" * 70 + "]" * 70, "[" + "9" * 500 + "]", "{"):
        with pytest.raises(S.ContractError):
            S.strict_json(bad)
    assert S.canonical_json({"b": "é", "a": 1}) == b'{"a":1,"b":"\\u00e9"}'
    with pytest.raises(S.ContractError):
        S.canonical_json({"a": float("nan")})
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": [1, 2]}}}, "additionalProperties": False}
    assert S.schema_errors(schema, {"a": 1, "b": [1, 2]}) == []
    assert len(S.schema_errors(schema, {"b": [3], "c": 1})) == 3 and S.schema_errors(schema, {"a": True})
    with pytest.raises(S.ContractError):
        S.schema_errors({"pattern": "x"}, "x")


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a", {"x": 1.0}), (2, None, None)], "id int, s string, m map<string,double>")
    path = f"file://{tmp_path}/run"
    m = S.publish(spark, {"t": df, "u": df.limit(0)}, path, {"note": 1})
    assert S.load_manifest(spark, path) == json.loads(json.dumps(m)) and m["tables"]["t"]["rows"] == 2
    assert spark.read.parquet(f"{path}/t").count() == 2
    with pytest.raises(S.ContractError):
        S.publish(spark, {"t": df}, path)
    real = S.table_digest
    calls = iter(range(100))
    monkeypatch.setattr(S, "table_digest", lambda d: real(d) | {"rows": next(calls)})
    with pytest.raises(S.ContractError):
        S.publish(spark, {"t": df}, f"file://{tmp_path}/other")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["run"]
    f = tmp_path / "run" / "manifest.json"
    (tmp_path / "run" / ".manifest.json.crc").unlink(missing_ok=True)
    f.write_text(f.read_text().replace('"rows":2', '"rows":3'))
    with pytest.raises(S.ContractError):
        S.load_manifest(spark, path)
    merged = S.merge_manifests(m, {"version": 1, "tables": {"v": {}}, "meta": {}})
    assert set(merged["tables"]) == {"t", "u", "v"} and S.merge_manifests({"version": 0}, m) == m


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "x").write_bytes(b"abc")
    assert [(r.length, r.sha256) for r in S.file_hashes(spark, f"file://{tmp_path}").collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]


def run(stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_rollups(spark, tmp_path):
    rows = [("a", T0 + timedelta(hours=h), float(h)) for h in range(0, 60, 7)] + [("z", T0 + timedelta(days=30), 0.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, v double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    run(R.daily_rollup(s, ["key"], "ts", "v", "1 hour"), tmp_path, "daily")
    want = {(r.key, r.day): (r.n, r.mean) for r in df.where("key = 'a'").groupBy("key", F.to_date("ts").alias("day")).agg(F.count("v").alias("n"), F.avg("v").alias("mean")).collect()}
    assert {(r.key, r.day): (r.n, r.mean) for r in spark.read.parquet(f"file://{tmp_path}/daily").collect()} == want
    run(R.sessions(s, ["key"], "ts", "8 hours", "1 hour"), tmp_path, "sessions")
    assert [(r.key, r.n) for r in spark.read.parquet(f"file://{tmp_path}/sessions").collect()] == [("a", 9)]


def test_replay_resumes_as_if_never_stopped(spark, tmp_path):
    rng = np.random.default_rng(0)
    k = np.concatenate([np.arange(40), np.arange(45, 80)])
    rows = [(s, int(i), float(rng.normal()), 0.1, 1e-6, 1e-3) for s in ("a", "b") for i in k]
    schema = "key string, k long, x double, x_eq double, kappa double, gamma double"
    for part, keep in enumerate((lambda i: i < 30, lambda i: i >= 30)):
        spark.createDataFrame([r for r in rows if keep(r[1])], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        run(R.replay_stream(s, ["key"], 60.0), tmp_path, "out")  # a new query on the same checkpoint
    got = {(r.key, r.k): (r.forecast, r.was_reset) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    for s in ("a", "b"):
        own = np.array([r[1:] for r in rows if r[0] == s])
        f, reset, _ = R.replay_rows(own[:, 0].astype(int), *own.T[1:], 60.0, None)
        assert [got[(s, int(i))] for i in own[:, 0]] == [(float(a), bool(b)) for a, b in zip(f, reset)]
    assert [i for (s, i), v in got.items() if s == "a" and v[1]] == [0, 45] or sorted(i for (s, i), v in got.items() if s == "a" and v[1]) == [0, 45]


def test_footers_frames_and_hashes(spark, tmp_path):
    import hashlib

    from pyspark.sql import types as T

    from tidemill.sources.files import file_hashes, footer_metadata, frame_errors, publish

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    path = f"file://{tmp_path}/out"
    publish(spark, {"people": df}, path, meta={"run": "r1"})
    assert footer_metadata(spark, f"{path}/people") == {"table": "people", "published": {"run": "r1"}}
    want = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    assert frame_errors(df, want) == [] and frame_errors(df.select("name", "id"), want) and frame_errors(df.select("name", "id"), want, ordered=False) == []
    assert frame_errors(df.selectExpr("cast(id as int) AS id", "1 AS more"), want) == ["name: missing", "more: unexpected", "id: int, not bigint"]
    (tmp_path / "f").mkdir()
    data = {"x": b"q", "y": b"abc" * 1000}
    for n, b in data.items():
        (tmp_path / "f" / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in file_hashes(spark, f"file://{tmp_path}/f", piece=7).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in data.items()}
    from tidemill.sources.files import write_csv_gz

    write_csv_gz(df, f"file://{tmp_path}/csv")
    assert {(r.id, r.name) for r in spark.read.option("header", True).schema(df.schema).csv(f"file://{tmp_path}/csv").collect()} == {(1, "a"), (2, None)}
