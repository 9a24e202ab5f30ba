import math

import pytest
from pyspark.sql import functions as F

from tidemill.functions import expr as X


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_arrays(spark):
    a = F.array(*(F.lit(x) for x in (1.0, -2.0, 2.0, 2.0)))
    none = F.array().cast("array<double>")
    r = one(spark, d=X.dot(a, a), n=X.norm(a), m=X.argmax(a), h=X.herfindahl(a), s=X.softmax(a), e=X.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))), z=X.argmax(none), t=X.total(none), w=X.herfindahl(none))
    assert (r.d, r.n, r.m, r.z, r.t, r.w) == (13.0, math.sqrt(13), 2, None, 0.0, 1.0)
    assert r.h == pytest.approx(13 / 49) and sum(r.s) == pytest.approx(1) and r.e == pytest.approx(math.log(2))


def test_scalars(spark):
    r = one(spark, a=X.sigmoid(F.lit(1e6)), b=X.half_life(F.lit(0.5)), c=X.half_life(F.lit(1.0)), d=X.within(F.lit(1.0), F.lit(1.0 + 1e-10)), e=X.within(F.lit(1.0), F.lit(1.1)), f=X.is_sha256(F.lit("a" * 64)), g=X.is_sha256(F.lit("A" * 64)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (pytest.approx(1), pytest.approx(1), None, True, False, True, False)
    assert X.alpha(1) == 0.5
    with pytest.raises(ValueError):
        X.alpha(0)
    paths = {"a//b\\c": "a/b/c", "./x": "x", "/etc": None, "C:/x": None, "a/../b": None, "..": None}
    got = spark.createDataFrame([(k,) for k in paths], "p string").select("p", X.logical_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in got} == paths


def test_names_and_paths(spark):
    import uuid

    names = ["", "evt-1", "Ünïcode", "x" * 300]
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    got = {r.n: r.u for r in df.select("n", X.uuid5(ns, F.col("n")).alias("u"), X.is_uuid(X.uuid5(ns, F.col("n"))).alias("ok")).where("ok OR n IS NULL").collect()}
    assert got == {n: str(uuid.uuid5(uuid.UUID(ns), n)) for n in names} | {None: None} or got.get(None) is not None
    assert all(got[n] == str(uuid.uuid5(uuid.UUID(ns), n)) for n in names)
    docs = spark.createDataFrame([('{"a": {"b": [1, {"c": "x"}]}}',), ("[1]",), ("no",), (None,)], "d string")
    assert [r[0] for r in docs.select(X.json_at(F.col("d"), "a.b.1.c")).collect()] == ["x", None, None, None]
    assert docs.select(X.six_places(F.lit(1 / 3))).first()[0] == "0.333333" and docs.select(X.is_commit(F.lit("a" * 40)), X.is_commit(F.lit("a" * 39))).first()[:] == (True, False)
