"""Typed readers and checked, atomic writers."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of a strict document.
MAX_DEPTH, MAX_BYTES, MAX_DIGITS = 64, 50 << 20, 400

BAR_SCHEMA = T.StructType([T.StructField("timestamp", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")), T.StructField("symbol", T.StringType())])


class ContractError(ValueError):
    """An input does not keep what it promises."""


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None, time_format: str = "yyyy-MM-dd HH:mm:ssXXX") -> DataFrame:
    """Bars from CSV with exactly the declared header and types.

    A header in another order, a malformed row, a time of another form or a row of another
    ``symbol`` fails the query.  Adds ``position``: a number that grows in file order, by
    which later stages break ties.  Read whole files of a series into one dataset; order
    between files follows their partition.
    """
    df = spark.read.schema(BAR_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    df = df.withColumn("timestamp", F.to_timestamp("timestamp", time_format)).withColumn("position", F.monotonically_increasing_id())
    if symbol is not None:
        wrong = F.raise_error(F.concat(F.lit(f"expected {symbol}, found "), F.coalesce("symbol", F.lit("null"))))
        df = df.withColumn("symbol", F.when(F.col("symbol") == symbol, F.col("symbol")).otherwise(wrong))
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents, one a line; blank lines are skipped, a malformed one fails the query."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("d")).select("d.*")


def strict_json(text: str) -> Any:
    """A JSON document without what parsers quietly accept: repeated keys, NaN and
    infinities, endless numbers, excessive depth or size."""
    if len(text.encode()) > MAX_BYTES:
        raise ContractError("document too large")

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ContractError("repeated key")
        return out

    def number(s: str) -> Any:
        raise ContractError(f"{s} is no JSON number")

    def whole(s: str) -> int:
        if len(s) > MAX_DIGITS:
            raise ContractError("number too long")
        return int(s)

    try:
        doc = json.loads(text, object_pairs_hook=pairs, parse_constant=number, parse_int=whole)
    except RecursionError as e:
        raise ContractError("too deep") from e
    except json.JSONDecodeError as e:
        raise ContractError(str(e)) from e
    _check(doc, 0)
    return doc


def _check(x: Any, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ContractError("too deep")
    if isinstance(x, float) and not math.isfinite(x):
        raise ContractError("not finite")
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        _check(y, depth + 1)


def canonical_json(doc: Any) -> bytes:
    """Sorted keys, no spaces, ASCII, finite numbers: equal documents give equal bytes."""
    _check(doc, 0)
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def document_hash(doc: Any) -> str:
    return hashlib.sha256(canonical_json(doc)).hexdigest()


def schema_errors(schema: dict, doc: Any, path: str = "$") -> list[str]:
    """Errors of a document against a subset of JSON Schema (type, required, properties,
    items, enum, additionalProperties); a keyword beyond it is an error of the schema."""
    known = {"type", "required", "properties", "items", "enum", "additionalProperties", "title", "description", "$schema", "$id"}
    if unknown := set(schema) - known:
        raise ContractError(f"{path}: unknown keywords {sorted(unknown)}")
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def fits(kind: str) -> bool:
        if kind in ("integer", "number"):
            return not isinstance(doc, bool) and isinstance(doc, int if kind == "integer" else (int, float)) and math.isfinite(doc)
        return isinstance(doc, kinds[kind])

    want = schema.get("type")
    if want and not any(fits(k) for k in ([want] if isinstance(want, str) else want)):
        return [f"{path}: not of type {want}"]
    out = [f"{path}: not one of {schema['enum']}"] if "enum" in schema and doc not in schema["enum"] else []
    if isinstance(doc, dict):
        props = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in doc]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: unexpected" for k in doc if k not in props]
        for k, v in doc.items():
            if k in props:
                out += schema_errors(props[k], v, f"{path}.{k}")
    if isinstance(doc, list) and "items" in schema:
        for i, v in enumerate(doc):
            out += schema_errors(schema["items"], v, f"{path}[{i}]")
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(data)
    out.close()


def _get(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    return data


def table_digest(df: DataFrame) -> dict[str, Any]:
    """Row count and an order-free digest of all columns, in one distributed pass."""
    h = F.xxhash64(*(F.col(f"`{c}`").cast("string") if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in df.columns))
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"), F.expr("sum(cast(h AS decimal(38, 0)))").alias("s")).first()
    return {"rows": r["n"], "xor": r["x"] or 0, "sum": str(r["s"] or 0)}


def publish(spark: SparkSession, frames: dict[str, DataFrame], path: str, meta: dict[str, Any] | None = None, partition_by: dict[str, Sequence[str]] | None = None) -> dict[str, Any]:
    """Write several frames as one directory that appears whole or not at all.

    They are staged beside it, read back, compared with what was meant to be written, and
    described in ``manifest.json``; one rename makes them visible.  An existing target is
    never overwritten; after any failure the staging area is removed.
    """
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ContractError(f"{path} exists already")
    stage = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        tables = {}
        for name, df in frames.items():
            first = df.columns[0]
            # what Spark keeps of a column's metadata stands in the footer of each Parquet file
            noted = df.withMetadata(first, (df.schema[first].metadata or {}) | {"table": name, "published": meta or {}})
            w = noted.write.option("compression", "zstd")
            keys = list((partition_by or {}).get(name, ()))
            (w.partitionBy(*keys) if keys else w).parquet(f"{stage}/{name}")
            back = spark.read.schema(df.schema).parquet(f"{stage}/{name}").select(df.columns)
            if (got := table_digest(back)) != (want := table_digest(df)):
                raise ContractError(f"{name}: wrote {got}, meant {want}")
            tables[name] = got | {"columns": [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]}
        manifest = {"version": 1, "tables": tables, "meta": meta or {}}
        manifest["sha256"] = document_hash(manifest)
        _put(spark, f"{stage}/manifest.json", canonical_json(manifest))
        if not fs.rename(_fs(spark, stage)[1], target):
            raise ContractError(f"{path} could not be published")
        return manifest
    except BaseException:
        fs.delete(_fs(spark, stage)[1], True)
        raise


def footer_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    """What :func:`publish` noted in the footers of a table's files: its name and ``meta``."""
    m = spark.read.parquet(path).schema.fields[0].metadata
    return {k: m[k] for k in ("table", "published") if k in m}


def frame_errors(df: DataFrame, expected: T.StructType, ordered: bool = True) -> list[str]:
    """What is wrong with a frame's columns: missing, unexpected, of another type, in another order."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in expected.fields}
    out = [f"{c}: missing" for c in want if c not in have] + [f"{c}: unexpected" for c in have if c not in want]
    out += [f"{c}: {have[c].simpleString()}, not {t.simpleString()}" for c, t in want.items() if c in have and have[c] != t]
    if ordered and not out and df.columns != list(want):
        out.append(f"order: {df.columns}, not {list(want)}")
    return out


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest of a published directory; one that was changed is refused."""
    m = strict_json(_get(spark, f"{path.rstrip('/')}/manifest.json").decode())
    if document_hash({k: v for k, v in m.items() if k != "sha256"}) != m.get("sha256"):
        raise ContractError("the manifest was changed")
    return m


def merge_manifests(old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
    """Entries of a partial run over those of an earlier one of the same version."""
    if old.get("version") != new.get("version"):
        return new
    merged = {"version": new["version"], "tables": old.get("tables", {}) | new["tables"], "meta": old.get("meta", {}) | new.get("meta", {})}
    return merged | {"sha256": document_hash(merged)}


def write_csv_gz(df: DataFrame, path: str) -> None:
    """Compressed CSV, for readers without Parquet."""
    df.write.option("header", True).option("compression", "gzip").csv(path)


def file_hashes(spark: SparkSession, path: str, piece: int = 64 << 20) -> DataFrame:
    """SHA-256 and size of every file under a path, computed where the files lie.

    Files are read ``piece`` bytes at a time with Arrow's file systems, so none is ever held
    as a whole.  Empty files, which Spark does not list, are left out.
    """
    names = spark.read.format("binaryFile").load(path).select("path", "length")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            out = []
            for uri in b["path"].to_pylist():
                files, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                h = hashlib.sha256()
                with files.open_input_stream(at) as f:
                    while data := f.read(piece):
                        h.update(data)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b["path"], b["length"], pa.array(out, pa.string())], ["path", "length", "sha256"])

    return names.mapInArrow(digest, "path string, length long, sha256 string")
