"""Telemetry envelopes, stream frames and output formats."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = """v INT, ts STRING, kind STRING, event STRUCT<event_id: STRING, project_key: STRING, instance_id: STRING, correlation_id: STRING,
query_hash: STRING, query_class: STRING, phase: STRING, latency_us: BIGINT, result_count: BIGINT, memory_bytes: BIGINT,
cpu_pct: DOUBLE, rss_bytes: BIGINT, io_read_bytes: BIGINT, io_write_bytes: BIGINT, queue_depth: BIGINT>"""
SEARCH = ["event_id", "project_key", "instance_id", "correlation_id", "query_hash", "query_class", "phase", "latency_us", "result_count", "memory_bytes"]
RESOURCE = ["project_key", "instance_id", "cpu_pct", "rss_bytes", "io_read_bytes", "io_write_bytes", "queue_depth"]

# Kinds of frames of a result stream, in the order they may appear.
FRAME_KINDS = ["started", "progress", "result", "explain", "warning", "terminal"]


def envelopes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed envelopes with their time; lines that are no envelope have a null kind."""
    e = F.from_json(F.col(column), ENVELOPE)
    return lines.select(e.alias("e")).select("e.*", F.unix_millis(F.try_to_timestamp("e.ts")).alias("ts_ms"))


def search_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'search'").select(*[F.col(f"event.{c}").alias(c) for c in SEARCH], "ts_ms")


def resource_samples(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'resource'").select(*[F.col(f"event.{c}").alias(c) for c in RESOURCE], "ts_ms")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return envelopes(spark.read.text(path))


# -- stream frames ------------------------------------------------------------------


def encode_frames(rows: DataFrame, stream_id: str, order: str = "rank") -> DataFrame:
    """(value): one JSON line for each row as a result frame, numbered by ``order``, which starts at 0."""
    payload = F.struct(*[c for c in rows.columns])
    return rows.select(F.to_json(F.struct(F.lit(stream_id).alias("stream_id"), (F.col(order) + 1).alias("seq"), F.lit("result").alias("kind"), payload.alias("payload"))).alias("value"))


def frame(stream_id: str, seq: int, kind: str, payload: dict | None = None) -> str:
    if kind not in FRAME_KINDS:
        raise ValueError(f"no such frame: {kind}")
    return json.dumps({"stream_id": stream_id, "seq": seq, "kind": kind, "payload": payload or {}}, ensure_ascii=False)


def decode_frame(line: str) -> dict:
    f = json.loads(line)
    if f.get("kind") not in FRAME_KINDS or not isinstance(f.get("seq"), int):
        raise ValueError("not a frame")
    return f


def validate_frames(lines: Iterable[str]) -> list[str]:
    """What is wrong with a stream: it begins with started, ends with one terminal, and numbers rise by one."""
    frames, wrong = [decode_frame(x) for x in lines], []
    if not frames or frames[0]["kind"] != "started":
        wrong.append("no start")
    if not frames or frames[-1]["kind"] != "terminal" or sum(f["kind"] == "terminal" for f in frames) != 1:
        wrong.append("not one terminal frame at the end")
    if any(b["seq"] != a["seq"] + 1 for a, b in zip(frames, frames[1:])):
        wrong.append("numbers don't rise by one")
    return wrong


# -- output ---------------------------------------------------------------------------


def _toon_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    s = str(v)
    return json.dumps(s, ensure_ascii=False) if s == "" or any(c in s for c in ',:"\n\t') or s != s.strip() or s in ("null", "true", "false") else s


def toon(name: str, rows: list[dict]) -> str:
    """A table in token-oriented notation: a header with count and columns, then a line a row."""
    columns = list(rows[0]) if rows else []
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *["  " + ",".join(_toon_value(r[c]) for c in columns) for r in rows]])


def write(rows: DataFrame, path: str, form: str = "jsonl") -> None:
    """Writes a result as jsonl, json, csv, table (parquet) or toon."""
    if form in ("jsonl", "json"):
        rows.write.json(path)
    elif form == "csv":
        rows.write.option("header", True).csv(path)
    elif form == "table":
        rows.write.parquet(path)
    elif form == "toon":
        columns = rows.columns
        quoted = F.udf(lambda *v: "  " + ",".join(_toon_value(x) for x in v))  # a page of results
        rows.select(quoted(*columns).alias("value")).write.text(path)
    else:
        raise ValueError(f"no such format: {form}")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a folder with path, size, time and content, for classification."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)
