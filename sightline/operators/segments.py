"""A lexical index that grows by segments.

Layout of an index's folder::

    manifests/00000001.json    {"segments": [{"id": ..., "number": 1, "docs": 900}, ...], "tombstones": [...], "fields": ..., "doc_id": ...}
    segments/<id>/postings, lengths, statistics, terms      as a written index
    tombstones/<id>            (doc_id, before): segments numbered below ``before`` no longer hold the document

A batch of documents becomes a segment of its own; documents it repeats, and deleted ones, are marked in a tombstone
table, so nothing is written anew. ``merge`` joins segments of one size class once there are enough of them, and
leaves out what is dead; so a posting is rewritten once for each size class it passes through.
A commit publishes one manifest in one step: readers see all of it or nothing, a failed run leaves files
no manifest names, and of two writers one is refused.

Statistics count dead documents until a merge drops them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.lexical import LexicalIndex, build_index
from sightline.sources import files


class SegmentedIndex:
    """The index in ``path``; ``fields`` and ``doc_id`` are fixed by the first commit."""

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, str] | None = None, doc_id: str = "doc_id"):
        self.spark, self.path = spark, path.rstrip("/")
        m = self.manifest()
        self.fields, self.doc_id = (m["fields"], m["doc_id"]) if m else (dict(fields or {"content": "text"}), doc_id)
        if m and fields and dict(fields) != m["fields"]:
            raise ValueError(f"the index has the fields {m['fields']}")

    # manifests -----------------------------------------------------------------
    def version(self) -> int:
        return max((int(n[:-5]) for n in files.list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict | None:
        at = self.version() if version is None else version
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{at:08d}.json")) if at else None

    def _state(self) -> tuple[int, dict]:
        return self.version(), self.manifest() or {"segments": [], "tombstones": [], "next": 1}

    def _commit(self, base: int, state: dict) -> int:
        text = json.dumps(state | {"fields": self.fields, "doc_id": self.doc_id})
        if not files.write_new(self.spark, f"{self.path}/manifests/{base + 1:08d}.json", text):
            raise RuntimeError(f"another writer committed version {base + 1} of {self.path}")
        return base + 1

    # writing -------------------------------------------------------------------
    def _bury(self, ids: DataFrame, before: int) -> str:
        """Marks documents (as strings) as dead in segments below ``before``."""
        name = uuid.uuid4().hex
        ids.where("doc_id IS NOT NULL").distinct().select("doc_id", F.lit(before).alias("before")).write.parquet(f"{self.path}/tombstones/{name}")
        return name

    def _segment(self, index: LexicalIndex, number: int) -> dict:
        name = uuid.uuid4().hex
        index.write(f"{self.path}/segments/{name}")
        docs = self.spark.read.parquet(f"{self.path}/segments/{name}/lengths").select("doc_id").distinct().count()
        return {"id": name, "number": number, "docs": docs}

    def add(self, documents: DataFrame) -> int:
        """Adds a batch; documents that are there already are replaced. Returns the committed version.

        Ids must be unique within a batch; null ids are left out.
        """
        base, state = self._state()
        number = state["next"]
        segment = self._segment(build_index(documents, self.doc_id, self.fields, once=True), number)
        graves = [self._bury(documents.select(F.col(self.doc_id).cast("string").alias("doc_id")), number)] if state["segments"] else []
        return self._commit(base, {"segments": [*state["segments"], segment], "tombstones": [*state["tombstones"], *graves], "next": number + 1})

    def delete(self, ids: DataFrame) -> int:
        """Deletes documents by id; unknown ids change nothing. Returns the committed version."""
        base, state = self._state()
        grave = self._bury(ids.select(F.col(self.doc_id).cast("string").alias("doc_id")), state["next"])
        return self._commit(base, {"segments": state["segments"], "tombstones": [*state["tombstones"], grave], "next": state["next"]})

    # reading -------------------------------------------------------------------
    def _dead(self, state: dict) -> DataFrame | None:
        if not state["tombstones"]:
            return None
        marks = self.spark.read.schema("doc_id string, before int").parquet(*[f"{self.path}/tombstones/{t}" for t in state["tombstones"]])
        return marks.groupBy("doc_id").agg(F.max("before").alias("before"))

    def _read(self, state: dict, segments: list[dict], drop_dead: bool) -> LexicalIndex:
        parts = [LexicalIndex.read(self.spark, f"{self.path}/segments/{s['id']}") for s in segments]
        dead = self._dead(state)

        def union(name: str) -> DataFrame:
            return reduce(DataFrame.unionByName, [getattr(p, name).withColumn("segment", F.lit(s["number"])) for p, s in zip(parts, segments)])

        def living(rows: DataFrame) -> DataFrame:
            if dead is None:
                return rows.drop("segment")
            marked = rows.join(dead.withColumnRenamed("doc_id", "_dead"), (F.col("doc_id") == F.col("_dead")) & (F.col("segment") < F.col("before")), "left_anti")
            return marked.drop("segment")

        postings, lengths = living(union("postings")), living(union("lengths"))
        if drop_dead:
            statistics = lengths.groupBy("field").agg(F.count("*").alias("docs"), F.sum("length").alias("total"))
            return LexicalIndex(postings, lengths, statistics)
        statistics = union("statistics").groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
        terms = union("terms").groupBy("field", "term").agg(F.sum("df").alias("df"))
        return LexicalIndex(postings, lengths, statistics, terms=terms)

    def open(self, version: int | None = None) -> LexicalIndex | None:
        """The index as of a version, the newest if None; None if nothing was added yet."""
        state = self.manifest(version)
        return self._read(state, state["segments"], False) if state and state["segments"] else None

    # maintenance ---------------------------------------------------------------
    def due(self, fan_out: int = 8, dead_share: float = 0.2) -> list[dict]:
        """The segments to merge next: of the least size class with ``fan_out`` of them, else all if their dead documents make up ``dead_share``."""
        state = self.manifest()
        if not state or not state["segments"]:
            return []
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(int(math.log(max(1, s["docs"]), fan_out) + 1e-9), []).append(s)
        full = [t for t in sorted(tiers) if len(tiers[t]) >= fan_out]
        if full:
            return tiers[full[0]]
        held = sum(s["docs"] for s in state["segments"])
        live = self._read(state, state["segments"], False).lengths.select("doc_id").distinct().count() if state["tombstones"] else held
        return state["segments"] if held - live >= dead_share * held > 0 else []

    def merge(self, segments: list[dict]) -> int:
        """Makes one segment of some, without what is dead in them; returns the committed version.

        The merged segment takes the greatest of their numbers. So only neighbours are merged:
        segments between them join in, or a document could come back to life.
        """
        base, state = self._state()
        low, high = min(s["number"] for s in segments), max(s["number"] for s in segments)
        inside = [s for s in state["segments"] if low <= s["number"] <= high]
        merged = self._segment(self._read(state, inside, True), high)
        kept = [s for s in state["segments"] if s not in inside]
        return self._commit(base, {"segments": sorted([*kept, merged], key=lambda s: s["number"]), "tombstones": state["tombstones"] if kept else [], "next": state["next"]})
