"""Generations of an index: activation, rollback, time travel and retention.

A generation is a folder of tables; ``activations/<n>.json`` files say which one was
active from when. Each is written under another name and renamed, so readers see an
activation whole or not at all, and two writers cannot take the same number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from sightline.sources import files


class Generations:
    """History of the index in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def history(self) -> list[dict]:
        """Activations, oldest first: number, generation, at_ms."""
        names = files.list_names(self.spark, f"{self.path}/activations")
        return [json.loads(files.read_text(self.spark, f"{self.path}/activations/{n}")) for n in names if n.endswith(".json")]

    def folder(self, generation: str) -> str:
        return f"{self.path}/generations/{generation}"

    def activate(self, generation: str, at_ms: int, tables: list[str] = ()) -> int:
        """Makes a generation current after checking that its tables are there and time goes on."""
        past = self.history()
        if past and at_ms < past[-1]["at_ms"]:
            raise ValueError("time went back")
        missing = [t for t in tables if not files.exists(self.spark, f"{self.folder(generation)}/{t}")]
        if missing or not files.exists(self.spark, self.folder(generation)):
            raise ValueError(f"generation {generation} lacks {missing or 'its folder'}")
        number = past[-1]["number"] + 1 if past else 1
        text = json.dumps({"number": number, "generation": generation, "at_ms": at_ms})
        if not files.write_new(self.spark, f"{self.path}/activations/{number:08d}.json", text):
            raise RuntimeError(f"activation {number} was taken")
        return number

    def current(self) -> str | None:
        past = self.history()
        return past[-1]["generation"] if past else None

    def as_of(self, at_ms: int) -> str | None:
        """The generation that was active at a time."""
        return next((a["generation"] for a in reversed(self.history()) if a["at_ms"] <= at_ms), None)

    def rollback(self, at_ms: int) -> str:
        """Activates the generation before the current one again."""
        seen = [a["generation"] for a in self.history()]
        before = next((g for g in reversed(seen) if g != seen[-1]), None) if seen else None
        if before is None:
            raise ValueError("nothing to go back to")
        self.activate(before, at_ms)
        return before

    def retain(self, keep: int, now_ms: int, keep_ms: int) -> list[str]:
        """Deletes generations beyond the newest ``keep`` that were last active longer ago than ``keep_ms``; never the current one."""
        last = {}
        for a in self.history():
            last[a["generation"]] = a["at_ms"]
        order = sorted(last, key=lambda g: -last[g])
        gone = [g for g in order[keep:] if g != self.current() and now_ms - last[g] > keep_ms]
        for g in gone:
            files.delete(self.spark, self.folder(g))
        return gone

    def table(self, name: str, at_ms: int | None = None) -> DataFrame:
        generation = self.current() if at_ms is None else self.as_of(at_ms)
        if generation is None:
            raise ValueError("no generation is active")
        return self.spark.read.parquet(f"{self.folder(generation)}/{name}")
