"""A keyed table kept current from a change feed: bucketed copy-on-write.

Layout of a table's folder::

    manifests/00000001.json     {"buckets": 64, "schema": ..., "parts": {"17": "data/<run>/merged/bucket=17", ...}, "rows": {"17": 90210, ...}}
    data/<run>/merged/bucket=17/*.parquet

A key's bucket is a hash of the key. ``apply`` reduces a batch of changes to the
winning change of each key (with map-side combine, so a hot key costs one row per
task), reads only the buckets those keys fall in, sort-merges them with the base,
writes replacement files under a new run folder and commits a new manifest in
one step. Files are never changed in place: readers of an older manifest go on
undisturbed, a failed run leaves files no manifest names, and a repeated batch
leads to the same state. ``vacuum`` deletes what no kept manifest names.

The number of buckets follows the number of keys: it is chosen so that a bucket holds some
``BUCKET_ROWS``, and when buckets have grown to four times that, the next batch
rewrites the base with more of them, so that a key is moved a bounded number of
times for each doubling of the table.

The base keeps the winning change of *every* key it ever saw, deletes included,
since a late change with a lower revision must not revive a deleted key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import BLANKS
from sightline.sources import files

#: Keys a bucket should hold, and the least number of buckets.
BUCKET_ROWS, FEWEST = 4_000_000, 8
#: How long files that no manifest names may belong to a run under way.
GRACE_MS = 86_400_000


def winning_changes(changes: DataFrame, key: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key: the change with the greatest ``order`` columns; ties fall to the greatest payload.

    Nulls in ``order`` or ``payload`` rank below every value. Columns: key, order, payload.
    """
    names = [*order, *payload]
    won = changes.groupBy(key).agg(F.max(F.struct(*names)).alias("_won"))
    return won.select(key, *[F.col(f"_won.{n}").alias(n) for n in names])


class BucketedTable:
    """The table in ``path``; ``buckets`` fixes their number when it is created, None lets it follow the size."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str,
        order: Sequence[str],
        payload: Sequence[str],
        buckets: int | None = None,
    ):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.order, self.payload, self.fixed = list(order), list(payload), buckets

    # manifests -----------------------------------------------------------------
    def versions(self) -> list[int]:
        names = files.list_names(self.spark, f"{self.path}/manifests")
        return [int(n[:-5]) for n in names if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of ``version``, or the newest one; None for a table without any."""
        at = version if version is not None else max(self.versions(), default=None)
        if at is None:
            return None
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{at:08d}.json"))

    def _commit(self, base: int, manifest: dict) -> int:
        if not files.write_new(self.spark, f"{self.path}/manifests/{base + 1:08d}.json", json.dumps(manifest)):
            raise RuntimeError(f"another writer committed version {base + 1} of {self.path}")
        return base + 1

    def vacuum(self, keep: int = 1, grace_ms: int = GRACE_MS) -> list[str]:
        """Deletes all but the newest ``keep`` manifests and the runs none of those names; returns the runs.

        Runs that no manifest ever named may still be at work and are left for ``grace_ms``.
        """
        versions = sorted(self.versions())
        kept, old = versions[-max(1, keep) :], versions[: -max(1, keep)]
        named = {v: {p.split("/")[1] for p in self.manifest(v)["parts"].values()} for v in versions}
        live, dropped = (set().union(*[named[v] for v in some]) for some in (kept, old))
        for v in old:
            files.delete(self.spark, f"{self.path}/manifests/{v:08d}.json")
        before = time.time() * 1000 - grace_ms
        gone = [r for r, at in files.modified(self.spark, f"{self.path}/data").items() if r not in live and (r in dropped or at < before)]
        for run in gone:
            files.delete(self.spark, f"{self.path}/data/{run}")
        return gone

    # reading -------------------------------------------------------------------
    def _read(self, folders: Sequence[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def state(self, version: int | None = None) -> DataFrame | None:
        """Winning change of every key, deletes included; None for a table that never had a change."""
        m = self.manifest(version)
        return self._read(list(m["parts"].values()), m["schema"]) if m and m["parts"] else None

    # writing -------------------------------------------------------------------
    def _buckets(self, held: int, rows: int) -> int:
        """Number of buckets for ``rows`` keys, where ``held`` (0: none) are there."""
        if self.fixed or (held and rows <= 4 * BUCKET_ROWS * held):
            return held or self.fixed
        return max(FEWEST, 1 << (max(1, -(-rows // BUCKET_ROWS)) - 1).bit_length())

    def apply(self, changes: DataFrame) -> int:
        """Apply a batch in any order, with any repeats; returns the committed version."""
        version = max(self.versions(), default=0)
        m = self.manifest() or {"buckets": 0, "parts": {}, "rows": {}}
        parts, held = dict(m["parts"]), dict(m["rows"])
        run = f"data/{uuid.uuid4().hex}"
        winning_changes(changes, self.key, self.order, self.payload).write.parquet(f"{self.path}/{run}/batch")
        new = self.spark.read.parquet(f"{self.path}/{run}/batch")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        buckets = self._buckets(m["buckets"], sum(held.values()) + new.count())
        if buckets != m["buckets"]:
            touched = list(parts)  # every bucket is written anew
        else:
            # as many rows as there are buckets at most
            touched = [str(r.bucket) for r in new.select(self._bucket(buckets)).distinct().collect()]
        old = [parts[b] for b in touched if b in parts]
        if old:
            new = self._merge(self._read(old, m["schema"]), new, buckets)
        else:
            new = new.withColumn("bucket", self._bucket(buckets))
        # one writer per bucket; keys are unique by now, so buckets are even
        new.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/{run}/merged")
        for b in touched:
            parts.pop(b, None), held.pop(b, None)
        written = [n.removeprefix("bucket=") for n in files.list_names(self.spark, f"{self.path}/{run}/merged") if n.startswith("bucket=")]
        parts |= {b: f"{run}/merged/bucket={b}" for b in written}
        if written:
            sizes = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{run}/merged").groupBy("bucket").count().collect()
            held |= {str(r.bucket): r["count"] for r in sizes}
        files.delete(self.spark, f"{self.path}/{run}/batch")
        return self._commit(version, {"buckets": buckets, "schema": schema, "parts": parts, "rows": held})

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int").alias("bucket")

    def _merge(self, base: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
        """Sort-merge of the touched buckets: per key the greater of base and batch."""
        names = [*self.order, *self.payload]
        left = base.select(self._bucket(buckets), self.key, F.struct(*names).alias("_base"))
        right = new.select(self._bucket(buckets), self.key, F.struct(*names).alias("_new"))
        both = left.hint("merge").join(right, ["bucket", self.key], "full_outer")
        won = both.withColumn("_won", F.greatest("_base", "_new"))  # greatest() skips nulls
        return won.select(self.key, *[F.col(f"_won.{n}").alias(n) for n in names], "bucket")


def catalog_changes(changelog: DataFrame) -> DataFrame:
    """Rows of the file catalog's feed that are changes: ``change_kind`` trimmed and in lower case.

    Rows whose ``file_key``, ``revision`` or ``change_kind`` is null are no changes.
    """
    kind = F.lower(F.trim("change_kind", F.lit(BLANKS)))
    return changelog.select("file_key", "revision", "stream_seq", kind.alias("change_kind")).where(
        "file_key IS NOT NULL AND revision IS NOT NULL AND change_kind IS NOT NULL"
    )


def current_catalog(spark: SparkSession, changelog: DataFrame, path: str, buckets: int | None = None, batches: int = 2) -> DataFrame:
    """Files that exist after the feed is applied to the table in ``path``: (file_key, stream_seq).

    The feed is applied as it comes, in ``batches`` by ranges of ``stream_seq`` (null first),
    each merged with what the table held. The change with the highest revision holds, among equal revisions the one with
    the highest ``stream_seq`` (null lowest); the file exists unless that change is
    a delete. An empty feed gives no rows. Further columns of the feed are ignored.
    """
    catalog = BucketedTable(spark, path, "file_key", ["revision", "stream_seq"], ["change_kind"], buckets)
    low, high = changelog.agg(F.min("stream_seq"), F.max("stream_seq")).first()
    span = 0 if low is None else high - low + 1
    ends = sorted({low + span * (n + 1) // batches - 1 for n in range(batches)}) if span else [0]
    seq, before = F.col("stream_seq"), None
    for end in ends:
        mine = seq.isNull() | (seq <= end) if before is None else (seq > before) & (seq <= end)
        catalog.apply(catalog_changes(changelog.where(mine)))
        before = end
    state = catalog.state()
    if state is None:
        return changelog.limit(0).select("file_key", "stream_seq")
    return state.where("change_kind <> 'delete'").select("file_key", "stream_seq")
