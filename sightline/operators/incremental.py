"""Only new or changed records, by comparing Merkle trees over key ranges.

A tree has leaves of ``width`` consecutive keys; a leaf's digest is made of the
hashes of its records, an inner node's of its ``fanout`` children. Two trees are
compared from the root: only children of nodes whose digests differ are looked at.

Digests are sums of hashes, so every level is one aggregate with map-side combine: a
run reads and hashes its input once and shuffles a row a leaf and task. What it
reads again, compares record by record and writes anew are the leaves that differ and their groups.

Levels are tables ``(node, digest)``; level 0 are the leaves. Only the number of
levels, and the bounds of what changed, are known to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import BLANKS
from sightline.session import shared_dir
from sightline.sources import files

WIDTH = 1024
FANOUT = 16


def node_of(key: Column | str, level: int, width: int = WIDTH, fanout: int = FANOUT) -> Column:
    """Number of the node of ``level`` whose key range holds ``key``; rounds down below zero too."""
    key = F.col(key) if isinstance(key, str) else key
    return _floor_div(key, width * fanout**level)


def _floor_div(of: Column, by: int) -> Column:
    """Integral division that rounds down; exact for all bigints."""
    return F.call_function("div", of - F.pmod(of, F.lit(by).cast("bigint")), F.lit(by).cast("bigint"))


def _parent(node: str, fanout: int) -> Column:
    return _floor_div(F.col(node), fanout)


def _digest(*of: str) -> list[Column]:
    """Order-free digest of rows: two independent hashes, summed by halves (which cannot overflow), and their number."""
    halves = []
    for name, h in (("a", F.xxhash64(*of)), ("b", F.xxhash64(F.lit(0x9E3779B9), *of))):
        halves += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}0"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}1")]
    return [F.struct(*halves, F.count("*").alias("n")).alias("digest")]


def leaves(records: DataFrame, key: str, row_hash: str, width: int = WIDTH) -> DataFrame:
    """Level 0 over records ``(key, row_hash)``."""
    return records.groupBy(node_of(key, 0, width).alias("node")).agg(*_digest(key, row_hash))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above."""
    return level.groupBy(_parent("node", fanout).alias("node")).agg(*_digest("node", "digest"))


def height(records: DataFrame, key: str, width: int = WIDTH, fanout: int = FANOUT) -> tuple[int, list[int]]:
    """Number of levels above the leaves until at most ``fanout`` nodes are left, and the nodes above those."""
    low, high = records.agg(F.min(key), F.max(key)).first()
    return (0, []) if low is None else _height(low // width, high // width, fanout)


def _height(low: int, high: int, fanout: int) -> tuple[int, list[int]]:
    levels = 0
    while high - low >= fanout:
        levels, low, high = levels + 1, low // fanout, high // fanout
    return levels, list(range(low // fanout, high // fanout + 1))


def tree(records: DataFrame, key: str, row_hash: str, levels: int, width: int = WIDTH, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels, leaves first."""
    out = [leaves(records, key, row_hash, width)]
    for _ in range(levels):
        out.append(parents(out[-1], fanout))
    return out


def descend(current: Sequence[DataFrame], saved: Sequence[DataFrame], on: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """Leaves whose digests differ: (on..., node).

    ``saved`` may hold a tree for each value of the ``on`` columns; ``current`` is
    then given per value of them as well. Nodes missing on one side differ.
    """
    keys = [*on, "node"]
    differ = None
    for now, then in zip(reversed(current), reversed(saved), strict=True):
        if differ is not None:
            near = [*on, "_parent"]
            above = differ.withColumnRenamed("node", "_parent")
            now = now.withColumn("_parent", _parent("node", fanout)).join(above, near, "left_semi").drop("_parent")
            then = then.withColumn("_parent", _parent("node", fanout)).join(above, near, "left_semi").drop("_parent")
        both = now.select(*keys, F.col("digest").alias("_now")).join(then.select(*keys, F.col("digest").alias("_then")), keys, "full_outer")
        differ = both.where(~F.col("_now").eqNullSafe(F.col("_then"))).select(*keys)
    return differ


# -- a consumer that keeps its own tree -------------------------------------------


class IncrementalRun:
    """Runs over a table whose records have an integer key, each run over what is new or changed.

    Folder: ``runs/<n>.json`` names a run's tree, the table of which run holds the record
    digests of each group of leaves, and the run's output. The file is written last and in
    one step: output and tree become visible together or not at all, so a run that
    fails is repeated in full and one that succeeded is never repeated. Record digests
    of groups without a change stay in the run that wrote them; after ``RUNS_MOST`` such runs
    all are written anew.
    """

    RUNS_MOST = 32

    def __init__(self, spark: SparkSession, path: str, key: str, width: int = WIDTH, fanout: int = FANOUT):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.width, self.fanout = width, fanout

    def _last(self) -> tuple[int, dict | None]:
        names = [n for n in files.list_names(self.spark, f"{self.path}/runs") if n.endswith(".json")]
        if not names:
            return 0, None
        return int(names[-1][:-5]), json.loads(files.read_text(self.spark, f"{self.path}/runs/{names[-1]}"))

    def _kept(self, df: DataFrame, name: str, run: str) -> DataFrame:
        df.write.parquet(f"{self.path}/data/{run}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{run}/{name}")

    def _group(self, node: Column | str) -> Column:
        """Group of a leaf: its ancestor on level 2."""
        return _floor_div(F.col(node) if isinstance(node, str) else node, self.fanout**2)

    def _records(self, runs: Sequence[str]) -> DataFrame:
        """Record digests of some runs: (_key, _row, run, _group)."""
        read = self.spark.read.schema("_key bigint, _row bigint, run string, _group bigint").option("basePath", f"{self.path}/records")
        return read.parquet(*[f"{self.path}/records/run={r}" for r in runs])

    def run(self, df: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Give ``process`` the new or changed rows of ``df``, publish its result and the tree; returns the result.

        Repeated rows count once; rows with a null key have no place in the key
        order and are left out. Records that vanished give no rows.
        """
        number, last = self._last()
        run = uuid.uuid4().hex
        columns = [F.col(f"`{c}`") for c in df.columns]
        row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        key = F.col(f"`{self.key}`").cast("bigint")
        hashed = df.where(key.isNotNull()).select(key.alias("_key"), row.alias("_row"), node_of(key, 0, self.width).alias("node"), F.struct(*columns).alias("_all"))

        new = [self._kept(hashed.groupBy("node").agg(*_digest("_key", "_row")), "level=0", run)]
        low, high = new[0].agg(F.min("node"), F.max("node")).first()
        levels = max(2, 0 if low is None else _height(low, high, self.fanout)[0], len(last["levels"]) - 1 if last else 0)
        while len(new) <= levels:
            new.append(self._kept(parents(new[-1], self.fanout), f"level={len(new)}", run))
        old = [self.spark.read.schema(new[0].schema).parquet(f"{self.path}/data/{x}") for x in (last["levels"] if last else [])]
        while len(old) <= levels:
            old.append(parents(old[-1], self.fanout) if old else new[0].limit(0))
        changed = self._kept(descend(new, old, (), self.fanout), "changed", run)
        groups = changed.select(self._group("node").alias("_group")).distinct()

        # the scan below is bounded by the keys of what changed, the joins pick it out
        first, final = changed.agg(F.min("node"), F.max("node")).first()
        reach = key.between(first * self.width, (final + 1) * self.width - 1) if first is not None else F.lit(False)
        todo = hashed.where(reach).join(changed, "node", "left_semi").distinct()
        owner = self.spark.read.schema("_group bigint, run string").parquet(f"{self.path}/data/{last['groups']}") if last else None
        if last and last["runs"]:
            known = self._records(last["runs"]).join(owner.join(groups, "_group", "left_semi"), ["_group", "run"], "left_semi")
            todo = todo.join(known.select("_key", "_row"), ["_key", "_row"], "left_anti")
        out = process(todo.select("_all.*"))
        out.write.parquet(f"{self.path}/data/{run}/output")

        # record digests of the groups that changed, or of all
        whole = not last or len(last["runs"]) >= self.RUNS_MOST
        held = hashed.select("_key", "_row", self._group("node").alias("_group"))
        present = new[2].select(F.col("node").alias("_group"), F.lit(run).alias("run"))
        if not whole:
            span = self.width * self.fanout**2
            a, b = (0, -1) if first is None else (first // self.fanout**2 * span, (final // self.fanout**2 + 1) * span - 1)
            held = held.where(F.col("_key").between(a, b)).join(groups, "_group", "left_semi")
            present = present.join(groups, "_group", "left_semi").unionByName(owner.join(groups, "_group", "left_anti"))
        held.distinct().repartition("_group").write.partitionBy("_group").parquet(f"{self.path}/records/run={run}")
        self._kept(present, "groups", run)
        runs = sorted(r.run for r in self.spark.read.schema("_group bigint, run string").parquet(f"{self.path}/data/{run}/groups").select("run").distinct().collect())
        text = json.dumps({"levels": [f"{run}/level={k}" for k in range(levels + 1)], "groups": f"{run}/groups", "runs": runs, "output": f"{run}/output"})
        if not files.write_new(self.spark, f"{self.path}/runs/{number + 1:08d}.json", text):
            raise RuntimeError(f"another run {number + 1} was published in {self.path}")
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/data/{run}/output")


# -- consumers known by their checkpoint only --------------------------------------


def committed_positions(checkpoints: DataFrame) -> DataFrame:
    """(consumer_id, position) of each consumer, by its last successful run; null without one.

    ``consumer_id`` is trimmed and in lower case, null ids are no consumer. The last
    successful run is the committed row with a position and the greatest
    ``updated_ts`` (null lowest; ties fall to the greatest position).
    """
    done = F.when((F.col("run_state") == "committed") & F.col("last_applied_seq").isNotNull(), F.struct("updated_ts", "last_applied_seq"))
    per = checkpoints.groupBy(F.lower(F.trim("consumer_id", F.lit(BLANKS))).alias("consumer_id")).agg(F.max(done).alias("_run"))
    return per.where(F.col("consumer_id").isNotNull()).select("consumer_id", F.col("_run.last_applied_seq").alias("position"))


def pending_records(spark: SparkSession, changelog: DataFrame, checkpoints: DataFrame, seq: str = "stream_seq", width: int = WIDTH, fanout: int = FANOUT, path: str | None = None) -> DataFrame:
    """(consumer_id, seq) of the records each consumer has not applied yet.

    The consumers' trees are saved in ``path`` (a new shared folder if None): the tree over what all of them can have
    applied, which they share, and of each the nodes on the path to its position, down to the
    records of the leaf the position lies in. They are restored from the log of checkpoints,
    which alone says what was applied. The current tree is then compared with
    every saved one at once, from the root: a consumer's children of a node that differs are
    looked up, in the shared tree before its path and on its path, and those without an equal digest go on.
    Of the leaves that differ come out the records that the saved leaf lacks.

    Output and current tree are published together by ``runs/<n>.json``, in one step; a run that fails
    before leaves nothing behind that is read, and a run repeated with the same checkpoints
    gives the same records. Repeated rows count once, null keys never come
    out, and an empty feed or log gives no rows.
    """
    at = path.rstrip("/") if path else shared_dir(spark, "pending")
    run = f"{at}/data/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{run}/{name}")
        return spark.read.schema(df.schema).parquet(f"{run}/{name}")

    keys = kept(changelog.where(F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("_key")).distinct().withColumn("_row", F.xxhash64("_key")), "keys")
    consumers = kept(committed_positions(checkpoints), "consumers")
    levels, tops = height(keys, "_key", width, fanout)
    now = [kept(leaves(keys, "_key", "_row", width), "tree/level=0")]
    for _ in range(levels):
        now.append(parents(now[-1], fanout))

    # saved trees: what is shared, and each consumer's leaf at its position
    farthest = consumers.agg(F.max("position")).first()[0]
    applied = keys.where(F.col("_key") <= F.lit(farthest)) if farthest is not None else keys.limit(0)
    shared = [kept(leaves(applied, "_key", "_row", width), "saved/level=0")]
    edge = consumers.where("position IS NOT NULL").withColumn("node", node_of("position", 0, width))
    last = applied.withColumn("node", node_of("_key", 0, width)).join(edge, "node").where("_key <= position")
    last = kept(last.select("consumer_id", "node", "_key", "_row"), "saved/records")
    paths = [last.groupBy("consumer_id", "node").agg(*_digest("_key", "_row"))]
    for k in range(levels):
        shared.append(parents(shared[-1], fanout))
        above = edge.select("consumer_id", node_of("position", k, width, fanout).alias("_own"), node_of("position", k + 1, width, fanout).alias("_up"))
        before = shared[k].withColumn("_up", _parent("node", fanout)).join(above, "_up").where("node < _own")
        below = before.select("consumer_id", "node", "digest").unionByName(paths[-1])
        paths.append(below.groupBy("consumer_id", _parent("node", fanout).alias("node")).agg(*_digest("node", "digest")))

    # every consumer starts at the one or two nodes above the top level
    differ = consumers.withColumn("node", F.explode(F.array(*[F.lit(t).cast("bigint") for t in tops]) if tops else F.expr("array(cast(null as bigint))")))
    for k in range(levels, -1, -1):
        above = differ.select(F.col("node").alias("_parent"), "consumer_id", "position")
        node = now[k].withColumn("_parent", _parent("node", fanout)).join(above, "_parent").drop("_parent")
        node = node.join(shared[k].select("node", F.col("digest").alias("_shared")), "node", "left")
        node = node.join(paths[k].select("consumer_id", "node", F.col("digest").alias("_path")), ["consumer_id", "node"], "left")
        own = node_of("position", k, width, fanout)
        saved = F.when(F.col("node") < own, F.col("_shared")).when(F.col("node") == own, F.col("_path"))
        differ = node.where(~F.col("digest").eqNullSafe(saved)).select("consumer_id", "position", "node")
    found = keys.withColumn("node", node_of("_key", 0, width)).join(differ, "node").join(last, ["consumer_id", "_key", "_row"], "left_anti")
    out = kept(found.select("consumer_id", F.col("_key").alias(seq)), "output")
    number = len(files.list_names(spark, f"{at}/runs")) + 1
    if not files.write_new(spark, f"{at}/runs/{number:08d}.json", json.dumps({"output": f"{run}/output", "tree": f"{run}/tree/level=0", "consumers": f"{run}/consumers"})):
        raise RuntimeError(f"another run {number} was published in {at}")
    return out
