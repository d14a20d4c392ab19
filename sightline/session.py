"""Session helpers: a local session for tests and benches, and the shared folder of a cluster."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "sightline") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    parallel = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: dict[str, str] = {}
_MADE: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="sightline-")) / "sightline.zip"  # the driver's own copy, which Spark serves
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED[app] = str(at)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor sees.

    Only where that setting is unset and all runs in this process (tests) a temporary folder of this machine
    is used, and set, so that ``checkpoint()`` works as well; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = hadoop.get() if hadoop.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        base = os.path.join(tempfile.gettempdir(), "sightline-shared")
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/sightline-{purpose}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_shared(spark: SparkSession, stored: bool = False) -> None:
    """Deletes what this process wrote by ``shared_dir``, and by ``stored_once`` if asked for; results that still read it must be written before."""
    from sightline.sources import files

    while _MADE:
        files.delete(spark, _MADE.pop())
    while stored and _STORED:
        files.delete(spark, _STORED.popitem()[1])


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from the shared folder: computed once, without lineage, safe from lost executors."""
    at = shared_dir(df.sparkSession, purpose)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, purpose: str, of: str, write: Callable[[str], None]) -> str:
    """Folder of what ``write`` made of the tables in ``of``, made at the first call of an application and again if it was deleted."""
    from sightline.sources import files

    key = spark.sparkContext.applicationId, purpose, of
    if key not in _STORED or not files.exists(spark, _STORED[key]):
        at = shared_dir(spark, purpose)
        _MADE.remove(at)  # what is stored outlives the query that made it
        write(at)
        _STORED[key] = at
    return _STORED[key]
