"""Queries over the catalog's change feed, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.operators.changefeed import current_catalog
from sightline.operators.incremental import pending_records
from sightline.session import shared_dir
from sightline.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog after its whole feed."""
    return current_catalog(spark, table(spark, folder, "fsfs_catalog_changelog"), shared_dir(spark, "catalog"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """What each consumer still has to apply."""
    return pending_records(spark, table(spark, folder, "fsfs_catalog_changelog"), table(spark, folder, "fsfs_catalog_replay_checkpoint"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found}

ORACLE = {
    "p2_found": """
        WITH changes AS (
            SELECT DISTINCT file_key, revision, stream_seq, lower(trim(change_kind, ' ' || chr(9) || chr(10) || chr(13))) AS kind
            FROM fsfs_catalog_changelog
            WHERE file_key IS NOT NULL AND revision IS NOT NULL AND change_kind IS NOT NULL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY revision DESC, stream_seq DESC NULLS LAST, kind DESC) AS place
            FROM changes
        )
        SELECT file_key, stream_seq FROM ranked WHERE place = 1 AND kind <> 'delete'""",
    "p3_found": """
        WITH runs AS (
            SELECT lower(trim(consumer_id, ' ' || chr(9) || chr(10) || chr(13))) AS consumer_id,
                   CASE WHEN run_state = 'committed' AND last_applied_seq IS NOT NULL THEN 1 ELSE 0 END AS good,
                   last_applied_seq, updated_ts
            FROM fsfs_catalog_replay_checkpoint WHERE consumer_id IS NOT NULL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY good DESC, updated_ts DESC NULLS LAST, last_applied_seq DESC) AS place
            FROM runs
        ), consumers AS (
            SELECT consumer_id, CASE WHEN good = 1 THEN last_applied_seq END AS position FROM ranked WHERE place = 1
        )
        SELECT DISTINCT c.consumer_id, l.stream_seq
        FROM consumers c JOIN fsfs_catalog_changelog l ON c.position IS NULL OR l.stream_seq > c.position
        WHERE l.stream_seq IS NOT NULL""",
}
