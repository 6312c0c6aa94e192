"""Queries of the general training-data problems: drifting schemas and full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema_drift import consistent_rows, consistent_table, schema_changes
from ..operators.snapshots import snapshot_changes, two_decimals
from ..registry import Registry
from ..session import table

registry = Registry()


@registry.query(
    "p5_found",
    """
    WITH r AS (
      SELECT board_id, snapshot_no, player_key, min(run_date) AS run_date, min(pos_rank) AS pos_rank,
             min(CASE WHEN isnan(estimated_fp) THEN -999999 ELSE round(estimated_fp, 2) END) AS fp, min(depth_rank) AS depth_rank
      FROM rankings WHERE board_id IS NOT NULL AND snapshot_no IS NOT NULL AND run_date IS NOT NULL AND player_key IS NOT NULL
      GROUP BY ALL),
    s AS (SELECT board_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY board_id ORDER BY d, snapshot_no) AS prev_no
          FROM (SELECT board_id, snapshot_no, min(run_date) AS d FROM r GROUP BY ALL)),
    cur AS (SELECT r.*, s.prev_no FROM r JOIN s USING (board_id, snapshot_no) WHERE s.prev_no IS NOT NULL),
    prev AS (SELECT r.board_id, s.snapshot_no, r.player_key, r.pos_rank, r.fp, r.depth_rank
             FROM r JOIN s ON r.board_id = s.board_id AND r.snapshot_no = s.prev_no)
    SELECT coalesce(c.board_id, p.board_id) AS board_id, coalesce(c.snapshot_no, p.snapshot_no) AS snapshot_no,
           coalesce(c.player_key, p.player_key) AS player_key,
           CASE WHEN p.player_key IS NULL THEN 'added' WHEN c.player_key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
    FROM cur c FULL JOIN prev p ON c.board_id = p.board_id AND c.snapshot_no = p.snapshot_no AND c.player_key = p.player_key
    WHERE p.player_key IS NULL OR c.player_key IS NULL OR c.pos_rank IS DISTINCT FROM p.pos_rank
       OR c.fp IS DISTINCT FROM p.fp OR c.depth_rank IS DISTINCT FROM p.depth_rank
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players added, removed or changed in rank, estimate or depth between snapshots of a board."""
    return snapshot_changes(
        table(spark, sf_dir, "rankings"),
        "board_id",
        "snapshot_no",
        "run_date",
        "player_key",
        [F.col("pos_rank"), two_decimals(F.col("estimated_fp")), F.col("depth_rank")],
    )


@registry.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields added, removed, renamed and retyped between the files of a feed."""
    files = table(spark, sf_dir, "published_files").select("file_id", "feed_id", "file_date", "body_format", "body")
    return schema_changes(files).select("file_id", "change_kind", "field_name", "new_name")


@registry.query("p4_consistent_rows")
def p4_consistent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all files in one table, every value under its field's lasting name."""
    files = table(spark, sf_dir, "published_files").select("file_id", "feed_id", "file_date", "body_format", "body")
    rows = consistent_rows(files)
    return rows.select("file_id", "row_no", F.explode("fields").alias("field_name", "field_value"))


@registry.query("p4_consistent_table")
def p4_consistent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all files in one wide table, a typed column for each lasting field."""
    files = table(spark, sf_dir, "published_files").select("file_id", "feed_id", "file_date", "body_format", "body")
    return consistent_table(files)
