"""Sources, sinks and streaming rules on the test tables."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..session import ensure_checkpoint_dir, table
from ..sources import files as FS
from ..sources import sinks as K
from ..streaming import rules as ST

registry = Registry()
q = registry.query


@q("s5_newest_copy", """
    WITH r AS (SELECT feed_id, file_id, delivered_utc, row_number() OVER (PARTITION BY feed_id ORDER BY delivered_utc DESC, file_id DESC) AS k FROM published_files WHERE file_date < DATE '2026-10-01')
    SELECT feed_id, file_id, delivered_utc FROM r WHERE k = 1""")
def s5(s, d):
    f = table(s, d, "published_files").where("file_date < date'2026-10-01'").select("feed_id", "file_id", "delivered_utc")
    return FS.latest_usable(f, ["feed_id"], "delivered_utc", None, "file_id")


@q("s9_html_tables")
def s9(s, d):
    t = table(s, d, "teams")
    page = t.select("team_code", F.concat(F.lit("<table><thead><tr><th>x</th></tr><tr><th>City</th><th> <b>fpts</b></th></tr></thead><tbody><tr><td>"), F.col("city"), F.lit("</td><td>"), F.col("espn_pro_team_id").cast("string"), F.lit("</td></tr></tbody></table>")).alias("html"))
    return FS.html_tables(page, "team_code", "html", "fpts")


@q("s13_nested_markets", "SELECT event_id, CAST(event_id AS VARCHAR) AS event, 'total' AS market, CASE WHEN k = 0 THEN 'over' ELSE 'under' END AS outcome, value AS line FROM events, (VALUES (0), (1)) v(k) WHERE event_id % 3 <> 0 AND (k = 0 OR event_id % 2 = 0)")
def s13(s, d):
    e = table(s, d, "events")
    side = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"), F.lit("-110").alias("american"), F.lit(1.9).alias("decimal"), F.col("value").alias("handicap"))
    market = F.struct(F.lit("total").alias("name"), F.when(F.col("event_id") % 3 == 0, "S").otherwise("O").alias("status"), F.lit("M").alias("period"), F.array(side("over", F.lit("O")), side("under", F.when(F.col("event_id") % 2 == 0, "O").otherwise("S"))).alias("outcomes"))
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.array(F.struct(F.array(market).alias("markets"))).alias("groups")))
    return FS.flatten_markets(e.select("event_id", body.alias("body")), "event_id", "body").select("event_id", "event", "market", "outcome", "line")


@q("s13_event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def s13b(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@q("s17_time_windows", """
    SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / (7 * 86400)) AS BIGINT) AS w, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29' GROUP BY ALL""")
def s17(s, d):
    w = FS.windows_of(s, "2024-01-01 00:00:00", "2024-01-29 00:00:00", 7)
    e = table(s, d, "events").join(F.broadcast(w), F.expr("ts >= lo and ts < hi"))
    return e.groupBy(F.floor(F.expr("timestampdiff(DAY, timestamp_ntz'2024-01-01', lo)") / 7).alias("w")).agg(F.countDistinct("user_id").alias("users"))


@q("s20_typed_csv", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def s20(s, d):
    path = os.path.join(ensure_checkpoint_dir(s), f"csv-{uuid.uuid4().hex}")
    K.write_csv_view(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return FS.read_csv(s, path, "c_custkey bigint, c_name string, c_acctbal double").withColumn("c_acctbal", F.round("c_acctbal", 2))


@q("s28_columnar_observations", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS row_no, r_name AS name FROM region")
def s28(s, d):
    rows = F.array_sort(F.collect_list(F.array(F.col("r_regionkey").cast("string"), F.col("r_name"))))
    body = table(s, d, "region").agg(F.to_json(F.struct(F.array(F.lit("key"), F.lit("name")).alias("columns"), rows.alias("rows"))).alias("body"))
    return FS.columnar_observations(body, "body").where("column_name = 'name'").select("row_no", F.col("value").alias("name"))


@q("k1_latest_and_history", "SELECT run_date, count(*) AS n FROM rankings WHERE run_date IS NOT NULL GROUP BY run_date")
def k1(s, d):
    root = os.path.join(ensure_checkpoint_dir(s), f"boards-{uuid.uuid4().hex}")
    r = table(s, d, "rankings").where("run_date is not null")
    r.select("board_id", "player_key", "run_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{root}/history")
    return s.read.parquet(f"{root}/history").groupBy("run_date").agg(F.count("*").alias("n"))


@q("k5_flat_view", "SELECT lineup_row_id, coalesce(slot, 'BENCH') AS slot, player FROM lineup_rows UNION ALL SELECT entry_id, 'BENCH', player FROM roster_entries")
def k5(s, d):
    a = table(s, d, "lineup_rows").select("lineup_row_id", "slot", "player")
    b = table(s, d, "roster_entries").select(F.col("entry_id").alias("lineup_row_id"), "player")
    return a.unionByName(b, allowMissingColumns=True).withColumn("slot", F.coalesce("slot", F.lit("BENCH")))


@q("k9_content_addressed", "SELECT count(*) AS stored FROM (SELECT DISTINCT body FROM published_files WHERE body IS NOT NULL)")
def k9(s, d):
    path = os.path.join(ensure_checkpoint_dir(s), f"inputs-{uuid.uuid4().hex}")
    files = table(s, d, "published_files").select("file_id", "body")
    K.archive_inputs(files, path, "body")
    K.archive_inputs(files, path, "body")
    return s.read.parquet(path).agg(F.count("*").alias("stored"))


@q("k11_newest_wins", """
    WITH u AS (SELECT player_key, pool_row_id, estimated_fp FROM slate_pool), r AS (SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY pool_row_id DESC) AS k FROM u)
    SELECT player_key, pool_row_id FROM r WHERE k = 1""")
def k11(s, d):
    p = table(s, d, "slate_pool").select("player_key", "pool_row_id")
    return K.newest_wins(p.where("pool_row_id % 2 = 0"), p.where("pool_row_id % 2 = 1"), ["player_key"], "pool_row_id")


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream: one file of the directory."""
    path = f"{d}/{name}.parquet"
    reader = s.readStream.schema(s.read.parquet(path).schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _run(df: DataFrame, mode: str) -> DataFrame:
    """The stream's rows after all input that is there, from a parquet sink or in memory."""
    s, name = df.sparkSession, f"t{uuid.uuid4().hex}"
    at = os.path.join(ensure_checkpoint_dir(s), name)
    if mode == "append":
        query = df.writeStream.format("parquet").option("checkpointLocation", f"{at}/c").option("path", f"{at}/out").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return s.read.schema(df.schema).parquet(f"{at}/out")
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{at}/c").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.table(name)


@q("r1_late_captures", "SELECT pool_row_id FROM slate_pool WHERE captured_utc < kickoff_utc")
def r1(s, d):
    return _run(ST.before_event(_stream(s, d, "slate_pool").select("pool_row_id", "captured_utc", "kickoff_utc"), "captured_utc", "kickoff_utc").select("pool_row_id"), "append")


@q("r3_week_blocks", """
    SELECT event_type, TIMESTAMP '1970-01-01 08:00:00' + INTERVAL 7 DAY * CAST(floor((epoch_us(ts) - 8 * 3600000000) / (7 * 86400000000)) AS INTEGER) AS block_start, count(*) AS n FROM events GROUP BY ALL""")
def r3(s, d):
    e = _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _run(ST.week_blocks(e, "ts", ["event_type"]), "complete")
    return out.select("event_type", F.col("block.start").cast("timestamp_ntz").alias("block_start"), "n")


@q("r7_once_by_content", "SELECT DISTINCT user_id, event_type FROM events")
def r7(s, d):
    e = _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return _run(ST.once_by_content(e, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append")


@q("r4_locked_rows", """
    SELECT lineup_row_id, CASE WHEN kickoff_utc <= TIMESTAMP '2026-10-15' THEN 'old' ELSE 'new' END AS origin FROM lineup_rows""")
def r4(s, d):
    r = table(s, d, "lineup_rows").select("lineup_row_id", "kickoff_utc")
    now = datetime(2026, 10, 15)
    return ST.keep_locked(r.withColumn("origin", F.lit("old")), r.withColumn("origin", F.lit("new")), ["lineup_row_id"], "kickoff_utc", now).select("lineup_row_id", "origin")
