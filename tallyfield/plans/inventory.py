"""Remaining data-processing operators of the inventory on the test tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import fits as X
from ..operators import matching as M
from ..operators import models as MO
from ..operators import ranking as R
from ..operators import simulation as S
from ..registry import Registry
from ..session import cut, ensure_checkpoint_dir, table
from ..sources import files as FS
from ..sources import sinks as K
from ..streaming import rules as ST
from .feeds import _run, _stream

registry = Registry()
q = registry.query
CLEAN = "mean_fp is not null and not isnan(mean_fp)"


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineup_rows").where(CLEAN)


@q("s14_relational_payload", """
    SELECT o_orderkey, c_name, n_name, l_linenumber, l_quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def s14(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    x = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select("o_orderkey", "c_name", "n_name", "l_linenumber", "l_quantity")


@q("s24_capture_before_cutoff", """
    WITH r AS (SELECT board_id, run_date, snapshot_no, row_number() OVER (PARTITION BY board_id ORDER BY delivered_utc DESC, snapshot_no DESC) AS k FROM (SELECT DISTINCT board_id, run_date, snapshot_no, delivered_utc FROM rankings) WHERE delivered_utc < TIMESTAMP '2026-10-10 12:00:00')
    SELECT board_id, run_date, snapshot_no FROM r WHERE k = 1""")
def s24(s, d):
    r = table(s, d, "rankings").select("board_id", "run_date", "snapshot_no", "delivered_utc").distinct()
    return FS.latest_usable(r, ["board_id"], "delivered_utc", F.expr("timestamp_ntz'2026-10-10 12:00:00'"), "snapshot_no").select("board_id", "run_date", "snapshot_no")


@q("s25_two_shape_config", "SELECT team_code AS id, CAST(espn_pro_team_id AS DOUBLE) AS value FROM teams")
def s25(s, d):
    t = table(s, d, "teams")
    as_map = t.where("espn_pro_team_id % 2 = 0").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("team_code", F.struct(F.col("espn_pro_team_id").alias("p")))))).alias("b"))
    as_rows = t.where("espn_pro_team_id % 2 = 1").agg(F.to_json(F.collect_list(F.struct(F.col("team_code").alias("id"), F.col("espn_pro_team_id").alias("p")))).alias("b"))
    return FS.two_shapes(as_map.unionByName(as_rows), "b", "map<string,struct<p:double>>", "array<struct<id:string,p:double>>", "id", F.col("row.p"), F.col("v.p"))


@q("k2_history_index", "SELECT day, count(*) AS n FROM lineup_rows, (VALUES ('2026-09-20'), ('2026-10-04')) t(day) GROUP BY day")
def k2(s, d):
    root = os.path.join(ensure_checkpoint_dir(s), f"lineups-{uuid.uuid4().hex}")
    r = table(s, d, "lineup_rows").select("lineup_row_id", "player")
    for day in ("2026-09-20", "2026-10-04", "2026-09-20"):
        K.write_latest_and_history(r, root, day, ["player"])
    return K.history_index(s, root).select(F.col("day").cast("string").alias("day"), "n")


@q("k8_immutable", "SELECT count(*) AS n FROM teams")
def k8(s, d):
    path = os.path.join(ensure_checkpoint_dir(s), f"once-{uuid.uuid4().hex}")
    t = table(s, d, "teams")
    K.write_immutable(t, path, t.columns)
    K.write_immutable(t, path, t.columns)
    return s.read.parquet(path).agg(F.count("*").alias("n"))


@q("f17_json_keys", r"SELECT DISTINCT regexp_replace(lower(trim(role_name || ' / ' || projection_method)), '[^a-z0-9]+', '_', 'g') AS name FROM rankings WHERE role_name IS NOT NULL AND projection_method IS NOT NULL")
def f17(s, d):
    r = table(s, d, "rankings").where("role_name is not null and projection_method is not null")
    return r.select(F.regexp_replace(F.lower(F.trim(F.concat_ws(" / ", "role_name", "projection_method"))), "[^a-z0-9]+", "_").alias("name")).distinct()


@q("f21_completeness", """
    SELECT quote_id, CASE WHEN market_props LIKE '%Ru %' AND market_props LIKE '%Rec %' AND market_props LIKE '%TD %' THEN 'good' WHEN market_props LIKE '%Ru %' OR market_props LIKE '%Rec %' THEN 'fair' WHEN market_props LIKE '%TD %' THEN 'td-only' ELSE 'partial' END AS quality FROM market_quotes""")
def f21(s, d):
    has = lambda w: F.coalesce(F.col("market_props").contains(w), F.lit(False))
    parts = F.array_compact(F.array(F.when(has("Ru "), "Ru"), F.when(has("Rec "), "Rec"), F.when(has("TD "), "TD")))
    lacking = F.array_except(F.array(F.lit("Ru"), F.lit("Rec"), F.lit("TD")), parts)
    quality = F.when(F.size(lacking) == 0, "good").when(F.array_contains(parts, "Ru") | F.array_contains(parts, "Rec"), "fair").when(F.array_contains(parts, "TD"), "td-only").otherwise("partial")
    return table(s, d, "market_quotes").select("quote_id", quality.alias("quality"))


@q("f22_reported_out", "SELECT lineup_row_id, player, injury FROM lineup_rows WHERE injury IS NOT NULL")
def f22(s, d):
    return table(s, d, "lineup_rows").where("injury is not null").select("lineup_row_id", "player", "injury")


@q("j4_j5_left_join", "SELECT r.entry_id, s.salary, s.fppg FROM roster_entries r LEFT JOIN salary_feed s ON r.player = s.player AND r.team = s.team")
def j4(s, d):
    f = table(s, d, "salary_feed").select("player", "team", "salary", "fppg")
    return table(s, d, "roster_entries").select("entry_id", "player", "team").join(f, ["player", "team"], "left").select("entry_id", "salary", "fppg")


@q("j8_roster_feed_schedule", """
    WITH k AS (SELECT team, min(kickoff_utc) AS kickoff FROM slate_pool WHERE team IS NOT NULL GROUP BY team), f AS (SELECT player, min(fppg) AS fppg, min(team) AS feed_team FROM salary_feed WHERE player IS NOT NULL GROUP BY player)
    SELECT entry_id, coalesce(f.feed_team, r.team) AS team, f.fppg, k.kickoff FROM roster_entries r LEFT JOIN f USING (player) LEFT JOIN k ON k.team = coalesce(f.feed_team, r.team)""")
def j8(s, d):
    k = table(s, d, "slate_pool").where("team is not null").groupBy("team").agg(F.min("kickoff_utc").alias("kickoff"))
    f = table(s, d, "salary_feed").where("player is not null").groupBy("player").agg(F.min("fppg").alias("fppg"), F.min("team").alias("feed_team"))
    r = table(s, d, "roster_entries").select("entry_id", "player", F.col("team").alias("own")).join(f, "player", "left").withColumn("team", F.coalesce("feed_team", "own"))
    return r.join(k, "team", "left").select("entry_id", "team", "fppg", "kickoff")


@q("a5_windowed_median", "SELECT lineup_row_id, round(median(mean_fp) OVER (PARTITION BY pos, slot), 7) AS middle, count(*) OVER (PARTITION BY pos, slot) AS n FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp)")
def a5(s, d):
    x = lines(s, d)
    g = x.groupBy("pos", "slot").agg(F.round(F.percentile("mean_fp", 0.5), 7).alias("middle"), F.count("*").alias("n"))
    return x.join(g, [x.pos.eqNullSafe(g.pos), x.slot.eqNullSafe(g.slot)]).select("lineup_row_id", "middle", "n")


@q("a17_threshold_medians", "SELECT l_quantity AS threshold, round(median(l_discount), 9) AS p, count(*) AS n FROM lineitem GROUP BY l_quantity")
def a17(s, d):
    x = table(s, d, "lineitem").select(F.col("l_quantity").alias("threshold"), "l_discount")
    return R.medians(x, ["threshold"], "l_discount", "p").select("threshold", F.round("p", 9).alias("p"), "n")


@q("w10_observations", """
    WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS place,
      CASE WHEN count(*) OVER w >= 2 THEN avg(o_totalprice) OVER w END AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
    SELECT o_orderkey, CAST(least(place, 4) AS INTEGER) AS bucket, round(o_totalprice - before, 5) AS change FROM x WHERE before IS NOT NULL""")
def w10(s, d):
    x = table(s, d, "orders").withColumn("y", F.year("o_orderdate")).withColumn("before", R.lagged_mean("o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], 4, 2))
    r = R.ranked_top_n(x, ["o_custkey", "y"], [F.desc("o_totalprice"), F.asc("o_orderkey")], None, "place").where("before is not null")
    return r.select("o_orderkey", F.least("place", F.lit(4)).alias("bucket"), F.round(F.col("o_totalprice") - F.col("before"), 5).alias("change"))


@q("t3_t8_top_k_ties_by_index", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 250")
def t3(s, d):
    return table(s, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(250)


@q("t4_highest_pairs", """
    SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size * b.p_size AS v FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey ORDER BY v DESC, a, b LIMIT 100""")
def t4(s, d):
    return M.highest_pairs(table(s, d, "part"), ["p_brand", "p_type"], "p_partkey", "p_size", 100)


@q("t6_head_per_group", "SELECT board_id, rank_row_id FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY estimated_fp DESC NULLS LAST, rank_row_id) AS k FROM rankings WHERE estimated_fp IS NULL OR NOT isnan(estimated_fp)) WHERE k <= 12")
def t6(s, d):
    r = table(s, d, "rankings").where("estimated_fp is null or not isnan(estimated_fp)")
    return R.ranked_top_n(r, ["board_id"], [F.desc_nulls_last("estimated_fp"), F.asc("rank_row_id")], 12).select("board_id", "rank_row_id")


@q("x2_x3_suffixes_anywhere", r"""
    SELECT espn_row_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(full_name)), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '\b(?:jr|sr|ii|iii|iv|v|vi|vii)\b', '', 'g'), '\s+', ' ', 'g')) AS name_key FROM espn_feed""")
def x2(s, d):
    return table(s, d, "espn_feed").select("espn_row_id", T.name_key(F.col("full_name"), ("jr", "sr", "ii", "iii", "iv", "v", "vi", "vii"), anywhere=True).alias("name_key"))


@q("x10_name_and_team", r"SELECT entry_id, trim(regexp_replace(player, '\s*\([A-Za-z]{2,4}\)\s*$', '')) AS name, upper(nullif(regexp_extract(player, '\(([A-Za-z]{2,4})\)\s*$', 1), '')) AS team FROM roster_entries")
def x10(s, d):
    name, team = T.name_and_team(F.col("player"))
    return table(s, d, "roster_entries").select("entry_id", name.alias("name"), team.alias("team"))


@q("x12_outcome_line", r"SELECT quote_id, coalesce(CASE WHEN isnan(market_mean) THEN NULL ELSE market_mean END, TRY_CAST(nullif(regexp_extract(market_props, '([+-]?\d+(?:\.\d+)?)', 1), '') AS DOUBLE)) AS line FROM market_quotes")
def x12(s, d):
    return table(s, d, "market_quotes").select("quote_id", F.coalesce(T.clean_number(F.col("market_mean")), T.first_number(F.col("market_props"))).alias("line"))


@q("x31_floor_of_one", "SELECT p_partkey, CAST(greatest(1, least(p_size, floor(p_size * 0.3e0 + 1e-9))) AS INTEGER) AS most FROM part")
def x31(s, d):
    return table(s, d, "part").select("p_partkey", F.greatest(F.lit(1), F.when(F.col("p_size") == 1, 1).otherwise(S.exposure_limit(F.col("p_size"), F.lit(0.3)))).cast("int").alias("most"))


@q("x37_html_text", r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain FROM documents".replace('""', '"'))
def x37(s, d):
    return table(s, d, "documents").select("doc_id", T.html_text(F.col("text")).alias("plain"))


@q("m1_design_rows", """
    SELECT rank_row_id, CASE WHEN pos = 'QB' THEN 1e0 ELSE 0e0 END AS qb, CASE WHEN pos = 'QB' THEN salary * 1e0 ELSE 0e0 END AS qb_salary, CASE WHEN coalesce(depth_rank, 1) = 2 THEN 1e0 ELSE 0e0 END AS depth2, CASE WHEN coalesce(depth_rank, 1) >= 3 THEN 1e0 ELSE 0e0 END AS depth3
    FROM rankings WHERE salary IS NOT NULL""")
def m1(s, d):
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    depth = F.coalesce("depth_rank", F.lit(1))
    qb = one(F.col("pos") == "QB")
    return table(s, d, "rankings").where("salary is not null").select("rank_row_id", qb.alias("qb"), (qb * F.col("salary")).alias("qb_salary"), one(depth == 2).alias("depth2"), one(depth >= 3).alias("depth3"))


@q("m3_floored_prediction", """
    WITH f AS (SELECT regr_slope(mean_fp, salary) AS b, regr_intercept(mean_fp, salary) AS a FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp))
    SELECT rank_row_id, round(greatest(a + b * salary, 0.05), 5) AS predicted FROM rankings, f WHERE salary IS NOT NULL""")
def m3(s, d):
    fit = X.ridge(lines(s, d).where("salary is not null").select(F.col("salary").cast("double").alias("salary"), "mean_fp"), ["salary"], "mean_fp", 0.0)
    return table(s, d, "rankings").where("salary is not null").select("rank_row_id", F.round(X.predict(fit, 0.05), 5).alias("predicted"))


@q("m7_prior_gate", """
    WITH h AS (SELECT o_custkey, o_orderkey, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent, avg(o_totalprice) OVER () AS base, o_orderpriority FROM orders),
    m AS (SELECT o_orderpriority, count(*) AS n, avg(abs(y - base)) AS b, avg(abs(y - recent)) AS r FROM h WHERE recent IS NOT NULL GROUP BY o_orderpriority)
    SELECT o_orderpriority, n, round(b, 3) AS base_mae, round(r, 3) AS recent_mae, n >= 200 AND r < 0.98 * b AS passed FROM m""")
def m7(s, d):
    o = table(s, d, "orders")
    base = o.agg(F.avg("o_totalprice").alias("base"))
    h = o.withColumn("recent", R.lagged_mean("o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], 4, 1)).where("recent is not null").crossJoin(F.broadcast(base))
    m = h.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("o_totalprice") - F.col("base"))).alias("b"), F.avg(F.abs(F.col("o_totalprice") - F.col("recent"))).alias("r"))
    return m.select("o_orderpriority", "n", F.round("b", 3).alias("base_mae"), F.round("r", 3).alias("recent_mae"), ((F.col("n") >= 200) & (F.col("r") < 0.98 * F.col("b"))).alias("passed"))


@q("m12_estimate_replacement", "SELECT quote_id, round(CASE WHEN market_quality = 'thin' AND market_props IS NOT NULL THEN 4 + 15 * TRY_CAST(nullif(regexp_extract(market_props, 'TD (\\d+)%', 1), '') AS DOUBLE) / 100 WHEN isnan(market_mean) THEN NULL ELSE market_mean END, 6) AS value FROM market_quotes")
def m12(s, d):
    td = F.nullif(F.regexp_extract("market_props", r"TD (\d+)%", 1), F.lit("")).try_cast("double") / 100
    return table(s, d, "market_quotes").select("quote_id", F.round(F.when((F.col("market_quality") == "thin") & F.col("market_props").isNotNull(), 4 + 15 * td).otherwise(T.clean_number(F.col("market_mean"))), 6).alias("value"))


@q("m20_target_correlations", """
    WITH p AS (SELECT DISTINCT lineup_id, player_key, pos, team FROM lineup_rows WHERE player_key IS NOT NULL AND pos IS NOT NULL AND team IS NOT NULL)
    SELECT a.lineup_id, count(*) AS pairs, round(sum(CASE WHEN a.team <> b.team THEN 0.02e0 WHEN 'QB' IN (a.pos, b.pos) THEN 0.35e0 WHEN a.pos = b.pos THEN -0.1e0 ELSE 0.05e0 END), 6) AS total FROM p a JOIN p b ON a.lineup_id = b.lineup_id AND a.player_key < b.player_key GROUP BY a.lineup_id""")
def m20(s, d):
    p = table(s, d, "lineup_rows").where("player_key is not null and pos is not null and team is not null").select("lineup_id", "player_key", "pos", "team").distinct()
    c = F.when(F.col("team_a") != F.col("team_b"), 0.02).when((F.col("pos_a") == "QB") | (F.col("pos_b") == "QB"), 0.35).when(F.col("pos_a") == F.col("pos_b"), -0.1).otherwise(0.05)
    return M.pairs_within(p, "lineup_id", "player_key", ["pos", "team"]).groupBy("lineup_id").agg(F.count("*").alias("pairs"), F.round(F.sum(c), 6).alias("total"))


@q("m26_m28_game_models")
def m26(s, d):
    r = lines(s, d).where("player_key is not null").groupBy("lineup_id", "player_key").agg(F.min("pos").alias("pos"))
    pairs = M.pairs_within(r, "lineup_id", "player_key", ["pos"]).select("lineup_id", F.col("_a").alias("a"), F.col("_b").alias("b"), F.when(F.col("pos_a") == F.col("pos_b"), -0.3).otherwise(0.4).alias("v"))
    roots = S.correlation_roots(pairs, r, "lineup_id", "player_key", "a", "b", "v")
    return roots.groupBy("lineup_id").agg(F.max("i").alias("members"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("trace"))


@q("m31_analytic_covariance", """
    WITH p AS (SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size AS g, p_retailprice * (0.5e0 + p_size / 50e0) AS sd FROM part)
    SELECT a.g, count(*) AS pairs, round(sum(0.25e0 * a.sd * b.sd) + 1e-5, 2) AS cov FROM p a JOIN p b ON a.g = b.g AND a.p_partkey < b.p_partkey GROUP BY a.g""")
def m31(s, d):
    p = table(s, d, "part").select(F.concat_ws("|", "p_brand", "p_type", "p_size").alias("g"), "p_partkey", (F.col("p_retailprice") * (0.5 + F.col("p_size") / 50.0)).alias("sd"))
    return M.pairs_within(p, "g", "p_partkey", ["sd"]).groupBy("g").agg(F.count("*").alias("pairs"), F.round(F.sum(0.25 * F.col("sd_a") * F.col("sd_b")) + 1e-5, 2).alias("cov"))


@q("m33_candidate_screen", """
    WITH c AS (SELECT lineup_id, sum(mean_fp) AS m, sqrt(sum(mean_fp * mean_fp * 0.25e0)) AS sd FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY lineup_id),
    a AS (SELECT lineup_id FROM c ORDER BY round(m + 0.85e0 * sd, 9) DESC, lineup_id LIMIT 40), b AS (SELECT lineup_id FROM c ORDER BY round(m, 9) DESC, lineup_id LIMIT 15)
    SELECT lineup_id FROM a UNION SELECT lineup_id FROM b""")
def m33(s, d):
    c = lines(s, d).groupBy("lineup_id").agg(F.sum("mean_fp").alias("m"), F.sqrt(F.sum(F.col("mean_fp") * F.col("mean_fp") * 0.25)).alias("sd"))
    top = lambda e, n: c.orderBy(F.desc(F.round(e, 9)), "lineup_id").limit(n).select("lineup_id")
    return top(F.col("m") + 0.85 * F.col("sd"), 40).union(top(F.col("m"), 15)).distinct()


@q("m50_calibrated_rates", """
    WITH g AS (SELECT pos, least(greatest(coalesce(depth_rank, 4), 1), 4) AS b, count(*) AS n, (sum(CASE WHEN estimated_fp < 5 THEN 1.0 ELSE 0 END) + 20 * 0.2) / (count(*) + 20) AS rate FROM rankings WHERE estimated_fp IS NOT NULL AND NOT isnan(estimated_fp) GROUP BY ALL),
    m AS (SELECT a.pos, a.b AS j, c.b AS k, sum(x.rate * x.n) / sum(x.n) AS m FROM g a JOIN g c ON a.pos = c.pos AND a.b <= c.b JOIN g x ON x.pos = a.pos AND x.b BETWEEN a.b AND c.b GROUP BY ALL),
    t AS (SELECT g.pos, g.b, m.j, min(m.m) AS t FROM g JOIN m ON m.pos = g.pos AND m.j <= g.b AND m.k >= g.b GROUP BY ALL)
    SELECT pos, CAST(b AS INTEGER) AS bucket, round(CAST(max(t) AS DOUBLE), 8) AS rate FROM t GROUP BY ALL""")
def m50(s, d):
    r = table(s, d, "rankings").where("estimated_fp is not null and not isnan(estimated_fp)").withColumn("bucket", F.least(F.greatest(F.coalesce("depth_rank", F.lit(4)), F.lit(1)), F.lit(4)).cast("int"))
    g = E.shrunken_rate(r, ["pos", "bucket"], F.col("estimated_fp") < 5, F.lit(0.2), 20)
    return X.pooled_monotone(g, "pos", "bucket", "rate", "n", True).select("pos", "bucket", F.round("fit", 8).alias("rate"))


@q("m52_hash_sample", "SELECT lineup_id FROM (SELECT DISTINCT lineup_id FROM lineup_rows) ORDER BY md5(lineup_id || '|356'), lineup_id LIMIT 25")
def m52(s, d):
    return table(s, d, "lineup_rows").select("lineup_id").distinct().orderBy(F.md5(F.concat("lineup_id", F.lit("|356")).cast("binary")), "lineup_id").limit(25)


@q("m54_m55_payloads", """
    SELECT slate_id, game_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE estimated_fp IS NOT NULL AND NOT isnan(estimated_fp)) < 5 THEN 'too few estimates' END AS skipped FROM slate_pool GROUP BY ALL""")
def m54(s, d):
    usable = F.count_if(F.col("estimated_fp").isNotNull() & ~F.isnan(F.coalesce("estimated_fp", F.lit(0.0))))
    return table(s, d, "slate_pool").groupBy("slate_id", "game_id").agg(F.count("*").alias("n"), F.when(usable < 5, "too few estimates").alias("skipped"))


@q("r2_latest_before_event", """
    WITH r AS (SELECT player_key, kickoff_utc, pool_row_id, row_number() OVER (PARTITION BY player_key, kickoff_utc ORDER BY captured_utc DESC, pool_row_id DESC) AS k FROM slate_pool WHERE captured_utc < kickoff_utc AND player_key IS NOT NULL)
    SELECT player_key, kickoff_utc, pool_row_id FROM r WHERE k = 1""")
def r2(s, d):
    p = table(s, d, "slate_pool").where("player_key is not null")
    return R.latest_before(p, ["player_key", "kickoff_utc"], "captured_utc", "kickoff_utc", ["pool_row_id"]).select("player_key", "kickoff_utc", "pool_row_id")


@q("r5_settled_guard", "SELECT lineup_row_id FROM lineup_rows WHERE kickoff_utc + INTERVAL 24 HOUR < TIMESTAMP '2026-11-01 00:00:00'")
def r5(s, d):
    return _run(_stream(s, d, "lineup_rows").where("kickoff_utc + interval 24 hours < timestamp_ntz'2026-11-01 00:00:00'").select("lineup_row_id"), "append")


@q("r6_streamed_upsert", "SELECT player_key, max(pool_row_id) AS pool_row_id FROM slate_pool WHERE player_key IS NOT NULL GROUP BY player_key")
def r6(s, d):
    root = os.path.join(ensure_checkpoint_dir(s), f"upsert-{uuid.uuid4().hex}")
    version = {"n": 0}
    schema = "player_key string, pool_row_id bigint"

    def read() -> DataFrame:
        return s.read.schema(schema).parquet(f"{root}/v{version['n']}") if version["n"] else s.createDataFrame([], schema)

    def write(df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{root}/v{version['n'] + 1}")
        version["n"] += 1

    stream = _stream(s, d, "slate_pool").where("player_key is not null").select("player_key", "pool_row_id")
    merge = ST.upsert_newest(read, write, ["player_key"], "pool_row_id")
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    return read()


@q("r8_freshness", "SELECT file_id FROM published_files WHERE delivered_utc > TIMESTAMP '2026-10-10' - INTERVAL 24 HOUR AND delivered_utc <= TIMESTAMP '2026-10-10'")
def r8(s, d):
    return table(s, d, "published_files").where("delivered_utc > timestamp_ntz'2026-10-10' - interval 24 hours and delivered_utc <= timestamp_ntz'2026-10-10'").select("file_id")


@q("r9_open_quotes", "SELECT quote_id FROM market_quotes WHERE kickoff_utc > TIMESTAMP '2026-10-15 18:00:00'")
def r9(s, d):
    return table(s, d, "market_quotes").where("kickoff_utc > timestamp_ntz'2026-10-15 18:00:00'").select("quote_id")


@q("y1_frozen_means", "SELECT lineup_row_id, CASE WHEN locked THEN mean_fp ELSE coalesce(CASE WHEN isnan(cbs_mean) THEN NULL ELSE cbs_mean END, mean_fp) END AS value FROM lineup_rows")
def y1(s, d):
    return table(s, d, "lineup_rows").select("lineup_row_id", F.when(F.col("locked"), F.col("mean_fp")).otherwise(F.coalesce(T.clean_number(F.col("cbs_mean")), F.col("mean_fp"))).alias("value"))


@q("y3_payload_rows", "SELECT lineup_row_id, round(mean_fp, 2) AS mean, strftime(kickoff_utc, '%Y-%m-%d %H:%M') AS kickoff FROM lineup_rows WHERE mean_fp IS NULL OR NOT isnan(mean_fp)")
def y3(s, d):
    return table(s, d, "lineup_rows").where("mean_fp is null or not isnan(mean_fp)").select("lineup_row_id", F.round("mean_fp", 2).alias("mean"), F.date_format("kickoff_utc", "yyyy-MM-dd HH:mm").alias("kickoff"))


@q("y16_score_from_latent", """
    WITH p AS (SELECT p_partkey, 0.5e0 + p_size / 50e0 AS cv FROM part) SELECT p_partkey, round(greatest(-0.999e0, least(0.999e0, (exp(0.4e0 * ln(1 + cv * cv)) - 1) / (cv * cv))), 9) AS score FROM p""")
def y16(s, d):
    cv = 0.5 + F.col("p_size") / 50.0
    return table(s, d, "part").select("p_partkey", F.round(S.score_lognormal(F.lit(0.4), cv, cv), 9).alias("score"))


@q("y20_box_muller", f"SELECT event_id, round(sqrt(-2 * ln({D.uniform_sql('1', 'event_id', engine='duckdb')})) * cos(2 * pi() * {D.uniform_sql('2', 'event_id', engine='duckdb')}), 8) AS z FROM events")
def y20(s, d):
    return table(s, d, "events").select("event_id", F.round(F.expr(f"sqrt(-2 * ln({D.uniform_sql('1', 'event_id')})) * cos(2 * pi() * {D.uniform_sql('2', 'event_id')})"), 8).alias("z"))


@q("y22_nearest_rank_quantile", """
    WITH r AS (SELECT l_linenumber, l_extendedprice AS v, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem)
    SELECT l_linenumber, max(CASE WHEN i = CAST(floor(0.9e0 * (n - 1) + 0.5e0) AS BIGINT) THEN v END) AS p90 FROM r GROUP BY l_linenumber""")
def y22(s, d):
    near = R.at_positions(table(s, d, "lineitem"), ["l_linenumber"], "l_extendedprice", p90=lambda n: F.floor(0.9 * (n - 1) + 0.5))
    return near.select("l_linenumber", "p90")


@q("y26_star_pairs", "SELECT lineup_id, player_key AS star FROM lineup_rows WHERE player_key IS NOT NULL GROUP BY ALL")
def y26(s, d):
    g = table(s, d, "lineup_rows").where("player_key is not null").groupBy("lineup_id").agg(F.collect_set("player_key").alias("members"))
    return g.select("lineup_id", F.explode("members").alias("star"))


@q("y33_rule_predicate", "SELECT lineup_id, count(*) FILTER (WHERE pos = 'WR') BETWEEN 2 AND 4 AND count(*) FILTER (WHERE pos = 'QB') = 1 AS fits FROM lineup_rows GROUP BY lineup_id")
def y33(s, d):
    g = table(s, d, "lineup_rows").groupBy("lineup_id").agg(F.collect_list("pos").alias("ps"))
    n = lambda p: F.size(F.filter("ps", lambda x: x == p))
    return g.select("lineup_id", (n("WR").between(2, 4) & (n("QB") == 1)).alias("fits"))


@q("y39_settled_points", "SELECT lineup_row_id, cbs_mean AS points FROM lineup_rows WHERE cbs_mean IS NOT NULL AND NOT isnan(cbs_mean) AND NOT isinf(cbs_mean)")
def y39(s, d):
    return table(s, d, "lineup_rows").select("lineup_row_id", T.clean_number(F.col("cbs_mean")).alias("points")).where("points is not null")


@q("y41_clean_ids", r"SELECT lineup_row_id, regexp_replace(CAST(CAST(salary AS DOUBLE) AS VARCHAR), '\.0$', '') AS clean FROM lineup_rows")
def y41(s, d):
    return table(s, d, "lineup_rows").select("lineup_row_id", F.regexp_replace(F.col("salary").cast("double").cast("string"), r"\.0$", "").alias("clean"))


@q("y47_packed_triangle", """
    WITH p AS (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS i FROM region) SELECT a.i, b.i AS j, (a.i - 1) * 5 - (a.i - 1) * a.i // 2 + b.i - a.i - 1 AS k FROM p a JOIN p b ON a.i < b.i""")
def y47(s, d):
    n = table(s, d, "region").agg(F.count("*").alias("n"))
    t = n.select("n", F.posexplode(F.sequence(F.lit(1), (F.col("n") * (F.col("n") - 1) / 2).cast("int"))).alias("k", "x"))
    i = F.expr("cast(n - floor((1 + sqrt(8 * (n * (n - 1) / 2 - k - 1) + 1)) / 2) as bigint)")
    t = t.withColumn("i", i)
    return t.select("i", (F.col("k") - (F.col("i") - 1) * F.col("n") + F.expr("(i - 1) * i div 2") + F.col("i") + 1).cast("bigint").alias("j"), F.col("k").cast("bigint").alias("k"))


@q("y49_gap_to_constant", """
    WITH g AS (SELECT pos, count(*) AS n, corr(mean_fp, salary) AS r FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY pos HAVING count(*) >= 30)
    SELECT pos, round(r - 0.9e0, 7) AS gap, 0.9e0 BETWEEN tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AND tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS inside FROM g""")
def y49(s, d):
    g = E.fisher_interval(lines(s, d), ["pos"], "mean_fp", "salary", 30)
    return g.select("pos", F.round(F.col("r") - 0.9, 7).alias("gap"), F.lit(0.9).between(F.col("low"), F.col("high")).alias("inside"))


@q("y53_null_if_any_null", "SELECT lineup_row_id, round(mean_fp + floor_fp + ceiling_fp, 6) AS total FROM lineup_rows WHERE mean_fp + floor_fp + ceiling_fp IS NOT NULL AND NOT isnan(mean_fp + floor_fp + ceiling_fp)")
def y53(s, d):
    t = F.col("mean_fp") + F.col("floor_fp") + F.col("ceiling_fp")
    return table(s, d, "lineup_rows").select("lineup_row_id", F.round(t, 6).alias("total")).where("total is not null and not isnan(total)")


@q("y55_completed_weeks", "SELECT w AS week, TIMESTAMP '2026-09-10 17:00:00' + INTERVAL 7 DAY * (w - 1) + INTERVAL 43 HOUR <= TIMESTAMP '2026-11-01' AS completed FROM range(1, 19) t(w)")
def y55(s, d):
    w = s.range(1, 19).withColumnRenamed("id", "week")
    return w.select("week", F.expr("timestampadd(HOUR, cast(168 * (week - 1) + 43 as int), timestamp_ntz'2026-09-10 17:00:00') <= timestamp_ntz'2026-11-01'").alias("completed"))


@q("y58_outside_pool", "SELECT lineup_row_id FROM lineup_rows WHERE player IS NOT NULL AND player NOT IN (SELECT player FROM slate_pool WHERE player IS NOT NULL)")
def y58(s, d):
    return table(s, d, "lineup_rows").where("player is not null").join(table(s, d, "slate_pool").select("player"), "player", "left_anti").select("lineup_row_id")


@q("y59_classification", "SELECT lineup_row_id, CASE WHEN depth_rank = 1 THEN 'main' WHEN depth_rank IS NOT NULL THEN 'other only' ELSE 'unknown' END AS kind FROM lineup_rows")
def y59(s, d):
    return table(s, d, "lineup_rows").select("lineup_row_id", F.when(F.col("depth_rank") == 1, "main").when(F.col("depth_rank").isNotNull(), "other only").otherwise("unknown").alias("kind"))


@q("y63_cohort_pivot", """
    SELECT pos, round(avg(mean_fp) FILTER (WHERE locked), 7) AS locked, round(avg(mean_fp) FILTER (WHERE NOT locked), 7) AS free, round(avg(mean_fp) FILTER (WHERE locked) - avg(mean_fp) FILTER (WHERE NOT locked), 7) AS difference FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY pos""")
def y63(s, d):
    p = lines(s, d).groupBy("pos").pivot("locked", [True, False]).agg(F.avg("mean_fp")).toDF("pos", "a", "b")
    return p.select("pos", F.round("a", 7).alias("locked"), F.round("b", 7).alias("free"), F.round(F.col("a") - F.col("b"), 7).alias("difference"))


@q("y65_residual_pairs", """
    WITH r AS (SELECT lineup_id, lineup_row_id, pos, (cbs_mean - mean_fp) / mean_fp AS e FROM lineup_rows WHERE mean_fp >= 2 AND NOT isnan(mean_fp) AND cbs_mean IS NOT NULL AND NOT isnan(cbs_mean))
    SELECT least(a.pos, b.pos) || '-' || greatest(a.pos, b.pos) AS label, count(*) AS n, round(avg(a.e * b.e), 9) AS product FROM r a JOIN r b ON a.lineup_id = b.lineup_id AND a.lineup_row_id < b.lineup_row_id GROUP BY ALL""")
def y65(s, d):
    r = lines(s, d).where("mean_fp >= 2 and cbs_mean is not null and not isnan(cbs_mean)").select("lineup_id", "lineup_row_id", "pos", ((F.col("cbs_mean") - F.col("mean_fp")) / F.col("mean_fp")).alias("e"))
    x = M.pairs_within(r, "lineup_id", "lineup_row_id", ["pos", "e"])
    label = F.when(F.col("pos_a").isNotNull() & F.col("pos_b").isNotNull(), F.concat_ws("-", F.least("pos_a", "pos_b"), F.greatest("pos_a", "pos_b")))
    return x.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("e_a") * F.col("e_b")), 9).alias("product"))


@q("y66_block_bootstrap")
def y66(s, d):
    c = lines(s, d).where("cbs_mean is not null and not isnan(cbs_mean)").groupBy("run_date").agg(F.sum(F.col("cbs_mean") - F.col("mean_fp")).alias("total"), F.count("*").alias("n"))
    b = E.cluster_bootstrap(c, "run_date", "total", "n", 500, F.expr(D.uniform_sql("3", "rep", "run_date")))
    return b.select("reps", *[F.round(x, 6).alias(x) for x in ("low", "middle", "high")])


@q("y68_missing_components", "SELECT quote_id, concat_ws(',', CASE WHEN coalesce(market_props, '') NOT LIKE '%Rec %' THEN 'Rec' END, CASE WHEN coalesce(market_props, '') NOT LIKE '%Ru %' THEN 'Ru' END, CASE WHEN coalesce(market_props, '') NOT LIKE '%TD %' THEN 'TD' END) AS missing FROM market_quotes")
def y68(s, d):
    lacks = lambda w: F.when(~F.coalesce("market_props", F.lit("")).contains(w + " "), F.lit(w))
    return table(s, d, "market_quotes").select("quote_id", F.concat_ws(",", lacks("Rec"), lacks("Ru"), lacks("TD")).alias("missing"))


@q("y69_sides", "SELECT salary_row_id, split_part(away_team || ' @ ' || home_team, ' @ ', CASE WHEN team = away_team THEN 1 ELSE 2 END) AS side FROM salary_feed WHERE team IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL")
def y69(s, d):
    f = table(s, d, "salary_feed").where("team is not null and home_team is not null and away_team is not null")
    return f.select("salary_row_id", F.split(F.concat_ws(" @ ", "away_team", "home_team"), " @ ")[F.when(F.col("team") == F.col("away_team"), 0).otherwise(1)].alias("side"))


@q("y74_unrounded_totals", "SELECT lineup_id, round(sum(coalesce(CASE WHEN isnan(cbs_mean) THEN NULL ELSE cbs_mean END, mean_fp)), 6) AS total FROM lineup_rows WHERE mean_fp IS NULL OR NOT isnan(mean_fp) GROUP BY lineup_id")
def y74(s, d):
    x = table(s, d, "lineup_rows").where("mean_fp is null or not isnan(mean_fp)")
    return x.groupBy("lineup_id").agg(F.round(F.sum(F.coalesce(T.clean_number(F.col("cbs_mean")), F.col("mean_fp"))), 6).alias("total"))


@q("x23_x24_signed_marginal", """
    WITH p AS (SELECT p_partkey, p_retailprice / 100 AS m, 0.5e0 + p_size / 50e0 AS cv FROM part) SELECT p_partkey, round((m + 0.05e0) / 0.8e0, 8) AS inner_mean, round(sqrt(greatest((cv * cv * m * m + m * m - 0.05e0) / 0.8e0 / pow((m + 0.05e0) / 0.8e0, 2) - 1, 0)), 8) AS inner_cv FROM p""")
def x23(s, d):
    return MO.signed_marginal(table(s, d, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("m"), (0.5 + F.col("p_size") / 50.0).alias("cv")), "m", "cv", 0.05, 0.15, -1.0).select("p_partkey", F.round("inner_mean", 8).alias("inner_mean"), F.round("inner_cv", 8).alias("inner_cv"))
