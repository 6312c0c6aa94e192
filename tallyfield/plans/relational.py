"""Scans, filters, joins, set operations and ranks on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import matching as M
from ..operators import ranking as R
from ..registry import Registry
from ..session import table

registry = Registry()
q = registry.query


@q("w1_ranked_top_n", """
    WITH c AS (SELECT c_custkey, c_name, c_mktsegment, n_name, round(sum(o_totalprice), 2) AS revenue
               FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY revenue DESC, c_name, c_custkey) AS INTEGER) AS rank FROM c)
    SELECT * FROM r WHERE rank <= 15""")
def w1(s: SparkSession, d: str) -> DataFrame:
    spend = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(spend, "c_custkey")
    c = c.select("c_custkey", "c_name", "c_mktsegment", "n_name", "revenue")
    return R.ranked_top_n(c, ["c_mktsegment"], [F.desc("revenue"), F.asc("c_name"), F.asc("c_custkey")], 15)


@q("w2_chart_tier", """
    SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN CAST(row_number() OVER (PARTITION BY p_brand, p_type, p_size % 7 <> 0 ORDER BY p_size, p_retailprice DESC, p_partkey) AS INTEGER) END AS tier FROM part""")
def w2(s, d):
    p = table(s, d, "part")
    charted = R.ranked_top_n(p.where("p_size % 7 <> 0"), ["p_brand", "p_type"], [F.asc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")], None, "tier")
    return p.select("p_partkey").join(charted.select("p_partkey", "tier"), "p_partkey", "left")


@q("w3_depth_rank_nulls_last", """
    SELECT pool_row_id, CAST(row_number() OVER (PARTITION BY slate_id, team, pos ORDER BY depth_rank ASC NULLS LAST, coalesce(estimated_fp, -1) DESC, pool_row_id) AS INTEGER) AS depth
    FROM slate_pool WHERE team IS NOT NULL AND pos IS NOT NULL AND (estimated_fp IS NULL OR NOT isnan(estimated_fp))""")
def w3(s, d):
    p = table(s, d, "slate_pool").where("team is not null and pos is not null and (estimated_fp is null or not isnan(estimated_fp))")
    r = R.ranked_top_n(p, ["slate_id", "team", "pos"], [F.asc_nulls_last("depth_rank"), F.desc(F.coalesce("estimated_fp", F.lit(-1.0))), F.asc("pool_row_id")], None, "depth")
    return r.select("pool_row_id", "depth")


@q("w4_override_rank", """
    SELECT rank_row_id, CAST(CASE WHEN pos = 'DEF' THEN 1 WHEN pos = 'QB' THEN row_number() OVER (PARTITION BY board_id, snapshot_no, team, pos ORDER BY coalesce(estimated_fp, -1) DESC, rank_row_id) ELSE depth_rank END AS INTEGER) AS depth
    FROM rankings""")
def w4(s, d):
    r = R.ranked_top_n(table(s, d, "rankings"), ["board_id", "snapshot_no", "team", "pos"], [F.desc(F.coalesce("estimated_fp", F.lit(-1.0))), F.asc("rank_row_id")], None, "rn")
    return r.select("rank_row_id", F.when(F.col("pos") == "DEF", 1).when(F.col("pos") == "QB", F.col("rn")).otherwise(F.col("depth_rank")).cast("int").alias("depth"))


@q("w7_percentile_blend", """
    WITH x AS (SELECT p_partkey, p_brand, p_retailprice AS v, p_retailprice / p_size AS u FROM part),
    r AS (SELECT *, (rank() OVER (PARTITION BY p_brand ORDER BY v) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand) AS a,
                    (rank() OVER (PARTITION BY p_brand ORDER BY u) + (count(*) OVER (PARTITION BY p_brand, u) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand) AS b FROM x)
    SELECT p_partkey, round(CAST(0.7 * a + 0.3 * b AS DOUBLE) + 1e-11, 9) AS blend FROM r""")
def w7(s, d):
    x = table(s, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("v"), (F.col("p_retailprice") / F.col("p_size")).alias("u"))
    r = R.with_average_rank(R.with_average_rank(x, "v", ["p_brand"], "ra", "a"), "u", ["p_brand"], "rb", "b")
    return r.select("p_partkey", F.round(0.7 * F.col("a") + 0.3 * F.col("b") + 1e-11, 9).alias("blend"))


@q("w8_lagged_mean", """
    SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER w >= 3 THEN round(avg(o_totalprice) OVER w, 6) END AS lagged FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def w8(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(R.lagged_mean("o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], 8, 3), 6).alias("lagged"))


@q("w9_opportunity_rank", """
    SELECT event_id, CAST(least(row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY value DESC, event_id), 4) AS INTEGER) AS bucket FROM events""")
def w9(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return R.ranked_top_n(e, ["day", "event_type"], [F.desc("value"), F.asc("event_id")], None, "rn").select("event_id", F.least("rn", F.lit(4)).alias("bucket"))


@q("w12_unique_flag", """
    SELECT entry_id, count(*) OVER (PARTITION BY league_code, player) = 1 AS is_unique FROM roster_entries""")
def w12(s, d):
    return table(s, d, "roster_entries").select("entry_id", (F.count("*").over(Window.partitionBy("league_code", "player")) == 1).alias("is_unique"))


@q("w14_rank_correlation", """
    WITH r AS (SELECT run_date, rank() OVER (PARTITION BY run_date ORDER BY mean_fp) + (count(*) OVER (PARTITION BY run_date, mean_fp) - 1) / 2.0 AS a,
                      rank() OVER (PARTITION BY run_date ORDER BY cbs_mean) + (count(*) OVER (PARTITION BY run_date, cbs_mean) - 1) / 2.0 AS b
               FROM lineup_rows WHERE mean_fp IS NOT NULL AND cbs_mean IS NOT NULL AND NOT isnan(cbs_mean) AND NOT isnan(mean_fp))
    SELECT run_date, CAST(count(*) AS BIGINT) AS n, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 8) AS rho FROM r GROUP BY run_date HAVING count(*) >= 10""")
def w14(s, d):
    x = table(s, d, "lineup_rows").where("mean_fp is not null and cbs_mean is not null and not isnan(cbs_mean) and not isnan(mean_fp)")
    r = R.with_average_rank(R.with_average_rank(x, "mean_fp", ["run_date"], "a"), "cbs_mean", ["run_date"], "b")
    return r.groupBy("run_date").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 8).alias("rho")).where("n >= 10")


@q("w16_z_score", """
    SELECT vec_id, CASE WHEN stddev_pop(v) OVER (PARTITION BY label) > 1e-12 THEN round((v - avg(v) OVER (PARTITION BY label)) / stddev_pop(v) OVER (PARTITION BY label), 6) ELSE 0 END AS z
    FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)""")
def w16(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("v"))
    return R.z_score(e, "v", ["label"], "z").select("vec_id", F.round("z", 6).alias("z"))


@q("w17_latest_before", """
    WITH x AS (SELECT o_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate,
                      row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_quantity DESC) AS k
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)
    SELECT o_orderkey, l_partkey, l_quantity, l_extendedprice FROM x WHERE k = 1""")
def w17(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.latest_before(x, ["o_orderkey"], "l_shipdate", "o_orderdate", ["l_extendedprice", "l_partkey", "l_quantity"]).select("o_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@q("w18_top_two_per_scenario", """
    WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)
    SELECT user_id, max(CASE WHEN k = 1 THEN event_id END) AS owner, max(CASE WHEN k = 1 THEN value END) AS top1, max(CASE WHEN k = 2 THEN value END) AS top2 FROM r GROUP BY user_id""")
def w18(s, d):
    r = R.ranked_top_n(table(s, d, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 2, "k")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return r.groupBy("user_id").agg(pick(1, "event_id").alias("owner"), pick(1, "value").alias("top1"), pick(2, "value").alias("top2"))


@q("t5_top_by_limits", """
    WITH r AS (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
    SELECT p_partkey, p_type, p_retailprice FROM r WHERE (p_type = 'ECONOMY' AND k <= 9) OR (p_type = 'STANDARD' AND k <= 4) OR (p_type = 'PROMO' AND k <= 1)""")
def t5(s, d):
    return R.top_by_limits(table(s, d, "part").select("p_partkey", "p_type", "p_retailprice"), "p_type", [F.desc("p_retailprice"), F.asc("p_partkey")], {"ECONOMY": 9, "STANDARD": 4, "PROMO": 1})


@q("t2_two_objectives", """
    SELECT p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40)
    UNION SELECT p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 25)""")
def t2(s, d):
    p = table(s, d, "part")
    a = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)
    b = p.orderBy(F.desc("p_size"), "p_partkey").limit(25)
    return a.select("p_partkey", "p_retailprice").union(b.select("p_partkey", "p_retailprice")).distinct()


@q("t7_trim_pool", """
    WITH x AS (SELECT s_suppkey, s_nationkey, s_acctbal + 2000 AS v, (s_acctbal + 2000) / (s_suppkey % 9 + 1) AS u FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY v DESC, s_suppkey) AS t, row_number() OVER (ORDER BY v DESC, s_suppkey) AS k,
          0.7 * (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () + 0.3 * (rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0) / count(*) OVER () AS b FROM x),
    p AS (SELECT *, CASE WHEN t <= 1 THEN 0 WHEN k <= 8 THEN 1 ELSE 2 END AS priority FROM r)
    SELECT s_suppkey, s_nationkey, CAST(priority AS INTEGER) AS priority FROM p ORDER BY priority, CASE WHEN priority = 2 THEN -b ELSE k END, s_suppkey LIMIT 36""")
def t7(s, d):
    x = table(s, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") + 2000).alias("v"), (F.col("s_suppkey") % 9 + 1).alias("price"))
    return R.trim_pool(x, "s_suppkey", "s_nationkey", "v", "price", 36, 1, 8).select("s_suppkey", "s_nationkey", "priority")


@q("j1_cascade_match", """
    WITH c AS (SELECT c_custkey, c_custkey % 1000 AS code, c_nationkey AS nation, round(c_acctbal) AS bal FROM customer),
    s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 7 END AS code, s_nationkey AS nation, round(s_acctbal) AS bal FROM supplier),
    a AS (SELECT code, min(s_suppkey) AS m FROM s WHERE code IS NOT NULL GROUP BY code HAVING count(*) = 1),
    b AS (SELECT nation, bal, min(s_suppkey) AS m FROM s GROUP BY ALL HAVING count(*) = 1),
    e AS (SELECT nation, min(s_suppkey) AS m FROM s GROUP BY ALL HAVING count(*) = 1)
    SELECT c_custkey, coalesce(a.m, b.m, e.m) AS matched, CAST(CASE WHEN a.m IS NOT NULL THEN 1 WHEN b.m IS NOT NULL THEN 2 WHEN e.m IS NOT NULL THEN 3 END AS INTEGER) AS matched_by
    FROM c LEFT JOIN a USING (code) LEFT JOIN b ON c.nation = b.nation AND c.bal = b.bal LEFT JOIN e ON c.nation = e.nation""")
def j1(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 1000).alias("code"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal").alias("bal"))
    p = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") * 7).alias("code"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal").alias("bal"))
    return M.cascade_match(c, p, "s_suppkey", [["code"], ["nation", "bal"], ["nation"]]).select("c_custkey", "matched", "matched_by")


@q("j3_unique_lookup", """
    WITH u AS (SELECT player, pos, team, min(fppg) AS fppg FROM salary_feed WHERE player IS NOT NULL AND pos IS NOT NULL AND team IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
    SELECT entry_id, u.fppg FROM roster_entries r LEFT JOIN u ON r.player = u.player AND r.pos = u.pos AND r.team = u.team""")
def j3(s, d):
    u = R.keep_unique(table(s, d, "salary_feed").select("player", "pos", "team", "fppg"), ["player", "pos", "team"])
    return table(s, d, "roster_entries").join(u, ["player", "pos", "team"], "left").select("entry_id", "fppg")


@q("j9_both_directions", """
    WITH g AS (SELECT home_team AS team, away_team AS opponent, game_start_utc AS kickoff FROM salary_feed UNION ALL SELECT away_team, home_team, game_start_utc FROM salary_feed),
    r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff NULLS FIRST, opponent) AS k FROM g WHERE team IS NOT NULL)
    SELECT team, opponent, kickoff FROM r WHERE k = 1""")
def j9(s, d):
    return M.both_directions(table(s, d, "salary_feed"), "home_team", "away_team", "game_start_utc").withColumnRenamed("at", "kickoff")


@q("j10_tolerant_join", """
    SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000""")
def j10(s, d):
    e = table(s, d, "events")
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("ta"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("tb"))
    return M.tolerant_join(a, b, ["user_id"], "ta", "tb", 21600).select("click_id", "purchase_id")


@q("j11_nearest_date", """
    WITH m AS (SELECT a.event_id AS error_id, b.event_id AS near_id, abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) AS days
               FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup'),
    r AS (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY days, near_id) AS k FROM m WHERE days <= 1)
    SELECT error_id, near_id FROM r WHERE k = 1""")
def j11(s, d):
    e = table(s, d, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("ta"))
    b = e.where("event_type = 'signup'").select(F.col("event_id").alias("near_id"), "user_id", F.col("ts").alias("tb"))
    pairs = M.tolerant_join(a, b, ["user_id"], "ta", "tb", 2 * 86400)
    return M.nearest_row(pairs, "error_id", F.abs(F.date_diff(F.to_date("ta"), F.to_date("tb"))), "near_id", 1).select("error_id", "near_id")


@q("j13_history_before", """
    WITH h AS (SELECT o.o_orderkey, e.o_totalprice AS v, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY e.o_orderdate DESC, e.o_orderkey DESC) AS k
               FROM orders o JOIN orders e ON e.o_custkey = o.o_custkey AND e.o_orderdate < o.o_orderdate)
    SELECT o.o_orderkey, round(avg(v), 6) AS mean_before, CAST(count(v) AS INTEGER) AS n_before FROM orders o LEFT JOIN (SELECT * FROM h WHERE k <= 8) h USING (o_orderkey) GROUP BY o.o_orderkey""")
def j13(s, d):
    o = table(s, d, "orders")
    asked, past = o.select("o_custkey", F.col("o_orderkey").alias("event_key"), "o_orderdate"), o.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    got = M.history_before(asked, past, "o_custkey", "event_key", "o_orderdate", "o_orderdate", "o_totalprice", 8, ["o_orderkey"])
    return got.select(F.col("event_key").alias("o_orderkey"), F.round("mean_before", 6).alias("mean_before"), "n_before")


@q("j14_membership_as_of", """
    WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
    SELECT o_custkey, CAST(y AS INTEGER) AS y, o_orderpriority FROM r WHERE k = 1""")
def j14(s, d):
    o = table(s, d, "orders").withColumn("y", F.year("o_orderdate"))
    return R.keep_first(o, ["o_custkey", "y"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "y", "o_orderpriority")


@q("j16_exactly_one", """
    SELECT a.p_partkey, min(b.p_partkey) AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey
    AND abs(a.p_retailprice - b.p_retailprice) <= 0.5 + 1e-9 GROUP BY a.p_partkey HAVING count(*) = 1""")
def j16(s, d):
    return M.exactly_one_near(table(s, d, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice", 0.5 + 1e-9, "other")


@q("j20_pair_classes", """
    WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))
    SELECT least(x.l_returnflag, y.l_returnflag) || '-' || greatest(x.l_returnflag, y.l_returnflag) AS label, count(*) AS n
    FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY ALL""")
def j20(s, d):
    a = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    p = M.pairs_within(a, "l_orderkey", "l_linenumber", ["flag"])
    return p.groupBy(F.concat_ws("-", F.least("flag_a", "flag_b"), F.greatest("flag_a", "flag_b")).alias("label")).agg(F.count("*").alias("n"))


@q("j21_combinations", """
    WITH p AS (SELECT * FROM (SELECT p_brand AS g, p_partkey AS i, CAST(p_size AS BIGINT) AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_brand IS NOT NULL) WHERE k <= 14)
    SELECT a.g AS p_brand, [a.i, b.i, c.i, e.i] AS members, a.w + b.w + c.w + e.w AS total
    FROM p a JOIN p b ON a.g = b.g AND b.i > a.i JOIN p c ON c.g = a.g AND c.i > b.i JOIN p e ON e.g = a.g AND e.i > c.i WHERE a.w + b.w + c.w + e.w <= 90""")
def j21(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(s, d, "part").where("p_brand is not null").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("w"), F.row_number().over(w).alias("k")).where("k <= 14")
    return M.combinations(p, "p_partkey", "w", 4, 90, group="p_brand")


@q("j25_outer_alignment", """
    WITH s AS (SELECT player, pos, min(fppg) AS salary_fp FROM salary_feed WHERE player IS NOT NULL AND pos IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
    e AS (SELECT full_name AS player, CASE default_position_id WHEN 1 THEN 'QB' WHEN 2 THEN 'RB' WHEN 3 THEN 'WR' WHEN 4 THEN 'TE' WHEN 5 THEN 'K' ELSE 'DEF' END AS pos, min(applied_total) AS espn_fp FROM espn_feed WHERE full_name IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
    SELECT player, pos, s.salary_fp, e.espn_fp FROM s FULL JOIN e USING (player, pos)""")
def j25(s, d):
    a = R.keep_unique(table(s, d, "salary_feed").select("player", "pos", F.col("fppg").alias("salary_fp")), ["player", "pos"])
    pos = F.element_at(F.create_map(*[x for k, v in {1: "QB", 2: "RB", 3: "WR", 4: "TE", 5: "K"}.items() for x in (F.lit(k), F.lit(v))]), F.col("default_position_id"))
    b = R.keep_unique(table(s, d, "espn_feed").select(F.col("full_name").alias("player"), F.coalesce(pos, F.lit("DEF")).alias("pos"), F.col("applied_total").alias("espn_fp")), ["player", "pos"])
    return a.join(b, ["player", "pos"], "full").select("player", "pos", "salary_fp", "espn_fp")


@q("j27_id_bridge", """
    SELECT player_key, min(player) AS player FROM slate_pool WHERE player_key IS NOT NULL AND player IS NOT NULL GROUP BY player_key HAVING count(DISTINCT player) = 1""")
def j27(s, d):
    p = table(s, d, "slate_pool").where("player_key is not null and player is not null")
    return p.groupBy("player_key").agg(F.min("player").alias("player"), F.max("player").alias("hi")).where("player = hi").drop("hi")


@q("j28_consistency", """
    SELECT a.slate_id, a.player_key, min(a.estimated_fp) AS lo, max(a.estimated_fp) AS hi FROM slate_pool a WHERE estimated_fp IS NOT NULL AND NOT isnan(estimated_fp)
    GROUP BY ALL HAVING max(a.estimated_fp) - min(a.estimated_fp) > 0.00501""")
def j28(s, d):
    p = table(s, d, "slate_pool").where("estimated_fp is not null and not isnan(estimated_fp)")
    return p.groupBy("slate_id", "player_key").agg(F.min("estimated_fp").alias("lo"), F.max("estimated_fp").alias("hi")).where("hi - lo > 0.00501")


@q("j29_grade", """
    WITH t AS (SELECT lineup_id, max(mean_fp) AS top FROM lineup_rows GROUP BY lineup_id)
    SELECT lineup_id, round(sum(mean_fp) + 0.5 * min(top), 4) AS actual, CAST(count(*) FILTER (WHERE mean_fp IS NULL) AS BIGINT) AS missing
    FROM lineup_rows JOIN t USING (lineup_id) WHERE mean_fp IS NULL OR NOT isnan(mean_fp) GROUP BY lineup_id""")
def j29(s, d):
    x = table(s, d, "lineup_rows").where("mean_fp is null or not isnan(mean_fp)")
    return x.groupBy("lineup_id").agg(F.round(F.sum("mean_fp") + 0.5 * F.max("mean_fp"), 4).alias("actual"), F.count_if(F.col("mean_fp").isNull()).alias("missing"))


@q("u1_union_all", "SELECT player, team FROM roster_entries UNION ALL SELECT player, team FROM salary_feed")
def u1(s, d):
    return table(s, d, "roster_entries").select("player", "team").unionByName(table(s, d, "salary_feed").select("player", "team"))


@q("u2_union_distinct", "SELECT player FROM roster_entries UNION SELECT player FROM salary_feed")
def u2(s, d):
    return table(s, d, "roster_entries").select("player").union(table(s, d, "salary_feed").select("player")).distinct()


@q("u3_intersect", "SELECT player FROM salary_feed INTERSECT SELECT full_name FROM espn_feed")
def u3(s, d):
    return table(s, d, "salary_feed").select("player").intersect(table(s, d, "espn_feed").select("full_name"))


@q("u4_except", "SELECT player FROM salary_feed EXCEPT SELECT full_name FROM espn_feed")
def u4(s, d):
    return table(s, d, "salary_feed").select("player").subtract(table(s, d, "espn_feed").select("full_name"))


@q("u5_ordered_distinct", "SELECT player_key, min(pool_row_id) AS first_row FROM slate_pool GROUP BY player_key")
def u5(s, d):
    return table(s, d, "slate_pool").groupBy("player_key").agg(F.min("pool_row_id").alias("first_row"))


@q("j23_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j23(s, d):
    o = table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@q("j24_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j24(s, d):
    o = table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


POS_SQL = "CASE WHEN upper(trim(pos, ' ' || chr(9))) IN ('D/ST', 'DST', 'D', 'DEF') THEN 'DEF' ELSE upper(trim(pos, ' ' || chr(9))) END"


@q("f1_normalised_pool", f"""
    WITH x AS (SELECT *, {POS_SQL} AS position FROM slate_pool),
    r AS (SELECT pool_row_id, slate_id, position, player, team, salary, row_number() OVER (PARTITION BY slate_id, player, position, team ORDER BY pool_row_id) AS k FROM x
          WHERE position IN ('QB', 'RB', 'WR', 'TE', 'DEF') AND salary > 0)
    SELECT pool_row_id, slate_id, position, player, team, salary FROM r WHERE k = 1""")
def f1(s, d):
    p = table(s, d, "slate_pool").withColumn("position", T.canonical_position(F.col("pos"))).where(F.col("position").isin("QB", "RB", "WR", "TE", "DEF") & (F.col("salary") > 0))
    return R.keep_first(p, ["slate_id", "player", "position", "team"], [F.asc("pool_row_id")]).select("pool_row_id", "slate_id", "position", "player", "team", "salary")


@q("f2_opponent", "SELECT salary_row_id, CASE WHEN team = away_team THEN home_team ELSE away_team END AS opponent FROM salary_feed")
def f2(s, d):
    return table(s, d, "salary_feed").select("salary_row_id", F.when(F.col("team") == F.col("away_team"), F.col("home_team")).otherwise(F.col("away_team")).alias("opponent"))


@q("f3_id_extraction", r"SELECT pool_row_id, TRY_CAST(nullif(regexp_extract(player_key, 'nfl\.p\.(\d+)', 1), '') AS BIGINT) AS player_no FROM slate_pool")
def f3(s, d):
    return table(s, d, "slate_pool").select("pool_row_id", F.nullif(F.regexp_extract("player_key", r"nfl\.p\.(\d+)", 1), F.lit("")).try_cast("bigint").alias("player_no"))


@q("f4_active_block", """
    WITH e AS (SELECT event_id, ts, CAST((ts - INTERVAL 8 HOUR) AS DATE) AS day FROM events),
    b AS (SELECT *, day - CAST((isodow(day) + 3) % 7 AS INTEGER) AS block FROM e),
    g AS (SELECT block, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY block),
    c AS (SELECT min(CASE WHEN last_ts + INTERVAL 6 HOUR >= TIMESTAMP '2024-01-15 12:00:00' THEN block END) AS live, max(block) AS newest FROM g)
    SELECT g.block, g.first_ts, g.last_ts, g.n FROM g, c WHERE g.block = coalesce(c.live, c.newest)""")
def f4(s, d):
    day = F.to_date(F.col("ts") - F.expr("interval 8 hours"))
    back = (F.weekday("day") + 4) % 7
    g = table(s, d, "events").withColumn("day", day).withColumn("block", F.date_sub("day", back)).groupBy("block").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    live = F.min(F.when(F.expr("last_ts + interval 6 hours >= timestamp_ntz'2024-01-15 12:00:00'"), F.col("block")))
    chosen = g.agg(F.coalesce(live, F.max("block")).alias("block"))
    return g.join(F.broadcast(chosen), "block")


@q("f5_repair_assignment", """
    SELECT slate_id, team, min(game_id) AS game_id FROM slate_pool WHERE team IS NOT NULL GROUP BY slate_id, team HAVING count(DISTINCT game_id) = 1""")
def f5(s, d):
    p = table(s, d, "slate_pool").where("team is not null")
    return p.groupBy("slate_id", "team").agg(F.min("game_id").alias("game_id"), F.max("game_id").alias("hi")).where("game_id = hi").drop("hi")


@q("f6_single_assignment", """
    SELECT slate_id, team, player, pos, count(DISTINCT game_id) AS n_games FROM slate_pool GROUP BY ALL HAVING count(DISTINCT game_id) > 1""")
def f6(s, d):
    return table(s, d, "slate_pool").groupBy("slate_id", "team", "player", "pos").agg(F.countDistinct("game_id").alias("n_games")).where("n_games > 1")


@q("f8_f9_depth_bucket", "SELECT rank_row_id, CAST(least(greatest(coalesce(depth_rank, pos_rank, 4), 1), 4) AS INTEGER) AS bucket FROM rankings")
def f8(s, d):
    return table(s, d, "rankings").select("rank_row_id", F.least(F.greatest(F.coalesce("depth_rank", "pos_rank", F.lit(4)), F.lit(1)), F.lit(4)).cast("int").alias("bucket"))


@q("f10_override", """
    WITH o AS (SELECT DISTINCT player_key, 99.5 AS forced FROM rankings WHERE role_name = 'starter' AND pos = 'K')
    SELECT rank_row_id, CAST(coalesce(o.forced, r.estimated_fp) AS DOUBLE) AS value FROM rankings r LEFT JOIN o USING (player_key)""")
def f10(s, d):
    r = table(s, d, "rankings")
    o = r.where("role_name = 'starter' and pos = 'K'").select("player_key").distinct().withColumn("forced", F.lit(99.5))
    return r.join(o, "player_key", "left").select("rank_row_id", F.coalesce("forced", "estimated_fp").alias("value"))


@q("f11_removal_reasons", """
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN player_key IS NULL THEN 'no match' WHEN kickoff_utc IS NULL THEN 'no game' WHEN estimated_fp IS NULL OR isnan(estimated_fp) THEN 'no projection' ELSE 'kept' END AS reason FROM slate_pool) GROUP BY reason""")
def f11(s, d):
    reason = F.when(F.col("player_key").isNull(), "no match").when(F.col("kickoff_utc").isNull(), "no game").when(F.col("estimated_fp").isNull() | F.isnan("estimated_fp"), "no projection").otherwise("kept")
    return table(s, d, "slate_pool").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@q("f12_match_rate", "SELECT slate_id, round(avg(CASE WHEN pos_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS rate, avg(CASE WHEN pos_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.75 AS passed FROM slate_pool GROUP BY slate_id")
def f12(s, d):
    r = F.avg(F.col("pos_rank").isNotNull().cast("double"))
    return table(s, d, "slate_pool").groupBy("slate_id").agg(F.round(r, 6).alias("rate"), (r >= 0.75).alias("passed"))


@q("f15_clean_numbers", "SELECT pool_row_id, CASE WHEN estimated_fp IS NULL OR isnan(estimated_fp) OR isinf(estimated_fp) THEN NULL ELSE estimated_fp END AS value FROM slate_pool")
def f15(s, d):
    return table(s, d, "slate_pool").select("pool_row_id", T.clean_number(F.col("estimated_fp")).alias("value"))


@q("f19_season", "SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END AS INTEGER) AS season FROM orders")
def f19(s, d):
    return table(s, d, "orders").select("o_orderkey", (F.year("o_orderdate") - (F.month("o_orderdate") < 3).cast("int")).alias("season"))


@q("f23_review_notes", """
    SELECT lineup_row_id, CASE WHEN n = '' THEN 'ok' ELSE n END AS note FROM (SELECT lineup_row_id, concat_ws('; ', CASE WHEN kickoff_utc IS NULL THEN 'no kickoff' END, CASE WHEN cbs_mean IS NULL OR isnan(cbs_mean) THEN 'one source' END, CASE WHEN depth_rank > 2 THEN 'deep role' END, CASE WHEN injury IS NOT NULL THEN 'injury: ' || injury END) AS n FROM lineup_rows)""")
def f23(s, d):
    r = table(s, d, "lineup_rows")
    n = F.concat_ws("; ", F.when(F.col("kickoff_utc").isNull(), "no kickoff"), F.when(F.col("cbs_mean").isNull() | F.isnan("cbs_mean"), "one source"), F.when(F.col("depth_rank") > 2, "deep role"), F.when(F.col("injury").isNotNull(), F.concat(F.lit("injury: "), F.col("injury"))))
    return r.select("lineup_row_id", F.when(n == "", "ok").otherwise(n).alias("note"))


@q("f26_feasibility", """
    SELECT slate_id, game_id, CASE WHEN count(*) < 5 THEN 'too few' WHEN count(DISTINCT team) <> 2 THEN 'not two teams' WHEN count(DISTINCT CASE WHEN upper(pos) NOT IN ('DEF', 'DST', 'D/ST') THEN team END) < 2 THEN 'no player' ELSE 'ok' END AS reason
    FROM slate_pool GROUP BY slate_id, game_id""")
def f26(s, d):
    g = table(s, d, "slate_pool").groupBy("slate_id", "game_id").agg(F.count("*").alias("n"), F.countDistinct("team").alias("t"), F.countDistinct(F.when(~F.upper("pos").isin("DEF", "DST", "D/ST"), F.col("team"))).alias("p"))
    return g.select("slate_id", "game_id", F.when(F.col("n") < 5, "too few").when(F.col("t") != 2, "not two teams").when(F.col("p") < 2, "no player").otherwise("ok").alias("reason"))
