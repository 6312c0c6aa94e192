"""Further joins, windows, reports and models of the inventory on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import models as MO
from ..operators import ranking as R
from ..registry import Registry
from ..session import table

registry = Registry()
q = registry.query


@q("f7_role_filter", "SELECT rank_row_id, NOT (pos = 'QB' AND coalesce(depth_rank, 1) > 1 AND player NOT LIKE 'A%') AS kept FROM rankings")
def f7(s, d):
    removed = (F.col("pos") == "QB") & (F.coalesce("depth_rank", F.lit(1)) > 1) & ~F.col("player").like("A%")
    return table(s, d, "rankings").select("rank_row_id", (~removed).alias("kept"))


@q("f13_unique_secondary", """
    WITH p AS (SELECT player_key, list_sort(list(DISTINCT upper(pos))) AS ps FROM slate_pool WHERE pos IS NOT NULL AND upper(pos) IN ('QB', 'RB', 'WR', 'TE', 'DEF') GROUP BY player_key)
    SELECT player_key, CASE WHEN len(ps) = 1 THEN ps[1] END AS pos FROM p""")
def f13(s, d):
    p = table(s, d, "slate_pool").where(F.upper("pos").isin("QB", "RB", "WR", "TE", "DEF")).groupBy("player_key").agg(F.collect_set(F.upper("pos")).alias("ps"))
    return p.select("player_key", F.when(F.size("ps") == 1, F.get("ps", F.lit(0))).alias("pos"))


@q("f14_close_names", """
    WITH s AS (SELECT DISTINCT player, lower(replace(strip_accents(player), chr(160), ' ')) AS a FROM salary_feed WHERE player IS NOT NULL), e AS (SELECT DISTINCT full_name, lower(replace(strip_accents(full_name), chr(160), ' ')) AS b FROM espn_feed WHERE full_name IS NOT NULL),
    m AS (SELECT player, full_name, levenshtein(a, b) AS edits FROM s JOIN e ON abs(len(a) - len(b)) <= 4 WHERE levenshtein(a, b) BETWEEN 1 AND 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY edits, full_name) AS k FROM m)
    SELECT player, full_name, CAST(edits AS INTEGER) AS edits FROM r WHERE k <= 3""")
def f14(s, d):
    plain = lambda c: F.lower(F.translate(T.strip_marks(F.col(c)), '\u00a0', ' '))
    a = table(s, d, "salary_feed").where("player is not null").select("player", plain("player").alias("a")).distinct()
    b = table(s, d, "espn_feed").where("full_name is not null").select("full_name", plain("full_name").alias("b")).distinct()
    m = M.close_pairs(a.select("a"), b.select("b"), 4).where("edits >= 1").join(a, "a").join(b, "b")
    return R.ranked_top_n(m, ["player"], [F.asc("edits"), F.asc("full_name")], 3).select("player", "full_name", "edits")


@q("f24_structure_flags", """
    SELECT lineup_id, coalesce(bool_or(depth_rank > 2), FALSE) AS deep_role, coalesce(sum(salary) < 180, FALSE) AS budget_left, coalesce(bool_or(pos = 'DEF'), FALSE) AS has_defence FROM lineup_rows GROUP BY lineup_id""")
def f24(s, d):
    return table(s, d, "lineup_rows").groupBy("lineup_id").agg(F.coalesce(F.bool_or(F.col("depth_rank") > 2), F.lit(False)).alias("deep_role"), F.coalesce(F.sum("salary") < 180, F.lit(False)).alias("budget_left"), F.coalesce(F.bool_or(F.col("pos") == "DEF"), F.lit(False)).alias("has_defence"))


@q("f25_construction_labels", """
    WITH c AS (SELECT lineup_id, team, count(*) AS n FROM lineup_rows WHERE team IS NOT NULL GROUP BY ALL)
    SELECT lineup_id, string_agg(team || ' ' || n, ', ' ORDER BY n DESC, team) AS split FROM c GROUP BY lineup_id""")
def f25(s, d):
    c = table(s, d, "lineup_rows").where("team is not null").groupBy("lineup_id", "team").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "team"))), lambda x: F.concat_ws(" ", x["team"], (-x["k"]).cast("string")))
    return c.groupBy("lineup_id").agg(F.concat_ws(", ", parts).alias("split"))


UNIQUE_NAMES = """
    e AS (SELECT espn_row_id, full_name AS player, team_code AS team, CASE default_position_id WHEN 1 THEN 'QB' WHEN 2 THEN 'RB' WHEN 3 THEN 'WR' WHEN 4 THEN 'TE' WHEN 5 THEN 'K' WHEN 16 THEN 'DEF' END AS pos FROM espn_feed LEFT JOIN teams ON pro_team_id = espn_pro_team_id)"""


@q("j2_external_id_then_name", f"""
    WITH {UNIQUE_NAMES},
    u AS (SELECT team, min(espn_row_id) AS m1 FROM e WHERE pos = 'DEF' AND team IS NOT NULL GROUP BY team HAVING count(*) = 1),
    t AS (SELECT player, team, pos, min(espn_row_id) AS m2 FROM e WHERE player IS NOT NULL AND team IS NOT NULL AND pos IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
    n AS (SELECT player, pos, min(espn_row_id) AS m3 FROM e WHERE player IS NOT NULL AND pos IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
    SELECT salary_row_id, coalesce(m1, m2, m3) AS matched, CAST(CASE WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 WHEN m3 IS NOT NULL THEN 3 END AS INTEGER) AS matched_by
    FROM salary_feed s LEFT JOIN u ON s.pos = 'DEF' AND s.team = u.team LEFT JOIN t ON s.player = t.player AND s.team = t.team AND s.pos = t.pos LEFT JOIN n ON s.player = n.player AND s.pos = n.pos""")
def j2(s, d):
    codes = table(s, d, "teams").select(F.col("espn_pro_team_id").alias("pro_team_id"), F.col("team_code").alias("team"))
    pos = F.element_at(F.create_map(*[x for k, v in {1: "QB", 2: "RB", 3: "WR", 4: "TE", 5: "K", 16: "DEF"}.items() for x in (F.lit(k), F.lit(v))]), F.col("default_position_id"))
    unit = F.when(F.col("pos") == "DEF", F.col("team")).alias("unit")
    e = table(s, d, "espn_feed").join(codes, "pro_team_id", "left").select("espn_row_id", F.col("full_name").alias("player"), "team", pos.alias("pos")).select("*", unit)
    f = table(s, d, "salary_feed").select("salary_row_id", "player", "team", "pos", unit)
    return M.cascade_match(f, e, "espn_row_id", [["unit"], ["player", "team", "pos"], ["player", "pos"]]).select("salary_row_id", "matched", "matched_by")


@q("j6_best_coverage", """
    WITH c AS (SELECT scoring_period_id AS period, count(DISTINCT pro_team_id) AS teams, count(applied_total) AS filled FROM espn_feed GROUP BY ALL)
    SELECT period, teams, filled FROM c ORDER BY teams DESC, filled DESC, period LIMIT 1""")
def j6(s, d):
    c = table(s, d, "espn_feed").groupBy(F.col("scoring_period_id").alias("period")).agg(F.countDistinct("pro_team_id").alias("teams"), F.count("applied_total").alias("filled"))
    return c.orderBy(F.desc("teams"), F.desc("filled"), "period").limit(1)


@q("j7_narrowing_match", """
    WITH c AS (SELECT r.entry_id, s.salary_row_id, row_number() OVER (PARTITION BY r.entry_id ORDER BY coalesce(s.team = r.team, FALSE) DESC, coalesce(s.pos = r.pos, FALSE) DESC, CASE WHEN isnan(s.fppg) THEN NULL ELSE s.fppg END DESC NULLS LAST, s.salary_row_id) AS k
               FROM roster_entries r JOIN salary_feed s ON r.player = s.player)
    SELECT entry_id, salary_row_id FROM c WHERE k = 1""")
def j7(s, d):
    r = table(s, d, "roster_entries").select("entry_id", "player", F.col("pos").alias("p"), F.col("team").alias("t"))
    x = r.join(table(s, d, "salary_feed").select("salary_row_id", "player", "pos", "team", "fppg"), "player")
    same = lambda a, b: F.desc(F.coalesce(F.col(a) == F.col(b), F.lit(False)))
    return R.keep_first(x, ["entry_id"], [same("team", "t"), same("pos", "p"), F.desc_nulls_last(T.clean_number(F.col("fppg"))), F.asc("salary_row_id")]).select("entry_id", "salary_row_id")


@q("j15_team_precedence", """
    WITH a AS (SELECT player, min(team) AS t1 FROM slate_pool WHERE team IS NOT NULL GROUP BY player), b AS (SELECT player, min(team) AS t2 FROM roster_entries WHERE team IS NOT NULL GROUP BY player)
    SELECT salary_row_id, coalesce(t1, t2, team) AS team, CASE WHEN t1 IS NOT NULL THEN 'stats' WHEN t2 IS NOT NULL THEN 'roster' WHEN team IS NOT NULL THEN 'feed' ELSE 'unresolved' END AS source
    FROM salary_feed LEFT JOIN a USING (player) LEFT JOIN b USING (player)""")
def j15(s, d):
    one = lambda n, c: table(s, d, n).where("team is not null").groupBy("player").agg(F.min("team").alias(c))
    x = table(s, d, "salary_feed").join(one("slate_pool", "t1"), "player", "left").join(one("roster_entries", "t2"), "player", "left")
    src = F.when(F.col("t1").isNotNull(), "stats").when(F.col("t2").isNotNull(), "roster").when(F.col("team").isNotNull(), "feed").otherwise("unresolved")
    return x.select("salary_row_id", F.coalesce("t1", "t2", "team").alias("team"), src.alias("source"))


@q("j17_best_series", """
    WITH m AS (SELECT l.lineup_id, b.board_id, count(DISTINCT l.player_key) AS matched FROM lineup_rows l JOIN (SELECT DISTINCT board_id, player FROM rankings) b ON l.player = b.player GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lineup_id ORDER BY matched DESC, board_id DESC) AS k FROM m) SELECT lineup_id, board_id, matched FROM r WHERE k = 1""")
def j17(s, d):
    b = table(s, d, "rankings").select("board_id", "player").distinct()
    m = table(s, d, "lineup_rows").join(b, "player").groupBy("lineup_id", "board_id").agg(F.countDistinct("player_key").alias("matched"))
    best = m.groupBy("lineup_id").agg(F.max(F.struct("matched", "board_id")).alias("b"))
    return best.select("lineup_id", "b.board_id", "b.matched")


@q("j18_provider_merge", """
    WITH k AS (SELECT quote_id, player_key, provider, CAST(floor((epoch_us(kickoff_utc) + 30000000) / 60000000) AS BIGINT) AS token FROM market_quotes WHERE player_key IS NOT NULL AND kickoff_utc IS NOT NULL AND provider IS NOT NULL),
    f AS (SELECT min(provider) AS first FROM k), b AS (SELECT player_key, token, count(*) AS n, min(quote_id) AS one FROM k, f WHERE provider = first GROUP BY ALL)
    SELECT k.quote_id, CASE WHEN k.provider <> f.first AND b.n = 1 THEN b.one END AS merged_into FROM k CROSS JOIN f LEFT JOIN b ON k.player_key = b.player_key AND k.token = b.token""")
def j18(s, d):
    """Quotes of other providers with the one of the first provider for the same player and minute; with none or several they stand alone."""
    k = table(s, d, "market_quotes").where("player_key is not null and kickoff_utc is not null and provider is not null")
    k = k.select("quote_id", "player_key", "provider", F.floor((F.unix_micros(F.col("kickoff_utc").cast("timestamp")) + 30_000_000) / 60_000_000).cast("long").alias("token"))
    first = k.agg(F.min("provider").alias("first"))
    k = k.crossJoin(F.broadcast(first))
    b = k.where("provider = first").groupBy("player_key", "token").agg(F.count("*").alias("n"), F.min("quote_id").alias("one"))
    return k.join(b, ["player_key", "token"], "left").select("quote_id", F.when((F.col("provider") != F.col("first")) & (F.col("n") == 1), F.col("one")).alias("merged_into"))


@q("j19_ladder_merge", """
    SELECT player_key, count(market_mean) AS n, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, max(market_props) AS props FROM market_quotes WHERE player_key IS NOT NULL AND (market_mean IS NULL OR NOT isnan(market_mean)) GROUP BY player_key""")
def j19(s, d):
    x = table(s, d, "market_quotes").where("player_key is not null and (market_mean is null or not isnan(market_mean))")
    providers = F.array_join(F.array_sort(F.collect_set("provider")), ",")
    return x.groupBy("player_key").agg(F.count("market_mean").alias("n"), F.nullif(providers, F.lit("")).alias("providers"), F.max("market_props").alias("props"))


@q("j26_environment", """
    WITH t AS (SELECT run_date, team, sum(mean_fp) AS total, count(*) AS n FROM lineup_rows WHERE team IS NOT NULL AND (mean_fp IS NULL OR NOT isnan(mean_fp)) AND pos <> 'RB' GROUP BY ALL)
    SELECT l.lineup_row_id, round(t.total, 6) AS other_fp, t.n FROM lineup_rows l LEFT JOIN t ON l.run_date = t.run_date AND l.team = t.team WHERE l.pos = 'RB'""")
def j26(s, d):
    r = table(s, d, "lineup_rows")
    t = r.where("team is not null and (mean_fp is null or not isnan(mean_fp)) and pos <> 'RB'").groupBy("run_date", "team").agg(F.round(F.sum("mean_fp"), 6).alias("other_fp"), F.count("*").alias("n"))
    return r.where("pos = 'RB'").join(t, ["run_date", "team"], "left").select("lineup_row_id", "other_fp", "n")


@q("a8_compact_metrics", "SELECT slot, count(*) AS n, round(avg(abs(floor_fp - mean_fp)), 7) AS mae, round(corr(floor_fp, mean_fp), 7) AS correlation FROM lineup_rows WHERE floor_fp IS NOT NULL AND mean_fp IS NOT NULL AND NOT isnan(mean_fp) AND NOT isnan(floor_fp) GROUP BY slot")
def a8(s, d):
    x = table(s, d, "lineup_rows").where("not isnan(mean_fp) and not isnan(floor_fp)")
    m = E.error_metrics(x, ["slot"], "mean_fp", "floor_fp")
    return m.select("slot", "n", F.round("mae", 7).alias("mae"), F.round("correlation", 7).alias("correlation"))


@q("a24_by_status", "SELECT coalesce(injury, 'none') AS status, count(*) AS n, round(avg(salary), 6) AS salary FROM lineup_rows GROUP BY ALL")
def a24(s, d):
    return table(s, d, "lineup_rows").groupBy(F.coalesce("injury", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("salary"), 6).alias("salary"))


@q("w5_w6_salary_depth", "SELECT pool_row_id, CAST(row_number() OVER (PARTITION BY slate_id, team, pos ORDER BY salary DESC NULLS LAST, pool_row_id) AS INTEGER) AS depth FROM slate_pool")
def w5(s, d):
    return R.ranked_top_n(table(s, d, "slate_pool"), ["slate_id", "team", "pos"], [F.desc_nulls_last("salary"), F.asc("pool_row_id")], None, "depth").select("pool_row_id", "depth")


@q("w11_bounded_history", """
    SELECT o.o_orderkey, count(h.o_orderkey) AS n FROM orders o LEFT JOIN orders h ON h.o_custkey = o.o_custkey AND h.o_orderdate < o.o_orderdate AND h.o_orderdate >= o.o_orderdate - INTERVAL 730 DAY GROUP BY o.o_orderkey""")
def w11(s, d):
    day = F.unix_date(F.to_date("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy("_day").rangeBetween(-730, -1)
    return table(s, d, "orders").withColumn("_day", day).select("o_orderkey", F.count("*").over(w).alias("n"))


@q("w13_group_transform", "SELECT rank_row_id, count(estimated_fp) OVER (PARTITION BY board_id, pos) AS n, max(estimated_fp) OVER (PARTITION BY board_id, pos) AS best FROM rankings")
def w13(s, d):
    w = Window.partitionBy("board_id", "pos")
    return table(s, d, "rankings").select("rank_row_id", F.count("estimated_fp").over(w).alias("n"), F.max("estimated_fp").over(w).alias("best"))


@q("w15_split_half", """
    WITH h AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (WHERE l_orderkey % 2 = 0) AS a, avg(l_extendedprice) FILTER (WHERE l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY l_suppkey),
    r AS (SELECT corr(a, b) AS r, count(*) AS n FROM h),
    o AS (SELECT count(*) AS k FROM (SELECT l_suppkey FROM h ORDER BY a DESC, l_suppkey LIMIT 20) JOIN (SELECT l_suppkey FROM h ORDER BY b DESC, l_suppkey LIMIT 20) USING (l_suppkey))
    SELECT n, round(r, 7) AS half_r, round(2 * r / (1 + r), 7) AS reliability, k AS top_overlap FROM r, o""")
def w15(s, d):
    half = lambda k: F.avg(F.when(F.col("l_orderkey") % 2 == k, F.col("l_extendedprice")))
    h = table(s, d, "lineitem").groupBy("l_suppkey").agg(half(0).alias("a"), half(1).alias("b"))
    return MO.split_half(h, "l_suppkey", "a", "b", 20).select("n", F.round("half_r", 7).alias("half_r"), F.round("reliability", 7).alias("reliability"), "top_overlap")


@q("t1_total_order", "SELECT lineup_row_id, mean_fp, salary FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) ORDER BY mean_fp DESC, salary DESC, lineup_row_id LIMIT 50")
def t1(s, d):
    return table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)").orderBy(F.desc("mean_fp"), F.desc("salary"), "lineup_row_id").limit(50).select("lineup_row_id", "mean_fp", "salary")


@q("t9_nulls_last", "SELECT lineup_row_id, kickoff_utc FROM lineup_rows ORDER BY kickoff_utc ASC NULLS LAST, lineup_row_id")
def t9(s, d):
    return table(s, d, "lineup_rows").orderBy(F.asc_nulls_last("kickoff_utc"), "lineup_row_id").select("lineup_row_id", "kickoff_utc")


@q("m5_grid_search")
def m5(s, d):
    x = table(s, d, "lineitem").select(F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 5 == 0).alias("held"))
    return MO.grid_search(x, "x1", "y", "held", [1, 2, 3], [0.0, 1.0, 10.0, 100.0])


@q("m6_shrunken_slopes", """
    SELECT l_linenumber, count(*) AS n, round(least(greatest(sum((l_quantity - 25) * (l_extendedprice - 37000)) / (sum((l_quantity - 25) * (l_quantity - 25)) + 25), 0), 5000), 5) AS slope FROM lineitem GROUP BY l_linenumber""")
def m6(s, d):
    return MO.shrunken_slopes(table(s, d, "lineitem"), ["l_linenumber"], F.col("l_quantity") - 25, F.col("l_extendedprice") - 37000, 25.0, 0.0, 5000.0).select("l_linenumber", "n", F.round("slope", 5).alias("slope"))


@q("m11_fallback_models", """
    WITH g AS (SELECT pos, count(*) AS n, regr_slope(mean_fp, salary) AS s, regr_intercept(mean_fp, salary) AS i FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY pos),
    a AS (SELECT regr_slope(mean_fp, salary) AS s, regr_intercept(mean_fp, salary) AS i FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp))
    SELECT g.pos, g.n, round(CASE WHEN g.n >= 200 THEN g.s ELSE a.s END, 7) AS slope, round(CASE WHEN g.n >= 200 THEN g.i ELSE a.i END, 6) AS intercept FROM g, a""")
def m11(s, d):
    x = table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)")
    return MO.lines_with_fallback(x, "pos", "salary", "mean_fp", 200).select("pos", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"))


@q("m13_component_sums", """
    WITH w AS (SELECT * FROM (VALUES ('A', 1.5), ('N', 0.5), ('R', -1.0)) t(l_returnflag, weight))
    SELECT l_suppkey, round(sum(l_quantity * CAST(weight AS DOUBLE)), 6) AS points FROM lineitem JOIN w USING (l_returnflag) GROUP BY l_suppkey""")
def m13(s, d):
    w = s.createDataFrame([("A", 1.5), ("N", 0.5), ("R", -1.0)], "l_returnflag string, weight double")
    return table(s, d, "lineitem").join(F.broadcast(w), "l_returnflag").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("weight")), 6).alias("points"))


@q("m19_leave_one_group_out", """
    WITH g AS (SELECT l_linenumber AS g, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
    SELECT a.g, round(regr_slope(b.l_extendedprice, b.l_quantity), 5) AS slope, count(*) AS n FROM g a JOIN lineitem b ON b.l_linenumber <> a.g GROUP BY a.g""")
def m19(s, d):
    x = table(s, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return MO.slopes_without_group(x, "g", "x", "y").select("g", F.round("slope", 5).alias("slope"), "n")


@q("m21_correlation_bounds", """
    WITH p AS (SELECT p_partkey, sqrt(ln(1 + pow(0.5e0 + p_size / 50e0, 2))) AS s FROM part)
    SELECT p_partkey, round((exp(-s * s / 2) - 1) / sqrt((exp(s * s) - 1) * (exp(s * s / 4) - 1)), 8) AS low, round((exp(s * s / 2) - 1) / sqrt((exp(s * s) - 1) * (exp(s * s / 4) - 1)), 8) AS high FROM p""")
def m21(s, d):
    sigma = F.expr("sqrt(ln(1 + pow(0.5e0 + p_size / 50e0, 2)))")
    low, high = MO.lognormal_bounds(F.col("s"), F.col("s") / 2)
    return table(s, d, "part").select("p_partkey", sigma.alias("s")).select("p_partkey", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@q("m23_m25_hurdle_latent")
def m23(s, d):
    cells = table(s, d, "part").select(F.expr("round(0.5e0 + p_size / 50e0, 1)").alias("cv"), F.expr("round(p_size / 500e0, 2)").alias("zero")).distinct()
    return MO.hurdle_latent(cells, "cv", "zero", 0.3).select("cv", "zero", F.round("latent", 6).alias("latent"), F.round("back", 6).alias("back"))


@q("m44_head_to_head", """
    WITH p AS (SELECT event_id, value FROM events WHERE event_type = 'purchase'), o AS (SELECT value AS v FROM events WHERE event_type = 'click'),
    c AS (SELECT p.event_id, sum(CASE WHEN o.v < p.value THEN 1.0 WHEN o.v = p.value THEN 0.5 ELSE 0 END) AS w, count(*) AS n FROM p, o GROUP BY p.event_id)
    SELECT event_id, round(CAST(w / n AS DOUBLE), 9) AS chance FROM c""")
def m44(s, d):
    e = table(s, d, "events")
    return MO.win_chance(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "event_id", "value").select("event_id", F.round("chance", 9).alias("chance"))


@q("m47_kickoff_locks", "SELECT lineup_row_id FROM lineup_rows WHERE kickoff_utc <= TIMESTAMP '2026-10-20 00:00:00' AND run_date >= DATE '2026-10-01'")
def m47(s, d):
    return table(s, d, "lineup_rows").where("kickoff_utc <= timestamp_ntz'2026-10-20 00:00:00' and run_date >= date'2026-10-01'").select("lineup_row_id")


@q("m51_marginal_checks", """
    SELECT pos, round(avg(mean_fp), 7) AS mean, round(stddev_pop(mean_fp) / avg(mean_fp), 7) AS cv, CASE WHEN abs(stddev_pop(mean_fp) / avg(mean_fp) - 0.45) <= 0.2 THEN 'PASS' ELSE 'REVIEW' END AS verdict
    FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY pos""")
def m51(s, d):
    cv = F.stddev_pop("mean_fp") / F.avg("mean_fp")
    return table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)").groupBy("pos").agg(F.round(F.avg("mean_fp"), 7).alias("mean"), F.round(cv, 7).alias("cv"), F.when(F.abs(cv - 0.45) <= 0.2, "PASS").otherwise("REVIEW").alias("verdict"))


@q("m53_hindsight_best", "SELECT run_date, round(max(t), 4) AS best FROM (SELECT run_date, lineup_id, sum(mean_fp) + 0.5 * max(mean_fp) AS t FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY ALL) GROUP BY run_date")
def m53(s, d):
    t = table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)").groupBy("run_date", "lineup_id").agg((F.sum("mean_fp") + 0.5 * F.max("mean_fp")).alias("t"))
    return t.groupBy("run_date").agg(F.round(F.max("t"), 4).alias("best"))


@q("x22_signed_hurdle", f"SELECT p_partkey, round(CASE WHEN u < 0.05e0 THEN -1e0 WHEN u < 0.15e0 THEN 0e0 ELSE {D.hurdle_sql('((u - 0.15e0) / 0.85e0)', '10e0', '0.8e0', '0e0')} END, 6) AS v FROM (SELECT p_partkey, {D.uniform_sql('9', 'p_partkey', engine='duckdb')} AS u FROM part)")
def x22(s, d):
    u = table(s, d, "part").select("p_partkey", F.expr(D.uniform_sql("9", "p_partkey")).alias("u"))
    v = F.when(F.col("u") < 0.05, -1.0).when(F.col("u") < 0.15, 0.0).otherwise(F.expr(D.hurdle_sql("((u - 0.15e0) / 0.85e0)", "10e0", "0.8e0", "0e0")))
    return u.select("p_partkey", F.round(v, 6).alias("v"))


@q("x27_interpolated_ladder", """
    WITH g AS (SELECT l_linenumber AS t, avg(l_discount) * 5 AS p FROM lineitem GROUP BY l_linenumber), l AS (SELECT t, p, lead(p) OVER (ORDER BY t) AS q FROM g)
    SELECT t + 0.5e0 AS t, round(1 / (1 + exp(-((ln(p / (1 - p)) + ln(q / (1 - q))) / 2))), 9) AS p FROM l WHERE q IS NOT NULL""")
def x27(s, d):
    g = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("t")).agg((F.avg("l_discount") * 5).alias("p"))
    l = g.withColumn("q", F.lead("p").over(Window.orderBy("t"))).where("q is not null")
    logit = lambda c: F.ln(F.col(c) / (1 - F.col(c)))
    return l.select((F.col("t") + 0.5).alias("t"), F.round(1 / (1 + F.exp(-(logit("p") + logit("q")) / 2)), 9).alias("p"))


@q("x33_x34_props_summary", """
    SELECT l_orderkey, 'Qty ' || CAST(CAST(round(2 * avg(l_quantity)) AS BIGINT) AS VARCHAR) || '/2 · n ' || count(*) AS summary FROM lineitem GROUP BY l_orderkey""")
def x33(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Qty "), F.round(2 * F.avg("l_quantity")).cast("long").cast("string"), F.lit("/2 · n "), F.count("*").cast("string")).alias("summary"))


@q("x35_player_keys", "SELECT salary_row_id, coalesce('feed:' || nullif(regexp_extract(player_code, '(\\d+)$', 1), ''), coalesce(team, 'UNK') || ':' || lower(player)) AS player_key FROM salary_feed")
def x35(s, d):
    code = F.nullif(F.regexp_extract("player_code", r"(\d+)$", 1), F.lit(""))
    return table(s, d, "salary_feed").select("salary_row_id", F.coalesce(F.concat(F.lit("feed:"), code), F.concat(F.coalesce("team", F.lit("UNK")), F.lit(":"), F.lower("player"))).alias("player_key"))


@q("x39_published_means", "SELECT quote_id, CASE WHEN market_quality IN ('good', 'fair') AND NOT isnan(market_mean) THEN market_mean END AS mean FROM market_quotes")
def x39(s, d):
    return table(s, d, "market_quotes").select("quote_id", F.when(F.col("market_quality").isin("good", "fair"), T.clean_number(F.col("market_mean"))).alias("mean"))


@q("x40_cutoffs", "SELECT DISTINCT week_no, TIMESTAMP '2026-09-01 17:00:00' + INTERVAL 7 DAY * week_no AS cutoff FROM documents WHERE week_no IS NOT NULL")
def x40(s, d):
    return table(s, d, "documents").where("week_no is not null").select("week_no", F.expr("timestampadd(DAY, 7 * week_no, timestamp_ntz'2026-09-01 17:00:00')").alias("cutoff")).distinct()


@q("y8_lineup_summary", """
    SELECT lineup_id, string_agg(player, ', ' ORDER BY mean_fp DESC, lineup_row_id) AS players, round(sum(mean_fp), 4) AS total, sum(salary)::BIGINT AS spent FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY lineup_id""")
def y8(s, d):
    x = table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)")
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean_fp")).alias("k"), "lineup_row_id", "player"))), lambda r: r["player"])
    return x.groupBy("lineup_id").agg(F.array_join(names, ", ").alias("players"), F.round(F.sum("mean_fp"), 4).alias("total"), F.sum("salary").alias("spent"))


@q("y9_slot_rows", "SELECT lineup_id, slot, player, CASE WHEN row_number() OVER (PARTITION BY lineup_id ORDER BY mean_fp DESC NULLS LAST, lineup_row_id) = 1 THEN 1.5e0 ELSE 1e0 END AS multiplier FROM lineup_rows WHERE mean_fp IS NULL OR NOT isnan(mean_fp)")
def y9(s, d):
    x = R.ranked_top_n(table(s, d, "lineup_rows").where("mean_fp is null or not isnan(mean_fp)"), ["lineup_id"], [F.desc_nulls_last("mean_fp"), F.asc("lineup_row_id")], None, "k")
    return x.select("lineup_id", "slot", "player", F.when(F.col("k") == 1, 1.5).otherwise(1.0).alias("multiplier"))


@q("y27_rank_bounds", "SELECT p_partkey, (SELECT count(*) FROM supplier WHERE s_acctbal < p_retailprice) AS below, (SELECT count(*) FROM supplier WHERE s_acctbal <= p_retailprice) AS upto FROM part")
def y27(s, d):
    return MO.rank_bounds(table(s, d, "part"), "p_partkey", "p_retailprice", table(s, d, "supplier"), "s_acctbal")


@q("y38_date_range", "SELECT min(CAST(kickoff_utc AS DATE)) AS lo, max(CAST(kickoff_utc AS DATE)) + 1 AS hi FROM lineup_rows")
def y38(s, d):
    return table(s, d, "lineup_rows").agg(F.min(F.to_date("kickoff_utc")).alias("lo"), F.date_add(F.max(F.to_date("kickoff_utc")), 1).alias("hi"))


@q("y52_residuals", """
    WITH f AS (SELECT l_linenumber AS g, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY ALL)
    SELECT l_linenumber AS g, round(sum(abs(l_extendedprice - i - s * l_quantity)), 2) AS spread FROM lineitem JOIN f ON l_linenumber = g GROUP BY l_linenumber""")
def y52(s, d):
    x = table(s, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return MO.residuals(x, ["g"], "x", "y").groupBy("g").agg(F.round(F.sum(F.abs("residual")), 2).alias("spread"))


@q("y61_expanding_cutoffs", """
    WITH w AS (SELECT week_no, min(published_utc) AS cutoff FROM documents WHERE week_no IS NOT NULL AND published_utc IS NOT NULL GROUP BY week_no)
    SELECT w.week_no, count(d.doc_id) AS known FROM w LEFT JOIN documents d ON d.published_utc + INTERVAL 24 HOUR < w.cutoff GROUP BY w.week_no""")
def y61(s, d):
    x = table(s, d, "documents")
    return MO.known_before(x.where("week_no is not null and published_utc is not null").groupBy("week_no").agg(F.min("published_utc").alias("cutoff")), "week_no", "cutoff", x, "published_utc", 24)


@q("y62_retention", "WITH l AS (SELECT DISTINCT run_date, player_key FROM lineup_rows WHERE player_key IS NOT NULL) SELECT a.run_date AS a, b.run_date AS b, count(*) AS shared FROM l a JOIN l b ON a.player_key = b.player_key AND b.run_date = a.run_date + 1 GROUP BY ALL")
def y62(s, d):
    l = table(s, d, "lineup_rows").where("player_key is not null").select("run_date", "player_key").distinct()
    nxt = l.select(F.date_sub("run_date", 1).alias("a"), F.col("run_date").alias("b"), "player_key")
    return l.withColumnRenamed("run_date", "a").join(nxt, ["a", "player_key"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


@q("y64_two_level_means", "SELECT pos, round(avg(m), 7) AS mean FROM (SELECT pos, lineup_id, avg(mean_fp) AS m FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) GROUP BY ALL) GROUP BY pos")
def y64(s, d):
    m = table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)").groupBy("pos", "lineup_id").agg(F.avg("mean_fp").alias("m"))
    return m.groupBy("pos").agg(F.round(F.avg("m"), 7).alias("mean"))


@q("y71_game_token", "SELECT quote_id, CASE WHEN kickoff_utc IS NOT NULL THEN 'm:' || CAST((epoch_us(kickoff_utc) + 30000000) // 60000000 AS VARCHAR) ELSE 'p:' || lower(coalesce(provider, '')) END AS token FROM market_quotes")
def y71(s, d):
    minute = F.floor((F.unix_micros(F.col("kickoff_utc").cast("timestamp")) + 30_000_000) / 60_000_000).cast("string")
    return table(s, d, "market_quotes").select("quote_id", F.when(F.col("kickoff_utc").isNotNull(), F.concat(F.lit("m:"), minute)).otherwise(F.concat(F.lit("p:"), F.lower(F.coalesce("provider", F.lit(""))))).alias("token"))
