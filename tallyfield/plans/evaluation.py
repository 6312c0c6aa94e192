"""Aggregations, forecast evaluation, calibration and fits on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from ..operators import evaluation as E
from ..operators import fits as X
from ..operators import ranking as R
from ..registry import Registry
from ..session import table

registry = Registry()
q = registry.query

FORECAST_SQL = "SELECT pos, run_date, lineup_id, lineup_row_id, mean_fp AS forecast, floor_fp, ceiling_fp, cbs_mean AS actual FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp) AND cbs_mean IS NOT NULL AND NOT isnan(cbs_mean)"


def forecasts(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp) and cbs_mean is not null and not isnan(cbs_mean)")
    return r.select("pos", "run_date", "lineup_id", "lineup_row_id", F.col("mean_fp").alias("forecast"), "floor_fp", "ceiling_fp", F.col("cbs_mean").alias("actual"))


@q("a1_min_max", "SELECT slate_id, game_id, min(captured_utc) AS first_capture, max(captured_utc) AS last_capture FROM slate_pool GROUP BY ALL")
def a1(s, d):
    return table(s, d, "slate_pool").groupBy("slate_id", "game_id").agg(F.min("captured_utc").alias("first_capture"), F.max("captured_utc").alias("last_capture"))


@q("a2_distinct_counts", "SELECT slate_id, count(DISTINCT player_key) AS players, count(DISTINCT team) AS teams FROM slate_pool GROUP BY slate_id")
def a2(s, d):
    return table(s, d, "slate_pool").groupBy("slate_id").agg(F.countDistinct("player_key").alias("players"), F.countDistinct("team").alias("teams"))


@q("a3_value_counts", "SELECT projection_method, count(*) AS n FROM rankings GROUP BY ALL")
def a3(s, d):
    return table(s, d, "rankings").groupBy("projection_method").agg(F.count("*").alias("n"))


@q("a4_median_scale", f"""
    WITH f AS ({FORECAST_SQL}) SELECT pos, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN quantile_cont(actual / forecast, 0.5) ELSE 1 END, 9) AS scale FROM f WHERE forecast <> 0 GROUP BY pos""")
def a4(s, d):
    return E.median_scale(forecasts(s, d), "pos", "forecast", "actual", 8).select("pos", "n", F.round("scale", 9).alias("scale"))


@q("a6_named_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 4) AS middle, max(abs(l_discount - 0.05)) AS widest, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def a6(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.percentile("l_extendedprice", 0.5), 4).alias("middle"), F.max(F.abs(F.col("l_discount") - 0.05)).alias("widest"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@q("a7_error_metrics", f"""
    WITH f AS ({FORECAST_SQL}) SELECT pos, count(*) AS n, round(avg(abs(forecast - actual)), 8) AS mae, round(sqrt(avg((forecast - actual) * (forecast - actual))), 8) AS rmse, round(avg(forecast - actual), 8) AS bias,
    round(corr(actual, forecast), 8) AS correlation, round(regr_slope(actual, forecast), 8) AS slope FROM f GROUP BY pos""")
def a7(s, d):
    m = E.error_metrics(forecasts(s, d), ["pos"], "actual", "forecast")
    return m.select("pos", "n", *[F.round(c, 8).alias(c) for c in ("mae", "rmse", "bias", "correlation", "slope")])


@q("a9_overall_and_by_position", f"""
    WITH f AS ({FORECAST_SQL}) SELECT pos, count(*) AS n, round(avg(abs(forecast - actual)), 8) AS mae, round(avg(CASE WHEN actual <= floor_fp THEN 1.0 ELSE 0.0 END), 8) AS below_floor, round(avg(CASE WHEN actual <= ceiling_fp THEN 1.0 ELSE 0.0 END), 8) AS below_ceiling
    FROM f GROUP BY GROUPING SETS ((), (pos))""")
def a9(s, d):
    below = lambda c: F.round(F.avg(F.coalesce((F.col("actual") <= F.col(c)).cast("double"), F.lit(0.0))), 8)
    return E.with_overall(forecasts(s, d), "pos", F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("forecast") - F.col("actual"))), 8).alias("mae"), below("floor_fp").alias("below_floor"), below("ceiling_fp").alias("below_ceiling"))


@q("a10_rate_with_error", """
    WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY ALL HAVING count(*) >= 150)
    SELECT l_returnflag, l_linestatus, n, round(rate, 9) AS rate, round(sqrt(rate * (1 - rate) / n), 9) AS se FROM g""")
def a10(s, d):
    g = E.rate_with_error(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") == 0, 150)
    return g.select("l_returnflag", "l_linestatus", "n", F.round("rate", 9).alias("rate"), F.round("se", 9).alias("se"))


@q("a11_fisher_interval", """
    WITH g AS (SELECT p_brand, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) >= 300)
    SELECT p_brand, n, round(r, 8) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 8) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 8) AS high FROM g""")
def a11(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = E.fisher_interval(x, ["p_brand"], "l_quantity", "l_extendedprice", 300)
    return g.select("p_brand", "n", *[F.round(c, 8).alias(c) for c in ("r", "low", "high")])


@q("a12_pivot_correlations", """
    WITH p AS (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, sum(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS b, sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS c FROM orders GROUP BY o_custkey)
    SELECT round(corr(a, b), 7) AS ab, round(corr(a, c), 7) AS ac, round(corr(b, c), 7) AS bc, count(*) AS n FROM p""")
def a12(s, d):
    p = table(s, d, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.sum("o_totalprice")).toDF("o_custkey", "a", "b", "c")
    return p.agg(F.round(F.corr("a", "b"), 7).alias("ab"), F.round(F.corr("a", "c"), 7).alias("ac"), F.round(F.corr("b", "c"), 7).alias("bc"), F.count("*").alias("n"))


@q("a13_standardised", "SELECT o_orderkey, round(CASE WHEN stddev_samp(o_totalprice) OVER (PARTITION BY o_orderpriority) > 0 THEN o_totalprice / stddev_samp(o_totalprice) OVER (PARTITION BY o_orderpriority) END, 8) AS v FROM orders")
def a13(s, d):
    x = R.standardised(table(s, d, "orders"), "o_totalprice", ["o_orderpriority"], "v")
    return x.select("o_orderkey", F.round("v", 8).alias("v"))


@q("a14_shrunken_rate", "SELECT pos, role_name, count(*) AS n, round((sum(CASE WHEN estimated_fp IS NULL THEN 1.0 ELSE 0.0 END) + 30 * 0.02) / (count(*) + 30), 9) AS rate FROM rankings GROUP BY ALL")
def a14(s, d):
    return E.shrunken_rate(table(s, d, "rankings"), ["pos", "role_name"], F.col("estimated_fp").isNull(), F.lit(0.02), 30).select("pos", "role_name", "n", F.round("rate", 9).alias("rate"))


ISO_SQL = """
    WITH g AS (SELECT p_brand, p_size // 5 AS x, avg(p_retailprice) AS y, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY x) AS i FROM g),
    m AS (SELECT a.p_brand, a.i AS j, b.i AS k, sum(c.y * c.w) / sum(c.w) AS m FROM i a JOIN i b ON a.p_brand = b.p_brand AND a.i <= b.i JOIN i c ON c.p_brand = a.p_brand AND c.i BETWEEN a.i AND b.i GROUP BY ALL),
"""


@q("a15_increasing_fit", ISO_SQL + """t AS (SELECT i.p_brand, i.x, j, min(m) AS t FROM i JOIN m ON m.p_brand = i.p_brand AND m.j <= i.i AND m.k >= i.i GROUP BY ALL)
    SELECT p_brand, CAST(x AS BIGINT) AS x, round(max(t), 7) AS fit FROM t GROUP BY ALL""")
def a15(s, d):
    g = table(s, d, "part").groupBy("p_brand", F.floor(F.col("p_size") / 5).alias("x")).agg(F.avg("p_retailprice").alias("y"), F.count("*").alias("w"))
    return X.pooled_monotone(g, "p_brand", "x", "y", "w", True).select("p_brand", "x", F.round("fit", 7).alias("fit"))


@q("a16_decreasing_fit", ISO_SQL + """t AS (SELECT i.p_brand, i.x, j, max(m) AS t FROM i JOIN m ON m.p_brand = i.p_brand AND m.j <= i.i AND m.k >= i.i GROUP BY ALL)
    SELECT p_brand, CAST(x AS BIGINT) AS x, round(min(t), 7) AS fit FROM t GROUP BY ALL""")
def a16(s, d):
    g = table(s, d, "part").groupBy("p_brand", F.floor(F.col("p_size") / 5).alias("x")).agg(F.avg("p_retailprice").alias("y"), F.count("*").alias("w"))
    return X.pool_adjacent(g, "p_brand", "x", "y", "w", False).select("p_brand", "x", F.round("fit", 7).alias("fit"))


@q("a18_weighted_mean", "SELECT l_linenumber, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean, round(median(l_discount), 9) AS middle, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def a18(s, d):
    return table(s, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("mean"), F.round(F.percentile("l_discount", 0.5), 9).alias("middle"), F.count("*").alias("n"))


@q("a19_global_median", "SELECT count(fp_per_salary) AS n, CASE WHEN count(fp_per_salary) >= 3 THEN round(median(fp_per_salary), 9) ELSE 0.17 END AS middle FROM rankings")
def a19(s, d):
    n = table(s, d, "rankings").agg(F.count("fp_per_salary").alias("n"))
    m = R.medians(table(s, d, "rankings"), [], "fp_per_salary", "m").select("m")
    return n.join(m, F.lit(True), "left").select("n", F.when(F.col("n") >= 3, F.round("m", 9)).otherwise(F.lit(0.17)).alias("middle"))


@q("a20_totals_with_stand_in", "SELECT lineup_id, CAST(sum(CAST(round(coalesce(cbs_mean, mean_fp) * 100) AS BIGINT)) AS BIGINT) AS total FROM lineup_rows WHERE coalesce(cbs_mean, mean_fp) IS NOT NULL AND NOT isnan(coalesce(cbs_mean, mean_fp)) GROUP BY lineup_id")
def a20(s, d):
    v = F.coalesce("cbs_mean", "mean_fp")
    return table(s, d, "lineup_rows").where(v.isNotNull() & ~F.isnan(v)).groupBy("lineup_id").agg(F.sum(F.round(v * 100).cast("long")).alias("total"))


@q("a21_exposure", """
    WITH n AS (SELECT count(DISTINCT lineup_id) AS n FROM lineup_rows)
    SELECT player_key, count(DISTINCT lineup_id) AS lineups, round(100.0 * count(DISTINCT lineup_id) / min(n), 1) AS share FROM lineup_rows, n WHERE player_key IS NOT NULL GROUP BY player_key""")
def a21(s, d):
    r = table(s, d, "lineup_rows")
    total = r.agg(F.countDistinct("lineup_id").alias("n"))
    return r.where("player_key is not null").groupBy("player_key").agg(F.countDistinct("lineup_id").alias("lineups")).crossJoin(F.broadcast(total)).select("player_key", "lineups", F.round(100.0 * F.col("lineups") / F.col("n"), 1).alias("share"))


@q("a22_overlaps", """
    WITH l AS (SELECT DISTINCT run_date, lineup_id, player_key FROM lineup_rows WHERE player_key IS NOT NULL)
    SELECT x.lineup_id AS a, y.lineup_id AS b, CAST(count(*) AS INTEGER) AS shared FROM l x JOIN l y ON x.run_date = y.run_date AND x.player_key = y.player_key AND x.lineup_id < y.lineup_id GROUP BY ALL""")
def a22(s, d):
    l = table(s, d, "lineup_rows").where("player_key is not null").select("run_date", "lineup_id", "player_key").distinct()
    return E.shared_members(l, ["run_date"], "lineup_id", "player_key")


@q("a25_regret", "SELECT slate_id, round(max(estimated_fp) - avg(estimated_fp), 6) AS regret, count(*) AS n FROM slate_pool WHERE estimated_fp IS NOT NULL AND NOT isnan(estimated_fp) GROUP BY slate_id")
def a25(s, d):
    return table(s, d, "slate_pool").where("estimated_fp is not null and not isnan(estimated_fp)").groupBy("slate_id").agg(F.round(F.max("estimated_fp") - F.avg("estimated_fp"), 6).alias("regret"), F.count("*").alias("n"))


def _poisson_sql(u: str) -> str:
    out, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        out.append(f"CASE WHEN {u} > {total!r} THEN 1 ELSE 0 END")
        p /= k + 1
    return " + ".join(out)


@q("a26_cluster_bootstrap", f"""
    WITH c AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey),
    r AS (SELECT *, {_poisson_sql(D.uniform_sql("7", "rep", "o_custkey", engine="duckdb"))} AS w FROM c, range(1, 201) t(rep)),
    e AS (SELECT rep, sum(total * w) / sum(n * w) AS m FROM r GROUP BY rep)
    SELECT count(*) AS reps, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.5), 4) AS middle, round(quantile_cont(m, 0.975), 4) AS high FROM e""")
def a26(s, d):
    c = table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    b = E.cluster_bootstrap(c, "o_custkey", "total", "n", 200, F.expr(D.uniform_sql("7", "rep", "o_custkey")))
    return b.select("reps", *[F.round(x, 4).alias(x) for x in ("low", "middle", "high")])


@q("a27_leave_one_out", "SELECT c_custkey, round((sum(c_acctbal) OVER () - c_acctbal) / (count(*) OVER () - 1), 6) AS others FROM customer")
def a27(s, d):
    return E.leave_one_out(table(s, d, "customer"), "c_acctbal", "others").select("c_custkey", F.round("others", 6).alias("others"))


@q("a28_win_tie_loss", f"""
    WITH f AS ({FORECAST_SQL}) SELECT pos, count(*) FILTER (WHERE forecast - actual > 1e-8) AS wins, count(*) FILTER (WHERE abs(forecast - actual) <= 1e-8) AS ties, count(*) FILTER (WHERE forecast - actual < -1e-8) AS losses FROM f GROUP BY pos""")
def a28(s, d):
    return E.win_tie_loss(forecasts(s, d), ["pos"], F.col("forecast") - F.col("actual"))


@q("a29_crps", """
    WITH x AS (SELECT o_custkey, o_totalprice AS v, 150000.0 AS y FROM orders), n AS (SELECT o_custkey, avg(abs(v - y)) AS a FROM x GROUP BY ALL),
    s AS (SELECT a.o_custkey, avg(abs(a.v - b.v)) / 2 AS b FROM x a JOIN x b USING (o_custkey) GROUP BY ALL)
    SELECT o_custkey, round(a - b + 1e-8, 6) AS crps FROM n JOIN s USING (o_custkey)""")
def a29(s, d):
    x = table(s, d, "orders").select("o_custkey", F.col("o_totalprice").alias("v"), F.lit(150000.0).alias("y"))
    return E.crps(x, ["o_custkey"], "v", "y").select("o_custkey", F.round(F.col("crps") + 1e-8, 6).alias("crps"))


@q("a30_brier", "SELECT l_linenumber, count(*) AS n, round(avg(pow(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END - l_discount * 5, 2)), 9) AS brier, round(sum(l_discount * 5), 4) AS expected FROM lineitem GROUP BY l_linenumber")
def a30(s, d):
    p = F.col("l_discount") * 5
    y = (F.col("l_returnflag") == "R").cast("double")
    return table(s, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(y - p, F.lit(2))), 9).alias("brier"), F.round(F.sum(p), 4).alias("expected"))


@q("a31_mergeable_correlation", "SELECT l_suppkey % 10 AS grp, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def a31(s, d):
    parts = E.moments(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    whole = parts.groupBy((F.col("l_suppkey") % 10).alias("grp")).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return whole.select("grp", "n", F.round(E.correlation_of_moments(), 6).alias("r"))


@q("a32_recency_weighted", """
    WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
    SELECT o_custkey, round(sum(o_totalprice * pow(0.8, k - 1)) / sum(pow(0.8, k - 1)), 4) AS weighted FROM r WHERE k <= 8 GROUP BY o_custkey""")
def a32(s, d):
    w = R.recency_weighted_mean(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice", 0.2, 8)
    return w.select("o_custkey", F.round("weighted", 4).alias("weighted"))


@q("a33_conditional_scores", """
    SELECT l_suppkey, CAST(2 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + sum(CASE WHEN l_linestatus = 'O' AND l_discount > 0.08 THEN 6 ELSE 0 END)
      + CASE WHEN sum(l_quantity) < 5000 THEN 10 WHEN sum(l_quantity) < 15000 THEN 4 ELSE -1 END AS BIGINT) AS score FROM lineitem GROUP BY l_suppkey""")
def a33(s, d):
    total = F.sum("l_quantity")
    return table(s, d, "lineitem").groupBy("l_suppkey").agg((2 * F.count_if(F.col("l_returnflag") == "R") + 6 * F.count_if((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.08)) + F.when(total < 5000, 10).when(total < 15000, 4).otherwise(-1)).cast("long").alias("score"))


@q("a34_weighted_score", "SELECT lineup_row_id, round(coalesce(mean_fp, 0) * 0.5 + coalesce(floor_fp, 0) * 0.2 - 2 * coalesce(depth_rank, 0), 8) AS score FROM lineup_rows WHERE mean_fp IS NULL OR NOT isnan(mean_fp)")
def a34(s, d):
    weights = {"mean_fp": 0.5, "floor_fp": 0.2, "depth_rank": -2.0}
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return table(s, d, "lineup_rows").where("mean_fp is null or not isnan(mean_fp)").select("lineup_row_id", F.round(score, 8).alias("score"))


@q("a36_method_counts", "SELECT board_id, projection_method, count(*) AS n FROM rankings GROUP BY ALL")
def a36(s, d):
    counts = table(s, d, "rankings").groupBy("board_id", "projection_method").agg(F.count("*").alias("n"))
    maps = counts.groupBy("board_id").agg(F.map_from_entries(F.collect_list(F.struct("projection_method", "n"))).alias("m"))
    return maps.select("board_id", F.explode("m").alias("projection_method", "n"))


@q("a37_source_counts", "SELECT CAST((mean_fp IS NOT NULL)::INT + (cbs_mean IS NOT NULL AND NOT isnan(cbs_mean))::INT AS INTEGER) AS sources, count(*) AS n FROM lineup_rows GROUP BY ALL")
def a37(s, d):
    k = F.col("mean_fp").isNotNull().cast("int") + (F.col("cbs_mean").isNotNull() & ~F.isnan("cbs_mean")).cast("int")
    return table(s, d, "lineup_rows").groupBy(k.alias("sources")).agg(F.count("*").alias("n"))


@q("a38_apportionment", """
    WITH w AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT *, n * 20.0 / sum(n) OVER () AS share FROM w),
    r AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 12) DESC, n DESC, c_mktsegment) AS k, 20 - sum(floor(share)) OVER () AS rest FROM x)
    SELECT c_mktsegment, n, CAST(floor(share) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS INTEGER) AS seats FROM r""")
def a38(s, d):
    return E.apportion(table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "c_mktsegment", "n", 20)


@q("a39_mandatory_members", """
    WITH t AS (SELECT slot, count(DISTINCT lineup_id) AS n FROM lineup_rows GROUP BY slot)
    SELECT l.slot, l.pos FROM lineup_rows l JOIN t USING (slot) GROUP BY l.slot, l.pos, t.n HAVING count(DISTINCT l.lineup_id) = t.n""")
def a39(s, d):
    r = table(s, d, "lineup_rows")
    t = r.groupBy("slot").agg(F.countDistinct("lineup_id").alias("n"))
    m = r.groupBy("slot", "pos").agg(F.countDistinct("lineup_id").alias("k"))
    return m.join(t, "slot").where("k = n").select("slot", "pos")


M8_SQL = """
    g8 AS (SELECT p_brand, l_quantity AS t, sum(count(*)) OVER (PARTITION BY p_brand ORDER BY l_quantity DESC) / sum(count(*)) OVER (PARTITION BY p_brand) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_quantity),
    x8 AS (SELECT p_brand, ln(t) AS x, ln(-ln(p)) AS y FROM g8 WHERE t > 0 AND p > 0 AND p < 1),
    f8 AS (SELECT p_brand, count(*) AS n, least(greatest(regr_slope(y, x), 0.7), 8.0) AS shape, avg(x) AS mx, avg(y) AS my FROM x8 GROUP BY p_brand)"""


def quantity_ladders(s, d):
    """The share of items of each brand with a quantity of t or more."""
    x = table(s, d, "lineitem").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = x.groupBy("p_brand", F.col("l_quantity").alias("t")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("p_brand")
    return g.withColumn("p", F.sum("c").over(w.orderBy(F.desc("t"))) / F.sum("c").over(w)).withColumn("w", F.lit(1.0))


@q("m8_weibull_fit", f"WITH {M8_SQL} SELECT p_brand, n, round(shape, 6) AS shape, round(exp(-(my - shape * mx) / shape), 4) AS scale FROM f8")
def m8(s, d):
    return X.weibull_fit(quantity_ladders(s, d), ["p_brand"], "t", "p", "w").select("p_brand", "n", F.round("shape", 6).alias("shape"), F.round("scale", 4).alias("scale"))


M9_SQL = """
    o AS (SELECT o_orderpriority AS grp, o_orderkey, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    l AS (SELECT grp, k, least(greatest(avg(CASE WHEN c >= k THEN 1e0 ELSE 0e0 END), 1e-6), 1 - 1e-6) AS p, sqrt(count(*)) AS w FROM o, range(1, 8) t(k) GROUP BY ALL),
    r1 AS (SELECT grp, rate, sum(w * pow(ln(s) - ln(1 - s) - ln(p) + ln(1 - p), 2)) AS loss FROM (
        SELECT l.*, x / 20e0 AS rate, least(greatest(1 - list_sum([exp(-(x / 20e0)) * pow(x / 20e0, j) / factorial(CAST(j AS INTEGER)) FOR j IN range(0, k)]), 1e-9), 1 - 1e-9) AS s FROM l, range(1, 241) t(x)) GROUP BY ALL),
    b1 AS (SELECT grp, arg_min(rate, loss) AS rate FROM r1 GROUP BY grp),
    r2 AS (SELECT grp, rate, sum(w * pow(ln(s) - ln(1 - s) - ln(p) + ln(1 - p), 2)) AS loss FROM (
        SELECT l.*, y AS rate, least(greatest(1 - list_sum([exp(-y) * pow(y, j) / factorial(CAST(j AS INTEGER)) FOR j IN range(0, k)]), 1e-9), 1 - 1e-9) AS s FROM (SELECT l.*, b1.rate + x / 20000e0 AS y FROM l JOIN b1 USING (grp), range(-1000, 1001) t(x)) l) GROUP BY ALL),
    f AS (SELECT grp, arg_min(rate, loss) AS rate FROM r2 GROUP BY grp)"""


def order_ladders(s, d):
    """The share of orders of each priority with k lines or more."""
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp")).join(lines, "o_orderkey", "left").na.fill(0, ["c"])
    g = o.groupBy("grp").agg(F.count("*").alias("n"), *[F.avg((F.col("c") >= k).cast("double")).alias(f"p{k}") for k in range(1, 8)])
    return g.select("grp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p"), F.sqrt("n").alias("w")) for k in range(1, 8)])).alias("x")).select("grp", "x.*")


@q("m9_poisson_fit", f"WITH {M9_SQL} SELECT grp, round(rate, 3) AS rate FROM f")
def m9(s, d):
    return X.poisson_fit(order_ladders(s, d), ["grp"], "k", "p", "w").select("grp", F.round("rate", 3).alias("rate"))


@q("y67_family_dispatch", f"""
    WITH {M8_SQL}, {M9_SQL}
    SELECT 'quantity' AS stat, p_brand AS grp, 'weibull' AS family, round(shape, 3) AS first, round(exp(-(my - shape * mx) / shape), 3) AS second FROM f8
    UNION ALL SELECT 'lines', grp, 'poisson', round(rate, 3), NULL FROM f""")
def y67(s, d):
    a = quantity_ladders(s, d).select(F.lit("quantity").alias("stat"), F.col("p_brand").alias("grp"), F.col("t").cast("double").alias("t"), "p", "w")
    b = order_ladders(s, d).select(F.lit("lines").alias("stat"), "grp", F.col("k").cast("double").alias("t"), "p", "w")
    fitted = X.fit_by_family(a.unionByName(b), "stat", ["grp"], "t", "p", "w", {"quantity": "weibull", "lines": "poisson"})
    return fitted.select("stat", "grp", "family", F.round("first", 3).alias("first"), F.round("second", 3).alias("second"))


@q("m10_trimmed_line", """
    WITH x AS (SELECT l_linenumber AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    f AS (SELECT g, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x GROUP BY g), r AS (SELECT x.*, y - i - s * x AS r FROM x JOIN f USING (g)),
    m AS (SELECT g, median(r) AS m FROM r GROUP BY g), a AS (SELECT r.*, abs(r - m) AS a FROM r JOIN m USING (g)), d AS (SELECT g, median(a) AS d FROM a GROUP BY g)
    SELECT g, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM a JOIN d USING (g) WHERE d <= 0 OR a <= 2.0 * 1.4826 * d GROUP BY g""")
def m10(s, d):
    x = table(s, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return X.trimmed_line(x, ["g"], "x", "y", 2.0).select("g", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@q("m2_ridge_prediction", """
    WITH f AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS vx, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem),
    b AS (SELECT mx, my, c * (n - 1) / sqrt(vx) / ((n - 1) + 10) / sqrt(vx) AS b FROM f)
    SELECT l_linenumber, round(sum(greatest(my + b * (l_quantity - mx), 0.05)), 1) AS predicted FROM lineitem, b GROUP BY l_linenumber""")
def m2(s, d):
    li = table(s, d, "lineitem")
    fit = X.ridge(li, ["l_quantity"], "l_extendedprice", 10.0)
    return li.groupBy("l_linenumber").agg(F.round(F.sum(X.predict(fit, 0.05)), 1).alias("predicted"))


@q("m17_shift_to_sum")
def m17(s, d):
    p = table(s, d, "rankings").where("estimated_fp is not null and not isnan(estimated_fp)")
    p = p.select(F.concat_ws("#", "board_id", "snapshot_no").alias("board_id"), "rank_row_id", (F.col("estimated_fp") / 4 - 2).alias("logit"))
    return X.shift_to_sum(p, "board_id", "rank_row_id", "logit", 5.0).select("board_id", "rank_row_id", F.round("p", 9).alias("p"))


@q("m18_normalised", "SELECT c_custkey, round((c_acctbal + 1000) / sum(c_acctbal + 1000) OVER (PARTITION BY c_mktsegment), 10) AS share FROM customer")
def m18(s, d):
    x = R.with_group_stats(table(s, d, "customer").withColumn("v", F.col("c_acctbal") + 1000), ["c_mktsegment"], total=F.sum("v"))
    return x.select("c_custkey", F.round(F.col("v") / F.col("total"), 10).alias("share"))
