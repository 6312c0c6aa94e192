"""Scalar functions, markets, blends, simulation and selection on the test tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from ..functions import text as T
from ..operators import blend as B
from ..operators import matching as M
from ..operators import games as G
from ..operators import portfolio as P
from ..operators import simulation as S
from ..registry import Registry
from ..session import table

registry = Registry()
q = registry.query

CV_SQL = "(0.5e0 + p_size / 50e0)"
ZERO_SQL = "(p_size / 500e0)"


@q("x1_name_keys", r"""
    SELECT salary_row_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(player)), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '\s(?:jr|sr|ii|iii|iv|v)$', ''), '\s+', ' ', 'g')) AS name_key FROM salary_feed""")
def x1(s, d):
    return table(s, d, "salary_feed").select("salary_row_id", T.name_key(F.col("player")).alias("name_key"))


@q("x4_tight_name_keys", r"""
    SELECT entry_id, replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(player)), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '\s(?:jr|sr|ii|iii|iv|v)$', '')), ' ', '') AS name_key FROM roster_entries""")
def x4(s, d):
    return table(s, d, "roster_entries").select("entry_id", T.name_key(F.col("player"), keep_spaces=False).alias("name_key"))


@q("x5_team_codes", """
    SELECT entry_id, coalesce(t.team_code, upper(trim(team))) AS team_code FROM roster_entries r LEFT JOIN teams t ON upper(trim(r.team)) = t.alt_code""")
def x5(s, d):
    t = table(s, d, "teams").where("alt_code is not null").select("team_code", "alt_code")
    r = table(s, d, "roster_entries").withColumn("_t", F.upper(F.trim("team")))
    return r.join(t, F.col("_t") == F.col("alt_code"), "left").select("entry_id", F.coalesce("team_code", "_t").alias("team_code"))


ODDS_SQL = "CASE WHEN event_id % 11 = 0 THEN 'EVEN' WHEN event_id % 13 = 0 THEN 'off' WHEN event_id % 2 = 0 THEN '+' || CAST(100 + event_id % 300 AS VARCHAR) ELSE '-' || CAST(101 + event_id % 400 AS VARCHAR) END"


@q("x6_odds", f"""
    WITH o AS (SELECT event_id, {ODDS_SQL} AS odds FROM events), n AS (SELECT event_id, odds, TRY_CAST(replace(odds, '+', '') AS DOUBLE) AS v FROM o)
    SELECT event_id, round(CASE WHEN odds = 'EVEN' THEN 0.5 WHEN v < 0 THEN -v / (-v + 100) WHEN v > 0 THEN 100 / (v + 100) END, 10) AS p FROM n""")
def x6(s, d):
    odds = F.expr(ODDS_SQL.replace("VARCHAR", "STRING"))
    return table(s, d, "events").select("event_id", F.round(T.american_probability(odds), 10).alias("p"))


@q("x7_x8_fair_probability", """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 / (1.5 + l_discount * 10) AS a, 1 / (1.6 + l_tax * 10) AS b FROM lineitem)
    SELECT l_linenumber, round(avg(a / (a + b)), 9) AS fair FROM p GROUP BY l_linenumber""")
def x7(s, d):
    none = F.lit(None).cast("string")
    p = table(s, d, "lineitem").select("l_linenumber", T.implied_probability(none, 1.5 + F.col("l_discount") * 10).alias("a"), T.implied_probability(none, 1.6 + F.col("l_tax") * 10).alias("b"))
    return p.groupBy("l_linenumber").agg(F.round(F.avg(T.no_vig(F.col("a"), F.col("b"))), 9).alias("fair"))


@q("x9_logit_logistic", f"SELECT p_partkey, round({D.logistic_sql('(' + D.logit_sql('(p_size / 60e0)') + ' + 0.3e0)')}, 10) AS p FROM part")
def x9(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.expr(D.logistic_sql("(" + D.logit_sql("(p_size / 60e0)") + " + 0.3e0)")), 10).alias("p"))


@q("x11_thresholds", r"SELECT quote_id, TRY_CAST(nullif(regexp_extract(market_props, 'Rec (\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS receptions, TRY_CAST(nullif(regexp_extract(market_props, 'TD (\d+)%', 1), '') AS DOUBLE) / 100 AS td FROM market_quotes")
def x11(s, d):
    m = F.col("market_props")
    number = lambda p: F.nullif(F.regexp_extract(m, p, 1), F.lit("")).try_cast("double")
    return table(s, d, "market_quotes").select("quote_id", number(r"Rec (\d+(?:\.\d+)?)").alias("receptions"), (number(r"TD (\d+)%") / 100).alias("td"))


@q("x13_balanced_line", """
    WITH l AS (SELECT l_orderkey, l_quantity AS line, avg(l_discount * 10) AS p FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(abs(p - 0.5), 9), line) AS k FROM l)
    SELECT l_orderkey, line, CAST(floor(line) + 1 AS BIGINT) AS threshold FROM r WHERE k = 1""")
def x13(s, d):
    l = table(s, d, "lineitem").groupBy("l_orderkey", F.col("l_quantity").alias("line")).agg(F.avg(F.col("l_discount") * 10).alias("p"))
    best = l.groupBy("l_orderkey").agg(F.min(F.struct(F.round(F.abs(F.col("p") - 0.5), 9).alias("d"), "line")).alias("b"))
    return best.select("l_orderkey", F.col("b.line").alias("line"), (F.floor("b.line") + 1).alias("threshold"))


@q("x14_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def x14(s, d):
    return table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@q("x15_role_labels", "SELECT rank_row_id, CASE depth_rank WHEN 1 THEN 'starter' WHEN 2 THEN 'rotation' WHEN 3 THEN 'backup' ELSE 'reserve' END AS label FROM rankings")
def x15(s, d):
    return table(s, d, "rankings").select("rank_row_id", F.when(F.col("depth_rank") == 1, "starter").when(F.col("depth_rank") == 2, "rotation").when(F.col("depth_rank") == 3, "backup").otherwise("reserve").alias("label"))


BAND = f"SELECT p_partkey, round({D.band_sql('p_retailprice', CV_SQL, -0.67449)}, 6) AS p25, round({D.band_sql('p_retailprice', CV_SQL, 1.28155)}, 6) AS p90 FROM part"


@q("x16_lognormal_band", BAND)
def x16(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.expr(D.band_sql("p_retailprice", CV_SQL, -0.67449)), 6).alias("p25"), F.round(F.expr(D.band_sql("p_retailprice", CV_SQL, 1.28155)), 6).alias("p90"))


@q("x18_conditional_cv", f"SELECT p_partkey, round({D.conditional_cv_sql(CV_SQL, ZERO_SQL)}, 10) AS cv, {D.representable_sql(CV_SQL, ZERO_SQL)} AS representable FROM part")
def x18(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.expr(D.conditional_cv_sql(CV_SQL, ZERO_SQL)), 10).alias("cv"), F.expr(D.representable_sql(CV_SQL, ZERO_SQL)).alias("representable"))


@q("x19_normal_cdf", f"SELECT event_id, round({D.normal_cdf_sql('(value / 10 - 3)')}, 12) AS p FROM events")
def x19(s, d):
    return table(s, d, "events").select("event_id", F.round(F.expr(D.normal_cdf_sql("(value / 10 - 3)")), 12).alias("p"))


@q("x20_normal_ppf", f"SELECT event_id, round({D.normal_ppf_sql(D.uniform_sql('356', 'event_id', engine='duckdb'))}, 9) AS z FROM events")
def x20(s, d):
    return table(s, d, "events").select("event_id", F.round(F.expr(D.normal_ppf_sql(D.uniform_sql("356", "event_id"))), 9).alias("z"))


@q("x21_hurdle_draws", f"SELECT p_partkey, round({D.hurdle_sql(D.uniform_sql('1', 'p_partkey', engine='duckdb'), 'p_retailprice', CV_SQL, ZERO_SQL)}, 6) AS draw FROM part")
def x21(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.expr(D.hurdle_sql(D.uniform_sql("1", "p_partkey"), "p_retailprice", CV_SQL, ZERO_SQL)), 6).alias("draw"))


@q("x25_poisson_survival", f"SELECT p_partkey, round({D.poisson_survival_sql('(p_size % 9)', '(0.5e0 + p_size / 10e0)', 'duckdb')}, 10) AS p FROM part")
def x25(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.expr(D.poisson_survival_sql("(p_size % 9)", "(0.5e0 + p_size / 10e0)")), 10).alias("p"))


@q("x26_weibull_survival", f"SELECT p_partkey, round({D.weibull_survival_sql('p_size', '1.7e0', '22.5e0')}, 12) AS p FROM part")
def x26(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.expr(D.weibull_survival_sql("p_size", "1.7e0", "22.5e0")), 12).alias("p"))


@q("x28_x29_pair_relationship", """
    WITH p AS (SELECT DISTINCT lineup_id, player_key, pos, team FROM lineup_rows WHERE player_key IS NOT NULL AND pos IS NOT NULL AND team IS NOT NULL)
    SELECT least(a.pos, b.pos) || '-' || greatest(a.pos, b.pos) || CASE WHEN a.team = b.team THEN ' same' ELSE ' other' END AS label, count(*) AS n
    FROM p a JOIN p b ON a.lineup_id = b.lineup_id AND a.player_key < b.player_key GROUP BY ALL""")
def x28(s, d):
    p = table(s, d, "lineup_rows").where("player_key is not null and pos is not null and team is not null").select("lineup_id", "player_key", "pos", "team").distinct()
    x = M.pairs_within(p, "lineup_id", "player_key", ["pos", "team"])
    label = F.concat(F.least("pos_a", "pos_b"), F.lit("-"), F.greatest("pos_a", "pos_b"), F.when(F.col("team_a") == F.col("team_b"), " same").otherwise(" other"))
    return x.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@q("x30_exposure_limits", "SELECT p_size AS n, p_partkey % 100 / 100.0 AS share, CAST(CASE WHEN p_size = 1 THEN 1 ELSE least(p_size, floor(p_size * (p_partkey % 100 / 100.0) + 1e-9)) END AS INTEGER) AS most FROM part")
def x30(s, d):
    p = table(s, d, "part").select(F.col("p_size").alias("n"), (F.col("p_partkey") % 100 / 100.0).alias("share"))
    return p.withColumn("most", S.exposure_limit(F.col("n"), F.col("share")))


@q("x36_content_hash", "SELECT count(DISTINCT (team_code, alt_code, city)) AS n FROM teams")
def x36(s, d):
    return table(s, d, "teams").select(T.content_hash("team_code", "alt_code", "city").alias("h")).agg(F.countDistinct("h").alias("n"))


@q("x38_move_rank", "SELECT rank_row_id, CAST(CASE WHEN depth_rank = 4 THEN 2 WHEN depth_rank BETWEEN 2 AND 3 THEN depth_rank + 1 ELSE depth_rank END AS INTEGER) AS depth FROM rankings")
def x38(s, d):
    c = F.col("depth_rank")
    return table(s, d, "rankings").select("rank_row_id", F.when(c == 4, 2).when(c.between(2, 3), c + 1).otherwise(c).cast("int").alias("depth"))


@q("m14_blend_two", """
    WITH e AS (SELECT full_name, default_position_id AS pid, pro_team_id AS team, min(applied_total) AS e, min(injury_status) AS status FROM espn_feed WHERE full_name IS NOT NULL GROUP BY ALL),
    x AS (SELECT espn.full_name, espn.pid, espn.team, s.fppg AS s, e, status FROM e espn LEFT JOIN (SELECT player, min(fppg) AS fppg FROM salary_feed GROUP BY player) s ON s.player = espn.full_name),
    y AS (SELECT *, max(CASE WHEN s >= 15 AND status IN ('OUT', 'INJURY_RESERVE', 'SUSPENSION') THEN 1 ELSE 0 END) OVER (PARTITION BY pid, team) AS so, coalesce(status IN ('OUT', 'INJURY_RESERVE', 'SUSPENSION'), FALSE) AS out, CASE WHEN isnan(s) THEN NULL ELSE s END AS a, CASE WHEN isnan(e) THEN NULL ELSE e END AS b FROM x),
    z AS (SELECT *, CASE WHEN out THEN 'ruled_out' WHEN so = 1 AND a IS NOT NULL AND b >= 1.5 * a THEN 'stale' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'mean' WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'none' END AS rule FROM y)
    SELECT full_name, pid, team, rule, round(CASE rule WHEN 'ruled_out' THEN 0 WHEN 'stale' THEN b WHEN 'second' THEN b WHEN 'mean' THEN (a + b) / 2 WHEN 'first' THEN a END, 6) AS value FROM z""")
def m14(s, d):
    e = table(s, d, "espn_feed").where("full_name is not null").groupBy("full_name", F.col("default_position_id").alias("pid"), F.col("pro_team_id").alias("team")).agg(F.min("applied_total").alias("e"), F.min("injury_status").alias("status"))
    sal = table(s, d, "salary_feed").groupBy(F.col("player").alias("full_name")).agg(F.min("fppg").alias("s"))
    x = B.blend_two(e.join(sal, "full_name", "left"), "s", "e", "status", F.coalesce(F.col("s") >= 15, F.lit(False)), ["pid", "team"])
    return x.select("full_name", "pid", "team", "rule", F.round("value", 6).alias("value"))


@q("m15_blend_three", """
    WITH x AS (SELECT lineup_row_id, CASE WHEN isnan(mean_fp) THEN NULL ELSE mean_fp END AS s, CASE WHEN isnan(ceiling_fp) THEN NULL ELSE ceiling_fp / 1.7 END AS e, CASE WHEN isnan(cbs_mean) THEN NULL ELSE cbs_mean * 1.02 END AS c FROM lineup_rows)
    SELECT lineup_row_id, round((coalesce(s, 0) + coalesce(e, 0) + coalesce(c, 0)) / nullif((s IS NOT NULL)::INT + (e IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS value, CAST((s IS NOT NULL)::INT + (e IS NOT NULL)::INT + (c IS NOT NULL)::INT AS INTEGER) AS n_sources,
    CASE WHEN s IS NULL OR e IS NULL OR c IS NULL THEN 'no referee' WHEN abs(s - e) <= 0.1 THEN 'agree' WHEN abs(c - s) < abs(c - e) THEN 'sides with first' WHEN abs(c - e) < abs(c - s) THEN 'sides with second' ELSE 'between' END AS verdict FROM x""")
def m15(s, d):
    x = table(s, d, "lineup_rows").select("lineup_row_id", F.col("mean_fp").alias("s"), (F.col("ceiling_fp") / 1.7).alias("e"), F.col("cbs_mean").alias("c"), F.lit(1.02).alias("k"))
    return B.blend_three(x, ["s", "e", "c"], "k", 0.1).select("lineup_row_id", F.round("value", 6).alias("value"), "n_sources", "verdict")


@q("m22_latent_correlation", """
    WITH p AS (SELECT p_partkey, p_brand || '|' || p_type AS g, 0.5 + p_size / 50.0 AS cv FROM part),
    x AS (SELECT a.g, a.p_partkey AS a, b.p_partkey AS b, a.cv AS ca, b.cv AS cb FROM p a JOIN p b ON a.g = b.g AND a.p_partkey < b.p_partkey)
    SELECT g, count(*) AS n, round(avg(greatest(-0.999, least(0.999, ln(greatest(1 + 0.25 * ca * cb, 1e-12)) / sqrt(ln(1 + ca * ca) * ln(1 + cb * cb))))), 8) AS latent FROM x GROUP BY g""")
def m22(s, d):
    p = table(s, d, "part").select(F.concat("p_brand", F.lit("|"), "p_type").alias("g"), "p_partkey", (0.5 + F.col("p_size") / 50.0).alias("cv"))
    x = M.pair_counts(p, "g", "p_partkey", "cv").withColumn("latent", S.latent_lognormal(F.lit(0.25), F.col("_a"), F.col("_b")))
    mean = F.sum(F.col("n") * F.col("latent")) / F.sum(F.when(F.col("latent").isNotNull(), F.col("n")))
    return x.groupBy("g").agg(F.sum("n").alias("n"), F.round(mean, 8).alias("latent"))


@q("m32_lineup_variance", """
    WITH r AS (SELECT lineup_id, lineup_row_id AS m, mean_fp, max(lineup_row_id) OVER (PARTITION BY lineup_id) AS star FROM lineup_rows WHERE mean_fp IS NOT NULL AND NOT isnan(mean_fp))
    SELECT x.lineup_id, round(sum(CASE WHEN x.m = x.star THEN 1.5 ELSE 1 END * CASE WHEN y.m = y.star THEN 1.5 ELSE 1 END * CASE WHEN x.m = y.m THEN x.mean_fp * x.mean_fp ELSE 0.1e0 * x.mean_fp * y.mean_fp END), 7) AS variance
    FROM r x JOIN r y USING (lineup_id) GROUP BY x.lineup_id""")
def m32(s, d):
    r = table(s, d, "lineup_rows").where("mean_fp is not null and not isnan(mean_fp)").select("lineup_id", F.col("lineup_row_id").alias("m"), "mean_fp", F.max("lineup_row_id").over(Window.partitionBy("lineup_id")).alias("star"))
    a = r.select("lineup_id", F.col("m").alias("a"), F.col("mean_fp").alias("x"))
    b = r.select("lineup_id", F.col("m").alias("b"), F.col("mean_fp").alias("y"))
    cov = a.join(b, "lineup_id").select("a", "b", F.when(F.col("a") == F.col("b"), F.col("x") * F.col("x")).otherwise(0.1 * F.col("x") * F.col("y")).alias("cov"))
    return S.lineup_variance(r, cov, "lineup_id", "m", "star").select("lineup_id", F.round("variance", 7).alias("variance"))


@q("m45_slot_fill", """
    WITH p AS (SELECT board_id || '#' || snapshot_no AS board_id, rank_row_id, pos, estimated_fp AS v FROM rankings WHERE estimated_fp IS NOT NULL AND NOT isnan(estimated_fp)),
    r AS (SELECT *, row_number() OVER (PARTITION BY board_id, pos ORDER BY v DESC, rank_row_id) AS k, CASE pos WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 WHEN 'WR' THEN 3 WHEN 'TE' THEN 1 WHEN 'DEF' THEN 1 ELSE 0 END AS cap FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY v DESC, rank_row_id) AS f FROM r WHERE k > cap AND pos IN ('RB', 'WR', 'TE'))
    SELECT board_id, rank_row_id, pos AS slot FROM r WHERE k <= cap UNION ALL SELECT board_id, rank_row_id, 'FLEX' FROM f WHERE f <= 1""")
def m45(s, d):
    p = table(s, d, "rankings").where("estimated_fp is not null and not isnan(estimated_fp)").withColumn("board_id", F.concat_ws("#", "board_id", "snapshot_no"))
    return S.fill_slots(p, "board_id", "rank_row_id", "pos", "estimated_fp", {"QB": 1, "RB": 2, "WR": 3, "TE": 1, "DEF": 1}, 1, ["RB", "WR", "TE"])


#: Members of a game and the setting of its play.
POOL = 27
PLAYED = G.Setting.detail("standard", budget=160.0)


def brand_games(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every brand as a game: its dearest parts as members, and the correlation of their scores."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(s, d, "part").where("p_brand is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= POOL)
    kind = F.element_at(F.split("p_container", " "), 1)
    m = p.select(F.col("p_brand").alias("game"), F.col("p_partkey").alias("member"), F.col("p_type").alias("pos"), F.element_at(F.split("p_name", " "), -1).alias("kind"), (F.col("p_retailprice") / 60).alias("mean"), F.expr(CV_SQL).alias("cv"), F.expr(ZERO_SQL).alias("zero"), F.col("p_size").cast("double").alias("price"))
    pairs = M.pairs_within(m, "game", "member", ["pos", "kind"])
    v = F.when(F.col("kind_a") == F.col("kind_b"), 0.25).when(F.col("pos_a") == F.col("pos_b"), -0.1).otherwise(0.05)
    return m, pairs.select("game", F.col("_a").alias("a"), F.col("_b").alias("b"), v.alias("v"))


def play_games(s: SparkSession, d: str, play, ddl: str) -> DataFrame:
    m, pairs = brand_games(s, d)
    return G.games(m, pairs, "game", "member", "mean", "cv", "zero", "price", play, ddl)


@q("m29_scenarios")
def m29(s, d):
    """Mean, deviation and zero rate of every member over 10,000 correlated scenarios of every game."""

    def play(make, who):
        game = make(PLAYED)
        x = game.draws().astype(float)
        return pd.DataFrame({"game": game.name, "member": game.members, "n": x.shape[1], "mean": x.mean(axis=1).round(6), "sd": x.std(axis=1).round(6), "zero": (x == 0).mean(axis=1).round(6)})

    return play_games(s, d, play, "game string, member bigint, n bigint, mean double, sd double, zero double")


def named(game: G.Game, rows) -> list[list]:
    members, _ = game.lineups()
    return [[game.members[j] for j in members[i]] for i in rows]


@q("m34_shared_scenario_scores")
def m34(s, d):
    """All figures of every line-up kept, over all scenarios and over either half, for every game."""
    figures = [f"{c}{t}" for c in ("mean", "sd", "p25", "p90", "p95", "near_best", "win_rate") for t in ("", "_a", "_b")]

    def play(make, who):
        game = make(PLAYED)
        m = game.measures()
        out = {"game": game.name, "members": named(game, range(len(game.lineups()[0]))), "star": [game.members[i] for i in game.lineups()[1]]}
        return pd.DataFrame(out | {c: m[c].round(6) for c in figures})

    return play_games(s, d, play, "game string, members array<bigint>, star bigint, " + ", ".join(f"{c} double" for c in figures))


@q("m36_m40_portfolios")
def m36(s, d):
    """Portfolios of twenty line-ups of every game: capped by quality, best of many, with exchanges; what each is worth on scenarios that the choice hasn't seen."""

    def play(make, who):
        game = make(PLAYED)
        if not len(game.lineups()[0]):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("game", "objective", "place", "members", "star", "held_mean", "held_p25", "gain_over_single")})
        many, _ = G.best_of_many(game)
        p90 = game.measures()["p90"]
        even = P.balanced([(i, m, float(v)) for i, (m, v) in enumerate(zip(game.lineups()[0].tolist(), p90))], PLAYED.entries, PLAYED.cap(PLAYED.member_share))
        picks = {"capped": G.capped(game, p90), "balanced": even, "best_of_many": many, "exchanged": G.exchanged(game, many)}
        single = int(np.argsort(-game.expectation(), kind="stable")[0])
        out = []
        for name, taken in picks.items():
            worth = G.held_out(game, taken, single)
            out += [(game.name, name, k, members, game.members[game.lineups()[1][i]], *(round(worth[x], 6) for x in ("held_mean", "held_p25", "gain_over_single"))) for k, (i, members) in enumerate(zip(taken, named(game, taken)), 1)]
        return pd.DataFrame(out, columns=["game", "objective", "place", "members", "star", "held_mean", "held_p25", "gain_over_single"])

    return play_games(s, d, play, "game string, objective string, place int, members array<bigint>, star bigint, held_mean double, held_p25 double, gain_over_single double")


@q("m37_m39_quota_selection")
def m37(s, d):
    """Line-ups of every game under construction rules, and the turns that no line-up fits."""
    quotas = [P.Quota("two_large", {"LARGE": (2, 5)}, 8), P.Quota("no_promo", {"PROMO": (0, 0)}, 7), P.Quota("small_and_economy", {"SMALL": (1, 2), "ECONOMY": (1, 5)}, 5)]

    def play(make, who):
        game = make(PLAYED)
        got, empty = G.scheduled(game, game.measures()["p90"], who["pos"].tolist(), quotas)
        out = [(game.name, k, rule, members, game.members[game.lineups()[1][i]]) for k, ((rule, i), members) in enumerate(zip(got, named(game, [i for _, i in got])), 1)]
        out += [(game.name, None, rule, None, n) for rule, n in sorted(empty.items())]
        return pd.DataFrame(out, columns=["game", "place", "rule", "members", "star"]).astype({"place": "Int32", "star": "Int64"})

    return play_games(s, d, play, "game string, place int, rule string, members array<bigint>, star bigint")


@q("m43_exact_selection")
def m43(s, d):
    """The three line-ups of every game with the greatest total expectation, each member in two at most: exactly, over all that were kept."""

    def play(make, who):
        game = make(PLAYED)
        (members, stars), e = game.lineups(), game.expectation()
        taken = P.exact_capped([(i, m, float(v)) for i, (m, v) in enumerate(zip(members.tolist(), e))], 3, 2)
        return pd.DataFrame([(game.name, k, m, game.members[stars[i]], round(float(e[i]), 6)) for k, (i, m) in enumerate(zip(taken, named(game, taken)), 1)], columns=["game", "place", "members", "star", "expected"])

    return play_games(s, d, play, "game string, place int, members array<bigint>, star bigint, expected double")
