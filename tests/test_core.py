import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import distributions as D
from tallyfield.functions import text as T
from tallyfield.operators import blend as B
from tallyfield.operators import evaluation as E
from tallyfield.operators import fits as X
from tallyfield.operators import matching as M
from tallyfield.operators import portfolio as P
from tallyfield.operators import ranking as R
from tallyfield.operators import simulation as S
from tallyfield.sources import files as FS
from tallyfield.sources import sinks as K


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def test_normal_functions(spark):
    xs = [-9.0, -7.5, -3.0, -0.3, 0.0, 0.7, 2.5, 7.2, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", F.expr(D.normal_cdf_sql("x")))
    for r in df.collect():
        assert r.p == pytest.approx(statistics.NormalDist().cdf(r.x), abs=1e-14, rel=1e-7)
    back = df.where("abs(x) < 5").withColumn("z", F.expr(D.normal_ppf_sql("p"))).collect()
    assert all(r.z == pytest.approx(r.x, abs=2e-8) for r in back)


def test_hurdle_keeps_mean_and_zero_share(spark):
    df = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    r = df.select(F.expr(D.hurdle_sql("u", "10e0", "0.8e0", "0.1e0")).alias("x")).agg(F.avg("x").alias("m"), F.avg((F.col("x") == 0).cast("double")).alias("z"), F.stddev_pop("x").alias("s")).first()
    assert r.m == pytest.approx(10, rel=0.01) and r.z == pytest.approx(0.1, abs=1e-3) and r.s == pytest.approx(8, rel=0.05)


def test_odds(spark):
    df = spark.createDataFrame([("EVEN",), ("+100",), ("-110",), ("−110",), ("1,200",), ("0",), ("inf",), ("x",), (None,)], "o string")
    got = [r.p for r in df.select(T.american_probability(F.col("o")).alias("p")).collect()]
    assert got[:5] == pytest.approx([0.5, 0.5, 110 / 210, 110 / 210, 100 / 1300]) and got[5:] == [None] * 4


def test_names_and_text(spark):
    df = spark.createDataFrame([("  Séan O'Brién-Smith Jr. ",)], "n string")
    r = df.select(T.name_key(F.col("n")).alias("a"), T.name_key(F.col("n"), keep_spaces=False).alias("b"), T.html_text(F.lit("<b>a&amp;b</b>  c")).alias("h"), T.threshold(F.lit("25+ yards")).alias("t"), *[c.alias(f"s{i}") for i, c in enumerate(T.name_and_team(F.lit("Al B (NE)")))]).first()
    assert (r.a, r.b, r.h, r.t, r.s0, r.s1) == ("sean obrien smith", "seanobriensmith", "a&b c", 25.0, "Al B", "NE")


def test_blend_rules(spark):
    rows = [("t1", 1, 18.0, 0.0, "OUT", False), ("t2", 1, 10.0, 15.5, None, False), ("t2", 2, 18.0, 1.0, "OUT", True), ("t3", 1, 13.0, 15.0, None, False), ("t4", 1, 6.0, None, None, False), ("t5", 1, None, float("nan"), None, False), ("t6", 1, None, 4.0, "ACTIVE", True)]
    df = spark.createDataFrame(rows, "team string, k int, s double, e double, status string, starter boolean")
    got = {(r.team, r.k): (r.rule, r.value) for r in B.blend_two(df, "s", "e", "status", F.col("starter"), ["team"]).collect()}
    assert got == {("t1", 1): ("ruled_out", 0.0), ("t2", 1): ("stale", 15.5), ("t2", 2): ("ruled_out", 0.0), ("t3", 1): ("mean", 14.0), ("t4", 1): ("first", 6.0), ("t5", 1): ("none", None), ("t6", 1): ("second", 4.0)}


def test_three_sources(spark):
    df = spark.createDataFrame([(7.58, 4.01, 7.2, 1.0), (9.0, 9.1, None, 1.0)], "s double, e double, c double, k double")
    got = B.blend_three(df, ["s", "e", "c"], "k", 1.0).collect()
    assert got[0].value == pytest.approx(6.2633, abs=1e-3) and (got[0].n_sources, got[0].verdict) == (3, "sides with first")
    assert got[1].value == pytest.approx(9.05) and got[1].verdict == "no referee"


def test_monotone_fits_agree_and_match_the_golden_case(spark):
    df = spark.createDataFrame([("a", 1, 0.8, 1.0), ("a", 2, 0.2, 3.0), ("a", 3, 0.9, 1.0)], "g string, x int, y double, w double")
    for f in (X.pooled_monotone, X.pool_adjacent):
        assert [v for _, v in values(f(df, "g", "x", "y", "w", True), "x", "fit")] == pytest.approx([0.35, 0.35, 0.9])
    rng = np.random.default_rng(3)
    many = spark.createDataFrame([("b", i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.random(40), rng.integers(1, 5, 40)))], "g string, x int, y double, w double")
    for up in (True, False):
        a, b = (dict(values(f(many, "g", "x", "y", "w", up), "x", "fit")) for f in (X.pooled_monotone, X.pool_adjacent))
        assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_survival_fits(spark):
    w = spark.createDataFrame([("g", float(t), math.exp(-((t / 80) ** 2)), 1.0) for t in (20, 40, 60, 100, 150)], "g string, t double, p double, w double")
    r = X.weibull_fit(w, ["g"], "t", "p", "w").first()
    assert (r["shape"], r["scale"]) == (pytest.approx(2), pytest.approx(80))
    p = spark.createDataFrame([("g", k, 1 - sum(math.exp(-3.25) * 3.25**i / math.factorial(i) for i in range(k)), 1.0) for k in range(1, 8)], "g string, k int, p double, w double")
    assert X.poisson_fit(p, ["g"], "k", "p", "w").first().rate == pytest.approx(3.25, abs=1e-6)


def test_trimmed_line_and_ridge(spark):
    rows = [("g", float(i), 4 + 15.0 * i + 0.1 * (-1) ** i) for i in range(12)] + [("g", 5.0, 900.0)]
    r = X.trimmed_line(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").first()
    assert r.n == 12 and r.slope == pytest.approx(15, abs=0.05)
    fit = X.ridge(spark.createDataFrame(rows[:-1], "g string, x double, y double"), ["x"], "y", 0.0)
    assert fit["x"] == pytest.approx(15, abs=0.05)


def test_apportionment_limits_and_shift(spark):
    w = spark.createDataFrame([("a", 4), ("b", 3), ("c", 4), ("d", 3), ("e", 2), ("f", 2), ("g", 2)], "k string, w int")
    assert [s for _, s in values(E.apportion(w, "k", "w", 20), "k", "seats")] == [4, 3, 4, 3, 2, 2, 2]
    x = spark.createDataFrame([(5, 0.7), (5, 0.05), (100, 0.29), (1, 0.05)], "n int, f double")
    assert [r.m for r in x.select(S.exposure_limit(F.col("n"), F.col("f")).alias("m")).collect()] == [3, 0, 29, 1]
    p = X.shift_to_sum(spark.createDataFrame([("g", i, float(i)) for i in range(9)], "g string, i int, l double"), "g", "i", "l", 5.0)
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(5)


def test_scenarios_recover_correlation_and_ignore_partitions(spark):
    m = spark.createDataFrame([("g", 1, 10.0, 0.6, 0.0), ("g", 2, 8.0, 0.6, 0.0)], "game string, m int, mean double, cv double, zero double")
    p = spark.createDataFrame([("g", 1, 2, 0.7)], "game string, a int, b int, v double")
    roots = S.correlation_roots(p, m, "game", "m", "a", "b", "v")
    draws = S.scenarios(m, roots, "game", "m", "mean", "cv", "zero", 1500, 5)
    wide = draws.groupBy("scenario").pivot("m", [1, 2]).agg(F.first("score"))
    r = wide.agg(F.corr(F.ln("1"), F.ln("2")).alias("c"), F.avg("1").alias("m")).first()
    assert r.c == pytest.approx(0.7, abs=0.05) and r.m == pytest.approx(10, rel=0.06)
    assert np.allclose(S.repaired(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])).diagonal(), 1)


def test_cascade_and_history(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "z", "x"), (3, None, "y"), (4, "q", "q")], "id int, k string, n string")
    right = spark.createDataFrame([(10, "a", "u"), (11, "b", "x"), (12, "c", "y"), (13, "c", "y"), (14, None, None)], "rid int, k string, n string")
    got = values(M.cascade_match(left, right, "rid", [["k"], ["n"]]), "id", "matched", "matched_by")
    assert got == [(1, 10, 1), (2, 11, 2), (3, None, None), (4, None, None)]
    pool = spark.createDataFrame([(i, 1.0) for i in range(8)], "i int, p double")
    assert M.combinations(pool, "i", "p", 5, 5.0).count() == math.comb(8, 5) and M.combinations(pool, "i", "p", 5, 4.0).count() == 0
    with pytest.raises(ValueError):
        M.combinations(pool, "i", "p", 5, 5.0, most=10)


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, None)], "g string, i int, v double")
    ranked = R.with_average_rank(df, "v", ["g"], "r", "p")
    assert values(ranked, "i", "r", "p") == [(1, 2.5, 2.5 / 3), (2, 2.5, 2.5 / 3), (3, 1.0, 1 / 3), (4, None, None)]
    assert values(R.keep_unique(df.where("v is not null"), ["v"]), "i") == [(3,)]


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(FS.MissingColumns):
        FS.require_columns(spark.range(1), ["id", "x"])
    html = "<table><thead><tr><th>no</th></tr><tr><th>Player</th><th>fpts</th></tr></thead><tbody><tr><td>A&amp;B</td><td>3</td></tr></tbody></table>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "id int, html string")
    assert values(FS.html_tables(pages, "id", "html", "fpts"), "id", "column_name", "value") == [(1, "Player", "A&B"), (1, "fpts", "3"), (2, "fpts", "no such column")]
    d = spark.createDataFrame([('{"7": {"p": 1.5}}',), ('[{"id": "8", "p": 2.5}]',)], "b string")
    assert values(FS.two_shapes(d, "b", "map<string,struct<p:double>>", "array<struct<id:string,p:double>>", "id", F.col("row.p"), F.col("v.p")), "id", "value") == [("7", 1.5), ("8", 2.5)]
    path = str(tmp_path / "once")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert K.write_immutable(df, path, ["k", "v"]) and not K.write_immutable(df, path, ["k", "v"])
    with pytest.raises(ValueError):
        K.write_immutable(df.withColumn("v", F.lit("b")), path, ["k", "v"])
    from datetime import datetime

    landing, calls = str(tmp_path / "land"), []
    fetch = lambda: calls.append(1) or json.dumps({"n": len(calls)})
    for now in (datetime(2026, 1, 1), datetime(2026, 1, 1, 12), datetime(2026, 1, 3)):
        FS.fresh_or_fetch(spark, landing, now, fetch).collect()
    assert len(calls) == 2


def test_look_back_equals_windows_over_any_division(spark):
    import random

    from pyspark.sql.window import Window

    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(50), i, rnd.choice([None, None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v string")
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("p", F.lag("i").over(w)).withColumn("c", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = R.look_back(df, ["k"], ["t", "i"], {"p": "i"}, {"c": "v"})
        assert values(got, "i", "p", "c") == values(want, "i", "p", "c")
        total = R.running_total(df, "t", "i", "s")
        assert max(r.s for r in total.collect()) == sum(r[2] for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_portfolios():
    import itertools
    import random

    rnd = random.Random(6)
    for _ in range(20):
        rows = [(i, tuple(rnd.sample(range(5), 2)), rnd.randrange(1, 20)) for i in range(8)]
        n, cap = rnd.randrange(1, 5), rnd.randrange(1, 3)
        fits = [c for k in range(n + 1) for c in itertools.combinations(rows, k) if all(sum(m in x[1] for x in c) <= cap for m in range(5))]
        most = max(len(c) for c in fits)
        got = [r for r in rows if r[0] in P.exact_capped(rows, n, cap)]
        assert len(got) == most and sum(r[2] for r in got) == max(sum(x[2] for x in c) for c in fits if len(c) == most)
    cands = [(1, ["q1", "w1"], 9.0), (2, ["q1", "w2"], 8.0), (3, ["q2", "w3"], 5.0), (4, ["w1", "w2"], 4.0)]
    quotas = [P.Quota("qb", {"QB": (1, 1)}, 2), P.Quota("wr", {"WR": (2, 2)}, 1)]
    P.validate(quotas, ["QB", "WR"], 2)
    assert P.balanced(cands, 2, 2) == [1, 3]
    for bad in ([P.Quota("", {}, 1)], [P.Quota("a", {"X": (1, 1)}, 1)], [P.Quota("a", {"QB": (2, 1)}, 1)], [P.Quota("a", {"QB": (1, 1), "WR": (2, 2)}, 1)]):
        with pytest.raises(ValueError):
            P.validate(bad, ["QB", "WR"], 2)


def test_close_pairs_lose_nothing(spark):
    import random

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(10))) for _ in range(90)})
    df = spark.createDataFrame([(w,) for w in [*words, *words[:4]]] + [(None,)], "w string")
    for k in (0, 2, 4):
        got = sorted(map(tuple, M.close_pairs(df, df, k).collect()))
        assert got == sorted((a, b, lev(a, b)) for a in words for b in words if lev(a, b) <= k)


def test_order_statistics_over_ranges(spark):
    rows = [("a", float(i * 7 % 11)) for i in range(30)] + [("hot", 1.0)] * 50 + [(None, 3.0), (None, 4.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.m) for r in R.medians(df.repartition(7), ["g"], "v", "m").collect()}
    assert got == {"a": (30, float(np.median([v for g, v in rows if g == "a"]))), "hot": (50, 1.0), None: (2, 3.5)}
    assert R.medians(df, [], "v", "m").first().m == float(np.median([v for _, v in rows if v is not None]))
    assert R.medians(df.where("false"), ["g"], "v", "m").count() == 0
    last = R.at_positions(df, ["g"], "v", top=lambda n: n - 1)
    assert {r.g: r.top for r in last.collect()} == {"a": 10.0, "hot": 1.0, None: 4.0}


def test_ladders_are_fitted_by_their_family(spark):
    import math

    rows = [("y", "g", float(t), math.exp(-((t / 40.0) ** 1.5)), 1.0) for t in (10, 20, 40, 60)]
    rows += [("c", "g", float(k), 1 - sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k)), 1.0) for k in (1, 2, 3, 5)]
    rows += [("other", "g", 1.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "stat string, grp string, t double, p double, w double")
    got = {r.stat: (r.family, r.first, r.second) for r in X.fit_by_family(df, "stat", ["grp"], "t", "p", "w", {"y": "weibull", "c": "poisson"}).collect()}
    assert set(got) == {"y", "c"} and got["y"][1:] == pytest.approx((1.5, 40.0)) and got["c"][0] == "poisson" and got["c"][1] == pytest.approx(2.5, abs=1e-4)


def part_table(tmp_path, select):
    """A directory with a table part that DuckDB made."""
    import duckdb

    duckdb.sql(f"COPY ({select}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    return str(tmp_path)


#: Repeated keys and rows, nulls in every column, keys that are the same in several groups.
ODD_PARTS = """SELECT CASE WHEN i % 41 = 0 THEN NULL ELSE i * 7 % 130 END AS p_partkey, CASE WHEN i % 37 = 0 THEN NULL WHEN i % 3 = 0 THEN 'B' ELSE 'A' END AS p_brand, CASE WHEN i % 31 = 0 THEN NULL WHEN i % 5 = 0 THEN 'y' ELSE 'x' END AS p_type,
    CASE WHEN i % 29 = 0 THEN NULL ELSE CAST(i * 11 % 13 AS INTEGER) END AS p_size, CASE WHEN i % 23 = 0 THEN NULL WHEN i % 19 = 0 THEN 'NaN'::DOUBLE ELSE 900 + (i * 17 % 151) / {step} END AS p_retailprice FROM range(240) t(i)"""


def as_sql(spark, name, folder):
    """The query's rows, after they were compared with those of its SQL."""
    import __spark_entry__ as entry
    from tools.compare import canonical, connect

    con, df = connect(folder), entry.queries()[name](spark, folder)
    con.execute(entry.oracle_sql()[name])
    columns, want = [c[0] for c in con.description], con.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert canonical(df.columns, got) == canonical(columns, want)
    return got


def test_pairs_are_counted_by_values(spark, tmp_path):
    assert len(as_sql(spark, "m22_latent_correlation", part_table(tmp_path, ODD_PARTS.format(step="1e1")))) == 4
    import __spark_entry__ as entry

    n = 300_000  # 45 thousand million pairs
    many = part_table(tmp_path, f"SELECT i AS p_partkey, 'A' AS p_brand, 'x' AS p_type, CAST(i % 2 * 25 AS INTEGER) AS p_size FROM range({n}) t(i)")
    got = entry.queries()["m22_latent_correlation"](spark, many).first()
    latent = lambda a, b: math.log(1 + 0.25 * a * b) / math.sqrt(math.log1p(a * a) * math.log1p(b * b))
    alike, other = n // 2 * (n // 2 - 1) // 2, (n // 2) ** 2
    assert got.n == n * (n - 1) // 2 and got.latent == pytest.approx((alike * (latent(0.5, 0.5) + latent(1, 1)) + other * latent(0.5, 1)) / got.n, abs=2e-8)


def test_highest_pairs_without_all_pairs(spark, tmp_path):
    odd = ODD_PARTS.format(step="1e1")
    assert len(as_sql(spark, "t4_highest_pairs", part_table(tmp_path, odd))) == 100
    for few in ("p_size IS NULL OR p_partkey < 20", "p_size IS NULL OR p_size = 0", "p_partkey < 5", "false"):  # null products, ties at 0, fewer than 100 pairs, none
        as_sql(spark, "t4_highest_pairs", part_table(tmp_path, f"SELECT * FROM ({odd}) WHERE {few}"))
    as_sql(spark, "t4_highest_pairs", part_table(tmp_path, f"SELECT * REPLACE (p_size - 6 AS p_size) FROM ({odd})"))  # negative values
    as_sql(spark, "t4_highest_pairs", part_table(tmp_path, f"SELECT * REPLACE ('A|' AS p_brand, p_brand || '|' AS p_type) FROM ({odd}) UNION ALL SELECT * REPLACE ('A' AS p_brand, '|' || p_type AS p_type) FROM ({odd})"))
    import __spark_entry__ as entry

    n = 300_000  # 45 thousand million pairs, all of one product
    many = part_table(tmp_path, f"SELECT {n} - i AS p_partkey, 'A' AS p_brand, 'x' AS p_type, 3 AS p_size FROM range({n}) t(i)")
    assert [tuple(r) for r in entry.queries()["t4_highest_pairs"](spark, many).collect()] == [(1, b, 9) for b in range(2, 102)]


def test_exactly_one_near_by_neighbours(spark, tmp_path):
    rows = []
    for step in ("2e-1", "1e0", "2e0", "5e0"):  # few neighbours to many
        odd = ODD_PARTS.format(step=step)
        rows += as_sql(spark, "j16_exactly_one", part_table(tmp_path, odd))
        rows += as_sql(spark, "j16_exactly_one", part_table(tmp_path, f"SELECT * REPLACE (p_partkey % 9 AS p_partkey) FROM ({odd}) UNION ALL SELECT * REPLACE (900 + p_partkey AS p_retailprice, 3000 + p_partkey AS p_partkey) FROM ({odd})"))
        rows += as_sql(spark, "j16_exactly_one", part_table(tmp_path, f"SELECT DISTINCT ON (p_partkey, p_brand) * FROM ({odd}) WHERE p_partkey < 40"))
    assert len(rows) > 20
    #: Identifiers' rows between each other: 1 meets 2 twice, 5 meets 6 once, 7 has a row of its own beside it, prices differ by just 0.5.
    few = [(1, 900.0), (2, 900.2), (1, 900.4), (5, 910.0), (6, 910.5), (7, 920.0), (7, 920.1), (8, 920.6), (9, 930.0), (10, 930.25), (11, 930.75), (12, None), (None, 930.0), (13, float("inf")), (14, float("inf"))]
    df = spark.createDataFrame([("g", *r) for r in few], "g string, i int, v double")
    want = [(5, 6), (6, 5), (7, 8), (8, 7), (9, 10), (11, 10)]
    assert values(M.exactly_one_near(df, ["g"], "i", "v", 0.5 + 1e-9, "other"), "i", "other") == sorted(want, key=str)
    import __spark_entry__ as entry

    n = 300_000  # 90 thousand million pairs, of which one row has one candidate
    many = part_table(tmp_path, f"SELECT i AS p_partkey, 'A' AS p_brand, 'x' AS p_type, CASE WHEN i = 0 THEN 1e0 WHEN i = 1 THEN 15e-1 ELSE 900e0 END AS p_retailprice FROM range({n}) t(i)")
    assert values(entry.queries()["j16_exactly_one"](spark, many), "p_partkey", "other") == [(0, 1), (1, 0)]
