import math
import random

from tallyfield.llm import topn
from tallyfield.llm.topn import BoundedHeap, top_n_per_group

SCHEMA = "g string, h string, score double, key string, id bigint, place int, _g0 string"


def brute(rows, n):
    groups = {}
    for g, h, score, key, ident, *_ in rows:
        if score is not None and not math.isnan(score) and ident is not None:
            groups.setdefault((g, h), []).append((-score, key is None, key or "", ident, key))
    out = set()
    for group, items in groups.items():
        seen = []
        for item in sorted(items, key=lambda x: x[:4]):
            if item[4] not in [s[4] for s in seen]:
                seen.append(item)
        out |= {(*group, place, s[3]) for place, s in enumerate(seen[:n], 1)}
    return out


def found(df, n=3):
    return {(r.g, r.h, r.place, r.id) for r in top_n_per_group(df, ["g", "h"], "score", "key", "id", n).collect()}


def test_matches_brute_force_with_ties_nulls_nan_and_repeats(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(4000):
        g = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None, "c"])
        score = rnd.choice([None, float("nan"), float("inf"), -1.5, 0.0, 2.0, 2.0, 3.25, rnd.random() * 5])
        rows.append((g, rnd.choice(["x", None]), score, rnd.choice([None, *"klmnopq"]), i, 0, "extra"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df.repartition(5)) == brute(rows, 3) == found(df.repartition(1))


def test_flushing_partial_heaps_changes_nothing(spark, monkeypatch):
    rows = [(f"g{i % 300}", "x", float(i * 7919 % 101), f"k{i % 11}", i, 0, "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(topn, "FLUSH_ROWS", 10)
    assert found(df) == brute(rows, 3)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_heap_keeps_best_of_each_key():
    heap = BoundedHeap(2)
    for item in [(1.0, "a", 1), (5.0, "a", 2), (5.0, "a", 1), (3.0, "b", 3), (4.0, "c", 4), (2.0, "c", 5)]:
        heap.push(*item)
    assert [(x.score, x.key, x.ident) for x in heap.items()] == [(5.0, "a", 1), (4.0, "c", 4)]


def by_window(df, groups, n):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    best = Window.partitionBy(*groups, "key").orderBy(F.desc("score"), "id")
    all_ = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("key"), "id")
    rows = df.where("score is not null and id is not null").withColumn("k", F.row_number().over(best)).where("k = 1").withColumn("place", F.row_number().over(all_)).where(f"place <= {n}")
    return {tuple(r) for r in rows.select(*groups, "place", "id").collect()}


def by_heaps(df, groups, n):
    return {tuple(r) for r in top_n_per_group(df, groups, "score", "key", "id", n).select(*groups, "place", "id").collect()}


def test_many_group_columns_of_many_values(spark):
    from pyspark.sql import functions as F

    df = spark.range(10_000).select(*[F.pmod(F.col("id") * (7919 + 2 * i), F.lit(10_000)).alias(f"g{i}") for i in range(6)], F.lit(1.5).alias("score"), F.col("id").alias("key"), "id")
    df = df.unionByName(df.withColumn("id", F.col("id") + 10_000).withColumn("key", F.col("key") + 1))
    groups = [f"g{i}" for i in range(6)]
    got = by_heaps(df, groups, 3)
    assert len(got) == 20_000 and got == by_window(df, groups, 3)


def test_keys_scores_and_groups_keep_their_own_types(spark):
    from datetime import date, datetime
    from decimal import Decimal

    big = 2**60
    rows = [(date(2026, 1, 1 + i % 3), datetime(2026, 1, 1, 0, 0, i % 2), i % 2 == 0, big + i // 4, i % 13 or None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "d date, t timestamp, b boolean, score bigint, key int, id bigint")
    assert by_heaps(df, ["d", "t", "b"], 4) == by_window(df, ["d", "t", "b"], 4)
    cents = spark.createDataFrame([("g", Decimal(big + i // 3) / 100, i % 12, str(i)) for i in range(60)], "g string, score decimal(24,2), key int, id string")
    assert by_heaps(cents, ["g"], 7) == by_window(cents, ["g"], 7)
    nan = float("nan")
    odd = spark.createDataFrame([(x, 1, k, i) for i, (x, k) in enumerate([(0.0, nan), (-0.0, 2.0), (nan, nan), (nan, None), (nan, nan), (None, 10.0), (None, 9.0)])], "g double, score int, key double, id bigint")
    got = sorted((str(r.g), r.place, r.id) for r in top_n_per_group(odd, ["g"], "score", "key", "id", 5).collect())
    assert got == [("0.0", 1, 1), ("0.0", 2, 0), ("None", 1, 6), ("None", 2, 5), ("nan", 1, 2), ("nan", 2, 3)]
