"""Equi-joins with conditions on uniqueness, nearness in time and earlier history."""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .ranking import keep_unique


def cascade_match(left: DataFrame, right: DataFrame, ident: str, steps: list[list[str]], out: str = "matched") -> DataFrame:
    """Left rows with the right identifier found by the first of several key lists that finds one.

    A key counts only where it is unique on the right; null keys match nothing. `matched_by`
    tells the number of the step, from 1.
    """
    found: list[Column] = []
    d = left
    for i, keys in enumerate(steps):
        side = keep_unique(right.select(ident, *keys), keys).select(*[F.col(k).alias(f"_k{i}_{k}") for k in keys], F.col(ident).alias(f"_m{i}"))
        cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}_{k}") for k in keys])
        d = d.join(side, cond, "left").drop(*[f"_k{i}_{k}" for k in keys])
        found.append(F.col(f"_m{i}"))
    by = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(found, 1)])
    return d.withColumn(out, F.coalesce(*found)).withColumn(f"{out}_by", by).drop(*[f"_m{i}" for i in range(len(steps))])


def tolerant_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose times differ by at most `seconds`; time is bucketed into the join key.

    A bucket is as long as the tolerance, so a right row is needed in three of them. This keeps
    a frequent key from meeting all its rows of all times.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / max(1, seconds))
    a = left.withColumn("_bucket", bucket(left_time))
    b = right.withColumn("_near", bucket(right_time)).withColumn("_bucket", F.explode(F.array(F.col("_near") - 1, F.col("_near"), F.col("_near") + 1))).drop("_near")
    gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [*keys, "_bucket"]).where(gap <= seconds * 1_000_000).drop("_bucket")


def nearest_row(pairs: DataFrame, ident: str, distance: Column, tie: str, most: float) -> DataFrame:
    """Of candidate pairs the one of least distance for each identifier, if it is near enough."""
    w = Window.partitionBy(ident).orderBy("_d", tie)
    return pairs.withColumn("_d", distance).where(F.col("_d") <= most).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_d")


def exactly_one_near(df: DataFrame, keys: list[str], ident: str, value: str, most: float, other: str) -> DataFrame:
    """(ident, other): identifiers with just one row of another identifier that has their keys and a value within `most`.

    Rows are sorted by value, so candidates stand next to each other, and pairs aren't listed. In either direction the nearest
    row of another identifier and the one behind it are looked at: if that one is near too, there are two pairs, whichever identifier
    it has. All rows of an identifier count together; rows with a null or without a value that can be compared are near nothing.
    """
    rows = df.select(*keys, ident, F.col(value).alias("_v")).dropna("any", subset=[*keys, ident, "_v"])
    near = lambda c: F.coalesce(F.abs(F.col("_v") - F.col(c)) <= most, F.lit(False))
    n, found = F.lit(0), []
    for x, order in (("_up", [F.asc("_v"), F.asc(ident)]), ("_down", [F.desc("_v"), F.desc(ident)])):
        w = Window.partitionBy(*keys).orderBy(*order)
        before = F.struct(F.lag(ident).over(w).alias("i"), F.lag("_v").over(w).alias("v"), F.lag("_v", 2).over(w).alias("next"))
        rows = rows.withColumn(x, before).withColumn(x, F.last(F.when(F.col(f"{x}.i") != F.col(ident), F.col(x)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        n = n + near(f"{x}.v").cast("int") + near(f"{x}.next").cast("int")
        found.append(F.when(near(f"{x}.v"), F.col(f"{x}.i")))
    got = rows.select(ident, n.alias("_n"), F.coalesce(*found).alias(other)).where("_n > 0")
    return got.groupBy(ident).agg(F.sum("_n").alias("_n"), F.min(other).alias(other)).where("_n = 1").drop("_n")


def history_before(events: DataFrame, history: DataFrame, key: str, event_id: str, event_time: str, time: str, value: str, last: int, tie: list[str]) -> DataFrame:
    """Per event the mean and number of the last `last` values of its key strictly before it.

    Both tables are stacked and sorted once per key, so nothing is joined row by row: an
    event takes the latest list of values that a running window has seen.
    """
    kinds = dict(history.dtypes)
    h = history.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_event"), F.lit(None).cast(dict(events.dtypes)[event_id]).alias(event_id), F.col(value).cast("double").alias("_v"), *[F.col(t).alias(f"_tie_{t}") for t in tie])
    e = events.select(F.col(key).alias("_k"), F.col(event_time).alias("_t"), F.lit(0).alias("_event"), F.col(event_id), F.lit(None).cast("double").alias("_v"), *[F.lit(None).cast(kinds[t]).alias(f"_tie_{t}") for t in tie])
    rows = h.unionByName(e).where("_k is not null and _t is not null")
    w = Window.partitionBy("_k").orderBy("_t", "_event", *[f"_tie_{t}" for t in tie])
    seen = rows.withColumn("_n", F.sum(F.col("_v").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    values = seen.where("_v is not null").withColumn("_list", F.collect_list("_v").over(w.rowsBetween(-(last - 1), 0))).select("_k", "_n", "_list")
    asked = seen.where(F.col("_event") == 0).select("_k", "_n", event_id)
    got = asked.join(values, ["_k", "_n"], "left")
    mean = F.expr("aggregate(_list, CAST(0 AS DOUBLE), (a, x) -> a + x) / size(_list)")
    return got.select(event_id, F.when(F.col("_list").isNotNull(), mean).alias("mean_before"), F.coalesce(F.size("_list"), F.lit(0)).alias("n_before"))


def pairs_within(df: DataFrame, group: str, ident: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of different members of small groups, each with its columns and theirs, as _a and _b."""
    a = df.select(group, F.col(ident).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(group, F.col(ident).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, group).where("_a < _b")


def pair_counts(df: DataFrame, group: str, ident: str, column: str) -> DataFrame:
    """How many pairs of members of a group, with different identifiers, have each two values of a column: group, _a, _b and n.

    Two values come once, in either order. Numbers of rows are multiplied, less the rows of one identifier, so the work
    grows with the values of a group and not with its pairs. A null value counts as a value; rows without a group or an identifier
    take no part; values that no pair has are left out.
    """
    per = df.select(F.col(group), F.col(ident).alias("_i"), F.col(column).alias("_v")).where(F.col(group).isNotNull() & F.col("_i").isNotNull()).groupBy(group, "_i", "_v").agg(F.count("*").alias("_m"))
    a, b = (per.select(group, "_i", F.col("_v").alias(f"_{x}"), F.col("_m").alias(f"_m{x}")) for x in "ab")
    same = a.join(b, [group, "_i"]).groupBy(F.col(group).alias("_g"), F.col("_a").alias("_sa"), F.col("_b").alias("_sb")).agg(F.sum(F.col("_ma") * F.col("_mb")).alias("_same"))
    sizes = per.groupBy(group, "_v").agg(F.sum("_m").alias("_m")).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_v")))
    a, b = (sizes.select(group, F.col("_v").alias(f"_{x}"), F.col("_m").alias(f"_m{x}"), F.col("_k").alias(f"_k{x}")) for x in "ab")
    both = a.join(b, group).where("_ka <= _kb")
    both = both.join(same, (both[group] == same["_g"]) & both["_a"].eqNullSafe(same["_sa"]) & both["_b"].eqNullSafe(same["_sb"]), "left")
    return both.select(group, "_a", "_b", F.expr("(_ma * _mb - coalesce(_same, 0)) div if(_ka = _kb, 2, 1)").alias("n")).where("n > 0")


def highest_pairs(df: DataFrame, groups: list[str], ident: str, value: str, k: int) -> DataFrame:
    """The k pairs of members of a group, the smaller identifier first, with the highest product of a value: a, b and v.

    Equal products go by a, then b; null ones come last. Exact without a list of all pairs: any two values with a pair, and any
    member with a partner of some value, stand for one pair at least, so what comes behind the k-th of these is left out, and
    a member needs the next k partners only. Groups and identifiers that are null take no part.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(x) for g, x in zip(groups, keys)], F.col(ident).alias("_i"), F.col(value).alias("_v")).dropna(subset=[*keys, "_i"])
    sizes = rows.groupBy(*keys, "_v").agg(F.min("_i").alias("_least"), F.max("_i").alias("_most"))
    product = F.col("_v") * F.col("_w")
    place = F.struct(product.isNotNull().alias("known"), product.alias("v")).alias("_place")  # a null product is below all others
    values = sizes.drop("_most").join(sizes.select(*keys, F.col("_v").alias("_w"), "_most"), keys).where("_least < _most").select(*keys, "_v", "_w", "_most", place)
    last = values.select("_place").orderBy(F.desc("_place")).limit(k).agg(F.min("_place").alias("_lowest"))
    values = cut(values.join(F.broadcast(last), F.col("_place") >= F.col("_lowest")).drop("_lowest"))

    def alike(x: DataFrame, y: DataFrame, w: str, also: Column = F.lit(True), how: str = "inner") -> DataFrame:
        """Rows of x beside those of y of their group whose w is their _v, nulls included."""
        y = y.withColumnsRenamed({c: f"{c}y" for c in [*keys, w]})
        same = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"{c}y") for c in keys])
        return x.join(y, same & F.col("_v").eqNullSafe(F.col(f"{w}y")) & also, how)

    firsts = alike(rows, values, "_v", F.col("_i") < F.col("_most")).select(*keys, "_i", "_w", "_place")
    last = firsts.select("_place", "_i").orderBy(F.desc("_place"), "_i").limit(k).orderBy("_place", F.desc("_i")).limit(1).toDF("_lowest", "_farthest")
    firsts = cut(firsts.join(F.broadcast(last), (F.col("_place") > F.col("_lowest")) | ((F.col("_place") == F.col("_lowest")) & (F.col("_i") <= F.col("_farthest")))).drop("_lowest", "_farthest"))

    near = alike(rows, firsts.select(*keys, "_w").distinct(), "_w", how="left_semi").select(*keys, F.col("_v").alias("_w"), "_i", F.lit(None).alias("_place"), F.lit(0).alias("_asks"))
    so_far = Window.partitionBy(*keys, "_w").orderBy("_i", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    near = near.unionByName(firsts.withColumn("_asks", F.lit(1))).withColumn("_n", F.sum(1 - F.col("_asks")).over(so_far))
    a = near.where("_asks = 1").select(*keys, F.col("_w").alias("_v"), F.col("_i").alias("a"), "_place.v", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + k)).alias("_at"))
    b = near.where("_asks = 0").select(*keys, "_w", F.col("_i").alias("b"), "_n")
    return alike(a, b, "_w", F.col("_at") == F.col("_n")).select("a", "b", "v").orderBy(F.desc("v"), "a", "b").limit(k)


def combinations(pool: DataFrame, ident: str, price: str, size: int, cap: float, most: int = 30_000_000, group: str | None = None) -> DataFrame:
    """Every ascending combination of `size` members, of each group if one is named, whose price stays within the cap.

    Pools must be so small that the combinations of each number at most `most`; that is counted
    first, so a single pool is small enough to be broadcast. Each step extends partial combinations by larger members and cuts those over the cap.
    """
    keys = [group] if group else []
    n = pool.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    total = 1
    for i in range(size):
        total = total * (n - i) // (i + 1)
    if total > most:
        raise ValueError(f"{total} combinations are more than {most}")
    p = pool.select(*[F.col(k).alias("_g") for k in keys], F.col(ident).alias("_i"), F.col(price).alias("_p"))
    if not group:
        p = F.broadcast(p)
    out = pool.select(*keys, F.array(F.col(ident)).alias("members"), F.col(price).alias("total")).where(F.col("total") <= cap)
    for _ in range(size - 1):
        larger = (F.col("_i") > F.element_at("members", -1)) & (F.col("total") + F.col("_p") <= cap)
        out = out.join(p, larger & (F.col(group) == F.col("_g")) if group else larger)
        out = out.select(*keys, F.concat("members", F.array("_i")).alias("members"), (F.col("total") + F.col("_p")).alias("total"))
    return out


def both_directions(games: DataFrame, home: str, away: str, at: str) -> DataFrame:
    """(team, opponent, at): each team's earliest game, from a list of home and away teams."""
    rows = games.select(F.col(home).alias("team"), F.col(away).alias("opponent"), F.col(at).alias("at")).unionByName(
        games.select(F.col(away).alias("team"), F.col(home).alias("opponent"), F.col(at).alias("at"))
    )
    return rows.where("team is not null").groupBy("team").agg(F.min(F.struct("at", "opponent")).alias("x")).select("team", "x.opponent", "x.at")


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts that a word of that length is cut into, the longer ones last."""
    base, extra = divmod(length, parts)
    sizes = [base + (i >= parts - extra) for i in range(parts)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _segment_keys(k: int, probe: bool):
    """Keys of words: their length with each of k + 1 parts; of probes: the parts that words of each length may have there.

    k edits leave one of the parts whole. Before part i there are at most i edits if an earlier part is whole or
    not counted, and at most k - i after it, which bounds where it may stand in the probe.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for w in batch.column(0).to_pylist():
                own = set()
                for n in range(max(0, len(w) - k), len(w) + k + 1) if probe else [len(w)]:
                    for i, (at, size) in enumerate(segments(n, k + 1)):
                        d = len(w) - n
                        lo, hi = max(0, at - i, at + d - (k - i)), min(len(w) - size, at + i, at + d + (k - i))
                        for x in range(lo, hi + 1) if probe else [at]:
                            own.add(f"{n}:{i}:{w[x : x + size]}")
                keys += sorted(own)
                words += [w] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], names=["key", "word"])

    return run


def close_pairs(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(a, b, edits): every pair of words of the two one-column tables within k edits, equal ones included.

    Candidates share a part of the word near the same place, of which k edits leave one whole, so no pair is lost,
    whatever letters differ. Words are taken once; nulls take no part.
    """
    one = lambda d: d.toDF("word").where("word is not null").distinct()
    a = one(left).mapInArrow(_segment_keys(k, True), "key string, word string").withColumnRenamed("word", "a")
    b = one(right).mapInArrow(_segment_keys(k, False), "key string, word string").withColumnRenamed("word", "b")
    return a.join(b, "key").select("a", "b").distinct().withColumn("edits", F.levenshtein("a", "b", k)).where("edits >= 0")
