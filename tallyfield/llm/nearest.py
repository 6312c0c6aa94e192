"""Pairing every row with the row of another table that is nearest in time, by x-fast tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK_ROWS = 60_000
HOT_QUERIES = 200_000
HOT_LEAVES = 50_000
BROADCAST_ROWS = 100_000
_LEVEL = 57


class XFastTrie:
    """x-fast tries of many groups over fixed-width integers, probed for whole arrays at once.

    leaves: sorted distinct codes group << width | offset. For every prefix length there is
    a hash table from the prefixes that occur to the least and the greatest leaf below; the
    tables share one hash index whose keys hold the length above the prefix. A probe
    searches the longest prefix that occurs by halving the range of lengths, so it looks up
    about log2(width) prefixes; the leaf on the side of the missing branch is the
    predecessor or the successor, and its neighbour in the leaf list is the other one.
    """

    def __init__(self, leaves: np.ndarray, width: int) -> None:
        self.leaves, self.width = leaves, width
        keys, low, high = [], [], []
        for length in range(width + 1):
            prefix = leaves >> (width - length)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(leaves) else np.zeros(0, np.int64)
            keys.append(prefix[first] + (np.int64(length) << _LEVEL))
            low.append(first)
            high.append(np.r_[first[1:], len(leaves)][: len(first)] - 1)
        self.nodes, self.low, self.high = pd.Index(np.concatenate(keys)), np.concatenate(low), np.concatenate(high)

    def neighbours(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the greatest leaf <= and the least leaf >= each probe of its group; -1 for none."""
        w = self.width
        lo, hi, node = np.zeros(len(probes), np.int64), np.full(len(probes), w, np.int64), self.nodes.get_indexer(probes >> w)
        known = node >= 0
        while True:
            todo = np.flatnonzero(known & (lo < hi))
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo] + 1) >> 1
            at = self.nodes.get_indexer((probes[todo] >> (w - mid)) + (mid << _LEVEL))
            hit = at >= 0
            lo[todo[hit]], node[todo[hit]] = mid[hit], at[hit]
            hi[todo[~hit]] = mid[~hit] - 1
        pred, succ = np.full(len(probes), -1, np.int64), np.full(len(probes), -1, np.int64)
        exact = known & (lo == w)
        pred[exact] = succ[exact] = self.low[node[exact]]
        rest = np.flatnonzero(known & (lo < w))
        right = ((probes[rest] >> (w - lo[rest] - 1)) & 1).astype(bool)
        r, l = rest[right], rest[~right]
        pred[r], succ[r] = self.high[node[r]], self.high[node[r]] + 1
        succ[l], pred[l] = self.low[node[l]], self.low[node[l]] - 1
        for found in (pred, succ):
            inside = (found >= 0) & (found < len(self.leaves))
            same = inside.copy()
            same[inside] = (self.leaves[found[inside]] >> w) == (probes[inside] >> w)
            found[~same] = -1
        return pred, succ


def _matcher(bits: int, tolerance: int):
    """mapInArrow over rows (key, bucket, sa, sb, side, t, id) sorted in that order; side 0 holds the leaves.

    Whole groups are answered together once BLOCK_ROWS rows are there. Of a group that goes on,
    only its leaves stay in memory while its probes stream by.
    """
    width, shift = bits + 2, np.int64(1) << bits
    schema = pa.schema([("_left", pa.int64()), ("_right", pa.int64()), ("_gap", pa.int64())])

    def solve(d: pd.DataFrame) -> pa.RecordBatch | None:
        side = d["side"].to_numpy()
        if side.all() or not side.any():
            return None
        off = d["t"].to_numpy() - (d["bucket"].to_numpy() << bits) + shift
        code = (d["_group"].to_numpy().astype(np.int64) << width) | off
        leaf = side == 0
        leaves, ids = code[leaf], d["id"].to_numpy()[leaf]
        probes, names = code[~leaf], d["id"].to_numpy()[~leaf]
        pred, succ = XFastTrie(leaves, width).neighbours(probes)
        far = np.int64(1) << 60
        before = np.where(pred >= 0, probes - leaves[pred], far)
        after = np.where(succ >= 0, leaves[succ] - probes, far)
        take_after = (after < before) | ((after == before) & (ids[succ] < ids[pred]))
        gap, best = np.where(take_after, after, before), np.where(take_after, succ, pred)
        ok = gap <= tolerance
        if not ok.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(names[ok]), pa.array(ids[best[ok]]), pa.array(gap[ok])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        size = 0
        keys = ["key", "bucket", "sa", "sb"]

        def grouped(d: pd.DataFrame) -> pd.DataFrame:
            same = np.ones(len(d), bool)
            for k in keys:
                v = d[k].to_numpy()
                same[1:] &= v[1:] == v[:-1]
            same[:1] = False
            d["_group"] = np.cumsum(~same)
            twin = np.zeros(len(d), bool)
            for k in ("side", "t", "id"):
                v = d[k].to_numpy()
                twin[1:] = (twin[1:] | (k == "side")) & (v[1:] == v[:-1])
            return d[~(twin & same)]

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size
            d = grouped(pd.concat(parts, ignore_index=True))
            if final:
                out, parts = solve(d), []
            else:
                tail = d["_group"].to_numpy() == d["_group"].iloc[-1]
                stay = d[tail & (d["side"].to_numpy() == 0)]
                if d["side"].iloc[-1] == 0:
                    out = solve(d[~tail])
                else:
                    out = solve(d)
                parts = [stay.drop(columns="_group")]
            size = 0
            if out is not None:
                yield out

        for batch in batches:
            if batch.num_rows:
                parts.append(batch.to_pandas())
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    yield from take(False)
        if parts:
            yield from take(True)

    return run


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_us: int,
) -> DataFrame:
    """(left_id, right_id, gap_us): for each left row the right row of its key nearest in time.

    A gap of exactly tolerance_us counts; of equally near rows the smaller right_id wins,
    whether they lie on one side or both. Null keys, times or identifiers never match and
    left rows without a match give no row. Rows repeated whole count once. Empty tables give
    no rows. Only the six named columns are read, so other columns can't clash. Times
    without a zone are read in the session's zone. Identifiers are integers and not negative.

    Time is cut into buckets by its high bits, just wider than the tolerance, so a right row
    is needed in at most three buckets. A (key, bucket) cell with very many rows becomes a
    grid: its left rows are divided into sa parts and its right rows into sb parts, every
    left part meets every right part, and the least gap wins. No task therefore holds more
    than about HOT_LEAVES right rows of a cell or answers more than about HOT_QUERIES left ones.
    """
    if tolerance_us < 0:
        raise ValueError("the tolerance must not be negative")
    bits = max(1, int(tolerance_us).bit_length())
    if bits > 40:
        raise ValueError("the tolerance must be under twelve days")
    probes = left.select(
        F.col(key).cast("string").alias("key"), _micros(left_time).alias("t"), F.col(left_id).cast("long").alias("id")
    ).where("key is not null and t is not null and id is not null")
    probes = probes.withColumn("bucket", F.shiftright("t", bits))
    leaves = right.select(
        F.col(key).cast("string").alias("key"), _micros(right_time).alias("t"), F.col(right_id).cast("long").alias("id")
    ).where("key is not null and t is not null and id is not null")
    leaves = leaves.groupBy("key", "t").agg(F.min("id").alias("id"))
    tol = F.lit(int(tolerance_us))
    leaves = leaves.withColumn(
        "bucket", F.explode(F.sequence(F.shiftright(F.col("t") - tol, bits), F.shiftright(F.col("t") + tol, bits)))
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    hot = (
        probes.select("key", "bucket", one.alias("q"), zero.alias("m"))
        .unionByName(leaves.select("key", "bucket", zero.alias("q"), one.alias("m")))
        .groupBy("key", "bucket")
        .agg(F.sum("q").alias("q"), F.sum("m").alias("m"))
        .where((F.col("q") > HOT_QUERIES) | (F.col("m") > HOT_LEAVES))
        .where("q > 0 and m > 0")
        .select("key", "bucket", F.ceil(F.col("q") / HOT_QUERIES).cast("int").alias("na"), F.greatest(F.ceil(F.col("m") / HOT_LEAVES), one).cast("int").alias("nb"))
    )
    hot = cut(hot)
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        salt = lambda c, n: F.pmod(F.xxhash64(F.lit(7), c), n).cast("int")
        probes = probes.join(small, ["key", "bucket"], "left").na.fill(1, ["na", "nb"])
        probes = probes.withColumn("sa", salt(F.col("id"), F.col("na"))).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        leaves = leaves.join(small, ["key", "bucket"], "left").na.fill(1, ["na", "nb"])
        leaves = leaves.withColumn("sb", salt(F.col("t"), F.col("nb"))).withColumn("sa", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    else:
        probes = probes.withColumn("sa", F.lit(0)).withColumn("sb", F.lit(0))
        leaves = leaves.withColumn("sa", F.lit(0)).withColumn("sb", F.lit(0))
    cols = ["key", "bucket", "sa", "sb", "side", "t", "id"]
    rows = leaves.withColumn("side", F.lit(0)).select(cols).unionByName(probes.withColumn("side", F.lit(1)).select(cols))
    found = (
        rows.repartition("key", "bucket", "sa", "sb")
        .sortWithinPartitions(*cols)
        .mapInArrow(_matcher(bits, int(tolerance_us)), "_left bigint, _right bigint, _gap bigint")
    )
    if n_hot:
        best = found.groupBy("_left").agg(F.min(F.struct("_gap", "_right")).alias("_b"))
        found = best.select("_left", F.col("_b._right").alias("_right"), F.col("_b._gap").alias("_gap"))
    return found.select(F.col("_left").alias(left_id), F.col("_right").alias(right_id), F.col("_gap").alias("gap_us"))
