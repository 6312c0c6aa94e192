"""Pairs of words within a bounded number of edits, by a join over shards of tries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, heavy_partitions
from .automaton import LevenshteinAutomaton, build_trie
from .skew import BROADCAST_ROWS, grid

HOT_PROBES = 20_000
HOT_WORDS = 50_000


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts that a word of that length is cut into."""
    base, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - extra)
        out.append((at, n))
        at += n
    return out


def word_keys(word: str, k: int) -> list[str]:
    """The shards that hold a word: its length with each of its parts.

    One edit spoils one part, a swap over a boundary two, so of 2k + 1 parts one stays whole.
    """
    return [f"{len(word)}:{i}:{word[s : s + n]}" for i, (s, n) in enumerate(segments(len(word), 2 * k + 1))]


def probe_keys(word: str, k: int) -> set[str]:
    """The shards in which words within k edits may be: parts may have moved by up to k places."""
    out = set()
    for length in range(max(0, len(word) - k), len(word) + k + 1):
        for i, (s, n) in enumerate(segments(length, 2 * k + 1)):
            for at in range(max(0, s - k), min(len(word) - n, s + k) + 1):
                out.add(f"{length}:{i}:{word[at : at + n]}")
    return out


def _keyed(k: int, probe: bool):
    schema = pa.schema([("shard", pa.string()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, words = [], []
            for w, block in zip(*(c.to_pylist() for c in batch.columns)):
                for key in probe_keys(w, k) if probe else word_keys(w, k):
                    shards.append(f"{block}:{key}")
                    words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), pa.array(words, pa.string())], schema=schema)

    return run


def _search(k: int):
    schema = pa.schema([("probe", pa.string()), ("word", pa.string()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, trie = None, [], None
        for batch in batches:
            probes, words, edits = [], [], []
            for *key, side, w in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    current, own, trie = key, [], None
                if side == 0:
                    own.append(w)
                    continue
                if not own:
                    continue
                if trie is None:
                    trie = build_trie(own)
                for found, e in LevenshteinAutomaton(w, k).search(trie):
                    probes.append(w)
                    words.append(found)
                    edits.append(e)
            if probes:
                yield pa.RecordBatch.from_arrays([pa.array(probes), pa.array(words), pa.array(edits, pa.int32())], schema=schema)

    return run


def edit_neighbours(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(probe, word, edits): words of right within k edits of words of left, equal ones included.

    Both sides have one column of strings, or a second one with the block of the word; only words
    of one block meet then. Nulls take no part, repeated words count once and empty words are
    words. The right words are divided into shards by length and by each of
    their parts; every shard is a trie that is walked together with a Levenshtein automaton of
    each probe sent to it. Shards with very many words or probes are divided into grids.
    """
    blocked = lambda d: (d if len(d.columns) > 1 else d.withColumn("block", F.lit(""))).toDF("word", "block")
    a = blocked(left).where("word is not null and block is not null").distinct()
    b = blocked(right).where("word is not null and block is not null").distinct()
    probes = a.mapInArrow(_keyed(k, True), "shard string, word string")
    words = b.mapInArrow(_keyed(k, False), "shard string, word string")
    probes, words, _ = grid(probes, words, ["shard"], F.col("word"), F.col("word"), HOT_PROBES, HOT_WORDS)
    cols = ["shard", "sa", "sb", "side", "word"]
    rows = words.withColumn("side", F.lit(0)).select(cols).unionByName(probes.withColumn("side", F.lit(1)).select(cols))
    found = rows.repartition("shard", "sa", "sb").sortWithinPartitions(*cols).mapInArrow(_search(k), "probe string, word string, edits int")
    return found.distinct()


ROWS = "block string, k int, side int, word string, ident bigint, mark int"
MATCHES = "a bigint, b bigint, edits int, mark_a int, mark_b int"


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot blocks under the keys of their words' parts."""
    for batch in batches:
        cols: list[list] = [[] for _ in batch.schema]
        for block, k, side, word, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            for key in sorted(probe_keys(word, k)) if side else word_keys(word, k):
                for c, v in zip(cols, (f"{block}:{key}", k, side, word, *rest)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, batch.schema)], schema=batch.schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of every shard, whose words (side 0) come before its probes (side 1)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edits", pa.int32()), ("mark_a", pa.int32()), ("mark_b", pa.int32())])
    current, own, trie = None, {}, None
    for batch in batches:
        cols: list[list] = [[] for _ in schema]
        for block, sa, sb, k, side, word, ident, mark in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, sa, sb) != current:
                current, own, trie = (block, sa, sb), {}, None
            if side == 0:
                own.setdefault(word, []).append((ident, mark))
                continue
            if len(own) == 1 and word in own:
                found = [(word, 0)]
            else:
                if trie is None:
                    trie = build_trie(own)
                found = LevenshteinAutomaton(word, k).search(trie) if own else ()
            for w, e in found:
                for other, m in own[w]:
                    if other != ident:
                        for c, v in zip(cols, (ident, other, e, mark, m)):
                            c.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def trie_join(rows: DataFrame) -> DataFrame:
    """MATCHES of probes (side 1) and words (side 0) of one block within k edits of each other.

    rows are ROWS. A block is one trie, walked together with a Levenshtein automaton of each of
    its probes. Blocks with very many words or probes are divided by their words' parts, of which
    one stays whole within k edits, and what is still hot then into grids; nothing is left
    out. A match may come more than once.
    """
    hot = rows.groupBy("block").agg(F.sum(F.lit(1) - F.col("side")).alias("m"), F.sum("side").alias("q")).where(f"(m > {HOT_WORDS} or q > {HOT_PROBES}) and m > 0 and q > 0").select("block")
    hot = cut(hot)
    n = hot.count()
    placed = rows.select("block", F.lit(0).alias("sa"), F.lit(0).alias("sb"), "k", "side", "word", "ident", "mark")
    if n:
        small = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        parts = cut(rows.join(small, "block", "left_semi").mapInArrow(_divide, ROWS))
        probes, words, _ = grid(parts.where("side = 1"), parts.where("side = 0"), ["block"], F.col("ident"), F.col("ident"), HOT_PROBES, HOT_WORDS)
        placed = placed.join(small, "block", "left_anti")
        for d in (probes, words):
            placed = placed.unionByName(d.select(placed.columns))
    return placed.repartition(heavy_partitions(rows.sparkSession), "block", "sa", "sb").sortWithinPartitions("block", "sa", "sb", "side").mapInArrow(_walk, MATCHES)
