"""The N best items of every group, by mergeable bounded heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FLUSH_ROWS = 400_000


_NAN = float("nan")


class _Entry:
    """An item whose order is worst first, as heapq keeps the least at the root."""

    __slots__ = ("score", "key", "ident", "live")

    def __init__(self, score: object, key: object, ident: object) -> None:
        self.score, self.key, self.ident, self.live = score, key, ident, True

    def order(self) -> tuple:
        """After the score: key from low to high in its own type, NaN after numbers, null last; then identifier."""
        return (self.key is None, self.key != self.key, self.key if self.key is not None else 0, self.ident)

    def __lt__(self, other: "_Entry") -> bool:
        if self.score != other.score:
            return self.score < other.score
        return self.order() > other.order()


class BoundedHeap:
    """At most n items with different keys: the best of all that were pushed.

    Items are compared by score from high to low, then key, then identifier. Of the items
    of one key only the best counts. Heaps merge by pushing one's items into the other;
    the result doesn't depend on the order of pushes or on how rows were divided, since a
    key among the n best of all rows is among the n best of whatever part holds its best row.
    """

    __slots__ = ("n", "heap", "by_key")

    def __init__(self, n: int) -> None:
        self.n, self.heap, self.by_key = n, [], {}

    def worst_score(self) -> object:
        """The score that an item must reach; null while there is room."""
        return self.heap[0].score if len(self.by_key) >= self.n else None

    def push(self, score: object, key: object, ident: object) -> None:
        if key != key:
            key = _NAN
        full = len(self.by_key) >= self.n
        if full and score < self.heap[0].score:
            return
        item, old = _Entry(score, key, ident), self.by_key.get(key)
        if old is not None:
            if not old < item:
                return
            old.live = False
        elif full:
            if not self.heap[0] < item:
                return
            gone = heapq.heappop(self.heap)
            del self.by_key[gone.key]
        self.by_key[key] = item
        heapq.heappush(self.heap, item)
        while not self.heap[0].live:
            heapq.heappop(self.heap)
        if len(self.heap) > 2 * self.n + 8:
            self.heap = [x for x in self.heap if x.live]
            heapq.heapify(self.heap)

    def items(self) -> list[_Entry]:
        return sorted(self.by_key.values(), reverse=True)


def _emit(groups: Iterable[tuple], heaps: Iterable[BoundedHeap], schema: pa.Schema, places: bool) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in schema]
    for group, heap in zip(groups, heaps):
        for place, x in enumerate(heap.items(), 1):
            for c, v in zip(cols, (*group, x.score, x.key, x.ident, place) if places else (*group, x.score, x.key, x.ident)):
                c.append(v)
        if len(cols[0]) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            cols = [[] for _ in schema]
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def group_rows(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, local): a row of each different group, and for every row the place of its group there.

    Columns are added one by one and the numbers made dense after each, so they never exceed
    rows times the values of one column, however many columns there are.
    """
    codes = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for column in columns:
        own = column.dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(1, len(own.dictionary)) + own.indices.to_numpy().astype(np.int64), return_inverse=True)[1]
    _, rows, local = np.unique(codes, return_index=True, return_inverse=True)
    return rows, local


def _folder(n: int, n_groups: int, schema: pa.Schema, final: bool):
    """A mapInArrow function over (group columns, score, key, id).

    Not final: heaps of whatever groups the task meets, sent on when their items reach
    FLUSH_ROWS, so the memory of a task is bounded. Final: the rows come sorted by group, so
    only the groups of one batch are held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple, BoundedHeap] = {}
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first, local = group_rows([batch.column(i) for i in range(n_groups)])
            mine = []
            for group in zip(*(batch.column(i).take(pa.array(first)).to_pylist() for i in range(n_groups))):
                heap = heaps.get(group)
                if heap is None:
                    heap = heaps[group] = BoundedHeap(n)
                mine.append(heap)
            score = batch.column(n_groups).to_numpy(zero_copy_only=False)
            worst = [h.worst_score() for h in mine]
            floor = np.array([score[i] if w is None else w for i, w in zip(first, worst)], score.dtype)
            rows = np.flatnonzero((score >= floor[local]) | np.array([w is None for w in worst])[local])
            rows = rows[np.argsort(score[rows], kind="stable")[::-1]]
            scores, keys, idents = (batch.column(n_groups + i).take(pa.array(rows)).to_pylist() for i in range(3))
            for g, s, k, i in zip(local[rows].tolist(), scores, keys, idents):
                mine[g].push(s, k, i)
            if final:
                last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(n_groups))
                done = [g for g in heaps if g != last]
                yield from _emit(done, [heaps.pop(g) for g in done], schema, True)
            else:
                held += sum(len(h.by_key) for h in mine)
                if held >= FLUSH_ROWS:
                    held = sum(len(h.by_key) for h in heaps.values())
                    if held >= FLUSH_ROWS:
                        yield from _emit(heaps.keys(), heaps.values(), schema, False)
                        heaps, held = {}, 0
        yield from _emit(heaps.keys(), heaps.values(), schema, final)

    return fold


def top_n_per_group(df: DataFrame, groups: list[str], score: str, key: str, ident: str, n: int, place: str = "place") -> DataFrame:
    """The n best items of every group with their place, 1 the best.

    Each task folds its rows into one heap of at most n items for each group, so what is
    shuffled is at most n rows for each task and group, however many rows a group has; the
    heaps of a group are then merged the same way from rows sorted by group. No group is
    ever held whole, and the hottest group costs its task n rows for each earlier task.

    Order: score from high to low, then key, then identifier, each in its own type, so
    integers and decimals of any size keep every digit and numeric keys stand by value; nulls of
    the key come last. Only the best row of each key counts; rows with a null key are one key.
    Rows whose score is null or NaN, or whose identifier is null, don't take part. A null in a
    group column is a group of its own; group columns are of atomic types, and there may be any
    number of them. Repeated rows give one place. An empty table gives no rows. Other columns
    aren't read, so their names can't clash.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if not groups:
        raise ValueError("at least one group column is needed")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    inner = [f"_g{i}" for i in range(len(groups))]
    # Doubles travel as text, since -0.0 and the many NaN are one group each.
    real = (T.FloatType, T.DoubleType)
    as_group = lambda g: F.when(F.col(g) == 0, F.lit("0.0")).otherwise(F.col(g).cast("string")) if isinstance(kinds[g], real) else F.col(g)
    rows = df.select(*[as_group(g).alias(x) for g, x in zip(groups, inner)], F.col(score).alias("_score"), F.col(key).alias("_key"), F.col(ident).alias("_id"))
    rows = rows.where("_score is not null and _id is not null")
    if isinstance(kinds[score], real):
        rows = rows.where("not isnan(_score)")
    held = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    placed = T.StructType([*held.fields, T.StructField("_place", T.IntegerType(), True)])
    partial = rows.mapInArrow(_folder(n, len(groups), to_arrow_schema(held), False), held)
    merged = partial.repartition(*inner).sortWithinPartitions(*inner).mapInArrow(_folder(n, len(groups), to_arrow_schema(placed), True), placed)
    return merged.select(
        *[F.col(x).cast(kinds[g]).alias(g) for g, x in zip(groups, inner)],
        F.col("_place").alias(place),
        F.col("_id").alias(ident),
        F.col("_key").alias(key),
        F.col("_score").alias(score),
    )
