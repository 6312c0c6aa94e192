"""Schemas that drift between files: edit scripts, changes and one consistent table."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, heavy_partitions
from .ranking import look_back, running_total

SEPARATORS = ",;\t|"
_INT = re.compile(r"[+-]?\d+")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_ANY_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)")
#: Least agreement beyond chance of two fields' values that makes them one field under two names.
SAME_VALUES = 0.35
IMPOSSIBLE = 1e6
#: Cost of taking a leaf to another parent; an addition or a deletion costs 1.
MOVE = 0.3
#: Files of a feed that one task compares in a row, and files up to which their list is broadcast.
CHUNK, BROADCAST_FILES = 32, 200_000
#: Fields that the one wide table may have.
MAX_FIELDS = 5_000


@dataclass
class Node:
    """A field of a schema: leaves have a type (null if no value was seen) and values by row key."""

    name: str
    kind: str | None = None
    children: dict[str, "Node"] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


@dataclass
class Parsed:
    """A file: its schema tree and its rows as flat maps from path to text."""

    root: Node
    rows: list[dict[tuple[str, ...], str]]
    key: tuple[str, ...] | None = None


def _csv_kind(cells: list[str]) -> str | None:
    if not cells:
        return None
    if all(_INT.fullmatch(c) for c in cells):
        return "int"
    if all(_NUMBER.fullmatch(c) for c in cells):
        return "double"
    return "boolean" if all(c in ("True", "False") for c in cells) else "string"


def _json_kind(kinds: set[str]) -> str | None:
    if not kinds:
        return None
    if kinds <= {"int", "double"}:
        return "double" if "double" in kinds else "int"
    return kinds.pop() if len(kinds) == 1 else "string"


def _separator(header: str) -> str:
    bare = re.sub(r'"(?:[^"]|"")*"', "", header)
    return max(SEPARATORS, key=lambda s: (bare.count(s), -SEPARATORS.index(s)))


def parse_file(body: str | None, body_format: str | None) -> Parsed:
    """Schema and rows of one csv or JSON-lines file; a null or empty body has no fields.

    A byte-order mark, the kind of line ends and blank lines don't matter; a csv file's
    separator is the one of , ; tab | that its header has most of. Lines that aren't JSON
    objects are left out. Of a column name that occurs twice the first counts.
    """
    root, rows = Node(""), []
    text = (body or "").lstrip("﻿")
    if (body_format or "").lower() == "csv":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        lines = csv.reader(io.StringIO(text), delimiter=_separator(text.split("\n", 1)[0]))
        header = next((x for x in lines if any(c.strip() for c in x)), [])
        cells: dict[str, list[str]] = {}
        for name in header:
            if name not in root.children:
                root.children[name], cells[name] = Node(name), []
        for line in lines:
            row: dict[tuple[str, ...], str] = {}
            for name, cell in zip(header, line):
                if cell.strip() and (name,) not in row:
                    row[(name,)] = cell.strip()
                    cells[name].append(cell.strip())
            if row:
                rows.append(row)
        for name, own in cells.items():
            root.children[name].kind = _csv_kind(own)
        return Parsed(root, rows)
    kinds: dict[tuple[str, ...], set[str]] = {}

    def walk(value: object, node: Node, path: tuple[str, ...], row: dict[tuple[str, ...], str]) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, node.children.setdefault(k, Node(k)), (*path, k), row)
        elif value is not None:
            own = "boolean" if isinstance(value, bool) else "int" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
            kinds.setdefault(path, set()).add(own)
            row[path] = value if isinstance(value, str) else json.dumps(value)

    for line in re.split(r"\r\n|\r|\n", text):
        if line.strip():
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                row = {}
                walk(value, root, (), row)
                rows.append(row)

    def settle(node: Node, path: tuple[str, ...]) -> None:
        node.kind = _json_kind(kinds.get(path, set())) if not node.children else None
        for k, c in node.children.items():
            settle(c, (*path, k))

    settle(root, ())
    return Parsed(root, rows)


def _same(value: str) -> str:
    """A value without its dress: numbers as numbers wherever they stand alone, else letters and digits."""
    v = value.strip().lower()
    found = _ANY_NUMBER.findall(v)
    if len(found) == 1 and len(re.sub(r"[^a-z]", "", v)) <= 3:
        return f"{float(found[0]):.6g}"
    return re.sub(r"[\W_]+", "", v) or v


def _leaf(root: Node, path: tuple[str, ...]) -> Node:
    for k in path:
        root = root.children[k]
    return root


def align(old: Parsed, new: Parsed) -> None:
    """Give both files' leaves their values by row key.

    The key is the field of both whose texts have most values in common, one whose name says
    player or name first.
    """
    texts = []
    for p in (old, new):
        by: dict[tuple[str, ...], set[str]] = {}
        for row in p.rows:
            for path, v in row.items():
                if not _NUMBER.fullmatch(v):
                    by.setdefault(path, set()).add(v)
        texts.append(by)
    pairs = [(a, b) for a in texts[0] for b in texts[1] if a == b or (a not in texts[1] and b not in texts[0])]
    named = lambda p: bool(re.search(r"player|name", p[-1], re.I))
    best = max(pairs, key=lambda ab: (len(texts[0][ab[0]] & texts[1][ab[1]]) > 0, ab[0] == ab[1] and named(ab[0]), len(texts[0][ab[0]] & texts[1][ab[1]]), ab), default=None)
    for p, key in zip((old, new), best or (None, None)):
        p.key = key
        if key is not None:
            for row in p.rows:
                if key in row:
                    for path, v in row.items():
                        _leaf(p.root, path).values.setdefault(row[key], _same(v))


def likeness(a: Node, b: Node) -> float:
    """Agreement beyond chance of two leaves' values for the same rows; 0 if there is nothing to tell."""
    shared = [k for k in a.values if k in b.values]
    if len(shared) < 2:
        return 0.0
    n = len(shared)
    agree = sum(a.values[k] == b.values[k] for k in shared) / n
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    for k in shared:
        left[a.values[k]] = left.get(a.values[k], 0) + 1
        right[b.values[k]] = right.get(b.values[k], 0) + 1
    chance = sum(c * right.get(v, 0) for v, c in left.items()) / (n * n)
    beyond = (agree - chance) / (1 - chance) if chance < 0.999 else 0.0
    if chance > 0.6 and agree > 0.8:
        beyond = max(beyond, agree * names_alike(a.name, b.name))
    return beyond


def names_alike(a: str, b: str) -> float:
    """Shared letters in order over the longer name, without case and signs."""
    x, y = (re.sub(r"[\W_]+", "", s.lower()) for s in (a, b))
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1] / max(len(x), len(y))


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row of a square matrix in a matching of least total cost."""
    n = len(cost)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    out = [0] * n
    for j in range(1, n + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def leaf_cost(a: Node, b: Node, moved: bool) -> float:
    """Cost of taking one leaf for the other under a new name or parent, IMPOSSIBLE if they differ."""
    same = likeness(a, b)
    if moved and a.name == b.name:
        told = len(a.values.keys() & b.values.keys()) >= 2
        return MOVE + (0.9 * (1.0 - same) if told else 0.0) if same >= SAME_VALUES or not told else IMPOSSIBLE
    return 1.0 - 0.9 * same + (MOVE if moved else 0.0) if same >= SAME_VALUES else IMPOSSIBLE


def pair_up(gone: list, come: list, cost: object, single: object) -> list[tuple]:
    """(old or null, new or null): the pairs, deletions and additions of least total cost."""
    n, m = len(gone), len(come)
    if not n or not m:
        return [(x, None) for x in gone] + [(None, y) for y in come]
    table = [[0.0] * (n + m) for _ in range(n + m)]
    for i in range(n):
        for j in range(m):
            table[i][j] = cost(gone[i], come[j])
        for j in range(m, n + m):
            table[i][j] = single(gone[i])
    for j in range(m):
        for i in range(n, n + m):
            table[i][j] = single(come[j])
    out = []
    for i, j in enumerate(assign(table)):
        if i < n and j < m and table[i][j] < IMPOSSIBLE:
            out.append((gone[i], come[j]))
        else:
            out += [(gone[i], None)] if i < n else []
            out += [(None, come[j])] if j < m else []
    return out


def branch_cost(a: Node, b: Node) -> float:
    """Cost of taking one branch for the other under a new name: what its leaves don't share."""
    own, other = dict(_leaves(a)), dict(_leaves(b))
    differ = len(own.keys() ^ other.keys()) / 2 + sum(own[k].values != other[k].values and likeness(own[k], other[k]) < SAME_VALUES for k in own.keys() & other.keys())
    return 0.5 + differ if differ < 0.5 * (len(own) + len(other)) / 2 else IMPOSSIBLE


def _match(a: Node, b: Node, pa_: tuple[str, ...], pb: tuple[str, ...], gone: list, come: list) -> list[tuple]:
    """Script of what two nodes' children share; leaves without a counterpart are put into gone and come."""
    script = []
    for k in a.children.keys() & b.children.keys():
        x, y = a.children[k], b.children[k]
        if x.children and y.children:
            script += _match(x, y, (*pa_, k), (*pb, k), gone, come)
        elif x.children or y.children:
            gone += [(*pa_, k, *p) for p in _inner(x)]
            come += [(*pb, k, *p) for p in _inner(y)]
        elif x.kind != y.kind and x.kind and y.kind:
            script.append(("retype", (*pa_, k), (*pb, k)))
    left = [a.children[k] for k in sorted(a.children.keys() - b.children.keys())]
    right = [b.children[k] for k in sorted(b.children.keys() - a.children.keys())]
    for x, y in pair_up([x for x in left if x.children], [y for y in right if y.children], branch_cost, Node.size):
        if x and y:
            script.append(("rename", (*pa_, x.name), (*pb, y.name)))
            script += _match(x, y, (*pa_, x.name), (*pb, y.name), gone, come)
        else:
            gone += [(*pa_, x.name, *p) for p in _inner(x)] if x else []
            come += [(*pb, y.name, *p) for p in _inner(y)] if y else []
    gone += [(*pa_, x.name) for x in left if not x.children]
    come += [(*pb, y.name) for y in right if not y.children]
    return script


def edit_script(old: Parsed, new: Parsed) -> list[tuple[str, tuple[str, ...] | None, tuple[str, ...] | None]]:
    """The least-cost script of add, delete, rename, retype and move between two files' schemas.

    A field of the same name and parent is the same field. Whole branches may be renamed if most of
    their leaves go on. All other leaves, wherever they are, are paired at once so that the
    total cost of renames (same parent, agreeing values), moves (other parent, same name or
    agreeing values), additions and deletions is least.
    """
    align(old, new)
    gone, come = [], []
    script = _match(old.root, new.root, (), (), gone, come)
    parents = {s[1]: s[2] for s in script if s[0] == "rename"}

    def home(path: tuple[str, ...]) -> tuple[str, ...]:
        for n in range(len(path), 0, -1):
            if path[:n] in parents:
                return (*parents[path[:n]], *path[n:])
        return path

    def cost(x: tuple[str, ...], y: tuple[str, ...]) -> float:
        return leaf_cost(_leaf(old.root, x), _leaf(new.root, y), home(x[:-1]) != y[:-1])

    for x, y in pair_up(sorted(gone), sorted(come), cost, lambda _: 1.0):
        kind = "add" if x is None else "delete" if y is None else "rename" if home(x[:-1]) == y[:-1] else "move"
        script.append((kind, x, y))
    return sorted(script, key=lambda s: (s[0], s[1] or (), s[2] or ()))


def _inner(node: Node) -> list[tuple[str, ...]]:
    """Paths of a node's leaves from the node; a leaf's own path is empty."""
    if not node.children:
        return [()]
    return [(k, *rest) for k, c in node.children.items() for rest in _inner(c)]


def _dotted(path: tuple[str, ...] | None) -> str:
    return ".".join(path) if path else ""


def _leaves(node: Node, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Node]]:
    for k, c in node.children.items():
        if c.children:
            yield from _leaves(c, (*path, k))
        else:
            yield (*path, k), c


KINDS = {"add": "added", "delete": "removed", "rename": "renamed", "move": "moved"}
FIELDS = "file_id bigint, change_kind string, field_name string, new_name string, type_name string"


def _leaf_changes(script: list[tuple], old: Node) -> Iterator[tuple[str, str, str]]:
    """(kind, field_name, new_name) of a script, with the leaves of renamed branches."""
    for kind, a, b in script:
        if kind in KINDS:
            yield KINDS[kind], _dotted(a or b), _dotted(b) if a and b else ""


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields of each file and its changes against the one before it in its chunk; a carried file only
    stands before the first one."""
    schema = pa.schema([("file_id", pa.int64()), ("change_kind", pa.string()), ("field_name", pa.string()), ("new_name", pa.string()), ("type_name", pa.string())])
    at, before = None, None
    for batch in batches:
        cols: list[list] = [[] for _ in schema]

        def put(*row: object) -> None:
            for c, v in zip(cols, row):
                c.append(v)

        for feed, chunk, carried, ident, fmt, body in zip(*(c.to_pylist() for c in batch.columns)):
            new = parse_file(body, fmt)
            if (feed, chunk) != at:
                at, before = (feed, chunk), None
            if not carried:
                for path, leaf in _leaves(new.root):
                    put(ident, "field", _dotted(path), "", leaf.kind)
                if before is not None:
                    for kind, a, b in _leaf_changes(edit_script(before, new), before.root):
                        put(ident, kind, a, b, None)
            for _, leaf in _leaves(new.root):
                leaf.values.clear()
            before = new
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def file_fields(files: DataFrame) -> DataFrame:
    """Fields and structural changes of every file against the one before it in its feed.

    files: file_id, feed_id, file_date, body_format, body. The order of a feed's files comes from the
    narrow columns alone. Each CHUNK of files in a row is one group of the single shuffle of
    the bodies, together with the file before it, so a feed with a third of all files is
    spread like any other, each file is parsed once (the last of a chunk twice), and a task holds two
    files at a time.
    """
    meta = files.select("file_id", "feed_id", "file_date")
    steps = look_back(meta, ["feed_id"], ["file_date", "file_id"], {"prev_id": "file_id"}, {})
    placed = running_total(steps.withColumn("_one", F.lit(1)).withColumn("_at", F.struct("file_date", "file_id")), "_at", "_one", "_no", False, ["feed_id"])
    placed = cut(placed.select("file_id", "feed_id", "file_date", "prev_id", F.col("_no").cast("long").alias("_no")))
    chunk = F.floor(F.col("_no") / CHUNK).cast("long")
    into = F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("carried")), F.when(F.col("_no") % CHUNK == CHUNK - 1, F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("carried"))))
    seats = placed.select("file_id", "feed_id", "_no", F.explode(F.filter(into, lambda x: x.isNotNull())).alias("x"))
    seats = seats.select("file_id", "feed_id", "_no", "x.chunk", "x.carried")
    if placed.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        seats = F.broadcast(seats)
    bodies = files.select("file_id", "body_format", "body").join(seats, "file_id")
    rows = bodies.repartition(heavy_partitions(files.sparkSession), "feed_id", "chunk").sortWithinPartitions("feed_id", "chunk", "_no")
    compared = rows.select("feed_id", "chunk", "carried", "file_id", "body_format", "body").mapInArrow(_compare, FIELDS)
    return compared.join(placed.drop("_no"), "file_id")


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name, new_name): every change of every file against the one before.

    change_kind is added, removed, renamed, moved or retyped. A field without any value keeps the
    type it had before, so types are carried along each field's own history within its feed.
    The first file of a feed gives no change; files of a null feed form one feed. A file with
    a null or empty body has no fields. Files delivered again change nothing. An empty table
    gives no rows. Columns other than the five named ones aren't read.
    """
    rows = file_fields(files).withColumn("_field", F.col("change_kind") == "field").withColumn("_n", F.xxhash64("change_kind", "new_name"))
    seen = look_back(rows, ["feed_id", "field_name", "_field"], ["file_date", "file_id", "_n"], {"_at": "file_id"}, {"_type": "type_name"})
    retyped = (F.col("change_kind") == "field") & (F.col("_at") == F.col("prev_id")) & (F.col("type_name") != F.col("_type"))
    kind = F.when(F.col("change_kind") != "field", F.col("change_kind")).when(retyped, "retyped")
    return seen.select("file_id", kind.alias("change_kind"), "field_name", "new_name").where("change_kind is not null")


class Lasting:
    """Lasting names of one feed's fields, file by file.

    A field keeps the name it first bore through renames and moves. A name that comes back after its field
    went belongs to that field again; a new field whose name another one still goes by gets
    a number, so no two fields of a file share a lasting name.
    """

    def __init__(self) -> None:
        self.alive: dict[str, str] = {}
        self.last: dict[str, str] = {}
        self.used: set[str] = set()

    def apply(self, born: list[str], gone: list[str], renamed: list[tuple[str, str]]) -> dict[str, str]:
        """Take over the changes of a file; gives the new lasting names of its fields that changed."""
        came = {b: self.alive.get(a) for a, b in renamed}
        for a in [*gone, *(a for a, _ in renamed)]:
            self.alive.pop(a, None)
        out = {}
        for b, lasting in sorted(came.items()):
            if lasting is not None:
                self.alive[b] = self.last[b] = out[b] = lasting
        for b in sorted({*born, *(b for b, x in came.items() if x is None)} - out.keys()):
            lasting = self.last.get(b)
            if lasting is None or lasting in self.alive.values():
                lasting, k = b, 1
                while lasting in self.used:
                    k += 1
                    lasting = f"{b}#{k}"
            self.used.add(lasting)
            self.alive[b] = self.last[b] = out[b] = lasting
        return out


def field_projections(files: DataFrame) -> DataFrame:
    """(file_id, field_name, lasting_name, type_name): every field of every file with its lasting name.

    Only the changes of a feed are composed in the order of its files, as a stream of narrow
    rows; which of them holds for a file's field is then looked back for over ranges. A projection is
    one-to-one.
    """
    rows = cut(file_fields(files))
    change = rows.where("change_kind in ('added', 'removed', 'renamed', 'moved') or (change_kind = 'field' and prev_id is null)")
    change = change.select("feed_id", "file_date", "file_id", "change_kind", "field_name", "new_name")
    schema = pa.schema([("feed_id", pa.string()), ("file_date", pa.date32()), ("file_id", pa.int64()), ("field_name", pa.string()), ("lasting_name", pa.string())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed, at, state, own = object(), None, Lasting(), ([], [], [])
        cols: list[list] = [[] for _ in schema]

        def close() -> None:
            for name, lasting in state.apply(*own).items():
                for c, v in zip(cols, (*at, name, lasting)):
                    c.append(v)

        for batch in batches:
            for f, day, ident, kind, name, new in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, day, ident) != at:
                    if at is not None:
                        close()
                    if f != feed:
                        feed, state = f, Lasting()
                    at, own = (f, day, ident), ([], [], [])
                if kind in ("field", "added"):
                    own[0].append(name)
                elif kind == "removed":
                    own[1].append(name)
                else:
                    own[2].append((name, new))
            if len(cols[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema)], schema=schema)
                cols = [[] for _ in schema]
        if at is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema)], schema=schema)

    ordered = change.withColumn("feed_id", F.col("feed_id").cast("string")).withColumn("file_date", F.col("file_date").cast("date")).repartition("feed_id").sortWithinPartitions("feed_id", "file_date", "file_id")
    named = ordered.mapInArrow(compose, "feed_id string, file_date date, file_id bigint, field_name string, lasting_name string")
    own = rows.where("change_kind = 'field'").select(F.col("feed_id").cast("string").alias("feed_id"), F.col("file_date").cast("date").alias("file_date"), "file_id", "field_name", "type_name", F.lit(1).alias("_asks"))
    both = own.withColumn("_lasting", F.lit(None).cast("string")).unionByName(named.select("feed_id", "file_date", "file_id", "field_name", F.lit(None).cast("string").alias("type_name"), F.lit(0).alias("_asks"), F.col("lasting_name").alias("_lasting")))
    seen = look_back(both, ["feed_id", "field_name"], ["file_date", "file_id", "_asks"], {}, {"lasting_name": "_lasting"})
    return seen.where("_asks = 1").select("file_id", "field_name", F.coalesce("lasting_name", "field_name").alias("lasting_name"), "type_name")


def compile_projections(files: DataFrame) -> DataFrame:
    """(file_id, projection): for every file a map from its own field names to the feed's lasting ones."""
    pairs = F.collect_list(F.struct("field_name", "lasting_name"))
    return field_projections(files).groupBy("file_id").agg(F.map_from_entries(F.array_sort(pairs)).alias("projection"))


def unified_types(fields: DataFrame) -> DataFrame:
    """(lasting_name, type_name): the type that holds all of a field's types, over all files: int, double,
    boolean or string; string if no file has a value."""
    kinds = F.array_sort(F.collect_set("type_name"))
    one = F.when(F.size("k") == 1, F.get("k", F.lit(0))).when(F.size(F.array_except("k", F.array(F.lit("int"), F.lit("double")))) == 0, F.when(F.size("k") > 0, "double"))
    return fields.groupBy("lasting_name").agg(kinds.alias("k")).select("lasting_name", F.coalesce(one, F.lit("string")).alias("type_name"))


ROWS = "file_id bigint, row_no int, fields map<string,string>"


def _rows_of(files: DataFrame, projections: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for ident, fmt, body, projection in zip(*(batch.column(i).to_pylist() for i in range(4))):
                to = dict(projection or ())
                rows = parse_file(body, fmt).rows
                maps = [[(to.get(_dotted(k), _dotted(k)), v) for k, v in row.items()] for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(maps, kind)], names=["file_id", "row_no", "fields"])

    source = files.select("file_id", "body_format", "body").join(projections, "file_id", "left")
    return source.mapInArrow(read, ROWS)


def consistent_rows(files: DataFrame) -> DataFrame:
    """(file_id, row_no, fields): the rows of all files with values, as text, under their lasting names."""
    return _rows_of(files, compile_projections(files))


def consistent_table(files: DataFrame) -> DataFrame:
    """file_id, row_no and one typed column for each lasting name over all feeds.

    Types are brought together over all files (see unified_types); integers too long for 64 bits
    would be null in a bigint, so a field that has one is a string. Files lacking a field have null there. The
    list of fields, which is schema and not data, is collected; over MAX_FIELDS it is an error. Of names
    that differ in case alone all but the first get a number.
    """
    fields = cut(field_projections(files))
    projections = fields.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "lasting_name")))).alias("projection"))
    kinds = unified_types(fields).orderBy("lasting_name").limit(MAX_FIELDS + 1).collect()
    if len(kinds) > MAX_FIELDS:
        raise ValueError("the files have too many fields for one table")
    rows = cut(_rows_of(files, projections))
    whole = [r["lasting_name"] for r in kinds if r["type_name"] == "int"]
    value = lambda n: F.element_at("fields", F.lit(n))
    lost = rows.agg(*[F.max((value(n).isNotNull() & value(n).try_cast("bigint").isNull()).cast("int")).alias(f"c{i}") for i, n in enumerate(whole)]).first() if whole else ()
    long = {n for n, x in zip(whole, lost) if x}
    types = {"int": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
    column = lambda r: value(r["lasting_name"]) if r["type_name"] == "string" or r["lasting_name"] in long else value(r["lasting_name"]).try_cast(types[r["type_name"]])
    names, seen = {}, {"_file_id", "_row_no"}
    for r in kinds:
        name, k = r["lasting_name"], 1
        while name.lower() in seen:
            k += 1
            name = f"{r['lasting_name']}#{k}"
        seen.add(name.lower())
        names[r["lasting_name"]] = name
    return rows.select(F.col("file_id").alias("_file_id"), F.col("row_no").alias("_row_no"), *[column(r).alias(names[r["lasting_name"]]) for r in kinds])
