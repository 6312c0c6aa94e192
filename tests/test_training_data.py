from datetime import date

from pyspark.sql import functions as F

from tallyfield.operators import schema_drift
from tallyfield.operators.schema_drift import Node, align, assign, compile_projections, consistent_rows, consistent_table, edit_script, parse_file, schema_changes
from tallyfield.operators.snapshots import snapshot_changes, two_decimals


def test_parsing():
    p = parse_file("﻿a;b;c\r\n1;x, y;\r\n\r\n+2;;True\r\n", "csv")
    assert {k: v.kind for k, v in p.root.children.items()} == {"a": "int", "b": "string", "c": "boolean"} and len(p.rows) == 2
    j = parse_file('{"a": 1, "n": {"x": 2.5}}\nnot json\n{"a": 2.5, "b": null, "n": {"x": 1}}', "jsonl")
    assert j.root.children["a"].kind == "double" and j.root.children["b"].kind is None and j.root.children["n"].children["x"].kind == "double"
    assert not parse_file(None, "csv").root.children and not parse_file("", "jsonl").root.children


def test_assignment_is_least():
    import itertools
    import random

    rnd = random.Random(2)
    for n in range(1, 6):
        c = [[rnd.randrange(20) for _ in range(n)] for _ in range(n)]
        got = assign(c)
        assert sorted(got) == list(range(n))
        assert sum(c[i][j] for i, j in enumerate(got)) == min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def body(names, rows):
    return "\n".join([",".join(names), *[",".join(map(str, r)) for r in rows]])


ROWS = [("Ann Lee", "QB", 10.5, 3), ("Bob Ray", "WR", 8.25, 7), ("Cy Dunn", "TE", 6.75, 9), ("Di Voss", "K", 4.5, 11)]


def test_scripts_and_moves():
    old = parse_file(body(["player", "pos", "fp", "rank"], ROWS), "csv")
    new = parse_file(body(["player", "position", "extra", "rank"], [(p, q, i * 31 % 7, r) for i, (p, q, _, r) in enumerate(ROWS)]), "csv")
    assert edit_script(old, new) == [("add", None, ("extra",)), ("delete", ("fp",), None), ("rename", ("pos",), ("position",))]
    a = parse_file('{"player": "A", "m": {"x": 1.5}}\n{"player": "B", "m": {"x": 2.5}}', "jsonl")
    b = parse_file('{"player": "A", "n": {"k": 1}, "x": 1.5}\n{"player": "B", "n": {"k": 2}, "x": 2.5}', "jsonl")
    kinds = {s[0] for s in edit_script(a, b)}
    assert "move" in kinds or "rename" in kinds
    assert edit_script(a, a) == [] and isinstance(a.root, Node)


def test_changes_types_and_projection(spark):
    days = [
        (1, "f", 1, body(["player", "pos", "fp", "rank"], ROWS)),
        (2, "f", 2, body(["player", "rank", "position", "fp"], [(p, r, q, "") for p, q, _, r in ROWS])),
        (3, "f", 3, body(["player", "position", "fp", "rank"], [(p, q, int(v), r) for p, q, v, r in ROWS])),
        (4, "f", 3, body(["player", "position", "fp", "rank"], [(p, q, int(v), r) for p, q, v, r in ROWS])),
        (5, "g", 1, None),
        (6, "g", 2, body(["player", "fp"], [("Ann Lee", 1)])),
        (7, "h", 1, ""),
    ]
    df = spark.createDataFrame([(i, f, date(2026, 9, n), "csv", b, "x") for i, f, n, b in days], "file_id bigint, feed_id string, file_date date, body_format string, body string, change_kind string")
    got = {(r.file_id, r.change_kind, r.field_name, r.new_name) for r in schema_changes(df).collect()}
    assert got == {(2, "renamed", "pos", "position"), (3, "retyped", "fp", ""), (6, "added", "player", ""), (6, "added", "fp", "")}
    proj = {r.file_id: r.projection for r in compile_projections(df).collect()}
    assert proj[4]["position"] == "pos" and proj[1]["pos"] == "pos"
    rows = {(r.file_id, r.row_no): r.fields for r in consistent_rows(df).collect()}
    assert rows[(3, 0)] == {"player": "Ann Lee", "pos": "QB", "fp": "10", "rank": "3"}
    assert schema_changes(df.where("false")).count() == 0


def test_snapshots(spark):
    rows = [
        ("b", 1, 1, "p", 1, 2.0, None), ("b", 1, 1, "q", 2, 3.0, 1), ("b", 1, 1, "r", None, None, 1), ("b", 1, 1, "s", 1, float("nan"), 1), ("b", 1, 1, "t", None, 1.0, 2),
        ("b", 4, 2, "p", 1, 2.0000000001, None), ("b", 4, 2, "p", 1, 2.0, None), ("b", 4, 2, "q", 2, 3.01, 1), ("b", 4, 2, "s", 1, None, 1), ("b", 4, 2, "t", 1, 1.0, None), ("b", 4, 2, "u", 5, 5.0, 5),
        ("b", 2, 3, "p", 1, 2.0, 1), ("c", 1, 1, "p", 1, 1.0, 1), (None, 1, 1, "p", 1, 1.0, 1), ("b", 1, None, "z", 1, 1.0, 1), ("b", 4, 2, None, 1, 1.0, 1),
    ]
    df = spark.createDataFrame([(*r, "old") for r in rows], "board string, no int, day int, key string, a int, x double, d int, _e string")
    run = lambda d: {(r.board, r.no, r.key, r.change_kind) for r in snapshot_changes(d, "board", "no", "day", "key", [F.col("a"), two_decimals(F.col("x")), F.col("d")]).collect()}
    got = run(df)
    assert got == {
        ("b", 4, "q", "changed"), ("b", 4, "r", "removed"), ("b", 4, "s", "changed"), ("b", 4, "t", "changed"), ("b", 4, "u", "added"),
        ("b", 2, "p", "changed"), ("b", 2, "q", "removed"), ("b", 2, "s", "removed"), ("b", 2, "t", "removed"), ("b", 2, "u", "removed"),
    }
    assert run(df.repartition(7).unionByName(df)) == got and run(df.where("false")) == set()


def test_align_prefers_the_player_field():
    a, b = parse_file(body(["player", "team"], [("Ann", "T1"), ("Bob", "T2")]), "csv"), parse_file(body(["team", "player"], [("T1", "Bob"), ("T2", "Ann")]), "csv")
    align(a, b)
    assert a.key == ("player",) == b.key


def table_of(spark, bodies, fmt="csv", feeds=None):
    rows = [(i, (feeds or {}).get(i, "f"), date(2026, 9, 1 + i), fmt, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "file_id bigint, feed_id string, file_date date, body_format string, body string")


def test_a_name_used_again_keeps_both_fields(spark):
    name = [r[0] for r in ROWS]
    first = body(["player", "a"], zip(name, (1.5, 2.5, 3.5, 4.5)))
    renamed = body(["player", "b"], zip(name, (1.5, 2.5, 3.5, 4.5)))
    again = body(["player", "b", "a"], zip(name, (1.5, 2.5, 3.5, 4.5), (40.5, 50.25, 9.0, 7.0)))
    gone = body(["player", "a"], zip(name, (40.5, 50.25, 9.0, 7.0)))
    files = table_of(spark, [first, renamed, again, gone, again])
    proj = {r.file_id: r.projection for r in compile_projections(files).collect()}
    assert proj[1] == {"player": "player", "b": "a"} and proj[2] == {"player": "player", "b": "a", "a": "a#2"} and proj[3] == {"player": "player", "a": "a#2"} and proj[4] == proj[2]
    assert all(len(set(p.values())) == len(p) for p in proj.values())
    rows = {(r.file_id, r.row_no): r.fields for r in consistent_rows(files).collect()}
    assert rows[(2, 0)] == {"player": "Ann Lee", "a": "1.5", "a#2": "40.5"}


def test_swapped_names_and_moves_are_applied(spark):
    name = [r[0] for r in ROWS]
    line = lambda **k: "\n".join(__import__("json").dumps({"player": p, **{f: v(i) for f, v in k.items()}}) for i, p in enumerate(name))
    nested = [line(st=lambda i: {"fp": i + 0.5, "n": i * 3 % 7}, mk=lambda i: {"q": i * i}), line(st=lambda i: {"n": i * 3 % 7}, mk=lambda i: {"q": i * i, "fp": i + 0.5})]
    files = table_of(spark, nested, "jsonl")
    assert {(r.change_kind, r.field_name, r.new_name) for r in schema_changes(files).collect()} == {("moved", "st.fp", "mk.fp")}
    assert {r.file_id: r.projection for r in compile_projections(files).collect()}[1] == {"player": "player", "st.n": "st.n", "mk.q": "mk.q", "mk.fp": "st.fp"}
    a, b = parse_file(nested[0], "jsonl"), parse_file(line(x=lambda i: i + 0.5, st=lambda i: {"n": i * 3 % 7}, mk=lambda i: {"z": i * i}), "jsonl")
    assert {s for s in edit_script(a, b)} == {("move", ("st", "fp"), ("x",)), ("rename", ("mk", "q"), ("mk", "z"))}
    branch = parse_file(line(other=lambda i: {"fp": i + 0.5, "n": i * 3 % 7}, mk=lambda i: {"q": i * i}), "jsonl")
    assert ("rename", ("st",), ("other",)) in edit_script(parse_file(nested[0], "jsonl"), branch)


def test_one_typed_table_of_all_files(spark):
    bodies = [body(["player", "n", "x", "flag", "big"], [("Ann", 1, 2, True, "1" * 25), ("Bob", 2, 3, False, 5)]), body(["player", "n", "x", "flag"], [("Ann", 7, 2.5, "no"), ("Bob", "", 3, "yes")])]
    df = consistent_table(table_of(spark, bodies, feeds={0: "f", 1: "g"}))
    assert dict(df.dtypes) == {"_file_id": "bigint", "_row_no": "int", "player": "string", "n": "bigint", "x": "double", "flag": "string", "big": "string"}
    got = {(r._file_id, r._row_no): (r.player, r.n, r.x, r.flag, r.big) for r in df.collect()}
    assert got == {(0, 0): ("Ann", 1, 2.0, "True", "1" * 25), (0, 1): ("Bob", 2, 3.0, "False", "5"), (1, 0): ("Ann", 7, 2.5, "no", None), (1, 1): ("Bob", None, 3.0, "yes", None)}
    assert consistent_table(table_of(spark, bodies).where("false")).count() == 0


def test_chunks_of_a_feed_change_nothing(spark, monkeypatch):
    bodies = [body(["player", "f" + str(i // 2), "g"], [(p, v + i // 2 * 0 + k, k) for k, (p, _, v, _) in enumerate(ROWS)]) for i in range(9)]
    files = table_of(spark, bodies)
    run = lambda: sorted(map(tuple, schema_changes(files).collect()))
    whole = run()
    assert len(whole) == 4 and {r[1] for r in whole} == {"renamed"}
    monkeypatch.setattr(schema_drift, "CHUNK", 2)
    monkeypatch.setattr(schema_drift, "BROADCAST_FILES", 1)
    assert run() == whole
