from tallyfield.llm import leakage
from tallyfield.llm.leakage import passages_in_documents, passages_nearby, rarest_offsets
from tallyfield.llm.words import word_forms, words

P1 = " ".join(f"alpha{i}" for i in range(20))
P2 = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_words_without_dress():
    assert words("<p>Thé <b>Qu­ick</b> bro​wn—fox,\r\ńx") == ["the", "quick", "brown", "fox", "x"]
    assert word_forms("un-\nits well-\r\n known") == [["units", "wellknown"], ["un", "its", "well", "known"]]
    assert word_forms(None) == [[]] and word_forms("") == [[]]


def test_rarest_offsets_cover_every_window():
    got = rarest_offsets([9, 5, 1, 9, 5, 7], 3, 2)
    for start in range(4):
        assert len(got & set(range(start, start + 3))) >= 2
    assert rarest_offsets([9, 0, 5], 3, 2) == set()


def brute(docs, items, run):
    out = set()
    for d, t, *_ in docs:
        for w in word_forms(t):
            grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
            for item, p, *_ in items:
                v = words(p)
                if any(tuple(v[i : i + run]) in grams for i in range(len(v) - run + 1)):
                    out.add((d, item))
    return out


def test_matches_brute_force_on_odd_texts(spark):
    ws = P1.split()
    docs = [
        (1, "x " + P1.upper().replace(" ", ",\n") + " y"), (2, " ".join(ws[3:15])), (3, " ".join(ws[3:14])), (4, None), (5, ""), (6, "..."),
        (7, " ".join(ws[:8] + ["zz"] + ws[8:])), (8, " ".join(ws[2:9]) + "<b> " + " ".join(ws[9:16]) + "</b>"), (9, P2.replace("four", "fo-\nur")),
        (10, (P1 + " filler ") * 200), (11, P2.replace(" ", " ")), (12, " ".join(reversed(ws))), (1, P2), (13, P1 + " " + P2),
    ]
    items = [(100, P1), (101, P2), (102, None), (103, "too short"), (104, P2), (105, " ".join(["same"] * 14))]
    docs.append((14, "same " * 12))
    docs.append((15, "same " * 11))
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, term int")
    i = spark.createDataFrame([(*x, "p") for x in items], "item_id bigint, passage string, doc string")
    got = passages_in_documents(d, i, "doc_id", "text", "item_id", "passage", 12).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 12)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {r.longest for r in got if r.item_id == 100 and r.doc_id in (1, 10)} == {20}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, P1)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, P1)], "item_id bigint, passage string")
    assert passages_in_documents(d.where("false"), i, "doc_id", "text", "item_id", "passage").count() == 0
    assert passages_in_documents(d, i.where("false"), "doc_id", "text", "item_id", "passage").count() == 0


def test_joins_instead_of_broadcasts_change_nothing(spark, monkeypatch):
    d = spark.createDataFrame([(1, P1), (2, P2), (3, P1 + " " + P2)], "doc_id bigint, text string")
    i = spark.createDataFrame([(10, P1), (11, P2), (12, P1), (13, P1), (13, P2), (13, P2)], "item_id bigint, passage string")
    run = lambda: sorted((r.doc_id, r.item_id) for r in passages_in_documents(d, i, "doc_id", "text", "item_id", "passage").collect())
    whole = run()
    monkeypatch.setattr(leakage, "VOCABULARY_LIMIT", 3)
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 1)
    assert run() == whole == [(1, 10), (1, 12), (1, 13), (2, 11), (2, 13), (3, 10), (3, 11), (3, 12), (3, 13)]


def test_one_index_for_several_questions(spark):
    import os

    from tallyfield.llm.leakage import drop_index, positional_index

    d = spark.createDataFrame([(1, P1), (2, " ".join(reversed(P1.split())))], "doc_id bigint, text string")
    i = spark.createDataFrame([(10, P1)], "item_id bigint, passage string")
    index = positional_index(d, "doc_id", "text")
    names = ("doc_id", "text", "item_id", "passage")
    assert {r.doc_id for r in passages_in_documents(d, i, *names, index=index).collect()} == {1} and {r.doc_id for r in passages_nearby(d, i, *names, index=index).collect()} == {1, 2}
    folder = index.removeprefix("file:")
    before = set(os.listdir(os.path.dirname(folder)))
    passages_in_documents(d, i, *names).count()
    assert not [x for x in set(os.listdir(os.path.dirname(folder))) - before if x.startswith("postings")]
    drop_index(spark, index)
    assert not os.path.exists(folder)


def test_nearby_words_in_any_order(spark):
    ws = P1.split()
    docs = [(1, " ".join(reversed(ws))), (2, " filler ".join(ws)), (3, (" gap" * 30).join(ws)), (4, " ".join(ws[:5])), (5, None), (6, P2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(10, P1), (11, "six words that are not there"), (12, None)], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in passages_nearby(d, i, "doc_id", "text", "item_id", "passage", 8, 6, 60).collect()}

    def brute():
        df = {w: sum(w in words(t) for _, t in docs) for w in ws}
        rare = sorted(dict.fromkeys(ws), key=lambda w: df[w])[:8]
        out = set()
        for k, t in docs:
            at = [(p, w) for p, w in enumerate(words(t)) if w in rare]
            if any(len({w for q, w in at if p <= q < p + 60}) >= 6 for p, _ in at):
                out.add((k, 10))
        return out

    assert got == brute() and (1, 10) in got and (3, 10) not in got
    assert passages_nearby(d.where("false"), i, "doc_id", "text", "item_id", "passage").count() == 0
