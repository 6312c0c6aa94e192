import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm.automaton import LevenshteinAutomaton, build_trie, osa
from tallyfield.llm.names import Name
from tallyfield.llm import triejoin
from tallyfield.llm.triejoin import edit_neighbours
from tallyfield.llm.variants import link_variants, linked_pairs

TEAMS = [("AAA", "AAX", "Amber Bay", "Owls"), ("BBB", None, "Birch Town", "Rams of Birch")]
word = st.text("abc", max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.lists(word, max_size=25), word, st.integers(1, 2))
def test_automaton_equals_the_full_table(words, query, k):
    got = LevenshteinAutomaton(query, k).search(build_trie(words))
    assert sorted(got) == sorted((w, osa(query, w)) for w in set(words) if osa(query, w) <= k)


def test_join_finds_every_neighbour(spark, monkeypatch):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(9))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in [*words, *words[:5]]] + [(None,)], "w string")
    for k, caps in ((1, (20_000, 50_000)), (2, (9, 5))):
        monkeypatch.setattr(triejoin, "HOT_PROBES", caps[0])
        monkeypatch.setattr(triejoin, "HOT_WORDS", caps[1])
        got = [(r.probe, r.word, r.edits) for r in edit_neighbours(df, df, k).collect()]
        assert sorted(got) == sorted((a, b, osa(a, b)) for a in words for b in words if osa(a, b) <= k)


def test_reading_names():
    n = Name("  Núñez-Smith,  Maria J. Jr. (WR)")
    assert (n.long, n.comma, n.initials, n.suffix, n.first_half) == (["nunezsmith", "maria"], 1, "j", "jr", {"nunezsmith": "nunez"})
    assert Name("J. Doe - BBB").tail == "BBB" and Name(None).long == []


def link(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "entry_id bigint, player string, pos string, team string, entity string")
    teams = spark.createDataFrame(TEAMS, "team_code string, alt_code string, city string, nickname string")
    return linked_pairs(link_variants(df, teams, "entry_id", "player", "pos", "team"), "entry_id", "a", "b")


def test_links_variants_and_keeps_others_apart(spark):
    same = ["William Karlstrom", "karlstrom, william", "WILLIAM  KARLSTROM Jr.", "Bill Karlstrom", "W. Karlstrom", "Karlstrom William", "William Karlstorm", "Wiliam Karlstrom", "William Karlström (QB)", "William T. Karlstrom - AAA"]
    rows = [(i, n, "QB", "AAA") for i, n in enumerate(same)]
    rows += [(20, "Walter Karlstrom", "WR", "BBB"), (21, "Walter Karlstrom", "WR", "BBB"), (22, "Amber Bay Owls", "DEF", None), (23, "The Owls D/ST", None, "AAA"), (24, "AAX def", "DEF", None), (25, "Rams of Brich", "DEF", "BBB")]
    rows += [(30, None, "QB", "AAA"), (31, "", None, None), (32, "...", None, None), (33, "x" * 5000, None, None), (34, "Oswald Quennel", None, None)]
    got = {(r.a, r.b) for r in link(spark, rows).collect()}
    want = {(i, j) for i in range(10) for j in range(i + 1, 10)} | {(20, 21), (22, 23), (22, 24), (23, 24)}
    assert got == want


def test_empty_table(spark):
    assert link(spark, []).count() == 0


def test_two_edits_with_an_initial_a_nickname_or_at_the_start(spark):
    rows = [(i, "William Karlstromberg", "QB", "AAA") for i in range(3)]
    rows += [(10, "W. Karlstrmbrg", "QB", "AAA"), (11, "Bill Karlstormbrg", "QB", "AAA"), (12, "William Akrlstrombrg", "QB", "AAA"), (13, "William Karlstrmbrg", "WR", "AAA"), (14, "W. Karlstrmbeg", "QB", "BBB")]
    got = {(r.a, r.b) for r in link(spark, rows).collect()}
    assert {(0, 10), (0, 11), (0, 12)} <= got and not {(0, 13), (0, 14)} & got


def test_join_in_blocks(spark):
    a, b = (spark.createDataFrame(x, "w string, b string") for x in ([("abcdef", "p"), ("abcdef", None)], [("abdcfe", "p"), ("abcdef", "q"), ("abcde", "p")]))
    assert {tuple(r) for r in edit_neighbours(a, b, 2).collect()} == {("abcdef", "abdcfe", 2), ("abcdef", "abcde", 1)}


def test_order_that_no_other_entry_settles(spark):
    rows = [(1, "Prendaaumiler Mattteo", "WR", "AAA"), (2, "Matteo Prendaumiler", "WR", "AAA"), (3, "Silas Orveolluvard-Ulmurigren", "RB", "BBB"), (4, "Oeveolluvard-Ulmurigren Silss", "RB", "BBB"), (5, "Prendaaumiler Mattteo", "TE", "BBB")]
    assert {(r.a, r.b) for r in link(spark, rows).collect()} == {(1, 2), (3, 4)}


def test_edits_anywhere_in_short_and_long_names(spark):
    rows = [(1, "Tyler Kane", "QB", "AAA"), (2, "Tyler Kane", "QB", "AAA"), (3, "Tyler Knae", "QB", "AAA")]
    rows += [(11, "Simon Richardson", "WR", "AAA"), (12, "Simon Richardson", "WR", "AAA"), (13, "Simon Rcihardsom", "WR", "AAA"), (14, "Simon Ricahrdsom", "WR", "AAA"), (15, "Iismon Richardson", "WR", "AAA")]
    rows += [(21, "Simon Bauer", "TE", "BBB"), (22, "Simon Bauer", "TE", "BBB"), (23, "Simon Buaes", "TE", "BBB"), (24, "Bauers, Smion", "TE", "BBB")]
    got = {(r.a, r.b) for r in link(spark, rows).collect()}
    want = {(a, b) for group in ((1, 2, 3), (11, 12, 13, 14, 15), (21, 22, 23, 24)) for a in group for b in group if a < b}
    assert got == want


def test_positions_part_namesakes_and_missing_ones_follow_the_team(spark):
    rows = [(1, "Simon Richardson", "QB", "AAA"), (2, "Simon Richardson Jr.", "WR", "BBB"), (3, "Richardson, Simon", None, "BBB"), (4, "S. Richardson", "QB", None), (5, "S Richardson", None, "BBB")]
    assert {(r.a, r.b) for r in link(spark, rows).collect()} == {(1, 4), (2, 3), (2, 5), (3, 5)}


def test_units_under_any_position_and_other_nicknames(spark):
    from tallyfield.llm.names import Nicknames
    from tallyfield.llm.variants import Units

    units = Units([(*TEAMS[0],), (*TEAMS[1],)])
    assert [units.find(x, p, None) for x, p in (("Amberbay Owlz", "WR"), ("Owls", "WR"), ("Amber Bya", None), ("AAX", "WR"), ("AAX", "DEF"), ("Simon Richardson", "WR"))] == ["AAA", "AAA", "AAA", None, "AAA", None]
    rows = [(1, "Giuseppe Richardson", "QB", "AAA"), (2, "Beppe Richardson", "QB", "AAA")]
    df = spark.createDataFrame(rows, "entry_id bigint, player string, pos string, team string")
    teams = spark.createDataFrame(TEAMS, "team_code string, alt_code string, city string, nickname string")
    pairs = lambda **kw: linked_pairs(link_variants(df, teams, "entry_id", "player", "pos", "team", **kw), "entry_id", "a", "b").count()
    assert pairs() == 0 and pairs(nicknames=Nicknames({"giuseppe": ("beppe",)})) == 1


def test_parents_are_followed_to_the_end(spark):
    from tallyfield.llm.variants import _roots

    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(70)] + [(100, 100)], "form bigint, parent bigint")
    assert {r.form: r.root for r in _roots(chain).collect()} == {**{i: 0 for i in range(70)}, 100: 100}


def test_hot_blocks_are_divided_without_losing_a_match(spark, monkeypatch):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))) for _ in range(120)})
    rows = [("hot", 2, side, w, i, side) for i, w in enumerate(words) for side in (0, 1)] + [("cold", 1, 0, "abc", 900, 4), ("cold", 1, 1, "acb", 901, 2), ("lone", 1, 1, "abc", 902, 0)]
    df = spark.createDataFrame(rows, triejoin.ROWS)
    want = {(i, j, osa(a, b), 1, 0) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and osa(a, b) <= 2} | {(901, 900, 1, 2, 4)}
    for caps in ((20_000, 50_000), (9, 5)):
        monkeypatch.setattr(triejoin, "HOT_PROBES", caps[0])
        monkeypatch.setattr(triejoin, "HOT_WORDS", caps[1])
        assert {tuple(r) for r in triejoin.trie_join(df).collect()} == want
