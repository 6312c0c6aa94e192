from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm.automaton import osa
from tallyfield.llm.matching import Rule, cascade, half_keys, match_records, planted_labels, read_records

TEAMS = [("AAA", "AAX", "Amber Bay", "Owls"), ("BBB", None, "Birch Town", "Rams of Birch")]
KIND = "ident bigint, name string, pos string, team string"


def match(spark, left, right):
    teams = spark.createDataFrame(TEAMS, "team_code string, alt_code string, city string, nickname string")
    rows = match_records(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), teams, planted=40).collect()
    assert all(0 < r.confidence < 1 for r in rows)
    return {(r.a, r.b): r.rule for r in rows}


def test_rules_from_strict_to_weak(spark):
    left = [(1, "William Karlstrom", "QB", "AAA"), (2, "Otto Brandvold", "WR", "AAX"), (3, "Pia Lindqvist", "TE", "AAA"), (4, "Owls", "DEF", "AAA"), (5, "Henrik Solbakken", "RB", None), (6, "Nils Overgaard", "RB", "AAA"), (7, "Nils Overgaard", "WR", "BBB"), (8, None, "K", "AAA"), (9, "", None, None)]
    right = [(101, "karlstrom, william", "QB", "AAA"), (102, "William Karlstrom", "QB", "AAA"), (103, "O. Brandvold", "WR", "AAA"), (104, "Pia Lindqvst", "TE", "AAA"), (105, "Amber Bay D/ST", "DEF", None), (106, "Henrik Solbakken", "RB", "BBB"), (107, "Nils Overgaard", "WR", "BBB"), (108, "Nils Overgaard", "QB", "BBB"), (109, None, None, None)]
    got = match(spark, left, right)
    assert set(got) == {(1, 101), (1, 102), (2, 103), (3, 104), (4, 105), (5, 106), (7, 107)}
    assert got[(2, 103)] == "initial_position_team" and got[(3, 104)] == "family_typo_position_team"


def test_empty_tables(spark):
    assert match(spark, [], [(1, "A Bcd", "QB", "AAA")]) == {} and match(spark, [(1, "A Bcd", "QB", "AAA")], []) == {}


def test_twins_without_team_or_position(spark):
    left = [(1, "Leif Vaskepivick", "RB", "AAA"), (2, "Leif Vaskepivick", "RB", None), (3, "Nils Overgaard", "RB", "AAA"), (4, "Nils Overgaard", "WR", "BBB"), (5, "Nils Overgaard", None, None)]
    right = [(101, "Leif Vaskepivick", "RB", "AAA"), (102, "Leif Vaskepivick", None, "AAA"), (103, "Nils Overgaard", "RB", "AAA"), (104, "Nils Overgaard", "WR", "BBB")]
    assert set(match(spark, left, right)) == {(1, 101), (1, 102), (2, 101), (2, 102), (3, 103), (4, 104)}


word = st.text("ab", max_size=9)


@settings(max_examples=400, deadline=None)
@given(word, word)
def test_words_an_edit_apart_share_a_half(a, b):
    if osa(a, b) <= 1:
        assert not set(half_keys(a)).isdisjoint(half_keys(b))


def people(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_confidence_is_the_labelled_precision_of_each_rule(spark):
    given_, n = ["Simon", "Pavel", "Jonas", "Ruben"], 40
    family = lambda i: 3 * chr(97 + i % 26) + 3 * chr(97 + i // 26) + "more" + 2 * chr(97 + i % 26)
    left = [(i, f"{given_[i % 4]} {family(i)}", "QB", "AAA") for i in range(n)]
    right = [(100 + i, f"{given_[i % 4]} {family(i)}", "QB", "AAA") for i in range(0, 20)]
    right += [(100 + i, f"{given_[i % 4][0]}. {family(i)}", None, "AAA") for i in range(20, 30)]
    right += [(200 + i, f"{given_[i % 4]} {family(i)}", None, None) for i in range(30, n)]
    labels = spark.createDataFrame([(i, 100 + i) for i in range(30)] + [(30, 200 + 30), (31, 200 + 31), *((i, 999) for i in range(32, n))], "a bigint, b bigint")
    teams = spark.createDataFrame(TEAMS, "team_code string, alt_code string, city string, nickname string")
    rows = match_records(people(spark, left), people(spark, right), teams, labels=labels).collect()
    sure = {r.rule: r.confidence for r in rows}
    assert len(rows) == n and sure == {"name_position_team": 21 / 22, "initial_team": 11 / 12, "name_only": 3 / 12}
    bare = match_records(people(spark, left), people(spark, right), teams).collect()
    assert {(r.a, r.b, r.rule) for r in bare} == {(r.a, r.b, r.rule) for r in rows} and all(r.confidence is None for r in bare)


def test_planted_copies_are_the_same_each_time_and_tell_weak_rules(spark):
    import random

    rnd = random.Random(3)
    given_ = ["Simon", "Sven", "Pavel", "Pieter", "Jonas", "Jarek"]
    left = [(i, f"{rnd.choice(given_)} {rnd.choice('bdfg')}{rnd.choice('ao')}rmond{rnd.choice('aeio')}st", rnd.choice(["QB", "WR"]), rnd.choice(["AAA", "BBB"])) for i in range(300)]
    teams = spark.createDataFrame(TEAMS, "team_code string, alt_code string, city string, nickname string")
    records = read_records(people(spark, left).where("false"), people(spark, left), teams)
    assert planted_labels(records).count() == 0
    records = read_records(people(spark, left), people(spark, left).where("false"), teams)
    once = sorted(map(tuple, planted_labels(records, 50).collect()))
    assert len(once) == 50 and once == sorted(map(tuple, planted_labels(records.repartition(5), 50).collect()))
    sure = {r.rule: r.confidence for r in match_records(people(spark, left), people(spark, [(1000 + i, n if i % 2 else f"{n[0]}. {n.split()[1]}", p, t) for i, n, p, t in left]), teams, planted=200).select("rule", "confidence").distinct().collect()}
    assert sure["name_position_team"] > sure["initial_position_team"]


def test_two_errors_at_the_start_and_unsettled_order(spark):
    left = [(1, "Simon Richardson", "QB", "AAA"), (2, "Prendaaumiler Mattteo", "WR", "AAA")]
    right = [(11, "Simon Irchardsom", "QB", "AAA"), (12, "Matteo Prendaaumiler", "WR", "AAA")]
    assert match(spark, left, right) == {(1, 11): "family_two_typos_position_team", (2, 12): "given_typo_position_team"}


def test_rules_are_named_once():
    names = [r.name for r in cascade()]
    assert len(names) == len(set(names)) == 20 and all(isinstance(r, Rule) for r in cascade())
