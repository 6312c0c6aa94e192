"""Records of two sources that describe the same player or team unit, without a shared key."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .automaton import osa
from .names import USUAL, Nicknames
from .triejoin import probe_keys, word_keys
from .variants import collect_units, order_words, parse_names

#: Bound of the sample of records of which labelled copies are made.
PLANTED = 4_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Record:
    """One reading of a record's normalised attributes; missing ones are empty."""

    unit: str
    given: str
    family: str
    half: str
    pos: str
    team: str

    def forms(self) -> list[str]:
        return USUAL.forms(self.given) if self.given else []

    def whole(self) -> bool:
        return len(self.given) >= 2


Keys = Callable[[Record], "list[str]"]


@dataclass(frozen=True)
class Rule:
    """One exact join of the cascade.

    words: the strings under which a record is found; probes: those under which it looks for
    others, the same if not given. check: what a pair must fulfil besides. In strict rules, in
    which position and team agree, an open record may also pair with a resolved one of
    the other source, since players are listed twice. Other rules pair open records only and
    need a single candidate on each side.
    """

    name: str
    strict: bool
    words: Keys
    check: Callable[[Record, Record], bool] | None = None
    probes: Keys | None = None


def half_keys(word: str) -> list[str]:
    """Keys of which two words share one if they are at most one letter more, less, other or one swap of
    neighbours apart: for either length that the shorter word may have, its start and its end."""
    out = []
    for m in {max(0, len(word) - 1), len(word)}:
        start = m // 2
        end = max(0, m - start - 1)
        out += [f"{m}<{word[:start]}", f"{m}>{word[len(word) - end :]}"]
    return out


def cascade() -> list[Rule]:
    """The rules from the strictest to the weakest."""

    def name(r: Record) -> list[str]:
        return [f"{r.given}|{r.family}"] if r.whole() and r.family else []

    def formal(r: Record) -> list[str]:
        return [f"{g}|{r.family}" for g in r.forms()] if len(r.given) >= 3 and r.family else []

    def letters(r: Record) -> list[str]:
        return sorted({g[0] for g in r.forms()})

    def initial(r: Record) -> list[str]:
        return [f"{x}|{r.family}" for x in letters(r)] if r.family else []

    def given_typo(r: Record) -> list[str]:
        return [f"{g}|{r.family}" for g in half_keys(r.given)] if len(r.given) >= 4 and r.family else []

    def family_typo(r: Record) -> list[str]:
        return [f"{x}|{f}" for x in letters(r) for f in half_keys(r.family)] if r.given and r.family else []

    def half(r: Record) -> list[str]:
        return [f"{x}|{h}" for x in letters(r) for h in sorted({r.half, r.family} - {""})] if r.given and r.family else []

    def two(keys: Callable[[str, int], object]) -> Keys:
        return lambda r: [f"{r.given}|{f}" for f in sorted(keys(r.family, 2))] if r.whole() and len(r.family) >= 5 else []

    def at(keys: Keys, *need: str) -> Keys:
        return lambda r: [f"{k}|{'|'.join(getattr(r, n) for n in need)}" for k in keys(r)] if all(getattr(r, n) for n in need) else []

    alike = lambda a, b: not set(a.forms()).isdisjoint(b.forms())
    given_ok = lambda a, b: len(a.given) < 3 or len(b.given) < 3 or alike(a, b) or osa(a.given, b.given) <= 1
    short = lambda a, b: len(a.given) == 1 or len(b.given) == 1 or (len(a.given) == 2) != (len(b.given) == 2) or alike(a, b)
    given_near = lambda a, b: osa(a.given, b.given) <= 1
    close = lambda a, b: osa(a.family, b.family) <= 1 and given_ok(a, b)
    cut_name = lambda a, b: a.family != b.family and (a.half == b.family or b.half == a.family) and given_ok(a, b)
    no_team = lambda a, b: not a.team or not b.team
    place = ("pos", "team")
    return [
        Rule("unit", True, lambda r: [r.unit] if r.unit else []),
        Rule("name_position_team", True, at(name, *place)),
        Rule("formal_name_position_team", True, at(formal, *place)),
        Rule("initial_position_team", True, at(initial, *place), short),
        Rule("given_typo_position_team", True, at(given_typo, *place), given_near),
        Rule("family_typo_position_team", True, at(family_typo, *place), close),
        Rule("half_family_position_team", True, at(half, *place), cut_name),
        Rule("family_two_typos_position_team", True, at(two(word_keys), *place), lambda a, b: osa(a.family, b.family) <= 2, at(two(probe_keys), *place)),
        Rule("name_position", False, at(name, "pos")),
        Rule("formal_name_position", False, at(formal, "pos")),
        Rule("name_team", False, at(name, "team")),
        Rule("formal_name_team", False, at(formal, "team")),
        Rule("given_typo_position", False, at(given_typo, "pos"), given_near),
        Rule("half_family_position", False, at(half, "pos"), cut_name),
        Rule("family_typo_position_no_team", False, at(family_typo, "pos"), lambda a, b: close(a, b) and no_team(a, b)),
        Rule("family_typo_position", False, at(family_typo, "pos"), lambda a, b: close(a, b) and len(a.given) >= 3 and len(b.given) >= 3),
        Rule("initial_position", False, at(initial, "pos"), short),
        Rule("initial_team", False, at(initial, "team"), short),
        Rule("family_typo_team", False, at(family_typo, "team"), lambda a, b: close(a, b) and a.whole() and b.whole()),
        Rule("name_only", False, name, lambda a, b: not a.pos or not b.pos or no_team(a, b)),
    ]


ATTRIBUTES = ("unit", "given", "family", "half", "pos", "team")
PROFILE = ("side", "ident", *ATTRIBUTES, "second_given", "second_family")


def read_records(left: DataFrame, right: DataFrame, teams: DataFrame) -> DataFrame:
    """(side, row, PROFILE): both sources, each (ident, name, pos, team), with the parts of their names.

    ident is the profile: rows of one source that read alike share it, so rules meet each
    combination of attributes once, however many rows have it.
    """
    units = collect_units(teams)
    both = cut(parse_names(left, units).withColumn("side", F.lit(0)).unionByName(parse_names(right, units).withColumn("side", F.lit(1))))
    people = order_words(both, ("side",)).withColumn("unit", F.lit(None).cast("string"))
    people = people.withColumn("second_given", F.when(F.col("unsettled"), F.col("second_given"))).withColumn("second_family", F.when(F.col("unsettled"), F.col("second_family")))
    none = F.lit(None).cast("string")
    cols = ["side", "ident", *ATTRIBUTES, "second_given", "second_family"]
    units_ = both.where("unit is not null").withColumn("second_given", none).withColumn("second_family", none)
    rows = people.select(cols).unionByName(units_.select(cols)).where("unit is not null or family <> ''")
    rows = rows.select("side", F.col("ident").alias("row"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols[2:]])
    return rows.withColumn("ident", F.xxhash64("side", *cols[2:]).bitwiseAND(F.lit(2**63 - 1)))


#: Sides of records: the two sources, and labelled copies of records of the first one.
LEFT, RIGHT, COPY = 0, 1, 2


def _keyed(number: int, rule: Rule, probe: bool):
    """Keys of the rows, each with the attributes of the reading that gives it, where a check needs them."""
    schema = pa.schema([("rule", pa.int32()), ("key", pa.int64()), ("to", pa.int32()), ("ident", pa.int64()), ("turned", pa.int32()), *((c, pa.string()) for c in ATTRIBUTES)])
    keys = (rule.probes or rule.words) if probe else rule.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for side, ident, unit, given, family, half, pos, team, other_given, other_family in zip(*(c.to_pylist() for c in batch.columns)):
                to = (RIGHT if side == LEFT else LEFT) if probe else side
                readings = [(0, Record(unit, given, family, half, pos, team)), *([(1, Record(unit, other_given, other_family, "", pos, team))] if other_family else [])]
                for turned, r in readings:
                    told = (unit, r.given, r.family, r.half, pos, team) if rule.check else ("",) * 6
                    for key in dict.fromkeys(keys(r)):
                        for c, v in zip(cols, (number, xxhash.xxh3_64_intdigest(key) - 2**63, to, ident, turned, *told)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run, "rule int, key bigint, to int, ident bigint, turned int, " + ", ".join(f"{c} string" for c in ATTRIBUTES)


def _checked(rule: Rule):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("rule", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for number, to, x, y, *told in zip(*(c.to_pylist() for c in batch.columns)):
                p, w = Record(*told[:6]), Record(*told[6:])
                if to == LEFT:
                    x, y, p, w = y, x, w, p
                if rule.check is None or rule.check(p, w):
                    for c, v in zip(cols, (x, y, number)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def rule_pairs(number: int, rule: Rule, probing: DataFrame, found_in: DataFrame) -> DataFrame:
    """(a, b, rule): pairs of profiles of the two sources that one exact join gives: the probing ones' keys in the
    others'.

    Of two readings of a name at most one may be in the other order of words. The plan is the same for all
    rules, down to its literals, so its code is generated once.
    """
    run, kind = _keyed(number, rule, True)
    probes = probing.select(*PROFILE).mapInArrow(run, kind)
    run, kind = _keyed(number, rule, False)
    words = found_in.select(*PROFILE).mapInArrow(run, kind).drop("rule")
    met = probes.join(words.select("key", "to", *(F.col(c).alias(f"{c}_b") for c in ("ident", "turned", *ATTRIBUTES))).hint("merge"), ["key", "to"]).where("turned + turned_b < 2")
    return met.select("rule", "to", "ident", "ident_b", *ATTRIBUTES, *(f"{c}_b" for c in ATTRIBUTES)).mapInArrow(_checked(rule), "a bigint, b bigint, rule int").distinct()


def with_twins(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, rule): pairs of open profiles with the partners of their twins.

    A twin has the same whole name in the same source and no other position or team. It counts
    only if all profiles of that name in the source that could be twins agree in what they have.
    """
    whole = profiles.where("length(given) >= 2 and family <> ''")
    out = None
    for side, own, other in ((0, "a", "b"), (1, "b", "a")):
        links = found.select(F.col(own).alias("ident"), F.col(other).alias("other"), "rule")
        mine = whole.where(F.col("side") == side)
        open_ = mine.join(links.select("ident").distinct().hint("merge"), "ident", "left_anti").select("ident", "given", "family", "pos", "team")
        known = mine.select(F.col("ident").alias("twin"), "given", "family", F.col("pos").alias("pos_t"), F.col("team").alias("team_t"))
        alike = open_.join(known.hint("merge"), ["given", "family"]).where("ident <> twin and (pos = '' or pos_t = '' or pos = pos_t) and (team = '' or team_t = '' or team = team_t)")
        some = lambda f, c: f(F.when(F.col(c) != "", F.col(c))).over(Window.partitionBy("ident"))
        single = alike.select("ident", "twin", *[some(f, c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("pos_t", "team_t")])
        single = single.where("coalesce(lo_pos_t = hi_pos_t, true) and coalesce(lo_team_t = hi_team_t, true)").select("ident", "twin")
        pairs = single.join(links.withColumnRenamed("ident", "twin").hint("merge"), "twin").groupBy("ident", "other").agg(F.min("rule").alias("rule"))
        pairs = pairs.select(F.col("ident" if side == 0 else "other").alias("a"), F.col("other" if side == 0 else "ident").alias("b"), "rule")
        out = pairs if out is None else out.unionByName(pairs)
        found = found.unionByName(pairs)
    return out.distinct()


def run_cascade(profiles: DataFrame, rules: list[Rule]) -> DataFrame:
    """(a, b, rule): pairs of profiles of the two sources, and of the first one and its copies, rule by rule.

    Each pass is one exact join, and what it resolves is taken out by an anti-join before the next
    one. Copies are resolved like other records, but nobody finds them and they resolve nobody.
    All joins are merge joins: dozens of small broadcasts would stay in the driver's memory.
    """
    open_, found = profiles, None
    for i, rule in enumerate(rules):
        if rule.strict:
            pairs = rule_pairs(i, rule, open_, profiles.where(F.col("side") != COPY))
        else:
            pairs = rule_pairs(i, rule, open_.where(F.col("side") != RIGHT), open_.where(F.col("side") == RIGHT).unionByName(profiles.where(F.col("side") == LEFT)))
            copy = F.col("b") < 0
            single = lambda c: F.count("*").over(Window.partitionBy(copy, c)) == 1
            pairs = pairs.withColumn("sa", single("a") | copy).withColumn("sb", single("b")).where("sa and sb")
        new = cut(pairs.select("a", "b", "rule"))
        found = new if found is None else found.unionByName(new)
        last = i + 1 == len(rules)
        if last or (rule.strict and not rules[i + 1].strict):
            found = cut(found)
            twins = cut(with_twins(profiles.where(F.col("side") != COPY), found.where("b >= 0")))
            found, new = found.unionByName(twins), new.unionByName(twins)
        if not last:
            done = new.select(F.explode(F.when(F.col("b") < 0, F.array("b")).otherwise(F.array("a", "b"))).alias("ident")).distinct()
            open_ = cut(open_.join(done.hint("merge"), "ident", "left_anti"))
    return cut(found)


def planted_labels(records: DataFrame, rows: int = PLANTED, nicknames: Nicknames = USUAL) -> DataFrame:
    """PROFILE rows of side COPY with the profile `origin` that each is a noisy copy of; its ident is negative.

    Copies are made of a bounded sample of the records with a whole name or a unit, those of least hash: a typing error or
    two in the family name, one in the given name, an initial, another of its usual forms, half
    of a double name; without position or team, or with another record's team. Which noise a record
    gets follows from its number, so the labels are the same at every run.
    """
    whole = records.where("side = 0 and (unit <> '' or (length(given) >= 3 and length(family) >= 3))").select(*PROFILE).distinct()
    some = whole.orderBy(F.xxhash64("ident", F.lit(5)), "ident").limit(rows)
    kinds = [pa.int32(), pa.int64(), *[pa.string()] * 8, pa.int64()]
    schema = pa.schema(list(zip([*PROFILE, "origin"], kinds)))

    def typed(word: str, rnd: random.Random) -> str:
        i, c = rnd.randrange(len(word)), rnd.choice(LETTERS)
        if rnd.random() < 0.3 and i + 1 < len(word):
            return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        return word[:i] + rnd.choice(["", c, c + word[i]]) + word[i + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, team_before = [], ""
            for _, ident, unit, given, family, half, pos, team, *_ in zip(*(c.to_pylist() for c in batch.columns)):
                rnd = random.Random(ident)
                noise = "none" if unit else rnd.choice(["none", "none", "family", "family", "two", "given", "initial", "form", "half"])
                g, f, h, p, t = given, family, half, pos, team
                if noise == "family" or noise == "two":
                    f, h = typed(f, rnd), ""
                if noise == "two":
                    f = typed(f, rnd) or f
                if noise == "given":
                    g = typed(g, rnd)
                if noise == "initial":
                    g = g[0]
                if noise == "form":
                    g = rnd.choice(nicknames.kindred(g))
                if noise == "half" and half:
                    f = half
                place = rnd.random()
                if place < 0.2:
                    t = ""
                elif place < 0.3:
                    p = ""
                elif place < 0.35:
                    p = t = ""
                elif place < 0.45:
                    t = team_before
                team_before = team
                out.append((COPY, -1 - ident, unit, g, f if f or unit else family, h, p, t, "", "", ident))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds))], schema=schema)

    ddl = "side int, ident bigint, " + ", ".join(f"{c} string" for c in PROFILE[2:]) + ", origin bigint"
    return some.coalesce(1).mapInArrow(run, ddl)


def planted_precision(found: DataFrame, profiles: DataFrame, copies: DataFrame) -> DataFrame:
    """(rule, tried, hits) of the labelled copies, which went through the cascade with all other records.

    A pair is a hit if it leads to the copied record or to one of the same name that position and
    team don't part from it.
    """
    left = profiles.where(F.col("side") == LEFT)
    who = lambda s: left.select(F.col("ident").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "given", "family", "pos", "team")])
    told = found.where("b < 0").join(copies.select(F.col("ident").alias("b"), F.col("origin").alias("o")), "b").join(who("a"), "a").join(who("o"), "o")
    same = lambda c: (F.col(f"{c}_a") == F.col(f"{c}_o")) | (F.col(f"{c}_a") == "") | (F.col(f"{c}_o") == "")
    hit = (F.col("a") == F.col("o")) | ((F.col("unit_a") == F.col("unit_o")) & (F.col("given_a") == F.col("given_o")) & (F.col("family_a") == F.col("family_o")) & same("pos") & same("team"))
    return told.groupBy("rule").agg(F.count("*").alias("tried"), F.sum(hit.cast("int")).alias("hits"))


def labelled_precision(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, tried, hits) of the pairs (a, b, rule) that touch a labelled record.

    labels are the true pairs (a, b); all partners of a record in them must be there, so a pair of
    such a record that isn't labelled is wrong.
    """
    truth = labels.select("a", "b").distinct()
    known = found.join(truth.select("a").distinct().withColumn("ka", F.lit(1)), "a", "left").join(truth.select("b").distinct().withColumn("kb", F.lit(1)), "b", "left")
    tried = known.where("ka is not null or kb is not null").join(truth.withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return tried.groupBy("rule").agg(F.count("*").alias("tried"), F.count("hit").alias("hits"))


def smoothed(hits: Column, tried: Column) -> Column:
    """Precision with one success and one failure added."""
    return (hits + 1) / (tried + 2)


def match_records(left: DataFrame, right: DataFrame, teams: DataFrame, labels: DataFrame | None = None, planted: int = 0, rules: list[Rule] | None = None) -> DataFrame:
    """(a, b, rule, confidence): records of two sources that describe the same player or team unit.

    left and right: (ident, name, pos, team). The rules form a cascade from strict to weak. Each
    is one exact join; what it resolves is taken out by an anti-join before the next (see Rule).
    After the strict rules, and at the end, an open record takes the partners of its twin (see
    with_twins), so a player listed twice gives a pair for each row.

    A rule's confidence is its precision on labelled records, smoothed. labels are true pairs
    (a, b) of a sample of records. Without them, planted > 0 makes that many labelled copies
    of the left records (see planted_labels) and sends them through the same cascade.
    With neither the confidence is null, and a rule that no labelled record met has 0.5.

    Null identifiers and names without a family name take no part; null positions and teams
    match nothing, but weaker rules go without them. Repeated rows match like any other. If
    either table is empty there are no pairs.
    """
    rules = rules or cascade()
    clean = lambda d: d.toDF("ident", "name", "pos", "team").where("ident is not null and name is not null")
    records = cut(read_records(clean(left), clean(right), teams))
    profiles, copies = records.select(*PROFILE).distinct(), None
    if planted and labels is None:
        copies = cut(planted_labels(records, planted))
        profiles = profiles.unionByName(copies.drop("origin"))
    profiles = cut(profiles)
    found = run_cascade(profiles, rules)
    rows = lambda side, c: records.where(F.col("side") == side).select(F.col("ident").alias(c), F.col("row").alias(f"row_{c}"))
    pairs = found.where("b >= 0").groupBy("a", "b").agg(F.min("rule").alias("rule")).join(rows(0, "a").hint("merge"), "a").join(rows(1, "b").hint("merge"), "b")
    pairs = pairs.groupBy(F.col("row_a").alias("a"), F.col("row_b").alias("b")).agg(F.min("rule").alias("rule"))
    names = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("rule") + 1).alias("rule")
    if labels is not None:
        pairs = cut(pairs)
        told = labelled_precision(pairs, labels)
    elif copies is not None:
        told = planted_precision(found, profiles, copies)
    else:
        return pairs.select("a", "b", names, F.lit(None).cast("double").alias("confidence"))
    sure = told.select("rule", smoothed(F.col("hits"), F.col("tried")).alias("confidence"))
    return pairs.join(F.broadcast(sure), "rule", "left").select("a", "b", names, F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
