"""Entries whose typed names mean the same person or team unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .automaton import LevenshteinAutomaton, build_trie
from .names import USUAL, Name, Nicknames, canonical_position, unit_spellings, unit_text
from .triejoin import ROWS, probe_keys, trie_join, word_keys

MAX_UNITS = 20_000


def letter_counts(text: str) -> np.ndarray:
    """How often each of the 36 letters and digits is in a folded text."""
    codes = np.frombuffer(text.encode("ascii", "ignore"), np.uint8)
    n = np.bincount(codes, minlength=123)
    return np.concatenate([n[48:58], n[97:123]])


class Units:
    """Team units by their spellings, found within one edit."""

    def __init__(self, rows: list[tuple[str, str | None, str | None, str | None]]) -> None:
        self.codes: dict[str, str] = {}
        owner: dict[str, set[str]] = {}
        for code, alt, city, nickname in rows:
            for c in (code, alt):
                if c:
                    self.codes[c.upper()] = code
            for s in unit_spellings(code, alt, city, nickname):
                owner.setdefault(s, set()).add(code)
        self.owner = {s: next(iter(c)) for s, c in owner.items() if len(c) == 1}
        self.trie = build_trie(self.owner)
        self.letters = np.array([letter_counts(w) for w in self.owner]).reshape(-1, 36)
        self.memo: dict[str, str | None] = {}

    def team(self, code: str | None) -> str | None:
        return self.codes.get((code or "").strip().upper())

    def find(self, text: str | None, pos: str | None, team: str | None) -> str | None:
        """The unit that a text names; codes and far spellings count only where a defence is meant."""
        bare, marked = unit_text(text)
        meant = marked or pos == "DEF"
        if bare in self.owner:
            return self.owner[bare]
        if meant and bare.upper() in self.codes:
            return self.codes[bare.upper()]
        if not meant and len(bare) < 6:
            return None
        if bare not in self.memo:
            k = 2 if len(bare) >= 12 else 1
            # An edit changes the counts of two letters at most, so most texts need no walk.
            may = bool((np.abs(self.letters - letter_counts(bare)).sum(axis=1) <= 2 * k).any())
            near = sorted((e, s) for s, e in LevenshteinAutomaton(bare, k).search(self.trie)) if may else []
            best = {self.owner[s] for e, s in near if e == near[0][0]}
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[bare] = best.pop() if len(best) == 1 else None
        return self.memo[bare] or (team if meant and pos == "DEF" else None)


def collect_units(teams: DataFrame) -> list[tuple]:
    """The reference list of teams, which must be a short one."""
    rows = teams.select("team_code", "alt_code", "city", "nickname").where("team_code is not null").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError("the list of teams is too long to be sent to every executor")
    return sorted((tuple(r) for r in rows), key=str)


PARSED = "ident bigint, unit string, given string, family string, half string, other_given string, other_family string, first string, last string, sure boolean, suffix string, pos string, team string"


def parse_names(rows: DataFrame, units: list[tuple], nicknames: Nicknames = USUAL) -> DataFrame:
    """Parts of the names of (ident, name, pos, team) rows; see PARSED.

    A name of a team unit has only unit, pos and team. Otherwise given is a word of three
    letters or more, initials, or empty; where the order of words isn't certain, other_given and
    other_family hold the other reading and first and last the words that decide.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(units)
    kinds = [pa.int64(), *[pa.string()] * 8, pa.bool_(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    schema = pa.schema(list(zip(names, kinds)))

    def one(ident: int, text: str | None, pos: str | None, team: str | None, known: Units) -> tuple:
        p, t = canonical_position(pos), known.team(team)
        unit = known.find(text, p, t)
        if unit is not None:
            return (ident, unit, *[None] * 7, None, None, "DEF", unit)
        n = Name(text, nicknames)
        if t is None:
            t = known.team(n.tail)
        other_given = other_family = first = last = None
        long = n.long
        if n.comma and len(long) > n.comma:
            given, family = long[n.comma], long[: n.comma]
            first, last, sure = given, "".join(family), True
        elif len(long) < 2 or n.comma or n.outer:
            given, family, sure = n.initials[:2], long, False
        else:
            given, family, sure = long[0], long[1:], False
            other_given, other_family = long[-1], "".join(long[:-1])
            first, last = long[0], long[-1]
        half = n.first_half.get(family[0]) if len(family) == 1 else family[0] if family else None
        return (ident, None, given, "".join(family), half, other_given, other_family, first, last, sure, n.suffix, p, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(shipped.value)
        for batch in batches:
            out = [one(*r, known) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds))], schema=schema)

    return rows.mapInArrow(run, PARSED)


#: Lead of one order of words over the other, as smoothed shares of places, from which it is settled.
SETTLED = 1 / 3


def order_words(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Names with given and family names told apart by where their words stand in all other entries.

    second_given and second_family hold the other order of the words, if there is one. unsettled
    tells that the order is open: words that stand in no other entries, as misspelled ones do, or
    in few, or in either place.
    """
    decided = parsed.where("first is not null")
    places = decided.select(
        F.explode(F.array(F.struct(F.col("first").alias("w"), F.lit(1.0).alias("f")), F.struct(F.col("last").alias("w"), F.lit(0.0).alias("f")))).alias("x")
    ).select("x.w", "x.f")
    share = places.groupBy("w").agg(F.sum("f").alias("f"), F.count("*").alias("c"))
    names = parsed.where("unit is null")
    joined = names.join(share.select(F.col("w").alias("first"), (F.col("f") / (F.col("c") + 1)).alias("fs")), "first", "left").join(
        share.select(F.col("w").alias("last"), ((F.col("f") + 1) / (F.col("c") + 1)).alias("ls")), "last", "left"
    )
    swap = F.coalesce(~F.col("sure") & (F.col("ls") > F.col("fs")) & F.col("other_given").isNotNull(), F.lit(False))
    lead = F.abs(F.coalesce("ls", F.lit(0.5)) - F.coalesce("fs", F.lit(0.5)))
    open_ = F.coalesce(~F.col("sure") & F.col("other_given").isNotNull() & (lead < SETTLED - 1e-9), F.lit(False))
    return joined.select(
        *keep,
        "ident",
        F.when(swap, F.col("other_given")).otherwise(F.col("given")).alias("given"),
        F.when(swap, F.col("other_family")).otherwise(F.col("family")).alias("family"),
        F.when(~swap, F.col("half")).alias("half"),
        F.when(~F.col("sure"), F.when(swap, F.col("given")).otherwise(F.col("other_given"))).alias("second_given"),
        F.when(~F.col("sure"), F.when(swap, F.col("family")).otherwise(F.col("other_family"))).alias("second_family"),
        open_.alias("unsettled"),
        "suffix",
        "pos",
        "team",
    )


#: Marks of rows in the trie join: read with an initial, as a formal or short form, as the first
#: half of a hyphenated family name, in the other order of words; the word is the given name, is
#: missing; the block is a part of the given name.
INITIAL, NICK, HALF, TURNED, GIVEN, NONE, PART = 1, 2, 4, 8, 16, 32, 64
#: Letters of a family name from which two edits are searched without the team's help.
LONG = 14
#: Positions of players. Fixed values.
PLAYED = ("QB", "RB", "WR", "TE", "K")
FORM = "form bigint, given string, family string, half string, pos string, teams array<string>, second_given string, second_family string, unsettled boolean, probe boolean"


def _spread(nicknames: Nicknames, wide: bool):
    """Rows of the trie join for FORM rows.

    Not wide, within one edit: the family names (long ones within two) of one given name, of one
    initial, and, within two, the given names of one family name; each for one position,
    and for entries without a position over all. Wide: whole names of one team and position within
    two edits, and names with an edit in either part; probes in either order of words.
    """
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
    schema = pa.schema(list(zip([x.split()[0] for x in ROWS.split(", ")], kinds)))

    def narrow(readings: list[tuple], places: list[str], side: int) -> Iterator[tuple]:
        for g, f, h, turn in readings:
            forms = nicknames.forms(g) if g else []
            families = [(f, turn), *([(h, turn | HALF)] if h and h != f and not side else [])]
            if len(g) >= 2:
                for x in forms:
                    for y, m in families:
                        own = m | (NICK if x != g else 0)
                        if len(y) >= LONG + 2 if side else len(y) >= LONG:
                            yield from ((f"L|{x}|{p}", 2, side, y, own) for p in places)
                        if len(y) < LONG + 2 if side else len(y) <= LONG + 2:
                            yield from ((f"F|{x}|{p}", 1, side, y, own) for p in places)
            if g and (not side or len(g) == 1):
                for x in sorted({x[0] for x in forms}):
                    for y, m in families:
                        yield from ((f"I|{x}|{p}", 1, side, y, m | INITIAL) for p in places)
            if len(g) >= 3:
                for x in nicknames.kindred(g) if not side else [g]:
                    yield from ((f"G|{f}|{p}", 2, side, x, turn | GIVEN | (NICK if x != g else 0)) for p in places)
            if not side:
                yield from ((f"N|{f}|{p}", 0, 0, "", turn | NONE) for p in places)
            elif not g:
                yield from ((f"N|{f}|{p}", 0, 1, "", turn | NONE) for p in places)

    def whole(readings: list[tuple], places: list[str], teams: list[str], side: int) -> Iterator[tuple]:
        for g, f, h, turn in readings:
            families = [(f, turn), *([(h, turn | HALF)] if h and h != f and not side else [])]
            names = [(x, NICK if x != g else 0) for x in (nicknames.forms(g) if side else nicknames.kindred(g))] if len(g) >= 2 else []
            letters = sorted({x[0] for x in nicknames.forms(g)}) if g and (not side or len(g) == 1) else []
            if len(g) >= 3 and "*" not in places[:1]:
                for key in sorted(probe_keys(g, 1)) if side else word_keys(g, 1):
                    yield f"P|{key}|{places[0]}", 1, side, f, turn | PART
            for y, m in families:
                for t in teams:
                    for p in places:
                        yield from ((f"W|{p}|{t}", 2, side, f"{x} {y}", m | own) for x, own in names)
                        yield from ((f"J|{x}|{p}|{t}", 2, side, y, m | INITIAL) for x in letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for form, g, f, h, pos, teams, sg, sf, unsettled, probe in zip(*(c.to_pylist() for c in batch.columns)):
                first, other = (g, f, h, 0), [(sg, sf, None, TURNED)] if sg is not None and (sg, sf) != (g, f) else []
                both = [first, *other]
                found: dict[tuple, int] = {}
                for side in (0, 1) if probe else (0,):
                    places = [pos or "*"] if side else [pos, "*"] if pos else ["*", *PLAYED]
                    rows = whole(both if side else [first], places, teams or [], side) if wide else narrow(both if unsettled else [first], places, side)
                    for block, k, own, word, mark in rows:
                        key = (block, k, own, word)
                        if key not in found or mark < found[key]:
                            found[key] = mark
                for (block, k, own, word), mark in found.items():
                    for c, v in zip(cols, (block, k, own, word, form, mark)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _candidates(forms: DataFrame, nicknames: Nicknames, wide: bool) -> DataFrame:
    """Pairs of forms that the trie join finds, each with the attributes of both.

    forms: FORM with root and, of the form or the whole entity, n, its number of entries, full, whether
    any has a whole given name, and known, whether any has a position; these rank it. Of a pair x
    is the lower one, so parents never lead back.
    """
    rows = forms.select(*[x.split()[0] for x in FORM.split(", ")]).mapInArrow(_spread(nicknames, wide), ROWS)
    met = trie_join(rows).where(F.expr(f"mark_a & mark_b & {TURNED} = 0"))
    met = met.select("a", "b", "edits", F.col("mark_a").bitwiseOR(F.col("mark_b")).alias("mark")).distinct()
    cols = ["root", "given", "family", "pos", "teams", "n", "full", "known"]
    own, other = (forms.select(F.col("form").alias(x), F.struct(*cols).alias(f"s{x}")) for x in ("a", "b"))
    pairs = met.join(own, "a").join(other, "b").where("sa.root <> sb.root")
    rank = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("full", "known", "n", "root")])
    up = _has(HALF) | (rank("sa") < rank("sb"))
    return pairs.select("edits", "mark", F.when(up, F.col("sa")).otherwise(F.col("sb")).alias("x"), F.when(up, F.col("sb")).otherwise(F.col("sa")).alias("y"))


def _has(bit: int) -> Column:
    return F.col("mark").bitwiseAND(F.lit(bit)) > 0


def _admitted(pairs: DataFrame) -> DataFrame:
    """The pairs in which form x may stand for y, the better supported one, with a score.

    The rules weigh edits against position and team. Positions never differ here. An entry that
    is misspelled stands alone, so a form with several entries is no misspelling of another; and
    a name that differs by two edits, or by one without its given name, needs the same team.
    """
    n, given, family = F.col("x.n"), F.col("x.given"), F.col("x.family")
    e = F.col("edits") + _has(PART).cast("int")
    tp = F.coalesce(F.col("x.pos") == F.col("y.pos"), F.lit(False))
    tt = F.when((F.size("x.teams") == 0) | (F.size("y.teams") == 0), 0).when(F.arrays_overlap("x.teams", "y.teams"), 1).otherwise(-1)
    la, lb = F.length(given), F.length("y.given")
    long = F.least(F.length(family), F.length("y.family"))
    given_long = F.when(_has(NICK), F.greatest(la, lb)).otherwise(F.least(la, lb))
    same, unknown, alone = tt == 1, tt == 0, n == 1
    initials = (
        F.when(e == 0, tp | (tt >= 0))
        .when(e == 1, same | (tp & unknown & alone & (long >= 6)))
        .otherwise(same & tp & (n <= 2) & (long >= 7))
    )
    halves = F.when(e == 0, same | (tp & unknown)).otherwise((e == 1) & tp & same & (alone | _has(INITIAL)))
    letters = F.when(_has(GIVEN), given_long).otherwise(long)
    supported = unknown & alone & (F.col("y.n") >= 2) & (letters >= 6)
    typed = (
        F.when(e == 0, F.when(_has(NICK), tp | same).otherwise(True))
        .when(e == 1, (same & (n <= 2)) | (tp & unknown & alone & (letters >= 4)) | (tp & alone & ((_has(GIVEN) & (given_long >= 5)) | ((F.col("y.n") >= 2) & (long >= 8)))) | supported)
        .otherwise((same & (n <= 2) & (letters >= 5)) | (tp & alone & ((_has(GIVEN) & unknown & (given_long >= 6)) | (unknown & (long >= LONG)))))
    )
    parts = tp & alone & (long >= 7) & (given != F.col("y.given")) & one_edit(given, F.col("y.given"))
    ok = F.when(_has(NONE), tp | (tt >= 0)).when(_has(PART), parts).when(_has(HALF), halves).when(_has(INITIAL), initials).otherwise(typed)
    exact = (e == 0) & F.col("y.full") & ~_has(NICK | INITIAL | HALF | NONE)
    score = 3.0 * exact.cast("double") + 2.0 * tt + tp.cast("double") - e - 0.3 * _has(NICK).cast("double") - 0.5 * _has(HALF).cast("double") - 0.2 * _has(TURNED).cast("double")
    return pairs.where(ok).select("x.root", F.struct(F.col("y.full").alias("full"), score.alias("score"), F.col("y.n").alias("n"), F.col("y.root").alias("root")).alias("to"))


def one_edit(a: Column, b: Column) -> Column:
    """At most one letter more, less, other or two neighbours swapped."""
    lev = F.levenshtein(a, b, 2)
    swap = (lev == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return lev.between(0, 1) | swap


def _roots(links: DataFrame) -> DataFrame:
    """(form, root) from (form, parent), where a form without a parent is its own: parents are followed
    until none changes, in steps that double."""
    links = cut(links)
    while True:
        up = links.select(F.col("form").alias("parent"), F.col("parent").alias("up"))
        links = cut(links.join(up, "parent").select("form", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")))
        if not links.where("moved").limit(1).count():
            return links.select("form", F.col("parent").alias("root"))
        links = links.drop("moved")


def link_variants(rows: DataFrame, teams: DataFrame, ident: str, name: str, pos: str, team: str, nicknames: Nicknames = USUAL) -> DataFrame:
    """(ident, entity): entries with the same entity mean the same person or team unit.

    1. Names are cleaned and read; team units are found in a trie of the known spellings.
       Entries read alike, of one position, are one form.
    2. The trie join finds, within an edit, the family names of the forms that share a given name
       (or a formal name that both may be short for), or an initial, and, within two, the given
       names of those that share a family name. A form whose order of words is unsettled
       takes part in both orders.
    3. Every form joins the best of the better supported forms that the rules admit; parents are
       followed until nothing changes.
    4. Entities of one or two entries are taken once more through a trie join of whole names
       within two edits, in both orders of words, among the entries of one team and position.

    nicknames is the table of names used for one another. Null and empty names have no entity
    and are left out, as are null identifiers. Repeated entries are linked like any others. Unknown
    teams and positions count as missing. An empty table gives no rows. Only the four named
    columns are read.
    """
    units = collect_units(teams)
    source = rows.select(F.col(ident).cast("long"), F.col(name).cast("string"), F.col(pos).cast("string"), F.col(team).cast("string"))
    parsed = cut(parse_names(source.where(F.col(ident).isNotNull() & F.col(name).isNotNull()), units, nicknames))
    people = cut(order_words(parsed).where("family <> '' or given <> ''").withColumn("form", F.xxhash64("given", "family", F.coalesce("pos", F.lit("-")))))

    second = F.max(F.when(F.col("second_given").isNotNull(), F.struct("unsettled", "second_given", "second_family")))
    forms = people.groupBy("form").agg(
        *[F.min(c).alias(c) for c in ("given", "family", "pos")], F.max("half").alias("half"), F.collect_set("team").alias("teams"), F.count("*").alias("n"), second.alias("s")
    )
    forms = cut(forms.select("form", "given", "family", "half", "pos", "teams", F.col("s.second_given").alias("second_given"), F.col("s.second_family").alias("second_family"), F.coalesce("s.unsettled", F.lit(False)).alias("unsettled"), F.lit(True).alias("probe"), "n", F.col("form").alias("root"), (F.length("given") >= 2).alias("full"), F.col("pos").isNotNull().alias("known")))

    def linked(forms: DataFrame, wide: bool) -> DataFrame:
        best = _admitted(_candidates(forms, nicknames, wide)).groupBy("root").agg(F.max("to").alias("to")).select("root", F.col("to.root").alias("parent"))
        return forms.select("root").distinct().join(best, "root", "left").select(F.col("root").alias("form"), F.coalesce("parent", "root").alias("parent"))

    roots = _roots(linked(forms, False))
    grouped = forms.drop("root").join(roots, "form")
    support = grouped.groupBy("root").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("teams"))).alias("teams"), F.max("full").alias("full"), F.max("known").alias("known"))
    grouped = cut(grouped.drop("n", "teams", "probe", "full", "known").join(support, "root").withColumn("probe", F.col("n") <= 2))
    again = _roots(linked(grouped, True)).withColumnRenamed("root", "entity").withColumnRenamed("form", "root")
    final = grouped.select("form", "root").join(again, "root").select("form", F.concat(F.lit("p:"), F.col("entity").cast("string")).alias("entity"))
    entity = people.select(F.col("ident").alias(ident), "form").join(final, "form").select(ident, "entity")
    return parsed.where("unit is not null").select(F.col("ident").alias(ident), F.concat(F.lit("u:"), F.col("unit")).alias("entity")).unionByName(entity)


def linked_pairs(entities: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """(a, b) with a < b for every two entries of one entity.

    The pairs are what is asked for; the join is on the entity and the adaptive planner
    divides an entity that is hot.
    """
    x = entities.select(F.col(ident).alias(a), "entity")
    y = entities.select(F.col(ident).alias(b), "entity")
    return x.join(y, "entity").where(F.col(a) < F.col(b)).select(a, b)
