"""Text, name and odds functions as Spark columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain letters, for keys made without a UDF. Fixed values.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŠŽ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyszAAAAAACEEEEIIIINOOOOOOUUUUYSZ"
#: Names of the same team in other sources: this feed's code and ours. Fixed values.
TEAM_ALIASES = {"JAC": "JAX", "WSH": "WAS", "LA": "LAR", "OAK": "LV", "SD": "LAC", "STL": "LAR"}
DEFENCE_POSITIONS = ("D/ST", "DST", "D", "DEF")


def strip_marks(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), MARKED, PLAIN)


def name_key(c: Column, suffixes: tuple[str, ...] = ("jr", "sr", "ii", "iii", "iv", "v"), anywhere: bool = False, keep_spaces: bool = True) -> Column:
    """A comparison key of a name: plain lower-case letters and digits without generation suffix.

    anywhere: drop suffix words wherever they stand, else only at the end; keep_spaces: words
    stay divided by single spaces, else they are run together.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip_marks(c)), r"['’.]", ""), r"[^a-z0-9]+", " "), r"\s+", " "))
    words = "|".join(suffixes)
    s = F.regexp_replace(s, rf"\b(?:{words})\b", "") if anywhere else F.regexp_replace(s, rf"\s(?:{words})$", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return s if keep_spaces else F.replace(s, F.lit(" "), F.lit(""))


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """The value's entry in a small table, the value itself where there is none."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(pairs, c), c)


def team_code(c: Column, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    return mapped(F.upper(F.trim(c)), aliases)


def canonical_position(c: Column) -> Column:
    p = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(p.isin(*DEFENCE_POSITIONS), "DEF").otherwise(p)


def name_and_team(c: Column) -> tuple[Column, Column]:
    """'Name (TEAM)' in its two parts; a text without a team has none."""
    team = F.nullif(F.regexp_extract(c, r"\(([A-Za-z]{2,4})\)\s*$", 1), F.lit(""))
    return F.trim(F.regexp_replace(c, r"\s*\([A-Za-z]{2,4}\)\s*$", "")), F.upper(team)


def american_probability(c: Column) -> Column:
    """The probability that American odds imply; even words are a half, unreadable odds null."""
    s = F.regexp_replace(F.translate(F.trim(F.upper(c)), "−–", "--"), r"[,+\s]", "")
    n = s.try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) & (n != 0)
    return F.when(s.isin("EVEN", "EV", "EVENS"), 0.5).when(ok & (n < 0), -n / (-n + 100)).when(ok, F.lit(100.0) / (n + 100))


def implied_probability(american: Column, decimal: Column, eps: float = 1e-6) -> Column:
    """From American odds if they can be read, else from decimal odds over 1; kept off 0 and 1."""
    d = F.when(decimal > 1, F.lit(1.0) / decimal)
    p = F.coalesce(american_probability(american), d)
    return F.when(p.isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p)))


def no_vig(p: Column, q: Column) -> Column:
    """The first of two complementary probabilities without the bookmaker's share."""
    return F.try_divide(p, p + q)


def threshold(c: Column) -> Column:
    """The N of 'N+' in a text."""
    return F.nullif(F.regexp_extract(c, r"(?<![\d.])(\d+(?:\.\d+)?)\s*\+", 1), F.lit("")).try_cast("double")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def html_text(c: Column) -> Column:
    """The text of a piece of HTML."""
    s = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_number(c: Column) -> Column:
    """The number, null for NaN and infinities."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def mean_of(*cols: Column) -> Column:
    """Mean of the values that are there; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(clean_number(c), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [clean_number(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(total, n)


def joined_flags(*pairs: tuple[Column, str], empty: str = "ok") -> Column:
    """The labels whose conditions hold, joined; `empty` if none does."""
    s = F.concat_ws("; ", *[F.when(cond, F.lit(label)) for cond, label in pairs])
    return F.when(s == "", F.lit(empty)).otherwise(s)


def content_hash(*cols: str) -> Column:
    """SHA-256 of the columns as canonical JSON; nulls are left out by name, so they count."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)
