"""Reading of names typed by people: cleaning, parts, nicknames and team units."""

from __future__ import annotations

import re
import unicodedata

#: English given names and their usual short forms. Fixed values.
NICKNAMES = {
    "alexander": ("alex", "al", "xander", "lex", "sasha"),
    "andrew": ("andy", "drew"),
    "anthony": ("tony", "ant"),
    "benjamin": ("ben", "benny", "benji"),
    "cameron": ("cam",),
    "charles": ("charlie", "chuck", "chas"),
    "christopher": ("chris", "topher", "kit"),
    "daniel": ("dan", "danny"),
    "david": ("dave", "davey"),
    "dominic": ("dom", "nic"),
    "donald": ("don", "donnie", "donny"),
    "edward": ("ed", "eddie", "ned", "ted", "teddy"),
    "frederick": ("fred", "freddie", "freddy", "rick"),
    "gabriel": ("gabe",),
    "gerald": ("jerry", "gerry"),
    "gregory": ("greg",),
    "jacob": ("jake",),
    "james": ("jim", "jimmy", "jamie"),
    "jeffrey": ("jeff",),
    "john": ("jack", "johnny"),
    "jonathan": ("jon", "jonny", "johnny", "nathan"),
    "joseph": ("joe", "joey"),
    "joshua": ("josh",),
    "kenneth": ("ken", "kenny"),
    "lawrence": ("larry", "lars", "law"),
    "leonard": ("leo", "len", "lenny"),
    "matthew": ("matt", "matty"),
    "maximilian": ("max", "maxi"),
    "michael": ("mike", "mikey", "mick"),
    "nathaniel": ("nate", "nat", "nathan"),
    "nicholas": ("nick", "nicky", "nico"),
    "patrick": ("pat", "paddy"),
    "peter": ("pete",),
    "philip": ("phil", "pip"),
    "raymond": ("ray",),
    "richard": ("rich", "rick", "ricky", "dick"),
    "robert": ("rob", "robbie", "bob", "bobby"),
    "ronald": ("ron", "ronnie"),
    "samuel": ("sam", "sammy"),
    "stephen": ("steve", "stevie", "steph"),
    "terrell": ("terry",),
    "theodore": ("theo", "ted", "teddy"),
    "thomas": ("tom", "tommy"),
    "timothy": ("tim", "timmy"),
    "vincent": ("vince", "vinny", "vinnie", "vin"),
    "william": ("will", "bill", "billy", "willie", "liam"),
    "zachary": ("zach", "zack", "zac"),
}
#: Suffixes of generations, positions and words for a defence. Fixed values.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
POSITIONS = ("QB", "RB", "WR", "TE", "K", "DEF", "DST", "D/ST")
DEFENCE_WORDS = ("def", "dst", "defense", "defence")



class Nicknames:
    """Which given names are used for one another, from a table of formal names and their short forms."""

    def __init__(self, table: dict[str, tuple[str, ...]] = NICKNAMES) -> None:
        self.table = {f: tuple(s) for f, s in table.items()}
        self.formal: dict[str, list[str]] = {}
        for formal, shorts in self.table.items():
            for short in shorts:
                self.formal.setdefault(short, []).append(formal)

    def forms(self, given: str) -> list[str]:
        """The given name and every formal name that it may be short for."""
        return [given, *self.formal.get(given, [])]

    def kindred(self, given: str) -> list[str]:
        """The given name, the formal names that it may be short for and their short forms."""
        forms = self.forms(given)
        return list(dict.fromkeys([*forms, *(n for f in forms for n in self.table.get(f, ()))]))


USUAL = Nicknames()

_ANNOTATION = re.compile(r"\s*[\(\[]\s*[A-Za-z/]{1,4}\s*[\)\]]\s*$")
_TEAM_TAIL = re.compile(r"\s+[-–—]\s+([A-Za-z0-9]{2,3})\s*$")


def fold(text: str) -> str:
    """Lower case without accents, odd spaces and invisible characters."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", text).strip().casefold()


def canonical_position(p: str | None) -> str | None:
    p = re.sub(r"\s+", "", p or "").upper()
    return None if p not in POSITIONS else "DEF" if p in ("DEF", "DST", "D/ST") else p


class Name:
    """Parts of a typed name.

    long: words of three letters or more without suffixes, in the order typed; comma: how many
    of them stood before a comma (0: no comma); initials: letters of shorter words, outer if they
    stood before all long words; halves of a hyphened word are kept apart in `first_half`.
    """

    __slots__ = ("long", "comma", "initials", "outer", "suffix", "tail", "first_half")

    def __init__(self, text: str | None, nicknames: Nicknames = USUAL) -> None:
        raw = (text or "").replace("\xa0", " ")
        self.tail = None
        raw = _ANNOTATION.sub("", raw)
        if m := _TEAM_TAIL.search(raw):
            self.tail, raw = m[1].upper(), raw[: m.start()]
        s = _ANNOTATION.sub("", fold(raw)).replace("'", "").replace("’", "")
        self.long, self.initials, self.suffix, self.comma, self.first_half = [], "", None, 0, {}
        places: list[int] = []
        for part, chunk in enumerate(s.split(",")):
            if part == 1:
                self.comma = len(self.long)
            for word in re.split(r"[\s.]+", chunk):
                pieces = [p for p in re.split(r"[^\w]+|_", word) if p]
                bare = "".join(pieces)
                if not bare:
                    continue
                if bare in SUFFIXES and (self.long or self.initials):
                    self.suffix = bare
                elif len(bare) <= 2 and bare not in nicknames.formal:
                    self.initials += bare
                    places.append(len(self.long))
                else:
                    self.long.append(bare)
                    if len(pieces) > 1:
                        self.first_half[bare] = pieces[0]
        self.outer = bool(places) and set(places) == {0}


def unit_spellings(code: str, alt: str | None, city: str | None, nickname: str | None) -> list[str]:
    """The ways a team unit is written, folded and without spaces."""
    squeeze = lambda *xs: re.sub(r"[^a-z0-9]", "", fold("".join(x or "" for x in xs)))
    out = {squeeze(nickname), squeeze(city, nickname), squeeze(nickname, city), squeeze(city)}
    letters = "".join(w[0] for w in re.split(r"\s+", fold(city or "")) if w)
    if letters and nickname:
        out |= {squeeze(letters, nickname), squeeze(nickname, letters)}
    out |= {squeeze(code, nickname), squeeze(alt or code, nickname)}
    return sorted(x for x in out if len(x) >= 4)


def unit_text(text: str | None) -> tuple[str, bool]:
    """A typed unit folded, without article and words for a defence, and whether such a word was there."""
    s = fold(_ANNOTATION.sub("", (text or "").replace("\xa0", " ")))
    s = s.replace("d/st", "dst")
    s = re.sub(r"\s+[-–—]\s+[a-z0-9]{2,3}$", "", s)
    ws = re.findall(r"[a-z0-9]+", s)
    bare = [w for w in ws if w not in DEFENCE_WORDS and w != "the"]
    if len(bare) == 2 and bare[1] == "d" and len(bare[0]) <= 3:
        return bare[0], True
    return "".join(bare), any(w in DEFENCE_WORDS for w in ws)
