"""Words of dirty texts: without case, accents, markup, punctuation and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

_INLINE = re.compile(r"</?(?:b|i|u|s|a|em|strong|span|font|small|big|sub|sup|code|mark|tt)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:!--.*?--|/?[a-z][^<>]*)>", re.I | re.S)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*(?:\r\n|\r|\n)[ \t]*(?=[^\W\d_])")
_RUN = re.compile(r"[^\W_]+")
_ASCII_UPPER = re.compile(r"[^\x00-\x7f]")


def _invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Mn", "Me", "Cf") or unicodedata.combining(c) > 0


def plain(text: str) -> str:
    """The text without tags, accents and invisible characters, in folded case; lines stay as they are."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if _ASCII_UPPER.search(text):
        text = unicodedata.normalize("NFKD", text)
        odd = {c for c in set(text) if ord(c) > 127 and _invisible(c)}
        if odd:
            text = text.translate({ord(c): None for c in odd})
        return unicodedata.normalize("NFKD", text.casefold())
    return text.lower()


def word_forms(text: str | None) -> list[list[str]]:
    """The text's words; a second reading where a hyphen at a line's end may be the word's own.

    The first reading joins words broken over two lines, the second takes the hyphen as
    punctuation. A null or empty text has one reading without words.
    """
    if not text:
        return [[]]
    base = plain(text)
    joined = _BROKEN.sub("", base)
    forms = [_RUN.findall(joined)]
    if joined != base:
        forms.append(_RUN.findall(base))
    return forms


def words(text: str | None) -> list[str]:
    return word_forms(text)[0]
