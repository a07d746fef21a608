"""Text functions that stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> tuple[str, str]:
    """Latin letters with accents and the letters they are written on, by decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()


# What goes from the text of an article, in this order, and what takes its place.
CLEANED = [
    (r"\{\{[^}]*\}\}", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"<[^>]+>", ""), (r"\[\[([^\]|]+\|)?([^\]]+)\]\]", "$2"), (r"={2,}", ""), (r"\n{3,}", "\n\n"),
]


def cleaned(c: Column) -> Column:
    """The text of an article without templates, references, tags, link targets and marks of headings."""
    for pattern, by in CLEANED:
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, r"^[ \n\r\t]+|[ \n\r\t]+$", "")


def unaccent(c: Column) -> Column:
    """Without accents on Latin letters, composed or decomposed; null stays null."""
    return F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), _FROM, _TO)


def normalised(c: Column) -> Column:
    """Lower case, without accents, white space as single spaces."""
    return F.trim(F.regexp_replace(unaccent(F.lower(c)), r"\s+", " "))


def plain_name(c: Column) -> Column:
    """Without what stands in brackets, lower case, all but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), "[^a-z0-9]+", " "))


def significant(c: Column, least: int) -> Column:
    """The words of at least so many letters in a normalised name."""
    return F.filter(F.split(plain_name(c), " "), lambda w: F.length(w) >= least)


def entity_key(qid: Column, label: Column) -> Column:
    """What makes two values the same entity: the QID, else the normalised name; null if there is neither."""
    q, n = F.trim(qid), normalised(label)
    return F.when(q != "", F.concat(F.lit("qid:"), q)).when(n != "", F.concat(F.lit("name:"), n))


def role_rank(role: Column) -> Column:
    """state, major, minor, minority; all else last."""
    rank = F.lit(9)
    for k, name in reversed(list(enumerate(["state", "major", "minor", "minority"]))):
        rank = F.when(role == name, k).otherwise(rank)
    return rank


def by_locale(c: Column, collation: str = "UNICODE") -> Column:
    """A text as a key of order by the rules of a language: accents and case decide last, nulls stay."""
    return F.collate(c, collation)
