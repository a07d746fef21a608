"""Texts into words that stay the same whatever their case, accents, punctuation, spacing and markup."""

from __future__ import annotations

import html
import re
import unicodedata

# markup that stands inside a sentence goes without a trace, other markup parts words
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|font|sup|sub|small|mark|code|tt|ins|del|s|q|wbr|ref)(?:\s[^<>]*)?/?>", re.I)
_BLOCK = re.compile(r"</?[a-zA-Z][^<>]*>")
_WIKI = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")
_URL = re.compile(r"\b(?:https?://|www\.)[^\s<>\])\"']+")
#: Signs inside words that aren't part of them.
_JOINED = re.compile("(?<=\\w)['’‘ʼʹ`´ʻ](?=\\w)|[_*\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u180e]")
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3})")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
# Letters that are no accented letters to Unicode but are written for one.
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ħ": "h"})


def without_comments(text: str, instead: str) -> str:
    """The text without comments of any length; one that doesn't end is text."""
    if "<!--" not in text:
        return text
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out += [text[at:start], instead]
        at = end + 3
    return "".join([*out, text[at:]])


def plain(text: str) -> str:
    """The text without markup and entities, in compatibility form, without accents, casefolded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", without_comments(text, " ")))
    if "[" in text:
        text = _LINK.sub(r"\1", _WIKI.sub(r"\1", text))
    if "://" in text or "www." in text:
        text = _URL.sub(" ", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_LETTERS)
    else:
        text = text.lower()
    return _JOINED.sub("", _THOUSANDS.sub("", text))


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))
