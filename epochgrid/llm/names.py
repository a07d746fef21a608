"""Names typed by people: folded forms, tokens and edit distances."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Letters of other scripts that look like Latin ones, digits typed for letters.
_ALIKE = str.maketrans("аеорсухіјѕԁһкмтвнгпαεορυικντ", "aeopcyxijsdhkmtbhrnaeopuiknt")
_DIGITS = str.maketrans("01534", "olsea")
_OWN = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ß": "ss"})
_TOKEN = re.compile(r"[^\W_]+\.?")
_TWICE = re.compile(r"(.)\1+")


def fold(name: str) -> str:
    """Casefolded, without accents and invisible signs, look-alike letters as Latin ones."""
    if not name.isascii():
        name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        name = name.casefold().translate(_OWN)
        if re.search("[a-z]", name):
            name = name.translate(_ALIKE)
        return name
    return name.lower()


def tokens(folded: str) -> list[str]:
    """Runs of letters and digits; a full stop stays, as it marks an abbreviation."""
    return _TOKEN.findall(folded)


def sounded(token: str) -> str:
    """The token without full stop, with digits read as letters, ph as f, y as i and double letters as one."""
    token = token.rstrip(".")
    if not token.isdigit():
        token = token.translate(_DIGITS)
    return _TWICE.sub(r"\1", token.replace("ph", "f").replace("y", "i"))


def allowed(length: int) -> int:
    """Edits that still leave a token of this length itself."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 7 else 3


def _codes(words: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), int(length.max(initial=1)) or 1), fill, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out, length


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair: insertions, deletions, substitutions and swaps of neighbours, by one table for all pairs."""
    if not left:
        return np.zeros(0, np.int64)
    a, la = _codes(left, -1)
    b, lb = _codes(right, -2)
    n, width = len(left), b.shape[1]
    rows = np.arange(n)
    out = np.where(la == 0, lb, 0)
    older = None
    last = np.tile(np.arange(width + 1, dtype=np.int16), (n, 1))
    for i in range(1, a.shape[1] + 1):
        now = np.empty_like(last)
        now[:, 0] = i
        for j in range(1, width + 1):
            best = np.minimum(np.minimum(last[:, j], now[:, j - 1]) + 1, last[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
            if older is not None and j > 1:
                swap = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swap, np.minimum(best, older[:, j - 2] + 1), best)
            now[:, j] = best
        done = la == i
        out[done] = now[rows[done], lb[done]]
        older, last = last, now
    return out


def near(words: list[str], vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, entry, distance) of all pairs within the allowed edits of the longer one.

    First by length and by the letters they don't share, which bounds the distance from below; then exactly.
    """
    if not words or not vocabulary:
        none = np.zeros(0, np.int64)
        return none, none, none

    def letters(ws: list[str]) -> np.ndarray:
        out = np.zeros((len(ws), 32), np.int16)
        for i, w in enumerate(ws):
            for c in w:
                out[i, ord(c) & 31] += 1
        return out

    size = np.array([len(v) for v in vocabulary])
    bag = letters(vocabulary)
    limit = np.array([allowed(k) for k in range(max(size.max(), max(map(len, words))) + 1)])
    at, to = [], []
    for start in range(0, len(words), 256):
        part = words[start : start + 256]
        own = np.array([len(w) for w in part])
        held = letters(part)
        for first in range(0, len(vocabulary), 2048):
            some = slice(first, first + 2048)
            most = np.maximum(limit[own][:, None], limit[size[some]][None, :])
            diff = held[:, None, :] - bag[None, some, :]
            apart = np.maximum(np.maximum(diff, 0).sum(2), np.maximum(-diff, 0).sum(2))
            i, j = np.nonzero(apart <= most)
            at.append(i + start)
            to.append(j + first)
    i, j = np.concatenate(at), np.concatenate(to)
    d = np.concatenate(
        [np.zeros(0, np.int64)]
        + [edit_distances([words[x] for x in i[k : k + 20000]], [vocabulary[x] for x in j[k : k + 20000]]) for k in range(0, len(i), 20000)]
    )
    keep = d <= np.maximum(limit[[len(words[x]) for x in i]] if len(i) else 0, limit[size[j]])
    return i[keep], j[keep], d[keep]
