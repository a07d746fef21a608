"""Nested JSON into linked flat rows by vectorised structural indexing.

A batch of JSON texts is one array of bytes. Bitmaps mark its quotes (without escaped ones), brackets and
delimiters; the parity of the running count of quotes tells text inside strings, the running sum of brackets gives
the depth; from depth and position follow each value's parent, its key or its position in the list. No text is
parsed by itself. Each text is also checked against the whole JSON grammar by what may follow what.

Results for odd input: a null, empty or blank text, and one that isn't JSON, has no values and isn't ``valid``;
of a key that is repeated in one object the last counts; no depth of nesting is too deep.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from epochgrid.operators.arrow import bytes_of, spans

OBJECT, OBJECT_END, LIST, LIST_END, COLON, COMMA, STRING, SCALAR, KEY, START = range(10)

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\r")] = 1
_CLASS[list(b"{}[]:,")] = 2
_CLASS[ord('"')] = 3
_KIND = np.full(256, SCALAR, np.uint8)
for _at, _char in enumerate(b'{}[]:,"'):
    _KIND[_char] = _at
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALARS = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")

#: _FOLLOWS[a, b]: whether b may stand right behind a.
_FOLLOWS = np.zeros((10, 10), bool)
_VALUE, _DONE = [OBJECT, LIST, STRING, SCALAR], [OBJECT_END, LIST_END, STRING, SCALAR]
for _a in (START, COLON, LIST, COMMA):
    _FOLLOWS[_a, _VALUE] = True
for _a in _DONE:
    _FOLLOWS[_a, [COMMA, OBJECT_END, LIST_END]] = True
_FOLLOWS[OBJECT, [KEY, OBJECT_END]] = True
_FOLLOWS[COMMA, KEY] = True
_FOLLOWS[KEY, COLON] = True
_FOLLOWS[LIST, LIST_END] = True


def unescaped(raw: bytes) -> str:
    """The text of a JSON string given with its quotes; half a surrogate pair becomes U+FFFD."""
    text = json.loads(raw)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


class JsonIndex:
    """Tokens of a batch of JSON texts: kind, first and last byte, text, parent, position in the parent."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, n, texts = data, off, len(data), len(off) - 1
        self.valid = np.ones(texts, bool)
        self.escapes = np.zeros(0, np.int64)
        first = np.zeros(n + 1, bool)
        first[off] = True
        quotes = np.flatnonzero(data == ord('"'))
        slashes = np.flatnonzero(data == ord("\\"))
        if slashes.size:
            fresh = np.r_[True, slashes[1:] != slashes[:-1] + 1] | first[slashes]
            at = np.arange(slashes.size)
            odd = (at - np.maximum.accumulate(np.where(fresh, at, 0))) & 1
            starts = slashes[odd == 0]
            starts = starts[~first[starts + 1]]  # none reaches into the next text
            escaped = np.zeros(n + 1, bool)
            escaped[starts + 1] = True
            quotes = quotes[~escaped[quotes]]
            self.escapes = starts
        uneven = (np.diff(np.searchsorted(quotes, off)) & 1).astype(bool)
        if uneven.any():
            self.valid &= ~uneven
            quotes = quotes[~uneven[np.searchsorted(off, quotes, "right") - 1]]
        inside = np.zeros(n, np.uint8)
        inside[quotes] = 1
        inside = (np.add.accumulate(inside, dtype=np.uint8) & 1).astype(bool)  # from the opening quote on, without the closing one
        kind = _CLASS[data]
        for k in np.flatnonzero(uneven):
            kind[off[k] : off[k + 1]] = 1
        scalar = (kind == 0) & ~inside
        starts = scalar.copy()
        starts[1:] &= ~scalar[:-1] | first[1:n]
        ends = scalar.copy()
        ends[:-1] &= ~scalar[1:] | first[1:n]
        mark = ((kind == 2) & ~inside) | starts
        mark[quotes[0::2]] = True
        self.at = np.flatnonzero(mark)
        self.kind = _KIND[data[self.at]]
        self.end = self.at + 1
        self.end[self.kind == STRING] = quotes[1::2] + 1
        self.end[self.kind == SCALAR] = np.flatnonzero(ends) + 1
        counts = np.diff(np.searchsorted(self.at, off))
        self.text = np.repeat(np.arange(texts), counts)
        self._refuse(counts == 0)
        self._check_strings(inside)
        self._check_scalars()
        depth = self._depths()
        self._link(depth)
        self._check_order()

    def _refuse(self, texts: np.ndarray) -> None:
        self.valid[texts] = False

    def _keep(self, keep: np.ndarray) -> None:
        self.at, self.kind, self.end, self.text = (x[keep] for x in (self.at, self.kind, self.end, self.text))

    def _texts_at(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def _check_strings(self, inside: np.ndarray) -> None:
        data = self.data
        self._refuse(self._texts_at(np.flatnonzero(inside & (data < 32))))
        esc = self.escapes[inside[self.escapes]] if self.escapes.size else self.escapes
        if esc.size:
            sign = data[esc + 1]
            self._refuse(self._texts_at(esc[~_ESCAPES[sign]]))
            u = esc[sign == ord("u")]
            hexes = _HEX[data[np.minimum(u[:, None] + np.arange(2, 6), len(data) - 1)]].all(1)
            self._refuse(self._texts_at(u[~hexes]))

    def _check_scalars(self) -> None:
        k = np.flatnonzero(self.kind == SCALAR)
        if not k.size:
            return
        a, b, data = self.at[k], self.end[k], self.data
        digit = (data >= 48) & (data <= 57)
        others = np.cumsum(~digit)
        minus = data[a] == ord("-")
        lead = np.where(minus, a + 1, a)
        rest = others[b - 1] - np.where(lead > 0, others[lead - 1], 0)
        plain = (lead < b) & (rest == 0) & ((b - lead == 1) | (data[np.minimum(lead, len(data) - 1)] != 48))
        memo: dict[bytes, bool] = {}
        for i in np.flatnonzero(~plain):
            word = data[a[i] : b[i]].tobytes()
            ok = memo.get(word)
            if ok is None:
                ok = memo[word] = _SCALARS.fullmatch(word) is not None
            if not ok:
                self.valid[self.text[k[i]]] = False

    def _depths(self) -> np.ndarray:
        step = np.zeros(len(self.at), np.int32)
        step[(self.kind == OBJECT) | (self.kind == LIST)] = 1
        step[(self.kind == OBJECT_END) | (self.kind == LIST_END)] = -1
        depth = np.cumsum(step)
        heads = np.searchsorted(self.text, np.arange(len(self.valid)))
        tails = np.searchsorted(self.text, np.arange(len(self.valid)), "right")
        total = np.r_[0, depth]
        depth = depth - total[heads][self.text] if len(depth) else depth
        self._refuse(total[tails] != total[heads])
        self._refuse(self.text[depth < 0])
        if not self.valid.all():
            keep = self.valid[self.text]
            self._keep(keep)
            depth = depth[keep]
        return depth

    def _link(self, depth: np.ndarray) -> None:
        opens = (self.kind == OBJECT) | (self.kind == LIST)
        closes = (self.kind == OBJECT_END) | (self.kind == LIST_END)
        within = depth - opens + closes
        self.parent = np.full(len(self.at), -1, np.int64)
        self.ordinal = np.zeros(len(self.at), np.int64)
        # by level, in order of place: the bracket that opens a level comes before what it holds, whatever the depth
        level = np.zeros(2 * len(self.at), np.int16 if depth.max(initial=0) < 2**15 else np.int32)
        level[0::2] = np.where(opens, depth, 0)
        level[1::2] = np.maximum(within, 0)
        some = np.flatnonzero(level)
        some = some[np.argsort(level[some], kind="stable")]
        token, head = some >> 1, (some & 1) == 0
        commas = np.cumsum((self.kind[token] == COMMA) & ~head)
        last = np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))
        kids = token[~head]
        self.parent[kids] = token[last][~head]
        self.ordinal[kids] = (commas - commas[last])[~head]

    def _check_order(self) -> None:
        n = len(self.at)
        before = np.full(n, START, np.uint8)
        before[1:] = np.where(self.text[1:] == self.text[:-1], self.kind[:-1], START)
        holder = np.where(self.parent >= 0, self.kind[np.maximum(self.parent, 0)] if n else 0, START)
        key = (self.kind == STRING) & (holder == OBJECT) & ((before == OBJECT) | (before == COMMA))
        self.kind[key] = KEY
        before[1:] = np.where(key[:-1] & (before[1:] == STRING), KEY, before[1:])
        good = _FOLLOWS[before, self.kind]
        value = (self.kind == OBJECT) | (self.kind == LIST) | (self.kind == STRING) | (self.kind == SCALAR)
        good &= ~(value & (before == COMMA) & (holder != LIST))
        good &= (self.kind != COMMA) | (holder != START)
        good &= (self.kind != OBJECT_END) | (holder == OBJECT)
        good &= (self.kind != LIST_END) | (holder == LIST)
        self.value = value
        self._refuse(self.text[~good])
        if not good.all():  # positions stay, but nothing of a refused text can be reached
            self.value = value & self.valid[self.text]

    def roots(self) -> np.ndarray:
        """The outermost value of each valid text, else -1."""
        root = np.full(len(self.valid), -1, np.int64)
        top = np.flatnonzero(self.value & (self.parent < 0))
        root[self.text[top]] = top
        return root

    def fields(self, names: list[str]) -> dict[str, np.ndarray]:
        """By name: for each token the value it has under that key, or -1; all at once."""
        owned = np.flatnonzero(self.value & (self.parent >= 0))
        owned = owned[self.kind[self.parent[owned]] == OBJECT]
        keys = owned - 2
        a, length = self.at[keys] + 1, self.end[keys] - self.at[keys] - 2
        out = {name: np.full(len(self.at) + 1, -1, np.int64) for name in names}  # the last one answers for -1
        odd: dict[int, str] = {}
        if self.escapes.size:
            inner = np.searchsorted(self.escapes, a) < np.searchsorted(self.escapes, a + length)
            odd = {i: unescaped(self.data[self.at[keys[i]] : self.end[keys[i]]].tobytes()) for i in np.flatnonzero(inner)}
        for name in names:
            raw = np.frombuffer(name.encode(), np.uint8)
            same = np.flatnonzero(length == len(raw))
            for k, byte in enumerate(raw):
                same = same[self.data[a[same] + k] == byte]
            hit = owned[same]
            if odd:
                hit = np.sort(np.r_[hit, owned[[i for i, text in odd.items() if text == name]].astype(np.int64)])
            out[name][self.parent[hit]] = hit
        return out

    def kinds(self, token: np.ndarray) -> np.ndarray:
        """The kinds of tokens; START for -1."""
        return np.where(token >= 0, self.kind[np.maximum(token, 0)] if len(self.kind) else START, START)

    def is_null(self, token: np.ndarray) -> np.ndarray:
        """Whether a value is absent or null."""
        none = token < 0
        if len(self.at):
            t = np.maximum(token, 0)
            none = none | ((self.kind[t] == SCALAR) & (self.data[self.at[t]] == ord("n")))
        return none

    def texts(self, token: np.ndarray) -> pa.Array:
        """Strings as text, numbers and booleans as written; null for null, absent, lists and objects."""
        if not len(self.at):
            return pa.nulls(len(token), pa.string())
        kind = self.kinds(token)
        null = self.is_null(token) | ((kind != STRING) & (kind != SCALAR))
        t = np.maximum(token, 0)
        quoted = kind == STRING
        a, b = self.at[t] + quoted, self.end[t] - quoted
        column = spans(self.data, a, b, null)
        if self.escapes.size:
            odd = np.flatnonzero(~null & quoted & (np.searchsorted(self.escapes, a) < np.searchsorted(self.escapes, b)))
            if odd.size:
                made = [unescaped(self.data[a[i] - 1 : b[i] + 1].tobytes()) for i in odd]
                order = np.arange(len(token))
                order[odd] = len(token) + np.arange(odd.size)
                column = pa.concat_arrays([column.cast(pa.string()), pa.array(made, pa.string())]).take(pa.array(order))
        return column

    def numbers(self, token: np.ndarray) -> pa.Array:
        """Whole numbers, also written as text; a fraction loses it; null for all else and beyond 64 bits."""
        return whole_numbers(self.texts(token))


def whole_numbers(column: pa.Array) -> pa.Array:
    simple = pc.fill_null(pc.match_substring_regex(column, r"^-?[0-9]{1,18}$"), False)
    out = pc.if_else(simple, column, pa.scalar(None, pa.string())).cast(pa.int64())
    odd = np.flatnonzero(pc.and_(pc.invert(simple), column.is_valid()).to_numpy(zero_copy_only=False))
    if odd.size:
        made = []
        for i in odd:
            try:
                number = int(float(column[int(i)].as_py().strip()))
                made.append(number if -(2**63) <= number < 2**63 else None)
            except (ValueError, OverflowError):
                made.append(None)
        order = np.arange(len(column))
        order[odd] = len(column) + np.arange(odd.size)
        out = pa.concat_arrays([out, pa.array(made, pa.int64())]).take(pa.array(order))
    return out


def indexed(column: pa.Array) -> list[tuple[JsonIndex, np.ndarray]]:
    """Indexes of a column of JSON texts, each with the rows its texts come from.

    JSON within a JSON string is read again, as often as it is wrapped, in an index of its own.
    """
    out, rows = [], np.arange(len(column))
    while len(column):
        index = JsonIndex(*bytes_of(column))
        out.append((index, rows))
        root = index.roots()
        wrapped = np.flatnonzero(index.kinds(root) == STRING)
        if not wrapped.size:
            break
        column, rows = index.texts(root[wrapped]).cast(pa.string()), rows[wrapped]
    return out
