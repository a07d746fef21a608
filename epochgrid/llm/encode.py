"""Encoding of a corpus with a byte-level BPE vocabulary.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over the vocabulary finds all tokens of a piece in one
pass. From the longest match at each place the encoder goes forward; a token is taken only if it may stand beside the one
before, that is if merging by rank would never join across the border. Where none may, it goes one token back and takes
the next shorter one. Places from which no way led on are marked, so each is tried once and the time stays linear. The
answers about neighbours are remembered, and so are whole pieces, since words come again and again. The result equals that of
merging by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.operators.arrow import sliced

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte_bpe_50k cuts a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers; beyond it the memory starts afresh, which costs time only.
REMEMBERED = 400_000
BLOCK = 8 << 20


class Encoder:
    """Tokens of a vocabulary whose ids are in the order of its merges."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        size = max(self.ids.values()) + 1
        self.length = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.length[rank] = len(token)
            self.automaton.add_word(token, (rank, len(token)))
            for k in range(len(token) - 1, 0, -1):
                if (shorter := self.ids.get(token[:k])) is not None:
                    self.shorter[rank] = shorter
                    break
        self.automaton.make_automaton()
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            left = self.shorter[rank]
            while left >= 0:
                right = self.ids.get(token[self.length[left] :])
                if right is not None and left < rank and right < rank and self._beside(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]
        self.known = {}

    def _beside(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between two tokens.

        Their merges are undone from the last back: the two tokens that then meet at the border were neighbours until
        that merge, so the border stays only if nothing that ranks below it joins them.
        """
        merged, halves = self.merged, self.halves
        bound = len(self.length)
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            if inner_left != left and (left > right or inner_right == right):
                bound, left = left, inner_left
            elif inner_right != right:
                bound, right = right + 1, inner_right
            else:
                return True

    def beside(self, left: int, right: int) -> bool:
        answer = self.known.get((left, right))
        if answer is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            answer = self.known[left, right] = self._beside(left, right)
        return answer

    def piece(self, text: str) -> list[int]:
        """The ids of one piece, given as Latin-1."""
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        longest = [0] * len(text)
        for end, (token, length) in self.automaton.iter(text):
            longest[end - length + 1] = token
        out: list[int] = []
        open_ = bytearray(b"\x01") * (len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            end = at + self.length[token]
            if open_[end] and (not out or self.beside(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
                continue
            token = self.shorter[token]
            if token < 0:
                open_[at] = 0
                token = out.pop()
                at -= self.length[token]
        return out


@lru_cache(2)
def read(data: bytes) -> Encoder:
    return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})


def encoder(path: str) -> Encoder:
    return read(Path(path).read_bytes())


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of each row, without special tokens; an empty list where the text is empty or null.

    ``vocabulary`` is a file of the driver, which is sent to the tasks. The strings of special tokens are ordinary text. Rows and their order within a task stay as they are, repeated and
    null keys too, and nothing is shuffled. Other columns of ``df`` aren't read; beside a key named ``ids`` the list is
    ``token_ids``.
    """
    source = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary, of a megabyte or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        made, pieces = read(shared.value), regex.compile(pattern).findall
        seen = made.seen
        for whole in batches:
            for batch in sliced(whole, "__text", BLOCK):
                flat: list[int] = []
                off = np.zeros(batch.num_rows + 1, np.int32)
                for i, value in enumerate(batch.column("__text").to_pylist()):
                    if value:
                        for word in pieces(value):
                            try:
                                flat += seen[word]
                            except KeyError:
                                if len(seen) > REMEMBERED:
                                    seen.clear()
                                ids = made.piece(word.encode().decode("latin-1"))
                                if len(word) < 64:
                                    seen[word] = ids
                                flat += ids
                    off[i + 1] = len(flat)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("__key"), ids], names=["__key", "ids"])

    out = source.mapInArrow(run, f"__key {dict(df.dtypes)[key]}, ids array<int>")
    return out.select(F.col("__key").alias(key), F.col("ids").alias("ids" if key != "ids" else "token_ids"))


def p6_ids(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
