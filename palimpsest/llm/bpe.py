"""Byte pair encoding by backtracking (problem 8).

An Aho-Corasick automaton over the vocabulary gives, for every position of a piece of text, the tokens
that start there. The encoder takes the longest, goes back to a shorter one where two neighbours aren't
compatible - where the merges in order of rank would have joined them otherwise - and marks positions
that lead nowhere, so that each is tried once. The result equals that of merging pairs in order of rank.
``decode`` cuts the bytes of all tokens out of one string by a table of offsets.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; repeated doc_ids give a row each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame

from ..session import spread

TOKENIZERS = os.environ.get("PALIMPSEST_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how these vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 1 << 18


class BytePairs:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        """ranks: lines of a token in base 64 and its rank, in order of rank."""
        import ahocorasick
        import regex

        tokens = [b""] * len(lines := ranks.split(b"\n")[: ranks.count(b"\n") + 1])
        for line in lines:
            if line:
                t, r = line.split()
                tokens[int(r)] = base64.b64decode(t)
        while not tokens[-1]:
            tokens.pop()
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            self.halves.append(self._split(i, t))
        self.compatible.clear()
        self.cache: dict[str, list[int]] = {}
        self.offsets = [0, *accumulate(self.lengths)]
        self.bytes = b"".join(tokens)

    def _split(self, i: int, t: bytes) -> tuple[int, int]:
        """The pair of earlier tokens whose merge makes token i; (i, i) for one that no merge makes."""
        for cut in range(len(t) - 1, 0, -1):
            a, b = self.rank.get(t[:cut], i), self.rank.get(t[cut:], i)
            if a < i and b < i and self._fits(a, b):
                self.merged[a, b] = i
                return a, b
        return i, i

    def _fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when the pairs of their bytes are merged in order of rank: no pair
        of parts that touch at the seam has a merge that comes before the merges that made a and b."""
        below = 1 << 62
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < below:
                return False
            if a > b:
                below, a = a, self.halves[a][1]
                if a == below:
                    below, b = b + 1, self.halves[b][0]
                    if b + 1 == below:
                        return True
            else:
                below, b = b + 1, self.halves[b][0]
                if b + 1 == below:
                    below, a = a, self.halves[a][1]
                    if a == below:
                        return True

    def fits(self, a: int, b: int) -> bool:
        ok = self.compatible.get((a, b))
        if ok is None:
            if len(self.compatible) > 4 * CACHE:
                self.compatible.clear()
            ok = self.compatible[a, b] = self._fits(a, b)
        return ok

    def piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n, lengths, fits = len(data), self.lengths, self.fits
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, t in self.automaton.iter(data.decode("latin-1")):
            starts[end + 1 - lengths[t]].append(t)  # shorter ones end earlier: the longest is the last
        out: list[int] = []
        left = [len(s) for s in starts]  # tokens of each position that are still untried
        dead = bytearray(n + 1)
        at = 0
        while at < n:
            here, last = starts[at], out[-1] if out else -1
            while left[at]:
                left[at] -= 1
                t = here[left[at]]
                end = at + lengths[t]
                if not dead[end] and (last < 0 or fits(last, t)):
                    out.append(t)
                    at = end
                    break
            else:
                if not out:
                    raise ValueError("no encoding")
                dead[at] = 1
                left[at] = len(here)
                at -= lengths[out.pop()]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, cache = self.cache.get, self.cache
        for w in self.findall(text):
            ids = get(w)
            if ids is None:
                ids = self.piece(w.encode())
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        o, b = self.offsets, self.bytes
        return b"".join([b[o[i] : o[i + 1]] for i in ids]).decode()


_READY: dict[int, BytePairs] = {}


def ready(ranks: bytes) -> BytePairs:
    """The encoder of these ranks, made once in each worker."""
    k = hash(ranks)
    if k not in _READY:
        _READY[k] = BytePairs(ranks)
    return _READY[k]


def encode_texts(df: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids: array<int>) of every row. The vocabulary, a file of fixed size, goes to the executors
    from the driver."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken").read_bytes())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = ready(ranks.value).encode
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                flat, ends = [], [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat += encode(t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids], [key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"{key} bigint, ids array<int>")
