"""A corpus as token ids of a public byte-level BPE vocabulary.

Method: pair occurrence index. The distinct pieces of a batch of texts lie behind one another as
byte symbols; an index maps each mergeable pair to all its positions. Ranks with positions are
applied in ascending order, each to all its positions at once, and each merge updates the lists
of the two pairs it makes. A rank only makes pairs of higher rank, so one pass is the same as
merging piece by piece. Texts are encoded where they are read; nothing is shuffled but to fill
idle cores. The vocabulary (some 50,000 entries) is read on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.spread import spread

#: The pattern that splits text into pieces: a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of pieces whose ids a worker remembers.
KNOWN_CHARS = 4_000_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    return os.path.join(os.environ.get("KINWEFT_TOKENIZERS", "/opt/tokenizers"), name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """merges: (left id, right id) -> (rank, merged id); base: the id of each byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = [ids[c] for c in byte_letters()]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        back = {c: b for b, c in enumerate(byte_letters())}
        self._bytes = {i: t for t, i in ids.items()}
        self._back = back

    def decode(self, ids: Iterable[int]) -> str:
        return bytes(self._back[c] for i in ids for c in self._bytes[i]).decode("utf-8", errors="replace")

    def __getstate__(self) -> dict:
        return {"base": self.base, "merges": self.merges}


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.base, self.merges = vocabulary.base, vocabulary.merges
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.size = 0

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        if self.size > KNOWN_CHARS:
            self.known, self.size = {}, 0
        new = list({p for ps in pieces for p in ps if p not in self.known})
        self.known.update(zip(new, self.merge(new)))
        self.size += sum(map(len, new))
        return [list(chain.from_iterable(map(self.known.__getitem__, ps))) for ps in pieces]

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece, by one pass over the pair occurrence index of all of them."""
        sym: list[int] = []
        starts: list[int] = []
        for p in pieces:
            starts.append(len(sym))
            sym.extend(map(self.base.__getitem__, p.encode("utf-8")))
        n = len(sym)
        starts.append(n)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for a in starts[:-1]:
            if a < n:
                prv[a] = -1
        for b in starts[1:]:
            if b > 0:
                nxt[b - 1] = -1
        merges, where, active = self.merges, {}, []
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                pair = (sym[i], sym[j])
                if pair in where:
                    where[pair].append(i)
                elif pair in merges:
                    where[pair] = [i]
                    active.append((merges[pair][0], pair))
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            left, right = pair
            made = merges[pair][1]
            for i in sorted(where.pop(pair)):
                j = nxt[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue  # an earlier merge took one of the two
                k = nxt[j]
                sym[i], sym[j], nxt[i] = made, -1, k
                if k >= 0:
                    prv[k] = i
                    new = (made, sym[k])
                    if new in where:
                        where[new].append(i)
                    elif new in merges:
                        where[new] = [i]
                        heapq.heappush(active, (merges[new][0], new))
                h = prv[i]
                if h >= 0:
                    new = (sym[h], made)
                    if new in where:
                        where[new].append(h)
                    elif new in merges:
                        where[new] = [h]
                        heapq.heappush(active, (merges[new][0], new))
        return [[s for s in sym[a:b] if s >= 0] for a, b in zip(starts, starts[1:])]


def token_ids(documents: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """documents with the token ids of text in a column out (array of int), without special tokens.

    Null, empty and no text give an empty list; blank text has ids like any other. The names of
    special tokens within a text are ordinary text. A column of the name out is replaced; all
    other columns stay. Texts are encoded whole, however long.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary(path or vocabulary_path()))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            yield pd.Series([np.array(ids, np.int32) for ids in encoder.encode_batch(b)], dtype=object)

    return spread(documents).withColumn(out, encode(F.col(text)))
