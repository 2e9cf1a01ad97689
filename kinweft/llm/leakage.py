"""Passages of held-out test items in a corpus.

Method: the words of each shard of the corpus become an FM-index; the phrases of the items are
backward-searched through its wavelet ranks and located by sampled suffix positions; the places
of one item in one document are merged into spans. Where enough phrases of an item meet in a
document, the spans are aligned with the item's statements word by word, so that small changes do
not hide a passage and a text of like build with other facts does not count as one. The item is
aligned as a whole and each statement by itself at each of its places, so that neither another
order nor a second copy hides anything.

The corpus is read once for every ``BLOCK_CHARS`` of items, whole texts, without a shuffle of its
own; a shard holds at most ``SHARD_WORDS`` words of it in memory at a time.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.fmindex import FMIndex
from kinweft.llm.spread import spread
from kinweft.llm.words import words
from kinweft.scratch import Scratch

SHARD_WORDS = 400_000
#: Characters of items that are sent to the executors at once: some 100,000 items of the usual length.
BLOCK_CHARS = 40_000_000
PHRASE = 3
#: Phrases of an item, at different places of it, that a document must share before it is aligned.
LEAST_PHRASES = 3
#: The share of the words of an item's statements that makes a passage.
LEAST_SHARE = 0.27
#: A run of words that speaks for itself where no fact stands in the span.
LONG_RUN = 9
_SENTENCE = re.compile(r"(?<=[.?!。！？])\s+")
_QUESTION = re.compile(r"[?？]\W*$")
_ANSWER = re.compile(r"^\W*(?:answer|antwort|réponse|respuesta|答え)\W", re.I)
SCHEMA = "doc_id bigint, item_id bigint, share double, spans array<struct<start:int,end:int>>"


class Usage:
    """How often sentences, words and phrases stand in all the test items, whatever block they come in.

    Kept as counts of hashes, so that it stays small beside the items.
    """

    def __init__(self, rows: Iterable[tuple[int, str | None]]):
        self.sentences: Counter[int] = Counter()
        for _, t in rows:
            self.sentences.update({_number(s) for s in _SENTENCE.split(t or "")})
        self.words: Counter[str] = Counter()
        self.phrases: Counter[int] = Counter()
        self.n_items = self.n_statements = 0

    def statements(self, text: str) -> list[list[str]]:
        """The words of the item's own sentences, without questions and answers."""
        own = [words(s) for s in _SENTENCE.split(text) if not (_QUESTION.search(s) or _ANSWER.match(s) or self.sentences[_number(s)] > 1)]
        return [w for w in own if w]

    def count(self, rows: Iterable[tuple[int, str | None]]) -> Usage:
        for _, t in rows:
            own = self.statements(t) if t and t.strip() else []
            if own:
                self.n_items += 1
                self.n_statements += len(own)
                self.words.update(w for s in own for w in set(s))
                flat = [w for s in own for w in s]
                self.phrases.update({_number(" ".join(flat[j : j + PHRASE])) for j in range(len(flat) - PHRASE + 1)})
        return self

    def rare(self, word: str) -> bool:
        return self.words[word] <= max(3, self.n_statements // 200)

    def telling(self, phrase: tuple[str, ...]) -> bool:
        """A phrase that many items share says nothing by itself; its words still count when aligned."""
        return self.phrases[_number(" ".join(phrase))] <= max(3, self.n_items // 100)


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Items:
    """The statements of a block of test items, their phrases and their facts."""

    def __init__(self, rows: list[tuple[int, str | None]], usage: Usage | None = None):
        usage = usage or Usage(rows).count(rows)
        split = {i: usage.statements(t) for i, t in rows if t and t.strip()}
        self.statements: dict[int, list[list[str]]] = {i: own for i, own in split.items() if own}
        vocabulary = {w for v in self.statements.values() for s in v for w in s}
        self.facts = {w for w in vocabulary if usage.rare(w) and not w.isdigit()}
        self.number = {w: k + 2 for k, w in enumerate(sorted(vocabulary))}
        self.flat = {i: [w for s in v for w in s] for i, v in self.statements.items()}
        at: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.flat.items():
            for j in range(len(w) - PHRASE + 1):
                at[tuple(w[j : j + PHRASE])].append((i, j))
        self.phrases = {p: v for p, v in at.items() if usage.telling(p)}
        self.table = np.array([[self.number[w] for w in p] for p in self.phrases], np.int64).reshape(-1, PHRASE)
        self.places = list(self.phrases.values())


def align(doc: list[str], item: list[list[str]], facts: set[str]) -> list[tuple[int, list[int], int, int]]:
    """(statement, its words' places in the item, start, end) of what doc carries of the item in its order."""
    flat = [w for s in item for w in s]
    blocks = [b for b in SequenceMatcher(None, doc, flat, autojunk=False).get_matching_blocks() if b.size]
    got: dict[int, int] = {b.b + k: b.a + k for b in blocks for k in range(b.size) if b.size > 1 or flat[b.b] in facts or _between(b, blocks)}
    out, start = [], 0
    for k, s in enumerate(item):
        mine = [j for j in range(start, start + len(s)) if j in got]
        start += len(s)
        if len(mine) < 3:
            continue
        inside = range(mine[0], mine[-1] + 1)
        named = [j for j in inside if flat[j] in facts]
        held = sum(j in got or _misspelt(j, flat[j], got, doc) for j in named)
        run = max(len(list(g)) for g in _runs(mine, got))
        if len(mine) >= 0.5 * len(inside) and (2 * held > len(named) if named else run >= LONG_RUN):
            out.append((k, mine, got[mine[0]], got[mine[-1]] + 1))
    return out


def carried(doc: list[str], hits: set[tuple[int, int]], item: list[list[str]], facts: set[str]) -> tuple[float, list[tuple[int, int]]]:
    """The share of the item's words that doc carries, each counted once, and all spans; hits are (place in doc, place in item).

    A passage of the document stands for one statement, the one with most of its words there.
    """
    n = sum(map(len, item))
    low, high = max(0, min(p for p, _ in hits) - 2 * n), min(len(doc), max(p for p, _ in hits) + 2 * n)
    found = [(k, mine, low + x, low + y) for k, mine, x, y in align(doc[low:high], item, facts)]
    start = 0
    for k, s in enumerate(item):
        slack = len(s) // 2 + PHRASE
        begins = sorted({p - (j - start) for p, j in hits if start - PHRASE < j < start + len(s)})
        for a, b in _places(begins, slack):
            a, b = max(0, a - slack), min(len(doc), b + len(s) + slack)
            found += [(k, [start + j for j in mine], a + x, a + y) for _, mine, x, y in align(doc[a:b], [s], facts)]
        start += len(s)
    held: set[int] = set()
    spans: list[tuple[int, int]] = []
    taken: dict[int, int] = {}
    for k, mine, a, b in sorted(found, key=lambda f: (-len(f[1]), f[0], f[2])):
        if 2 * sum(taken.get(p, k) != k for p in range(a, b)) < b - a:
            held.update(mine)
            spans.append((a, b))
            for p in range(a, b):
                taken.setdefault(p, k)
    return len(held) / n, spans


def _places(begins: list[int], slack: int) -> Iterator[tuple[int, int]]:
    """Sorted beginnings in groups, each within slack of its first."""
    k = 0
    while k < len(begins):
        first = begins[k]
        while k < len(begins) and begins[k] <= first + slack:
            last = begins[k]
            k += 1
        yield first, last


def _between(b, blocks) -> bool:
    """A lone word counts where the words around it are matched close by."""
    return any(o is not b and o.size > 1 and abs(o.a - b.a) <= 6 + o.size and abs(o.b - b.b) <= 6 + o.size for o in blocks)


def _runs(mine: list[int], got: dict[int, int]) -> Iterator[list[int]]:
    run = [mine[0]]
    for a, b in pairwise(mine):
        if b == a + 1 and got[b] == got[a] + 1:
            run.append(b)
        else:
            yield run
            run = [b]
    yield run


def _misspelt(j: int, word: str, got: dict[int, int], doc: list[str]) -> bool:
    """Whether the document has word with one or two letters changed where it should stand."""
    before = next((got[k] for k in range(j - 1, j - 4, -1) if k in got), None)
    after = next((got[k] for k in range(j + 1, j + 4) if k in got), None)
    a = before + 1 if before is not None else after - 3 if after is not None else 0
    b = after if after is not None else a + 3
    return any(SequenceMatcher(None, word, w, autojunk=False).ratio() >= 0.75 for w in doc[max(0, a) : min(b, a + 4)])


def merged(spans: list[tuple[int, int]], gap: int = 3) -> list[tuple[int, int]]:
    """Spans in order, those that touch or nearly touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_shard(docs: list[tuple[int, list[str]]], items: Items) -> Iterator[tuple]:
    """(doc_id, item_id, share, spans) for a shard of (doc_id, words)."""
    if not len(items.table):
        return
    # Words that no item has become one symbol, and a run of them one place: no phrase has any.
    seq, doc_of, pos_of = [], [], []
    for d, (_, ws) in enumerate(docs):
        other = True
        for p, w in enumerate(ws):
            n = items.number.get(w)
            if n is not None or not other:
                seq.append(n or 1)
                doc_of.append(d)
                pos_of.append(p)
            other = n is None
        seq.append(1)
        doc_of.append(d)
        pos_of.append(len(ws))
    if not seq:
        return
    index = FMIndex(np.array(seq), len(items.number) + 2)
    low, high = index.search(items.table)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    where = index.locate(rows)
    doc_at, pos_at = np.array(doc_of), np.array(pos_of)
    seen: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for k, t in zip(which.tolist(), where.tolist()):
        for i, j in items.places[k]:
            seen[int(doc_at[t]), i].add((int(pos_at[t]), j))
    for (d, i), hits in seen.items():
        if len({j for _, j in hits}) < min(LEAST_PHRASES, len(items.flat[i]) - PHRASE + 1):
            continue
        share, spans = carried(docs[d][1], hits, items.statements[i], items.facts)
        if share >= LEAST_SHARE:
            yield docs[d][0], i, share, merged(spans)


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, share, spans): the documents that carry a passage of a test item.

    share is the part of the words of the item's statements that the document carries; spans are
    the word positions [start, end) it carries them at, merged. Question and answer lines and
    sentences that several items have are no statements. Null, empty and blank texts carry
    nothing; repeated documents each get their rows; items are told apart by id, and a repeated
    item row counts once. Other columns are ignored, whatever their names. Without documents or
    items there are no rows.

    What is usual among the items is counted over all of them; block_chars bounds what is sent to
    the executors at once and changes no result.
    """
    docs = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    rows = Scratch(documents.sparkSession, "items").write(rows.orderBy("i"), "items").orderBy("i")
    stream = lambda: ((r["i"], r["t"]) for r in rows.toLocalIterator())
    usage = Usage(stream())
    usage.count(stream())
    out, block, size = None, [], 0
    for i, t in (*stream(), (None, None)):
        if i is None or size + len(t) > block_chars:
            sent = documents.sparkSession.sparkContext.broadcast(Items(block, usage))
            own = docs.mapInPandas(_searcher(sent), SCHEMA)
            out = own if out is None else out.unionByName(own)
            block, size = [], 0
        if i is not None:
            block.append((i, t))
            size += len(t)
    return out


def _searcher(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, shard, size = sent.value, [], 0
        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                ws = words(t)
                shard.append((int(d) if d == d else None, ws))
                size += len(ws) + 1
                if size >= SHARD_WORDS:
                    yield _frame(search_shard(shard, items))
                    shard, size = [], 0
        yield _frame(search_shard(shard, items))

    return run


def _frame(rows) -> pd.DataFrame:
    df = pd.DataFrame(list(rows), columns=["doc_id", "item_id", "share", "spans"])
    df["spans"] = pd.Series([[{"start": a, "end": b} for a, b in s] for s in df["spans"]], dtype=object)
    return df.astype({"doc_id": "Int64", "item_id": "Int64", "share": float})
