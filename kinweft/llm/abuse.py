"""Abusive, hateful and sexual content: a score for each document, and rates per source.

Method: FTRL-proximal logistic regression over hashed word n-grams and skip-grams, with
per-coordinate rates and L1 sparsity; the few weights that are not zero are broadcast. The model
is fitted on the driver on a bounded sample of labelled rows (``MAX_LABELS``). Documents are then
scored whole, utterance by utterance, where they are read: the score of a document is that of
its worst utterance, so that a long text cannot hide one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.spread import spread
from kinweft.llm.words import plain as unmarked
from kinweft.scratch import Scratch
from kinweft.session import plain

BITS = 20
MAX_LABELS = 200_000
WINDOW, STEP = 12, 4
THRESHOLD = 0.45
#: A shape of utterance that one document in so many has is usual, unless the labels condemn it.
USUAL_IN = 500
CONDEMNED = 0.75
MOST_PULL = 4.0
#: Words and utterances whose reading and score a worker remembers.
REMEMBERED = 200_000
#: Steps of an epoch: of more examples, several make one step. Utterances that are scored at once.
MAX_STEPS, BLOCK = 4_000, 20_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

# Letters of other scripts that look like Latin ones, and digits and signs used as letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαενικρτυ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHoaevikptu")
SIGNS = str.maketrans("013457$@!", "oieastsai")

_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E])
_CJK = r"぀-ヿ㐀-鿿ｦ-ﾟ"
_UTTERANCE = re.compile(r"(?<=[.!?…。！？])[\"'”»)\]]*\s+|(?<=[。！？])|\n\s*\n|\n-{2,}[ \t]*\n")
_STARRED = re.compile(r"(?<![\w*])(\*{1,3})(?=\S)([^*\n]+?)\1(?![\w*])")
_LONE = re.compile(r"(?<=\S)[ \t]+[.·*~_|>-]+[ \t]+(?=\S)")
_QUOTED = re.compile(r"^[ \t]*[>|]+", re.M)
_SPACED = re.compile(rf"(?<![\w])(?:[^\W\d_](?P<s>[-_.·*~])){{2,}}[^\W\d_](?![\w])|(?<![^\W_])(?:[^\W\d_] ){{3,}}[^\W\d_](?![\w])|[{_CJK}](?:[.・·\-_*~][{_CJK}]){{2,}}")
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}](?:[^\s.,;:?\"“”«»()\[\]{{}}<>|{_CJK}]*[\w*#$@])?")
_KANA, _HAN, _DIGITS = re.compile(r"[ァ-ヺー]+"), re.compile(r"[぀-ゟ㐀-鿿]"), re.compile(r"\d+(?:[.:,]\d+)*")
_NUMBER = re.compile(r"^[\d.,:]+$")
_RUN = re.compile(r"(.)\1+")
_WORDISH = re.compile(r"[^\w*#]")
_LATIN = re.compile("[A-Za-z]")
#: What any of the spaced-out words has: three single letters with one mark or blank between them.
_LETTERS = re.compile(rf"(?<![^\W_])[^\W\d_][-_.·*~ ][^\W\d_][-_.·*~ ][^\W\d_]|[{_CJK}][.・·\-_*~][{_CJK}]")


def utterances(text: str) -> list[str]:
    """The utterances of a text: up to a full stop or an empty line; wrapped lines go on."""
    text = _LONE.sub(" ", _QUOTED.sub("", _STARRED.sub(r"\2", unmarked(text)).replace("\r\n", "\n").replace("\r", "\n")))
    return [u for u in _UTTERANCE.split(text) if u and not u.isspace()]


def meant(utterance: str) -> list[str]:
    """The words of an utterance with look-alikes, signs, spacing and stretched letters undone."""
    t = utterance
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t.translate(_INVISIBLE))
        if _LATIN.search(t):
            t = t.translate(LOOKALIKES)
    if _LETTERS.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[-_.·・*~ ]", "", m[0]), t.replace("_", " ") if " _" in t else t)
    return [w for token in _TOKEN.findall(t) for w in _said(token)]


@lru_cache(maxsize=REMEMBERED)
def _said(w: str) -> tuple[str, ...]:
    """The words that one token stands for."""
    if _NUMBER.match(w):
        return ("0",)
    if any(c.isdigit() or c in "$@!" for c in w) and sum(c.isalpha() or c in "$@" for c in w) >= 1 and not re.match(r"^\d+[a-z]{1,2}$", w):
        w = w.translate(SIGNS)
    w = unicodedata.normalize("NFKD", w)
    w = "".join(c for c in w if not unicodedata.combining(c)).casefold()
    parts = [_WORDISH.sub("", part) for part in re.split(r"['’\-/]", w)]
    return tuple(p if "*" in p or "#" in p else _RUN.sub(r"\1", p) for p in parts if p)


class Speller:
    """Known words, by which hidden and mistyped forms are read: one letter off, or letters blotted out."""

    def __init__(self, counts: Counter):
        self.known = {w for w in counts if not ("*" in w or "#" in w)}
        near: dict[str, list[str]] = {}
        blot: dict[tuple[str, str, int], list[str]] = {}
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if w not in self.known:
                continue
            if len(w) >= 5:
                for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    near.setdefault(k, []).append(w)
            if len(w) >= 3:
                blot.setdefault((w[0], w[-1]), []).append(w)
        self.near, self.blot = near, blot

    def read(self, w: str) -> str:
        if w in self.known:
            return w
        if "*" in w or "#" in w:
            fits = re.compile("".join("." if c in "*#" else re.escape(c) for c in w))
            first, last = w[0], w[-1]
            found = [k for k in self.blot.get((first, last), ()) if abs(len(k) - len(w)) <= 1 and (fits.fullmatch(k) or fits.fullmatch(_unrun(k, len(w))))]
            return found[0] if found else w
        if len(w) >= 5:
            tries = [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]
            for t in tries:
                for k in self.near.get(t, ()):
                    if k[0] == w[0] and one_off(k, w):
                        return k
        return w


def _unrun(w: str, n: int) -> str:
    """w with one letter doubled, where that gives length n (runs are single in known words)."""
    return w if len(w) >= n else w[: len(w) // 2] + w[len(w) // 2] + w[len(w) // 2 :]


def one_off(a: str, b: str) -> bool:
    """One letter changed, added, dropped, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


@lru_cache(maxsize=REMEMBERED)
def _digest(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def features(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): hashed words, pairs, triples, and pairs over one or two words left out, each once in a row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter((_digest(w) for t in texts for w in t), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words from here to the end of the row
    rows, grams = [row], [word]
    for gap, kind in ((1, 1), (2, 2), (3, 3)):
        at = np.flatnonzero(left > gap)
        rows.append(row[at])
        grams.append(word[at] * _MIX[0] + word[at + gap] * _MIX[1] + np.uint64(kind))
    at = np.flatnonzero(left > 2)
    rows.append(row[at])
    grams.append(word[at] * _MIX[0] + word[at + 1] * _MIX[1] + word[at + 2] * _MIX[2])
    g = np.concatenate(grams)
    g = (g ^ (g >> np.uint64(29))) * _MIX[0]
    key = np.sort((np.concatenate(rows) << BITS) | (g >> np.uint64(64 - BITS)).astype(np.int64))
    key = key[np.diff(key, prepend=-1) != 0]
    return key >> BITS, key & ((1 << BITS) - 1)


class Ftrl:
    """Logistic regression by FTRL-proximal, with per-coordinate rates and L1."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.4, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias = 0.0

    def weights(self, x: np.ndarray) -> np.ndarray:
        z, n = self.z[x], self.n[x]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, row: np.ndarray, x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> None:
        """One step over the examples y, whose features are (row, x)."""
        size = np.bincount(row, minlength=len(y))
        value = 1 / np.sqrt(np.maximum(size, 1))
        k, at = np.unique(x, return_inverse=True)
        w = self.weights(k)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(y)) * value + self.bias, -30, 30)))
        each = (p - y) * importance
        g = np.bincount(at, (each * value)[row], len(k))
        sigma = (np.sqrt(self.n[k] + g * g) - np.sqrt(self.n[k])) / self.alpha
        self.z[k] += g - sigma * w
        self.n[k] += g * g
        self.bias -= 0.02 * each.sum()

    def all_weights(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        at = np.flatnonzero(self.n)
        out[at] = self.weights(at)
        return out


class Model:
    """The weights, and the words they were learned from."""

    def __init__(self, weights: np.ndarray, bias: float, speller: Speller, seen: set[str]):
        self.weights, self.bias, self.speller, self.seen = weights, bias, speller, seen
        self._read: dict[str, str] = {}
        self._scores: dict[str, float] = {}

    def __getstate__(self) -> dict:
        # Only the weights that are not zero travel.
        at = np.flatnonzero(self.weights)
        return self.__dict__ | {"weights": (at.astype(np.int32), self.weights[at]), "_read": {}, "_scores": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        at, w = self.weights
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[at] = w

    def read(self, w: str) -> str:
        """A word as the model knows it; all words that it has never seen become one."""
        if w not in self._read:
            if len(self._read) > REMEMBERED:
                self._read.clear()
            r = w if w in self.seen else self.speller.read(w)
            self._read[w] = r if r in self.seen else "·"
        return self._read[w]

    def windows(self, ws: list[str]) -> Iterator[list[str]]:
        """All words of an utterance, or where it is long, overlapping parts of it."""
        if len(ws) <= WINDOW + STEP:
            yield ws
        else:
            for i in range(0, len(ws) - WINDOW + STEP, STEP):
                yield ws[i : i + WINDOW]

    def score_words(self, texts: list[list[str]]) -> np.ndarray:
        """The score of each list of words; 0 for empty ones."""
        row, x = features(texts)
        size = np.bincount(row, minlength=len(texts))
        s = np.bincount(row, self.weights[x], len(texts)) / np.sqrt(np.maximum(size, 1)) + self.bias
        return np.where(size > 0, 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0)

    def worst_windows(self, utterances_: list[list[list[str]]]) -> list[list[str]]:
        """Of each list of utterances the window that scores highest."""
        parts = [[v for u in us for v in self.windows(u)] for us in utterances_]
        s = iter(self.score_words([v for vs in parts for v in vs]).tolist())
        return [max(vs, key=lambda v: next(s)) for vs in parts]

    def score(self, text: str | None) -> tuple[float, int]:
        worst, over = self.score_texts([text])
        return float(worst[0]), int(over[0])

    def score_texts(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text's worst utterance, and how many of its utterances reach the threshold."""
        split = [utterances(t) if t else [] for t in texts]
        if len(self._scores) > REMEMBERED:
            self._scores.clear()
        new = [u for u in dict.fromkeys(u for us in split for u in us) if u not in self._scores]
        for k in range(0, len(new), BLOCK):
            block = new[k : k + BLOCK]
            parts = [list(self.windows([self.read(w) for w in meant(u)])) for u in block]
            ends = np.cumsum([0, *map(len, parts)])
            s = self.score_words([v for vs in parts for v in vs])
            self._scores.update(zip(block, np.maximum.reduceat(s, ends[:-1]).tolist()))
        got = [[self._scores[u] for u in us] for us in split]
        return np.array([max(g, default=0.0) for g in got], float), np.array([sum(x >= THRESHOLD for x in g) for g in got], np.int64)


def fit(rows: list[tuple[str | None, int | None]], usual: list[str] | None = None, epochs: int = 12, rounds: int = 3, seed: int = 7) -> Model:
    """A model from (text, flagged) rows; null labels and texts are left out.

    A flagged text holds at least one bad utterance, not only such: after the first round its
    worst utterance stands for it. usual are utterances of the corpus taken as clean.
    """
    split = [(utterances(t), int(y)) for t, y in rows if t and y is not None and y == y]
    counts = Counter(w for us, _ in split for u in us for w in meant(u))
    speller = Speller(counts)
    read = lambda u: [speller.read(w) for w in meant(u)]
    known = {shape(u) for u in usual or ()} | {shape(u) for us, y in split if not y for u in us}
    negative = [w for w in [read(u) for us, y in split if not y for u in us] + [read(u) for u in usual or ()] if w]
    # Of a flagged text, utterances of a shape known as clean are no candidates, unless all are.
    flagged = [[w for w in ([read(u) for u in us if shape(u) not in known] or [read(u) for u in us]) if w] for us, y in split if y]
    flagged = [us for us in flagged if us]
    rng = np.random.default_rng(seed)
    positive = [[w for u in us for w in u] for us in flagged]
    seen = {w for part in (*flagged, negative) for u in part for w in u}
    model = Model(np.zeros(1 << BITS, np.float32), 0.0, speller, seen)
    for _ in range(rounds):
        ftrl = Ftrl()
        n, y = len(positive) + len(negative), np.repeat([1.0, 0.0], [len(positive), len(negative)])
        row, x = features(positive + negative)
        first = np.searchsorted(row, np.arange(n + 1))
        importance = np.where(y > 0, min(MOST_PULL, max(1.0, len(negative) / max(1, len(positive)))), 1.0)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(n), min(n, MAX_STEPS)) if n else ():
                sizes = first[part + 1] - first[part]
                own = np.repeat(np.arange(len(part)), sizes)
                ftrl.learn(own, x[np.concatenate([np.arange(first[k], first[k + 1]) for k in part])], y[part], importance[part])
        model = Model(ftrl.all_weights(), ftrl.bias, speller, seen)
        positive = model.worst_windows(flagged)
    return model


def shape(utterance: str) -> str:
    """An utterance with its names and numbers left open, for counting how usual it is."""
    out: list[str] = []
    for k, w in enumerate(_KANA.sub("N", _DIGITS.sub("0", utterance)).split()):
        bare = w.strip(".,;:!?()[]\"'“”«»<>")
        named = bool(bare) and not _HAN.search(bare) and (bare[0].isupper() and k > 0 or any(c.isdigit() for c in bare))
        if not (named and out and out[-1] == "N"):
            out.append("N" if named else bare.lower())
    return " ".join(out)


def _shapes():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            count: Counter[str] = Counter()
            example: dict[str, str] = {}
            for t in b["text"]:
                digest = xxhash.xxh3_64_intdigest(t or "")
                if digest in seen:
                    continue
                seen.add(digest)
                for s, u in {shape(u): u for u in utterances(t or "")}.items():
                    count[s] += 1
                    if s not in example or u < example[s]:
                        example[s] = u
            rows = [(s, n, example[s]) for s, n in count.items()]
            yield plain(pd.DataFrame([*rows, (None, len(b), None)], columns=["shape", "n", "example"]))

    return run


def usual_utterances(docs: DataFrame, model: Model) -> list[str]:
    """One utterance of each shape that one document in ``USUAL_IN`` has and the model does not condemn.

    Shapes are counted over all documents in one pass, in batches before the shuffle; copies of a
    text count once in each partition, so that a text sent again and again is not usual by that.
    So many documents to a shape bound how many there are, whatever the size of the corpus.
    """
    counted = docs.mapInPandas(_shapes(), "shape string, n bigint, example string").groupBy("shape").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
    counted = Scratch(docs.sparkSession, "shapes").write(counted, "shapes")
    total = counted.where("shape is null").select("n").collect()
    least = max(5, (total[0]["n"] if total else 0) // USUAL_IN)
    found = [r["example"] for r in counted.where(F.col("shape").isNotNull() & (F.col("n") >= least)).orderBy("shape").toLocalIterator()]
    scores, _ = model.score_texts(found)
    return [u for u, s in zip(found, scores) if s < CONDEMNED]


def labelled(labels: DataFrame, text: str = "text", flagged: str = "flagged") -> list[tuple[str, int]]:
    """At most ``MAX_LABELS`` labelled rows, chosen by hash, in a fixed order; repeated rows once."""
    rows = labels.select(F.col(text).alias("t"), F.col(flagged).cast("int").alias("y")).where("t is not null and y is not null").distinct()
    got = rows.orderBy(F.xxhash64("t", "y"), "t", "y").limit(MAX_LABELS).collect()
    return [(r["t"], r["y"]) for r in got]


def score_documents(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score, n_flagged, flagged) for each document.

    score is that of the worst utterance (0 for null, empty and blank texts), n_flagged counts the
    utterances at or over ``THRESHOLD``, and flagged says whether there is one. Repeated documents
    each get a row. Without labelled rows every score is 0 and nothing is flagged. Columns outside
    keep are dropped, so clashing names do no harm.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), *keep, F.col(text).alias("text")))
    rows = labelled(labels)
    if not rows:
        return docs.select("doc_id", *keep, F.lit(0.0).alias("score"), F.lit(0).alias("n_flagged"), F.lit(False).alias("flagged"))
    model = fit(rows)
    model = fit(rows, usual_utterances(docs.select("text"), model))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,n:int>")
    def score(texts: pd.Series) -> pd.DataFrame:
        worst, over = shared.value.score_texts(texts)
        return pd.DataFrame({"score": worst, "n": over})

    return docs.select("doc_id", *keep, score("text").alias("x")).select("doc_id", *keep, F.col("x.score").alias("score"), F.col("x.n").alias("n_flagged"), (F.col("x.n") > 0).alias("flagged"))
