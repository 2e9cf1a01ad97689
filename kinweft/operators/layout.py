"""Ordering the rows of a layered layout: sweeps, swaps and crossing counts, one family at a time."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import groupby
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweft.scratch import Scratch
from kinweft.session import plain, tasks

#: Families of up to so many nodes are ordered in one task, larger ones by joins, with equal results.
ALONE = 10_000_000
#: Pieces of edges whose crossings are counted at once.
PIECES = 2_000_000
#: Over so many nodes a family is ordered as numbers, with equal results.
LARGE = 500
PASSES = 8


def inversions(values: list[int]) -> int:
    """Pairs out of order, equal ones not counted, by a Fenwick tree."""
    ranks = sorted(set(values))
    tree = [0] * (len(ranks) + 1)
    total = 0
    for seen, v in enumerate(values):
        r = bisect_left(ranks, v) + 1
        k, below = r, 0
        while k:
            below += tree[k]
            k -= k & -k
        total += seen - below
        k = r
        while k < len(tree):
            tree[k] += 1
            k += k & -k
    return total


def crossings(rows: dict[int, list[str]], edges: list[tuple[str, str]]) -> int:
    """Crossings of a layered drawing; an edge over several rows is cut at each, its place in between interpolated."""
    level = {n: g for g, ns in rows.items() for n in ns}
    place = {n: i / max(1, len(ns) - 1) for ns in rows.values() for i, n in enumerate(ns)}
    bands: dict[int, list[tuple[float, float]]] = {}
    for a, b in edges:
        if a not in level or b not in level or level[a] == level[b]:
            continue
        if level[a] > level[b]:
            a, b = b, a
        span = level[b] - level[a]
        at = lambda k: place[a] + (place[b] - place[a]) * k / span  # noqa: B023, E731
        for k in range(span):
            bands.setdefault(level[a] + k, []).append((at(k), at(k + 1)))
    total = 0
    for parts in bands.values():
        parts.sort()
        total += inversions([round(e * 1e7) for _, e in parts])
    return total




def sweep(rows: dict[int, list[str]], edges: list[tuple[str, str]], passes: int = 8) -> dict[int, list[str]]:
    """Rows reordered by barycentre and median in turn, down and up in turn; nodes without neighbours keep to the end."""
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    level = {n: g for g, ns in rows.items() for n in ns}
    best, least = rows, crossings(rows, edges)
    current = {g: list(ns) for g, ns in rows.items()}
    for k in range(passes):
        fixed = {n: i for ns in current.values() for i, n in enumerate(ns)}
        for g in sorted(current, reverse=bool(k % 2)):
            score = {}
            for n in current[g]:
                ps = [fixed[m] for m in near.get(n, ()) if m in level and (level[m] < g if k % 2 == 0 else level[m] > g)]
                score[n] = None if not ps else sum(ps) / len(ps) if k % 2 == 0 else median(ps)
            current[g] = sorted(current[g], key=lambda n: (score[n] is None, score[n] or 0, fixed[n]))  # noqa: B023
            fixed.update((n, i) for i, n in enumerate(current[g]))
        c = crossings(current, edges)
        if c < least:
            best, least = {g: list(ns) for g, ns in current.items()}, c
    return best


def swap_neighbours(rows: dict[int, list[str]], edges: list[tuple[str, str]], rounds: int = 2) -> dict[int, list[str]]:
    """Adjacent swaps that lower the crossings, row by row from the first, up to a number of rounds."""
    names = [n for g in sorted(rows) for n in rows[g]]
    at = {n: k for k, n in enumerate(names)}
    level = np.array([g for g in sorted(rows) for _ in rows[g]], np.int64)
    place = np.array([i for g in sorted(rows) for i in range(len(rows[g]))], np.int64)
    pairs = np.array([(at[a], at[b]) for a, b in edges if a in at and b in at], np.int64).reshape(-1, 2)
    place, _ = swap_by_number(level, place, pairs, rounds)
    return {g: [names[k] for k in sorted((at[n] for n in ns), key=place.__getitem__)] for g, ns in rows.items()}


def precedence(ids: list[str], before: list[tuple[str, str]]) -> list[str]:
    """ids in their order as far as the pairs (left, right) of before allow; those on a loop come last."""
    rank = {n: k for k, n in enumerate(ids)}
    after: dict[str, set[str]] = {n: set() for n in ids}
    for a, b in before:
        if a in rank and b in rank and a != b:
            after[a].add(b)
    waits = dict.fromkeys(ids, 0)
    for bs in after.values():
        for b in bs:
            waits[b] += 1
    ready = [rank[n] for n in ids if not waits[n]]
    heapify(ready)
    out = []
    while ready:
        n = ids[heappop(ready)]
        out.append(n)
        for b in after[n]:
            waits[b] -= 1
            if not waits[b]:
                heappush(ready, rank[b])
    done = set(out)
    return out + [n for n in ids if n not in done]


def couples(rows: dict[int, list[str]], pairs: list[tuple[str, str]], keep_order: bool = True) -> dict[int, list[str]]:
    """rows with the pairs (mother, father) side by side where that parts no pair placed before; with keep_order mothers stand left."""
    rows = {g: list(ns) for g, ns in rows.items()}
    level = {n: g for g, ns in rows.items() for n in ns}
    pairs = [(m, f) for m, f in pairs if level.get(m) is not None and level.get(m) == level.get(f) and m != f]
    if keep_order:
        rows = {g: precedence(ns, [p for p in pairs if level[p[0]] == g]) for g, ns in rows.items()}
    placed: dict[int, list[tuple[str, str]]] = {}
    for m, f in pairs:
        g = level[m]
        row = [n for n in rows[g] if n not in (m, f)]
        at = min(rows[g].index(m), rows[g].index(f))
        row[at:at] = [m, f]
        if keep_order:
            row = precedence(row, [p for p in pairs if level[p[0]] == g])
        where = {n: k for k, n in enumerate(row)}
        if all(where[b] == where[a] + 1 for a, b in [*placed.get(g, []), (m, f)]):
            rows[g] = row
            placed.setdefault(g, []).append((m, f))
    return rows


def focused_order(rows: dict[int, list[str]], edges: list[tuple[str, str]], pairs: list[tuple[str, str]], passes: int = PASSES) -> tuple[dict[int, list[str]], int, int]:
    """The best of the given rows, swept ones and ones with couples, mothers left of fathers throughout, with the crossings before and after.

    Fewest crossings win, then fewest broken couples, then the order given first.
    """
    before = crossings(rows, edges)
    level = {n: g for g, ns in rows.items() for n in ns}
    held = lambda r: {g: precedence(ns, [p for p in pairs if level.get(p[0]) == g]) for g, ns in r.items()}
    swept = sweep(rows, edges, passes)
    tries = [held(rows), held(swept), couples(rows, pairs), couples(swept, pairs)]
    apart = lambda r: sum(f != m for m, f in ((r[level[m]].index(m) + 1, r[level[f]].index(f)) for m, f in pairs if level.get(m) is not None and level.get(m) == level.get(f)))
    score = [(crossings(r, edges), apart(r), k) for k, r in enumerate(tries)]
    best = min(score)
    return tries[best[2]], before, best[0]


def optimise(rows: dict[int, list[str]], edges: list[tuple[str, str]]) -> tuple[dict[int, list[str]], int, int]:
    """The best of the given order, its sweeps and swaps, with the crossings before and after."""
    before = crossings(rows, edges)
    best = swap_neighbours(sweep(rows, edges, PASSES), edges)
    return best, before, crossings(best, edges)


def _inversions_within(group: np.ndarray, v: np.ndarray) -> int:
    """What ``inversions`` counts, summed over groups that lie together, bit by bit from the highest."""
    total = 0
    for bit in range(int(v.max()).bit_length() - 1 if len(v) else -1, -1, -1):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        if alone.any():
            group, v = group[~alone], v[~alone]
            new = np.concatenate([[True], group[1:] != group[:-1]])
        if not len(v):
            break
        first, g = np.flatnonzero(new), np.cumsum(new) - 1
        one = (v >> bit) & 1
        before = np.cumsum(one) - one
        before -= before[first][g]
        total += int(before[one == 0].sum())
        zeros = np.add.reduceat(1 - one, first)[g]
        at = np.where(one == 1, first[g] + zeros + before, np.arange(len(v)) - before)
        group_, v_ = np.empty_like(g), np.empty_like(v)
        group_[at], v_[at] = 2 * g + one, v
        group, v = group_, v_
    return total


def _crossings_by_number(level: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """``crossings`` of the edges from a to b, a in the earlier row, for the places of the nodes."""
    if not len(a):
        return 0
    la, lb, pa, pb = level[a], level[b], place[a], place[b]
    low, high = int(la.min()), int(lb.max())
    open_ = np.cumsum(np.bincount(la - low, minlength=high - low + 1) - np.bincount(lb - low, minlength=high - low + 1))[:-1]
    total, lo = 0, 0
    upto = np.cumsum(open_)
    while lo < len(open_):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECES, "right")))
        at = np.flatnonzero((la < low + hi) & (lb > low + lo))
        k0 = np.maximum(la[at], low + lo)
        n = np.minimum(lb[at], low + hi) - k0
        e = np.repeat(at, n)
        band = np.repeat(k0 - np.cumsum(n) + n, n) + np.arange(n.sum())
        k, span, rise = band - la[e], lb[e] - la[e], pb[e] - pa[e]
        start, end = pa[e] + rise * k / span, pa[e] + rise * (k + 1) / span
        order = np.lexsort((end, start, band))
        total += _inversions_within(band[order], np.rint(end[order] * 1e7).astype(np.int64))
        lo = hi
    return total


def sweep_by_number(level: np.ndarray, start: np.ndarray, pairs: np.ndarray, passes: int) -> tuple[np.ndarray, int, int]:
    """``sweep`` over arrays: the best place of each node in its row, with the crossings before and after.

    Nodes lie row by row; level and start are their rows and first places, pairs the nodes of each edge.
    """
    rows, first = np.unique(level, return_index=True)
    ends = [*first[1:].tolist(), len(level)]
    size = np.diff([*first.tolist(), len(level)])
    wide = np.repeat(np.maximum(1, size - 1), size)
    a, b = pairs[level[pairs[:, 0]] != level[pairs[:, 1]]].T
    a, b = np.where(level[a] < level[b], a, b), np.where(level[a] < level[b], b, a)
    count = lambda p: _crossings_by_number(level, p / wide, a, b)
    near = []
    for n, m in ((b, a), (a, b)):
        order = np.argsort(n, kind="stable")
        n, m = n[order], m[order]
        near.append((n, m, np.searchsorted(n, first).tolist(), np.searchsorted(n, ends).tolist()))
    now = start.astype(np.int64)
    best, least = now.copy(), count(now)
    before = least
    for k in range(passes):
        node, other, lo, hi = near[k % 2]
        for g in reversed(range(len(rows))) if k % 2 else range(len(rows)):
            r = slice(int(first[g]), ends[g])
            n, at = node[lo[g] : hi[g]] - r.start, now[other[lo[g] : hi[g]]]
            many = np.bincount(n, minlength=ends[g] - r.start)
            if k % 2 == 0:
                score = np.bincount(n, at, ends[g] - r.start) / np.maximum(many, 1)
            else:
                at = at[np.lexsort((at, n))]
                from_ = np.cumsum(many) - many
                has = many > 0
                score = np.zeros(len(many))
                score[has] = (at[(from_ + (many - 1) // 2)[has]] + at[(from_ + many // 2)[has]]) / 2
            order = np.lexsort((now[r], score, many == 0))
            moved = np.empty(len(order), np.int64)
            moved[order] = np.arange(len(order))
            now[r] = moved
        c = count(now)
        if c < least:
            best, least = now.copy(), c
    return best, before, least


def swap_by_number(level: np.ndarray, start: np.ndarray, pairs: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, int]:
    """The place of each node after the swaps of neighbours that lower the crossings, and how much these change.

    Nodes lie row by row; level and start are their rows and places, pairs the nodes of each edge. A
    swap moves the pieces of its nodes' edges by little, so that only pieces that start or end within
    that little can cross them otherwise than before: pieces lie in cells by where they start and end.
    """
    first = np.unique(level, return_index=True)[1]
    ends = [*first[1:].tolist(), len(level)]
    size = np.diff([*first.tolist(), len(level)])
    wide = np.repeat(np.maximum(1, size - 1), size)
    a, b = pairs[level[pairs[:, 0]] != level[pairs[:, 1]]].T
    if not len(a):
        return start.astype(np.int64), 0
    a, b = np.where(level[a] < level[b], a, b), np.where(level[a] < level[b], b, a)
    span = level[b] - level[a]
    base = np.cumsum(span) - span
    edge = np.repeat(np.arange(len(a)), span)
    k = np.arange(len(edge)) - base[edge]
    at = start / wide
    low, rise = at[a][edge], (at[b] - at[a])[edge]
    begin, end = low + rise * k / span[edge], np.rint((low + rise * (k + 1) / span[edge]) * 1e7).astype(np.int64)
    _, band = np.unique(level[a][edge] + k, return_inverse=True)
    many = np.bincount(band)
    cells, many_, cells_ = np.cumsum(many) - many, many.tolist(), (np.cumsum(many) - many).tolist()
    in_s = cells[band] + np.clip((begin * many[band]).astype(np.int64), 0, many[band] - 1)
    in_e = cells[band] + np.clip((end / 1e7 * many[band]).astype(np.int64), 0, many[band] - 1)
    plain_ = lambda kind, x: array(kind, np.ascontiguousarray(x, {"q": np.int64, "d": np.float64}[kind]).tobytes())
    lists = [tuple(plain_("q", x) for x in _chained(c)) for c in (in_s, in_e)]
    (head_s, next_s, _, cell_s), (head_e, next_e, _, cell_e) = lists
    starts, stops, bands = plain_("d", begin), plain_("q", end), plain_("q", band)
    lower, upper, spans, bases, at = plain_("q", a), plain_("q", b), plain_("q", span), plain_("q", base), plain_("d", at)
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    own, from_ = plain_("q", order % len(a)), np.searchsorted(np.concatenate([a, b])[order], np.arange(len(level) + 1)).tolist()

    def moved(u: int, x: int, to_u: float, to_x: float) -> dict[int, list[tuple[int, float, int]]]:
        out: dict[int, list[tuple[int, float, int]]] = {}
        for n, to in ((u, to_u), (x, to_x)):
            for e in own[from_[n] : from_[n + 1]]:
                p, far = (to, at[upper[e]]) if lower[e] == n else (at[lower[e]], to)
                rise, m, q = far - p, spans[e], bases[e]
                for k in range(m):
                    out.setdefault(bands[q + k], []).append((q + k, p + rise * k / m, round((p + rise * (k + 1) / m) * 1e7)))
        return out

    def change(b: int, pieces: list[tuple[int, float, int]]) -> int:
        mine = {p for p, _, _ in pieces}
        total, n, c0 = 0, many_[b], cells_[b]
        for p, s1, e1 in pieces:
            s0, e0 = starts[p], stops[p]
            lo, hi = (s0, s1) if s0 < s1 else (s1, s0)
            if s0 != s1:
                for c in range(c0 + max(0, min(n - 1, int(lo * n))), c0 + max(0, min(n - 1, int(hi * n))) + 1):
                    q = head_s[c]
                    while q >= 0:
                        s, e = starts[q], stops[q]
                        if lo <= s <= hi and q not in mine:
                            total += ((s1 < s and e1 > e) or (s1 > s and e1 < e)) - ((s0 < s and e0 > e) or (s0 > s and e0 < e))
                        q = next_s[q]
            if e0 != e1:
                low, high = (e0, e1) if e0 < e1 else (e1, e0)
                for c in range(c0 + max(0, min(n - 1, int(low / 1e7 * n))), c0 + max(0, min(n - 1, int(high / 1e7 * n))) + 1):
                    q = head_e[c]
                    while q >= 0:
                        s, e = starts[q], stops[q]
                        if low <= e <= high and q not in mine and (s0 == s1 or not lo <= s <= hi):
                            total += ((s1 < s and e1 > e) or (s1 > s and e1 < e)) - ((s0 < s and e0 > e) or (s0 > s and e0 < e))
                        q = next_e[q]
        if len(pieces) > 1:
            total += inversions([e for _, e in sorted((s, e) for _, s, e in pieces)]) - inversions([e for _, e in sorted((starts[p], stops[p]) for p in mine)])
        return total

    def move(p: int, to: int, head: array, next_: array, last: array, cell: array) -> None:
        if cell[p] == to:
            return
        before, after = last[p], next_[p]
        if before >= 0:
            next_[before] = after
        else:
            head[cell[p]] = after
        if after >= 0:
            last[after] = before
        last[p], next_[p], cell[p] = -1, head[to], to
        if head[to] >= 0:
            last[head[to]] = p
        head[to] = p

    gain = 0
    sorted_ = np.lexsort((start, level))
    rows = [sorted_[i:j].tolist() for i, j in zip(first.tolist(), ends)]
    for _ in range(rounds):
        better = False
        for row in rows:
            w = max(1, len(row) - 1)
            for i in range(len(row) - 1):
                u, x = row[i], row[i + 1]
                pieces = moved(u, x, (i + 1) / w, i / w)
                d = sum(change(b, ps) for b, ps in pieces.items())
                if d >= 0:
                    continue
                row[i], row[i + 1], at[u], at[x] = x, u, (i + 1) / w, i / w
                gain, better = gain + d, True
                for b, ps in pieces.items():
                    n, c0 = many_[b], cells_[b]
                    for p, s, e in ps:
                        starts[p], stops[p] = s, e
                        move(p, c0 + max(0, min(n - 1, int(s * n))), *lists[0])
                        move(p, c0 + max(0, min(n - 1, int(e / 1e7 * n))), *lists[1])
        if not better:
            break
    place = np.empty(len(level), np.int64)
    for row in rows:
        place[row] = np.arange(len(row))
    return place, gain


def _chained(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first of each cell, next and last of each piece, its cell), -1 for none."""
    order = np.argsort(cell, kind="stable")
    same = cell[order][1:] == cell[order][:-1]
    head, next_, last = (np.full(len(cell), -1, np.int64) for _ in range(3))
    next_[order[:-1][same]], last[order[1:][same]] = order[1:][same], order[:-1][same]
    new = np.concatenate([[True], ~same])
    head[cell[order][new]] = order[new]
    return head, next_, last, cell


def ordered_by_number(level: np.ndarray, start: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, int, int]:
    """``optimise`` over arrays: the best place of each node, with the crossings before and after."""
    best, before, after = sweep_by_number(level, start, pairs, PASSES)
    if after:
        best, gain = swap_by_number(level, best, pairs)
        after += gain
    return best, before, after


def _swaps(level: np.ndarray, start: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, int, int]:
    best, gain = swap_by_number(level, start, pairs)
    return best, 0, gain


def crossing_counts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(component, c): what ``crossings`` counts, for rows (component, generation, id, position) and links (component, p, id).

    Pairs out of order are counted bit by bit of the lower end: two ends differ first at one bit,
    and a window over the pieces with the same bits above it counts the ones before each zero.
    """
    size = F.count("*").over(Window.partitionBy("component", "generation"))
    end = lambda n, k: rows.select("component", F.col("id").alias(n), F.struct("generation", (F.col("position") / F.greatest(F.lit(1), size - 1)).alias("place")).alias(k))
    x = links.join(end("p", "a"), ["component", "p"]).join(end("id", "b"), ["component", "id"]).where("a.generation != b.generation")
    x = x.select("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).withColumn("span", F.expr("b.generation - a.generation"))
    x = x.withColumn("k", F.explode(F.expr("sequence(0, span - 1)")))
    x = x.select("component", F.expr("a.generation + k").alias("band"), F.expr("a.place + (b.place - a.place) * k / span").alias("s"), F.expr("a.place + (b.place - a.place) * (k + 1) / span").alias("e"))
    x = x.withColumn("v", F.rint(F.col("e") * 1e7).cast("bigint")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(23))))
    x = x.withColumn("above", F.expr("shiftright(v, bit + 1)")).withColumn("one", F.expr("shiftright(v, bit) & 1"))
    w = Window.partitionBy("component", "band", "bit", "above").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = x.withColumn("ones", F.sum("one").over(w)).where("one = 0").groupBy("component").agg(F.sum("ones").alias("c"))
    return rows.select("component").distinct().join(counted, "component", "left").fillna(0, ["c"])


def _swept(placed: DataFrame, edges: DataFrame, passes: int, store: Scratch) -> DataFrame:
    """``sweep`` for families of any size: each row is one join and one window over its neighbours' places."""
    gens = sorted(r["generation"] for r in placed.select("generation").distinct().collect())
    start = F.row_number().over(Window.partitionBy("component", "generation").orderBy("id")) - 1
    best = store.write(placed.select("component", "generation", "id", start.alias("position")), "rows")
    member = placed.select("component", "id", "generation")
    links = edges.select(F.col("subject").alias("p"), F.col("object").alias("id")).distinct().join(member, "id").join(member.select("component", F.col("id").alias("p"), F.col("generation").alias("gp")), ["component", "p"])
    links = store.write(links, "links")
    near = links.select("component", F.col("p").alias("id"), F.col("gp").alias("g"), F.col("id").alias("m"), F.col("generation").alias("gm"))
    near = store.write(near.unionByName(links.select("component", "id", F.col("generation").alias("g"), F.col("p").alias("m"), F.col("gp").alias("gm"))), "near")
    links = links.select("component", "p", "id")
    least = store.write(crossing_counts(best, links).withColumn("before", F.col("c")), "least")
    rows = {g: best.where(F.col("generation") == g) for g in gens}
    for k in range(passes):
        done: list[DataFrame] = []
        for g in reversed(gens) if k % 2 else gens:
            if done:
                fixed = reduce(DataFrame.unionByName, done).select("component", F.col("id").alias("m"), F.col("position").alias("at"))
                ps = near.where((F.col("g") == g) & (F.col("gm") > g if k % 2 else F.col("gm") < g)).join(fixed, ["component", "m"])
                score = ps.groupBy("component", "id").agg((F.median("at") if k % 2 else F.avg("at")).alias("score"))
                w = Window.partitionBy("component").orderBy(F.col("score").isNull(), "score", "position")
                row = rows[g].join(score, ["component", "id"], "left").select("component", "generation", "id", (F.row_number().over(w) - 1).alias("position"))
                rows[g] = store.write(row, f"row-{g}")
            done.append(rows[g])
        now = reduce(DataFrame.unionByName, rows.values())
        c = crossing_counts(now, links).withColumnRenamed("c", "new")
        least = store.write(least.join(c, "component").select("component", F.least("c", "new").alias("c"), "before", (F.col("new") < F.col("c")).alias("better")), "least")
        better = least.where("better").select("component")
        best = store.write(best.join(better, "component", "left_anti").unionByName(now.join(better, "component", "left_semi")), "rows")
    return best.join(least.select("component", "before", F.col("c").alias("after")), "component").select("component", "generation", "id", "position", "before", "after")


def _by_number(big: DataFrame, edges: DataFrame, store: Scratch, search=ordered_by_number) -> DataFrame:
    """search for families of many nodes: each goes as numbers to one task, in its order by id or at its positions."""
    start = F.col("position") if "position" in big.columns else F.row_number().over(Window.partitionBy("component", "generation").orderBy("id")) - 1
    num = store.write(big.select("component", "generation", "id", start.alias("position")).withColumn("k", F.monotonically_increasing_id()), "numbers")
    num = store.write(num.join(num.groupBy("component").agg(F.min("k").alias("family")), "component"), "families")
    end = lambda n, k: num.select("family", F.col("id").alias(n), F.col("k").alias(k))
    links = edges.select(F.col("subject").alias("p"), F.col("object").alias("c")).distinct().join(end("c", "b"), "c").join(end("p", "a"), ["family", "p"])
    rows = num.select("family", F.lit(0).alias("kind"), F.col("k").alias("a"), F.col("position").cast("bigint").alias("b"), "generation")
    rows = rows.unionByName(links.select("family", F.lit(1).alias("kind"), "a", "b", F.lit(0).alias("generation")))
    rows = rows.repartition(tasks(big.sparkSession), "family").sortWithinPartitions("family")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, "family"):
            n = pdf[pdf["kind"] == 0].sort_values(["generation", "b"])
            k, level = n["a"].to_numpy(), n["generation"].to_numpy().astype(np.int64)
            order = np.argsort(k)
            pairs = order[np.searchsorted(k, pdf[pdf["kind"] == 1][["a", "b"]].to_numpy(), sorter=order)]
            best, before, after = search(level, n["b"].to_numpy(), pairs)
            yield pd.DataFrame({"k": k, "position": best.astype(np.int32), "before": before, "after": after})

    got = store.write(rows.mapInPandas(run, "k bigint, position int, before bigint, after bigint"), "ordered")
    return num.drop("position", "family").join(got, "k").select("component", "generation", "id", "position", "before", "after")


def _whole(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each value of key, of batches that are sorted by it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for k, part in b.groupby(key):
            if held and held[0][key].iloc[0] != k:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def optimised_rows(placed: DataFrame, edges: DataFrame, most: int | None = None, alone: int = ALONE, named: int = LARGE) -> DataFrame:
    """(component, generation, id, position, before, after) for placed (component, generation, id) and (subject, object).

    Every family is ordered: those of up to alone nodes in one task each (over named nodes as
    numbers), larger ones by joins and windows, with the same result. Swaps follow one another, so
    that those of a family are always tried in one task. Only where most is given do families of more
    nodes keep their order by id and null crossings.
    """
    store = Scratch(placed.sparkSession, "layout")
    placed, edges = store.write(placed.select("component", "generation", "id"), "placed"), store.write(edges.select("subject", "object"), "edges")
    size = store.write(placed.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    sized = placed.join(size if most is None else size.where(F.col("n") <= most), "component")
    named = min(named, alone)
    single = sized.where("n = 1").select("component", "generation", "id", F.lit(0).alias("position"), F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("after"))
    small = sized.where((F.col("n") > 1) & (F.col("n") <= named))
    links = edges.select(F.col("subject").alias("p"), F.col("object").alias("id"))
    rows = small.select("component", "generation", "id").join(links, "id", "left").repartition(tasks(placed.sparkSession), "component").sortWithinPartitions("component")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = ((b[c].tolist() for c in ("component", "generation", "id", "p")) for b in batches)
        for family, found in groupby((r for b in each for r in zip(*b)), key=lambda r: r[0]):
            found = list(found)
            order: dict[int, list[str]] = {}
            for g, n in sorted({(int(g), n) for _, g, n, _ in found}):
                order.setdefault(g, []).append(n)
            best, before, after = optimise(order, sorted({(p, n) for _, _, n, p in found if p is not None and p == p}))
            out = [(family, g, n, i, before, after) for g, ns in best.items() for i, n in enumerate(ns)]
            yield plain(pd.DataFrame(out, columns=["component", "generation", "id", "position", "before", "after"]))

    out = single.unionByName(rows.mapInPandas(run, "component string, generation int, id string, position int, before bigint, after bigint"))
    big = store.write(sized.where((F.col("n") > named) & (F.col("n") <= alone)).drop("n"), "big")
    if not big.isEmpty():
        out = out.unionByName(_by_number(big, edges, store))
    big = store.write(sized.where(F.col("n") > max(named, alone)).drop("n"), "big")
    if not big.isEmpty():
        swept = store.write(_swept(big, edges, PASSES, store), "swept")
        swapped = _by_number(swept.select("component", "generation", "id", "position"), edges, store, _swaps).withColumnRenamed("after", "gain").drop("before")
        counts = swept.select("component", "before", F.col("after").alias("swept")).distinct()
        out = out.unionByName(swapped.join(counts, "component").select("component", "generation", "id", "position", "before", (F.col("swept") + F.col("gain")).alias("after")))
    if most is not None:
        kept = placed.join(size.where(F.col("n") > most), "component")
        out = out.unionByName(kept.select("component", "generation", "id", (F.row_number().over(Window.partitionBy("component", "generation").orderBy("id")) - 1).alias("position"), F.lit(None).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("after")))
    return out


def focused_rows(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(generation, id, position, before, after) of one view: placed (id, generation), edges (type, subject, object).

    A view is what one screen shows, so that one task orders it (``focused_order``).
    """
    e = edges.select("type", F.col("subject").alias("p"), F.col("object").alias("id"))
    rows = placed.join(e, "id", "left").select("id", "generation", "type", "p")

    def run(batches) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts or not sum(map(len, parts)):
            return
        pdf = pd.concat(parts)
        nodes = pdf.drop_duplicates("id").sort_values(["generation", "id"])
        order = {int(g): list(x["id"]) for g, x in nodes.groupby("generation")}
        links = pdf.dropna(subset=["p"])
        of = lambda t: dict(sorted(set(zip(links["id"][links["type"] == t], links["p"][links["type"] == t])), reverse=True))
        mothers, fathers = of("biological_mother"), of("biological_father")
        pairs = sorted({(mothers[c], fathers[c]) for c in mothers.keys() & fathers.keys()})
        best, before, after = focused_order(order, sorted(set(zip(links["p"], links["id"]))), pairs)
        out = [(g, n, i, before, after) for g, ns in best.items() for i, n in enumerate(ns)]
        yield plain(pd.DataFrame(out, columns=["generation", "id", "position", "before", "after"]))

    return rows.coalesce(1).mapInPandas(run, "generation int, id string, position int, before bigint, after bigint")


def barycenter_rank(children: DataFrame, parents: DataFrame) -> DataFrame:
    """One sweep as a join: children (key, row, id) ordered by the mean position of their parents (id, position), null last."""


    score = children.join(parents, "id", "left").groupBy("key", "row", "id").agg(F.avg("position").alias("score"))
    w = Window.partitionBy("key", "row").orderBy(F.col("score").isNull(), "score", "id")
    return score.withColumn("rank", F.row_number().over(w) - 1)
