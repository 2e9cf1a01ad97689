"""Pedigree graphs: neighbourhoods, generations, cycles and counts over edge tables.

Nodes are (id, ...), edges (id, subject, object, type) with the parent as subject. Edges with an
end that is no node are dropped, never completed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweft.operators.components import SMALL, components
from kinweft.scratch import Scratch
from kinweft.session import plain, tasks

GENERATION_TYPES = ("biological_mother", "biological_father", "foster", "adoptive")
#: Links that one task levels by itself, and that each task of a walk holds.
ONE_TASK, ONE_WALK = 20_000_000, 10_000_000
#: Starts that are worth a task, and rows that a task hands on at once.
STARTS, BATCH = 1_000, 200_000
#: Rows of so few nodes are levelled node by node, which takes less than a call for all of them.
NARROW = 64


def known_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges both ends of which are nodes."""
    ends = nodes.select(F.col(node).alias("_n")).where("_n is not null").distinct()
    return edges.join(ends, edges["subject"] == ends["_n"], "left_semi").join(ends, edges["object"] == ends["_n"], "left_semi")


def incident_edges(edges: DataFrame) -> DataFrame:
    """Each edge under each of its ends, a loop once: (node, other, side, ...)."""
    out = edges.select(F.col("subject").alias("node"), F.col("object").alias("other"), F.lit("parent").alias("side"), "*")
    back = edges.where("subject != object").select(F.col("object").alias("node"), F.col("subject").alias("other"), F.lit("child").alias("side"), "*")
    return out.unionByName(back)


def induced_edges(edges: DataFrame, chosen: DataFrame, node: str = "id") -> DataFrame:
    """Edges within a chosen set, each id once, by two semi joins."""
    return known_edges(edges, chosen, node).dropDuplicates(["id"])


def parent_pairs(edges: DataFrame) -> DataFrame:
    """(child, mother, father) of each child that has both; no parent pairs with itself."""
    m = edges.where("type = 'biological_mother'").select(F.col("object").alias("child"), F.col("subject").alias("mother")).distinct()
    f = edges.where("type = 'biological_father'").select(F.col("object").alias("child"), F.col("subject").alias("father")).distinct()
    return m.join(f, "child").where("mother != father")


def walk(edges: DataFrame, starts: DataFrame, upward: bool, depth: int | None = None, most: int = ONE_WALK) -> DataFrame:
    """(start, node, distance): all that is reached from each start, at its least distance.

    starts is (start). Loops end the walk where they close. Up to most links are held as numbers by
    each of the tasks that share the starts, so that depth costs no rounds; more are walked by one
    join a level, with the same result.
    """
    spark = edges.sparkSession
    store = Scratch(spark, "walk")
    src, dst = ("object", "subject") if upward else ("subject", "object")
    step = store.write(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct(), "step")
    first = store.write(starts.select("start").where("start is not null").distinct(), "starts")
    if step.count() > most:
        return _walk_by_joins(store, step, first, depth)
    names = step.select("node").unionByName(step.select(F.col("next").alias("node"))).unionByName(first.select(F.col("start").alias("node"))).distinct()
    names = store.write(names.withColumn("k", F.monotonically_increasing_id()), "names")
    number = lambda c, k: names.select(F.col("node").alias(c), F.col("k").alias(k))
    parts = min(tasks(spark), 1 + first.count() // STARTS)
    links = step.join(number("node", "a"), "node").join(number("next", "b"), "next").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "a", "b")
    begin = first.join(number("start", "a"), "start").select(F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "a", F.col("a").alias("b"))
    rows = links.unionByName(begin).repartition(parts, "part").sortWithinPartitions("part", "kind")
    got = store.write(rows.mapInPandas(_walked(depth), "a bigint, b bigint, distance int"), "reached")
    return got.join(number("start", "a"), "a").join(number("node", "b"), "b").select("start", "node", "distance")


def _walked(depth: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, links, near = None, [], None
        out: list[tuple[int, list[int], list[int]]] = []
        held = 0
        for batch in batches:
            for (p, kind), rows in batch.groupby(["part", "kind"]):
                if p != part:
                    part, links, near = p, [], None
                if kind == 0:
                    links.append(rows[["a", "b"]].to_numpy())
                    continue
                if near is None:
                    near, links = _neighbours(links), []
                names, first, follow = near
                for s in rows["a"].tolist():
                    at = int(np.searchsorted(names, s))
                    distance = {at: 0}
                    level = [at] if at < len(names) and names[at] == s else []
                    d = 0
                    while level and (depth is None or d < depth):
                        d += 1
                        new = []
                        for n in level:
                            for m in follow[first[n] : first[n + 1]]:
                                if m not in distance:
                                    distance[m] = d
                                    new.append(m)
                        level = new
                    nodes = names[list(distance)] if at < len(names) and names[at] == s else np.array([s])
                    out.append((s, nodes, list(distance.values())))
                    held += len(nodes)
                    if held >= BATCH:
                        yield _reached(out)
                        out, held = [], 0
        yield _reached(out)

    return run


def _neighbours(links: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[int]]:
    """The numbers of all ends, and for each place among them where its neighbours' places begin."""
    x = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    names, at = np.unique(x, return_inverse=True)
    at = at.reshape(x.shape)
    at = at[np.argsort(at[:, 0], kind="stable")]
    return names, np.searchsorted(at[:, 0], np.arange(len(names) + 1)).tolist(), at[:, 1].tolist()


def _reached(out: list) -> pd.DataFrame:
    of = lambda k, kind: np.concatenate([np.asarray(x[k], kind) for x in out]) if out else np.zeros(0, kind)
    return pd.DataFrame({"a": np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out]), "b": of(1, np.int64), "distance": of(2, np.int32)})


def _walk_by_joins(store: Scratch, step: DataFrame, first: DataFrame, depth: int | None) -> DataFrame:
    """What is new at a level is all that the next one reads."""
    frontier = store.write(first.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")), "level0")
    parts = [frontier]
    level = 0
    while depth is None or level < depth:
        level += 1
        reached = frontier.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        new = store.write(reached.join(_union(parts).select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(level)), f"level{level}")
        if new.isEmpty():
            break
        parts.append(new)
        frontier = new
    return _union(parts)


def focused(edges: DataFrame, focus: str, depth: int | None = 3, cap: int | None = 250, small: int = SMALL) -> DataFrame:
    """(node, generation, truncated) around one node: its ancestors as negative, its descendants as positive generations.

    edges is (id, subject, object). Ancestors are walked before descendants, level by level, the
    neighbours of a level in the order of the nodes that lead to them, then of the edges' ids; the
    first label stays. Once cap nodes are kept no other is, nor is it walked on from; truncated says
    whether any was refused. The cap is a feature of the view: without one every node is kept.

    Up to small edges are walked in one task, more by one join a level, with the same result.
    """
    e = edges.select("id", "subject", "object").where("subject is not null and object is not null")
    if e.count() > small:
        return _focused_by_joins(e, focus, depth, cap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((i, s, o) for b in batches for i, s, o in zip(b["id"], b["subject"], b["object"]))
        up, down = defaultdict(list), defaultdict(list)
        for _, s, o in rows:
            up[o].append(s)
            down[s].append(o)
        label, refused = {focus: 0}, False
        for near, sign in ((up, -1), (down, 1)):
            level, visited, distance = [focus], {focus}, 0
            while level and (depth is None or distance < depth):
                distance += 1
                reached = []
                for n in level:
                    for m in near.get(n, ()):
                        if m not in label and cap is not None and len(label) >= max(1, cap):
                            refused = True
                            continue
                        label.setdefault(m, sign * distance)
                        if m not in visited:
                            visited.add(m)
                            reached.append(m)
                level = reached
        yield plain(pd.DataFrame({"node": list(label), "generation": pd.array(list(label.values()), dtype="Int32"), "truncated": refused}))

    return e.coalesce(1).mapInPandas(run, "node string, generation int, truncated boolean")


def _focused_by_joins(e: DataFrame, focus: str, depth: int | None, cap: int | None) -> DataFrame:
    spark = e.sparkSession
    store = Scratch(spark, "focused")
    e = store.write(e, "edges")
    label = store.write(spark.createDataFrame([(focus, 0)], "node string, generation int"), "label")
    kept, refused = 1, False
    for src, dst, sign in (("object", "subject", -1), ("subject", "object", 1)):
        level = spark.createDataFrame([(focus, 0)], "node string, place long")
        visited = level.select("node")
        distance = 0
        while depth is None or distance < depth:
            distance += 1
            near = e.join(level.withColumnRenamed("node", src), src).groupBy(F.col(dst).alias("node")).agg(F.min(F.struct("place", "id")).alias("at"))
            near = store.write(near.join(visited, "node", "left_anti").join(label, "node", "left"), "near")
            new = near.where("generation is null")
            n, room = new.count(), None if cap is None else max(0, max(1, cap) - kept)
            if room is not None and n > room:
                refused = True
                new = new.orderBy("at").limit(room)
                n = room
            new = store.write(new.select("node", "at"), "new")
            label = store.write(label.unionByName(new.select("node", F.lit(sign * distance).alias("generation"))), "label")
            kept += n
            level = near.where("generation is not null").select("node", "at").unionByName(new)
            level = store.write(level.select("node", (F.row_number().over(Window.orderBy("at")) if cap is not None else F.lit(0)).cast("bigint").alias("place")), "level")
            if level.isEmpty():
                break
            visited = store.write(visited.unionByName(level.select("node")), "visited")
    return label.withColumn("truncated", F.lit(refused))


def level_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, level, child) of pairs (parent, child): the longest path from a source to each node, -1 on or below a loop."""
    names, at = np.unique(pairs, return_inverse=True)
    p, c = at.reshape(pairs.shape).T if len(pairs) else (np.zeros(0, np.int64),) * 2
    n = len(names)
    order = np.argsort(p, kind="stable")
    first, below = np.searchsorted(p[order], np.arange(n + 1)), c[order]
    waits = np.bincount(c, minlength=n)
    child = waits > 0
    level = np.full(n, -1, np.int32)
    ready, r = np.flatnonzero(waits == 0), 0
    first_, below_, waits_, level_ = (memoryview(np.ascontiguousarray(x)) for x in (first, below, waits, level))
    while len(ready):
        if len(ready) > NARROW:
            level[ready] = r
            size = first[ready + 1] - first[ready]
            hit = below[np.repeat(first[ready] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            hit, k = np.unique(hit, return_counts=True)
            waits[hit] -= k
            ready, r = hit[waits[hit] == 0], r + 1
            continue
        row = ready.tolist()
        while row and len(row) <= NARROW:
            free = []
            for i in row:
                level_[i] = r
                for k in range(first_[i], first_[i + 1]):
                    waits_[below_[k]] -= 1
                    if not waits_[below_[k]]:
                        free.append(below_[k])
            row, r = free, r + 1
        ready = np.array(row, np.int64)
    return names, level, child


def levels(nodes: DataFrame, edges: DataFrame, node: str = "id", most: int = ONE_TASK) -> DataFrame:
    """(node, generation): the longest path to each node; null on and below a loop, 0 without parents.

    Round r takes the nodes that have no parent left, which are those of generation r, by one join.
    Once at most most links are left, one task takes them as numbers, with the same result.
    """
    store = Scratch(edges.sparkSession, "levels")
    names = store.write(nodes.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    number = lambda c, k: names.select(F.col("node").alias(c), F.col("k").alias(k))
    e = edges.select("subject", "object").join(number("subject", "a"), "subject").join(number("object", "b"), "object").select("a", "b").distinct()
    e = store.write(e, "links")
    now = names.select("k").join(e.select(F.col("b").alias("k")), "k", "left_anti")
    parts, r = [], 0
    while e.count() > most:
        now = store.write(now, f"level{r}")
        parts.append(now.select("k", F.lit(r).alias("generation")))
        gone = now.select(F.col("k").alias("a"))
        left = store.write(e.join(gone, "a", "left_anti"), f"links{r}")
        now = store.write(e.join(gone, "a", "left_semi").select(F.col("b").alias("k")).distinct().join(left.select(F.col("b").alias("k")), "k", "left_anti"), "next")
        store.drop(e)
        e, r = left, r + 1
        if now.isEmpty():
            parts.append(e.select(F.col("b").alias("k"), F.lit(None).cast("int").alias("generation")).distinct())
            break
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k, level, child = level_pairs(np.concatenate([np.zeros((0, 2), np.int64), *[b[["a", "b"]].to_numpy() for b in batches]]))
            k, level = k[child], level[child]
            for at in range(0, len(k), BATCH):
                g = level[at : at + BATCH]
                yield pd.DataFrame({"k": k[at : at + BATCH], "generation": pd.arrays.IntegerArray(g + np.int32(r), g < 0)})

        parts += [now.select("k", F.lit(r).alias("generation")), e.coalesce(1).mapInPandas(run, "k bigint, generation int")]
    return store.write(names.join(_union(parts), "k").select("node", "generation"), "levels")


def generations(nodes: DataFrame, edges: DataFrame, node: str = "id", group_nodes: int = ONE_TASK) -> DataFrame:
    """(node, component, generation): the longest path to each node within its connected family.

    generation is null on and below a loop. Nodes without edges are of generation 0. Up to
    group_nodes links are levelled in one task (``levels``).
    """
    e = known_edges(edges, nodes, node).select(F.col("subject").alias("p"), F.col("object").alias("c")).distinct()
    family = components(e, "p", "c", nodes.where(F.col(node).isNotNull()), node)
    return family.join(levels(nodes, edges, node, group_nodes), "node").select("node", "component", "generation")


def generation_violations(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is not of an earlier generation than the child."""
    p = levels.select(F.col("node").alias("subject"), F.col("generation").alias("parent_generation"))
    c = levels.select(F.col("node").alias("object"), F.col("generation").alias("child_generation"))
    return edges.join(p, "subject").join(c, "object").where("parent_generation >= child_generation")


def component_stats(members: DataFrame, attributes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, n_countries) of members (node, component) with (id, country)."""
    n = members.join(attributes, members["node"] == attributes["id"], "left").groupBy("component").agg(F.count("*").alias("n_nodes"), F.count_distinct("country").alias("n_countries"))
    e = edges.join(members.select(F.col("node").alias("subject"), "component"), "subject").groupBy("component").agg(F.count("*").alias("n_edges"))
    return n.join(e, "component", "left").select("component", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_countries")


def row_positions(nodes: DataFrame, gap: float = 240.0) -> DataFrame:
    """nodes (component, generation, id) with position and x, each row centred: (i - (n - 1) / 2) * gap."""
    row = Window.partitionBy("component", "generation")
    i = F.row_number().over(row.orderBy("id")) - 1
    return nodes.withColumn("position", i).withColumn("x", (F.col("position") - (F.count("*").over(row) - 1) / 2) * gap)


def normalized_rank(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with rank01: position / max(1, n - 1) within key."""
    w = Window.partitionBy(key)
    return rows.withColumn("rank01", (F.row_number().over(w.orderBy(order)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


def running_offset(groups: DataFrame, key: str, order: str, width: str, gap: float = 0.0) -> DataFrame:
    """groups with offset: the widths and gaps of all groups before it within key."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("offset", F.coalesce(F.sum(F.col(width) + gap).over(before), F.lit(0.0)))


def shelf_pack(tiles: DataFrame, target: float, gap: float = 32.0) -> DataFrame:
    """tiles (id, width, height) with x, y on shelves: largest area first, a new shelf where one would pass target.

    Packing is sequential: the sorted tiles stream through one task that keeps three numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = y = shelf = 0.0
        for b in batches:
            xs, ys = [], []
            for w, h in zip(b["width"], b["height"]):
                if x > 0 and x + w > target:
                    x, y, shelf = 0.0, y + shelf + gap, 0.0
                xs.append(x)
                ys.append(y)
                x, shelf = x + w + gap, max(shelf, h)
            yield plain(b.assign(x=xs, y=ys))

    order = [(F.col("width") * F.col("height")).desc(), F.col("height").desc(), F.col("width").desc(), F.col("id")]
    sorted_ = tiles.select("id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")).orderBy(*order).coalesce(1)
    return sorted_.mapInPandas(run, "id string, width double, height double, x double, y double")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parent_order_violations(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, mother, father): parents of one generation of which the mother does not stand left of the father."""
    at = lambda n: placed.select(F.col("id").alias(n), F.col("generation").alias(f"{n}_generation"), F.col("x").alias(f"{n}_x"))
    return parent_pairs(edges).join(at("mother"), "mother").join(at("father"), "father").where("mother_generation = father_generation and mother_x >= father_x").select("child", "mother", "father")


def locale_order(rows: DataFrame, key: list[str], country: str, name: str, node: str, missing: str = "") -> DataFrame:
    """rows with place: from 0 within key by country (missing for null), name (the id for null) and id, as a reader sorts them."""
    text = lambda c: F.collate(c, "UNICODE")
    w = Window.partitionBy(*key).orderBy(text(F.coalesce(country, F.lit(missing))), text(F.coalesce(name, node)), text(F.col(node)), node)
    return rows.withColumn("place", F.row_number().over(w) - 1)
