"""Parent-child rows into full hierarchies.

Method: bottom-up leaf peeling. Every round removes the leaves, which send their subtree sizes to
their parents, and half of the nodes that have a single child left (their child is then linked to
their parent, at the summed distance, so a chain of length n needs log n rounds instead of n).
What can never be peeled are loops. The removed nodes then get depth, root, path and state in
reverse order of peeling, each from the node it was hung on when it went.

A round shuffles the nodes that are left, which shrink geometrically. Once at most ``SMALL`` nodes
hang on others, one task peels them, with the same result; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.scratch import Scratch
from kinweft.session import plain

MAX_ROUNDS = 200
#: Nodes that one task peels by itself, and ids of paths that it hands on at once.
SMALL, BATCH = 300_000, 200_000


def hierarchy(
    edges: DataFrame, key: str = "tree", parent: str = "parent", child: str = "child", with_path: bool = False, small: int = SMALL
) -> DataFrame:
    """One row for each node of each tree: (key, node, root, depth, state, subtree_size[, path]).

    edges holds (key, parent, child) rows; a key separates independent forests (a relation type).
    Other columns are ignored, whatever their names. Rows with a null key, parent or child are no
    links; repeated links count once; an empty table gives no rows.

    state is ``rooted`` (root is the topmost ancestor, depth the number of links to it),
    ``on_cycle`` (root is the smallest id of the loop, depth 0) or ``below_cycle`` (root is that of
    the loop, depth the number of links to it). A node with several parents keeps the smallest
    one as its place in the tree; ``conflicting_parents`` lists such nodes.

    subtree_size counts the node and all below it (on a loop: the node and what hangs on it).
    path (with_path) is the array of ids from the root, or from the loop, to the node.
    """
    spark = edges.sparkSession
    store = Scratch(spark, "hierarchy")
    e = (
        edges.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(child).alias("v"))
        .where("k is not null and p is not null and v is not null")
        .groupBy("k", "v")
        .agg(F.min("p").alias("p"))
    )
    tops = e.select("k", F.col("p").alias("v"), F.lit(None).cast(e.schema["p"].dataType).alias("p"))
    # sz: the node and the peeled part below it; carry: the same of the nodes left out between the
    # node and its present parent; low: the smallest id from the node up to below that parent.
    state = store.write(
        e.unionByName(tops)
        .groupBy("k", "v")
        .agg(F.max("p").alias("p"))
        .select("k", "v", "p", F.lit(1).alias("w"), F.lit(1).cast("bigint").alias("sz"), F.lit(0).cast("bigint").alias("carry"), F.col("v").alias("low"), F.array().cast(f"array<{e.schema['v'].dataType.simpleString()}>").alias("frag")),
        "state",
    )
    is_open = F.col("p").isNotNull() & (F.col("p") != F.col("v"))
    removed: list[tuple[DataFrame, DataFrame]] = []
    left, n = state.where(is_open).count(), state.count()
    for r in range(MAX_ROUNDS):
        if left <= small:
            break
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 1  # noqa: B023, E731
        kids = state.where(is_open).groupBy("k", F.col("p").alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("below"), F.min("carry").alias("bcarry"))
        m = state.join(kids, ["k", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        m = m.withColumn("chain", is_open & (F.col("n") == 1) & coin(F.col("v")) & ~coin(F.col("p")))
        # A chain node that goes has a parent that stays (its coin is 0). Its child moves up to that
        # parent first, so that a child which is a leaf can go in the same round.
        skip = m.where("chain").select("k", F.col("below").alias("v"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("sz").alias("sz2"), F.col("carry").alias("carry2"), F.col("low").alias("low2"), F.col("frag").alias("frag2"), F.col("v").alias("v2"))
        moved = m.join(skip, ["k", "v"], "left").select(
            "k", "v",
            F.coalesce("p2", "p").alias("p"),
            (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
            "sz",
            (F.col("carry") + F.coalesce("carry2", F.lit(0)) + F.coalesce("sz2", F.lit(0))).alias("carry"),
            F.least("low", F.coalesce("low2", "low")).alias("low"),
            (F.when(F.col("v2").isNull(), F.col("frag")).otherwise(F.concat("frag2", F.array("v2"), "frag")) if with_path else F.col("frag")).alias("frag"),
            "below", "bcarry",
            F.when(F.col("chain"), "chain").when(is_open & (F.col("n") == 0), "leaf").alias("how"),
        )
        marked = store.write(moved, f"round{r}")
        removed.append((marked.where("how = 'leaf'"), marked.where("how = 'chain'")))
        sent = marked.where("how = 'leaf'").groupBy("k", F.col("p").alias("v")).agg(F.sum(F.col("sz") + F.col("carry")).alias("got"))
        state = marked.where("how is null").drop("how", "below", "bcarry").join(sent, ["k", "v"], "left").withColumn("sz", F.col("sz") + F.coalesce("got", F.lit(0))).drop("got")
        state = store.write(state, f"left{r}")
        left = state.where(is_open).count()
    else:
        raise RuntimeError(f"hierarchy: not peeled after {MAX_ROUNDS} rounds")
    # What hangs on others, and what they hang on, is peeled in one task; the rest are tops and closed loops.
    if n <= small:
        parts = [store.write(_peeled(state, with_path), "tops")]
    else:
        held = state.where(is_open).select("k", F.col("p").alias("v")).distinct()
        loop = F.col("p").isNotNull()
        alone = state.where(~is_open).join(held, ["k", "v"], "left_anti").select(
            "k", "v", F.when(loop, F.col("low")).otherwise(F.col("v")).alias("root"), F.lit(0).alias("depth"),
            F.when(loop, "on_cycle").otherwise("rooted").alias("state"), F.col("sz").alias("size"), F.array("v").alias("path"),
        )
        tied = state.where(is_open).unionByName(state.where(~is_open).join(held, ["k", "v"], "left_semi"))
        parts = [store.write(alone.unionByName(_peeled(tied, with_path)), "tops")]
    none = F.array().cast(parts[0].schema["path"].dataType)
    for r in range(len(removed) - 1, -1, -1):
        known = _union(parts)
        up = known.select("k", F.col("v").alias("p"), "root", F.col("depth").alias("pd"), F.col("state").alias("ps"), F.col("path").alias("pp"))
        path = F.concat("pp", "frag", F.array("v")) if with_path else none
        state_ = F.when(F.col("ps") == "on_cycle", "below_cycle").otherwise(F.col("ps"))
        leaves = removed[r][0].join(up, ["k", "p"]).select("k", "v", "root", (F.col("pd") + F.col("w")).alias("depth"), state_.alias("state"), F.col("sz").alias("size"), path.alias("path"))
        down = known.unionByName(leaves).select("k", F.col("v").alias("below"), F.col("state").alias("bs"), F.col("size").alias("bsize"))
        ring = F.col("bs") == "on_cycle"
        chains = removed[r][1].join(up, ["k", "p"]).join(down, ["k", "below"]).select(
            "k", "v", "root",
            F.when(ring, F.lit(0)).otherwise(F.col("pd") + F.col("w")).alias("depth"),
            F.when(ring, "on_cycle").otherwise(state_).alias("state"),
            (F.col("sz") + F.when(ring, F.lit(0)).otherwise(F.col("bcarry") + F.col("bsize"))).alias("size"),
            (F.when(ring, F.array("v")).otherwise(path) if with_path else none).alias("path"),
        )
        parts.append(store.write(leaves.unionByName(chains), f"down{r}"))
    cols: list[Column] = [F.col("k").alias(key), F.col("v").alias("node"), F.col("root"), F.col("depth"), F.col("state"), F.col("size").alias("subtree_size")]
    return _union(parts).select(*cols, *([F.col("path")] if with_path else []))


def _peeled(state: DataFrame, with_path: bool) -> DataFrame:
    """(k, v, root, depth, state, size, path) of the rows of state, by peeling in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {(k, v): (p, w, sz, carry, low, frag) for b in batches for k, v, p, w, sz, carry, low, frag in zip(*(b[c].tolist() for c in ("k", "v", "p", "w", "sz", "carry", "low", "frag")))}
        own = {n: n for n in rows}
        up = {n: own[n[0], x[0]] if x[0] is not None and x[0] == x[0] else None for n, x in rows.items()}
        kids = dict.fromkeys(rows, 0)
        for p in up.values():
            if p is not None:
                kids[p] += 1
        size = {n: x[2] for n, x in rows.items()}
        peeled = []
        ready = [n for n in rows if not kids[n]]
        while ready:
            n = ready.pop()
            peeled.append(n)
            p = up[n]
            if p is not None:
                size[p] += size[n] + rows[n][3]
                kids[p] -= 1
                if not kids[p]:
                    ready.append(p)
        told: dict = {}
        for n in rows:
            if kids[n] and n not in told:
                ring = [n]
                while up[ring[-1]] != n:
                    ring.append(up[ring[-1]])
                low = min(rows[m][4] for m in ring)
                told.update((m, (low, 0, "on_cycle")) for m in ring)
        for n in reversed(peeled):
            p = up[n]
            if p is None:
                told[n] = (n[1], 0, "rooted")
            else:
                root, depth, state_ = told[p]
                told[n] = (root, depth + rows[n][1], "below_cycle" if state_ == "on_cycle" else state_)
        out, held = [], 0
        for n, (root, depth, state_) in told.items():
            path: list = []
            if with_path:
                m = n
                while told[m][2] != "on_cycle" and up[m] is not None:
                    path += [m[1], *reversed(list(rows[m][5]))]
                    m = up[m]
                path = [*reversed(path + [m[1]])] if m != n else [m[1]]
            out.append((*n, root, depth, state_, size[n], path))
            held += 1 + len(path)
            if held >= BATCH:
                yield _told(out)
                out, held = [], 0
        yield _told(out)

    node, k = state.schema["v"].dataType.simpleString(), state.schema["k"].dataType.simpleString()
    return state.coalesce(1).mapInPandas(run, f"k {k}, v {node}, root {node}, depth int, state string, size bigint, path array<{node}>")


def _told(rows: list[tuple]) -> pd.DataFrame:
    return plain(pd.DataFrame(rows, columns=["k", "v", "root", "depth", "state", "size", "path"]))


def descendants(edges: DataFrame, key: str = "tree", parent: str = "parent", child: str = "child") -> DataFrame:
    """(key, node, descendant, distance): every node with every node below it, as rows.

    Rows and not one list per node, since the list of a root may hold a third of all nodes. Nodes
    of a loop are not descendants of one another here; what hangs on them is. Nulls, repeated
    links and empty tables are treated as in ``hierarchy``.
    """
    t = hierarchy(edges, key, parent, child, with_path=True)
    return (
        t.select(key, F.col("node").alias("descendant"), F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("at", "node"), F.size("path").alias("n"))
        .select(key, "node", "descendant", (F.col("n") - 1 - F.col("at")).alias("distance"))
    )


def conflicting_parents(edges: DataFrame, key: str = "tree", parent: str = "parent", child: str = "child") -> DataFrame:
    """(key, node, parents): nodes that are linked to more than one parent."""
    e = edges.select(F.col(key).alias(key), F.col(parent).alias("p"), F.col(child).alias("node")).dropna().distinct()
    return e.groupBy(key, "node").agg(F.count("*").alias("parents")).where("parents > 1")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
