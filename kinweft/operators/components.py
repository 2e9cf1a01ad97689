"""Connected components of any size by repeated contraction.

Every round each node moves to the node of the smallest random rank among itself and its
neighbours; the graph of the targets is what the next round sees. It shrinks geometrically
whatever its shape, a star included: of a hub only one smallest rank per leaf is kept, and edges
are made distinct before they are used again. Once at most ``SMALL`` edges are left, one task ends
the rest by union and find, with the same result. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.scratch import Scratch
from kinweft.session import plain

MAX_ROUNDS = 60
#: Edges that one task takes in by itself.
SMALL = 300_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, node: str = "node", small: int = SMALL) -> DataFrame:
    """(node, component): each node of edges, and of nodes, with the smallest id it is connected to.

    Edges have no direction; nulls on either side, self-loops and repeated edges add nothing but
    the nodes they name. Nodes without edges are their own component. Other columns are ignored.
    """
    spark = edges.sparkSession
    store = Scratch(spark, "components")
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    every = e.select(F.col("u").alias("n")).unionByName(e.select(F.col("v").alias("n")))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col(node).alias("n")))
    every = store.write(every.where("n is not null").distinct(), "nodes")
    e = store.write(e.where("u is not null and v is not null and u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    moves: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        n = e.count()
        if n and n <= small:
            moves.append(_joined(e))
        if n <= small:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(r)).alias("h"), F.col("v").alias("v"))).alias("b"))
        own = F.struct(F.xxhash64("u", F.lit(r)).alias("h"), F.col("u").alias("v"))
        move = store.write(best.select("u", F.least(own, F.col("b"))["v"].alias("to")), f"move{r}")
        moves.append(move)
        a, b = move.select("u", F.col("to").alias("a")), move.select(F.col("u").alias("v"), F.col("to").alias("b"))
        left = e.join(a, "u").join(b, "v").where("a != b")
        before, e = e, store.write(left.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"edges{r}")
        store.drop(before)
    else:
        raise RuntimeError(f"components: not contracted after {MAX_ROUNDS} rounds")
    placed: DataFrame | None = None
    for move in reversed(moves):
        if placed is None:
            placed = move
            continue
        later = placed.select(F.col("u").alias("to"), F.col("to").alias("end"))
        placed = store.write(move.join(later, "to", "left").select("u", F.coalesce("end", "to").alias("to")), "placed")
    if placed is None:
        return every.select(F.col("n").alias("node"), F.col("n").alias("component"))
    all_ = every.join(placed.withColumnRenamed("u", "n"), "n", "left").select("n", F.coalesce("to", "n").alias("to"))
    low = all_.groupBy("to").agg(F.min("n").alias("component"))
    return all_.join(low, "to").select(F.col("n").alias("node"), "component")


def _joined(e: DataFrame) -> DataFrame:
    """(u, to): the ends of the edges (u, v) with the smallest id of their component, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(x):
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for b in batches:
            for u, v in zip(b["u"].tolist(), b["v"].tolist()):
                a, c = top(u), top(v)
                if a != c:
                    up[max(a, c)] = min(a, c)
        yield plain(pd.DataFrame({"u": list(up), "to": [top(x) for x in list(up)]}))

    kind = e.schema["u"].dataType.simpleString()
    return e.coalesce(1).mapInPandas(run, f"u {kind}, to {kind}")
