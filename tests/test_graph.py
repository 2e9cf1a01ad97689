"""Graphs, layouts and geometry on small cases."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweft.operators import geometry as ge
from kinweft.operators import graph as gr
from kinweft.operators import layout as lo
from kinweft.plans import pedigree

EDGES = "id string, subject string, object string, type string"
M, P, S = "biological_mother", "biological_father", "social"


def edges(spark, *pairs):
    return spark.createDataFrame([(f"e{i}", a, b, t) for i, (a, b, t) in enumerate(pairs)], EDGES)


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_generations_longest_path_loops_and_large_families(spark):
    e = edges(spark, ("g", "p", M), ("p", "c", M), ("g", "c", P), ("x", "y", M), ("y", "x", M), ("y", "z", M), ("gone", "c", M), ("c", None, M))
    for bound in (50_000, 1):
        got = {r["node"]: (r["component"], r["generation"]) for r in gr.generations(nodes(spark, "gpcxyzl"), e, group_nodes=bound).collect()}
        assert got == {"g": ("c", 0), "p": ("c", 1), "c": ("c", 2), "x": ("x", None), "y": ("x", None), "z": ("x", None), "l": ("l", 0)}


def test_walk_focus_and_cap(spark):
    e = edges(spark, ("g", "p", M), ("p", "f", M), ("f", "c", M), ("c", "d", M), ("s", "f", P), ("d", "f", M))
    assert dict((r["node"], r["distance"]) for r in gr.walk(e, spark.createDataFrame([("f",)], "start string"), True).collect()) == {"f": 0, "p": 1, "s": 1, "d": 1, "g": 2, "c": 2}
    chain = edges(spark, ("g", "p", M), ("p", "f", M), ("f", "c", M))
    assert dict(rows(gr.focused(chain, "f", 2, None).select("node", "generation"))) == {"g": -2, "p": -1, "f": 0, "c": 1}
    capped = gr.focused(chain, "f", 2, 2).collect()
    assert len(capped) == 2 and {r["node"] for r in capped} == {"f", "p"} and all(r["truncated"] for r in capped)
    assert [r["node"] for r in gr.focused(edges(spark, ("a", "b", M)), "lone").collect()] == ["lone"]


def test_levels_by_rounds_and_in_one_task(spark):
    rng = random.Random(3)
    names = [f"n{i:03}" for i in range(90)]
    pairs = [(names[a], names[b]) for a, b in (sorted(rng.sample(range(70), 2)) for _ in range(110))] + [("n080", "n081"), ("n081", "n080"), ("n081", "n060"), ("n085", "n085")]
    e = edges(spark, *((a, b, M) for a, b in pairs), ("n001", "gone", M))
    level = dict.fromkeys(names, 0)
    for _ in names:
        for a, b in pairs:
            level[b] = max(level[b], level[a] + 1)
    want = sorted(((n, g if g < 90 else None) for n, g in level.items()), key=str)
    for most in (gr.ONE_TASK, 60, 0):
        assert rows(gr.levels(nodes(spark, names), e, most=most)) == want


def jobs(spark, run):
    """What run gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name := f"jobs-{random.random()}", name)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


@pytest.mark.parametrize("upward", [False, True])
def test_walks_take_no_rounds(spark, upward):
    def walked(n, **more):
        chain = edges(spark, *((f"{i:03}", f"{i + 1:03}", M) for i in range(n)), (f"{n:03}", f"{n - 2:03}", P))
        starts = spark.createDataFrame([(f"{n:03}",), ("lone",), ("000",)], "start string")
        return rows(gr.walk(chain, starts, upward, **more))

    got, n = jobs(spark, lambda: walked(60))
    assert n < 40 and ("lone", "lone", 0) in got and (("000", "060", 60) in got) != upward and (("060", "000", 60) in got) == upward
    assert walked(5) == walked(5, most=0) and {r[2] for r in walked(5, depth=2)} == {0, 1, 2}


def lines(spark, sf, upward):
    """A folder with a line of 46 animals, a loop and ids without numbers, and what each animal leads to."""
    links = [(f"an-{i:09d}", f"an-{i + 1:09d}") for i in range(1, 46)] + [("an-x", "an-y"), ("an-y", "an-x"), ("an-y", "an-000000003"), ("an-000000007", "an-000000007")]
    names = sorted({n for pair in links for n in pair} | {"an-lone"})
    nodes(spark, names).write.parquet(f"{sf}/animals.parquet")
    e = spark.createDataFrame([(f"r{k}", a, f" {b.upper()} ", M, "", [], None) for k, (a, b) in enumerate(links)] + [("r-null", "an-x", None, M, "", [], None)], EDGES + ", status string, source_ids array<string>, review string")
    e.withColumn("loaded_at", F.lit(None).cast("timestamp")).write.parquet(f"{sf}/relationships.parquet")
    want = {}
    for s in names:
        level, want[s, s] = [s], 0
        for d in range(1, len(names)):
            level = [x for a, b in links for n, x in [(b, a) if upward else (a, b)] if n in level and (s, x) not in want]
            want |= dict.fromkeys(((s, x) for x in level), d)
    return sorted((s, n, d) for (s, n), d in want.items())


def walked_from_all(spark, tmp_path, name, upward):
    want = lines(spark, tmp_path, upward)
    assert max(d for _, _, d in want) > 40 and rows(getattr(pedigree, name)(spark, str(tmp_path))) == want
    with duckdb.connect() as c:
        for t in ("animals", "relationships"):
            c.sql(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
        assert sorted(c.sql(pedigree.REG.sql[name]).fetchall()) == want


def test_ancestors_of_every_animal(spark, tmp_path):
    walked_from_all(spark, tmp_path, "ancestors", True)


def test_descendants_of_every_animal(spark, tmp_path):
    walked_from_all(spark, tmp_path, "descendants", False)


@pytest.mark.parametrize("narrow", [0, 3, 64])
def test_narrow_rows_are_levelled_without_a_call_per_row(monkeypatch, narrow):
    line = np.stack([np.arange(50_000), np.arange(1, 50_001)], 1)
    wide = np.array([(k % 7, 100_000 + k) for k in range(200)] + [(100_000 + k, 200_000) for k in range(200)] + [(300_000, 300_001), (300_001, 300_000), (300_001, 300_002)])
    calls, unique = [], np.unique
    monkeypatch.setattr(gr, "NARROW", narrow, raising=False)
    monkeypatch.setattr(gr.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    names, level, child = gr.level_pairs(np.concatenate([line, wide]) if narrow else wide)
    got = dict(zip(names.tolist(), level.tolist()))
    assert len(calls) <= 10
    assert all(got[k] == k for k in range(50_001 if narrow else 0))
    assert all(got[100_000 + k] == (k % 7 if narrow else 0) + 1 for k in range(200)) and got[200_000] == (8 if narrow else 2)
    assert [got[300_000 + k] for k in range(3)] == [-1, -1, -1] and int((~child).sum()) == (1 if narrow else 7)


DEEP = 51_000


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """A folder with one family of more than 50,000 nodes, each below the last, and a loop beside it."""
    sf = tmp_path_factory.mktemp("deep")
    n = spark.range(DEEP).select(F.format_string("an-%09d", "id").alias("id"))
    n.unionByName(spark.createDataFrame([("an-x",), ("an-y",)], "id string")).write.parquet(f"{sf}/animals.parquet")
    e = spark.range(DEEP - 1).select(F.format_string("r%d", "id").alias("id"), F.format_string("an-%09d", "id").alias("subject"), F.format_string("an-%09d", F.col("id") + 1).alias("object"))
    e = e.unionByName(spark.createDataFrame([("x", "an-x", "an-y"), ("y", "an-y", "an-x")], "id string, subject string, object string"))
    e.withColumn("type", F.lit(M)).withColumn("loaded_at", F.lit(None).cast("timestamp")).write.parquet(f"{sf}/relationships.parquet")
    return str(sf)


def test_acyclic_of_a_deep_family(spark, deep):
    assert rows(pedigree.acyclic(spark, deep)) == [("an-x",), ("an-y",)]


#: What holds for every row of a query over the deep family, and the rows beside the family's.
DEEP_ROWS = {
    "generations": ("generation = coalesce(try_cast(substr(animal_id, 4) as int), -1)", 2),
    "generation_widths": ("n = 1 and first_id = last_id and generation = cast(substr(first_id, 4) as int)", 0),
    "row_positions": ("position = 0 and x = 0 and generation = cast(substr(id, 4) as int)", 0),
    "normalized_rank": ("rank01 = 0", 0),
    "running_offset": ("`offset` = generation * 320.0", 0),
    "barycenter_rank": ("rank = 0 and generation = cast(substr(id, 4) as int)", 0),
    "parent_order": ("false", -DEEP),
}


@pytest.mark.parametrize("name", DEEP_ROWS)
def test_rows_of_a_deep_family(spark, deep, name):
    right, more = DEEP_ROWS[name]
    got = getattr(pedigree, name)(spark, deep).agg(F.count("*"), F.count_if(F.expr(right))).first()
    assert tuple(got) == (DEEP + more,) * 2


def test_edges_and_pairs(spark):
    e = edges(spark, ("m", "c", M), ("f", "c", P), ("m", "c", P), ("c", "c", S), ("m", "q", M))
    assert rows(gr.parent_pairs(e)) == [("c", "m", "f")]
    assert gr.incident_edges(e).where("node = 'c'").count() == 4
    assert sorted(r["id"] for r in gr.induced_edges(e, nodes(spark, "mcf")).collect()) == ["e0", "e1", "e2", "e3"]
    levels = spark.createDataFrame([("m", 0), ("c", 0), ("f", -1)], "node string, generation int")
    assert [r["id"] for r in gr.generation_violations(levels, e).orderBy("id").collect()] == ["e0", "e2", "e3"]


def test_rows_of_a_layout(spark):
    n = spark.createDataFrame([("k", 0, "a"), ("k", 0, "b"), ("k", 1, "c")], "component string, generation int, id string")
    assert rows(gr.row_positions(n, 10.0).select("id", "x")) == [("a", -5.0), ("b", 5.0), ("c", 0.0)]
    assert rows(gr.normalized_rank(n, "generation", "id").select("id", "rank01")) == [("a", 0.0), ("b", 1.0), ("c", 0.0)]
    w = spark.createDataFrame([("k", 0, 5.0), ("k", 1, 7.0), ("k", 2, 1.0)], "k string, g int, w double")
    assert [r["offset"] for r in gr.running_offset(w, "k", "g", "w", 1.0).orderBy("g").collect()] == [0.0, 6.0, 14.0]
    t = spark.createDataFrame([("a", 60.0, 20.0), ("b", 50.0, 50.0), ("c", 40.0, 10.0)], "id string, width double, height double")
    assert rows(gr.shelf_pack(t, 100.0, 0.0).select("id", "x", "y")) == [("a", 0.0, 50.0), ("b", 0.0, 0.0), ("c", 60.0, 50.0)]


def test_optimiser_never_worsens():
    rng = random.Random(2)
    for _ in range(10):
        n = {g: [f"{g}{i}" for i in range(5)] for g in range(3)}
        e = [(rng.choice(n[g]), rng.choice(n[g + 1])) for g in range(2) for _ in range(6)] + [(n[0][0], n[2][4])]
        best, before, after = lo.optimise(n, e)
        assert after <= before and {g: sorted(x) for g, x in best.items()} == n
    v = [rng.randrange(9) for _ in range(60)]
    assert lo.inversions(v) == sum(a > b for a, b in combinations(v, 2))
    assert lo.crossings({0: ["a", "b"], 1: ["c", "d"]}, [("a", "d"), ("b", "c")]) == 1
    assert lo.crossings({0: ["a", "b"], 1: ["c", "d"]}, [("a", "c"), ("a", "d")]) == 0


def test_optimised_rows(spark):
    placed = spark.createDataFrame([("k", 0, "a"), ("k", 0, "b"), ("k", 1, "c"), ("k", 1, "d"), ("l", 0, "z")], "component string, generation int, id string")
    e = edges(spark, ("a", "d", M), ("b", "c", M))
    got = {r["id"]: (r["before"], r["after"]) for r in lo.optimised_rows(placed, e).collect()}
    assert got["a"] == (1, 0) and got["z"] == (0, 0)
    assert {r["before"] for r in lo.optimised_rows(placed, e, 1).where("component = 'k'").collect()} == {None}


def test_large_families_are_swept_too(spark):
    rng = random.Random(8)
    size = 22
    ids = {k: [[f"{k}{g}-{i:02}" for i in range(size)] for g in range(4)] for k in "kl"}
    placed = spark.createDataFrame([(k, g, n) for k, gs in ids.items() for g, ns in enumerate(gs) for n in ns] + [("z", 0, "z")], "component string, generation int, id string")
    links = {(rng.choice(gs[g]), rng.choice(gs[min(3, g + rng.choice((1, 1, 2)))])) for gs in ids.values() for g in range(3) for _ in range(25)}
    e = edges(spark, *((a, b, M) for a, b in sorted(links)))
    one = rows(lo.optimised_rows(placed, e))
    assert rows(lo.optimised_rows(placed, e, alone=60)) == one
    assert all(r[4] > r[5] for r in one if r[0] != "z")
    wide = spark.createDataFrame([("w", g, f"{g}-{i:04}") for g in range(2) for i in range(1_200)], "component string, generation int, id string")
    turned = edges(spark, *((f"0-{i:04}", f"1-{1199 - i:04}", M) for i in range(1_200)))
    assert {(r["before"], r["after"]) for r in lo.optimised_rows(wide, turned).select("before", "after").distinct().collect()} == {(1_200 * 1_199 // 2, 0)}


def swapped(level, links, rounds=2):
    """Every swap of neighbours tried in turn, all crossings counted again."""
    level = {g: list(ns) for g, ns in level.items()}
    for _ in range(rounds):
        for ns in level.values():
            for i in range(len(ns) - 1):
                least = lo.crossings(level, links)
                ns[i : i + 2] = ns[i + 1], ns[i]
                if lo.crossings(level, links) >= least:
                    ns[i : i + 2] = ns[i + 1], ns[i]
    return level


def test_swaps_count_what_changes():
    rng = random.Random(12)
    for _ in range(60):
        level = {g: [f"{g}-{i:02}" for i in range(rng.randrange(1, 12))] for g in sorted(rng.sample(range(9), rng.randrange(1, 6)))}
        every = [n for ns in level.values() for n in ns]
        links = sorted({(rng.choice(every), rng.choice(every)) for _ in range(rng.randrange(60))})
        assert lo.swap_neighbours(level, links) == swapped(level, links)


@pytest.mark.parametrize("size", [12, 30, 105])
def test_families_of_every_size_are_searched_alike(spark, size):
    rng = random.Random(size)
    level = {g: [f"{g}-{i:03}" for i in range(size)] for g in range(5)}
    links = sorted({(rng.choice(level[g]), rng.choice(level[min(4, g + rng.choice((1, 1, 1, 3)))])) for g in range(4) for _ in range(size)})
    placed = spark.createDataFrame([("k", g, n) for g, ns in level.items() for n in ns], "component string, generation int, id string")
    want = lo.sweep(level, links, 8)
    if size < 100:
        want = swapped(want, links)
    else:
        want = lo.swap_neighbours(want, links)
        assert lo.crossings(want, links) < lo.crossings(lo.sweep(level, links, 8), links)
    count = (lo.crossings(level, links), lo.crossings(want, links))
    want = sorted(("k", g, n, i, *count) for g, ns in want.items() for i, n in enumerate(ns))
    e = edges(spark, *((a, b, M) for a, b in links))
    for more in ({}, {"named": 10}, {"named": 1_000}) + (({"alone": 10},) if size < 20 else ()):
        assert rows(lo.optimised_rows(placed, e, **more)) == want


def test_sweeps_by_number(spark):
    rng = random.Random(11)
    for _ in range(30):
        size = [rng.randrange(1, 12) for _ in range(6)]
        level = {g: [f"{g}-{i:02}" for i in range(n)] for g, n in enumerate(size)}
        every = [n for ns in level.values() for n in ns]
        links = sorted({(a, b) if a < b else (b, a) for a, b in (rng.sample(every, 2) for _ in range(50)) if a[0] != b[0]}) if len(every) > 1 else []
        at = {n: k for k, n in enumerate(every)}
        best, before, after = lo.sweep_by_number(np.array([int(n[0]) for n in every]), np.array([int(n[2:]) for n in every]), np.array([(at[a], at[b]) for a, b in links], int).reshape(-1, 2), 8)
        want = lo.sweep(level, links, 8)
        assert dict(zip(every, best.tolist())) == {n: i for ns in want.values() for i, n in enumerate(ns)}
        assert (before, after) == (lo.crossings(level, links), lo.crossings(want, links))
    group = np.sort(np.array([rng.randrange(5) for _ in range(200)]))
    v = np.array([rng.randrange(30) for _ in range(200)])
    assert lo._inversions_within(group, v) == sum(lo.inversions(v[group == g].tolist()) for g in range(5))


def test_large_families_are_ordered_without_a_job_per_row(spark):
    depth = 60
    placed = spark.createDataFrame([("k", g, f"{g:02}-{i}") for g in range(depth) for i in range(10)] + [("s", 3, "s"), ("t", 0, "t"), ("t", 1, "u")], "component string, generation int, id string")
    e = edges(spark, *((f"{g:02}-{i}", f"{g + 1:02}-{9 - i}", M) for g in range(depth - 1) for i in range(10)), ("t", "u", M))
    got, n = jobs(spark, lambda: rows(lo.optimised_rows(placed, e)))
    assert n < 60 and {r[4:] for r in got if r[0] == "k"} == {(45 * (depth - 1), 0)} and {r[3:] for r in got if r[0] != "k"} == {(0, 0, 0)}
    assert rows(lo.optimised_rows(placed, e, named=1_000)) == got


def test_geometry_against_brute_force(spark):
    rng = random.Random(4)
    s = [(i, i % 3, float(rng.randrange(2000)), float(rng.randrange(2000)), float(rng.randrange(2000)), float(rng.randrange(2000))) for i in range(40)] + [(99, 5, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(s, "id int, `group` int, x1 double, y1 double, x2 double, y2 double")
    side = lambda a, x, y: (a[4] - a[2]) * (y - a[3]) - (a[5] - a[3]) * (x - a[2])
    want = [(a[0], b[0]) for a, b in combinations(s, 2) if a[1] != b[1] and side(a, b[2], b[3]) * side(a, b[4], b[5]) < -1e-8 and side(b, a[2], a[3]) * side(b, a[4], a[5]) < -1e-8]
    assert rows(ge.segment_crossings(df, 300.0)) == sorted(want, key=str)
    n = [(i, i % 2, float(rng.randrange(3000)), float(rng.randrange(200))) for i in range(60)]
    ndf = spark.createDataFrame(n, "id int, row int, x double, y double")
    assert rows(ge.overlaps(ndf)) == sorted([(a[0], b[0]) for a, b in combinations(n, 2) if a[1] == b[1] and abs(a[2] - b[2]) < 176 and abs(a[3] - b[3]) < 74], key=str)
    box = spark.createDataFrame([("q", 50.0, 50.0), ("far", 900.0, 900.0)], "id string, x double, y double")
    line = spark.createDataFrame([("l", "a", "b", 0.0, 0.0, 100.0, 100.0), ("m", "q", "b", 0.0, 0.0, 100.0, 100.0), ("n", "a", "b", 0.0, 90.0, 100.0, 95.0)], "id string, `from` string, `to` string, x1 double, y1 double, x2 double, y2 double")
    assert rows(ge.edge_box_hits(line, box, 20.0, 20.0, 64.0)) == [("l", "q")]
    c = [F.col(k) for k in ("x1", "y1", "x2", "y2")]
    assert abs(df.where("id = 99").select(ge.route_length(*c)).first()[0]) < 1e-9
    p = ndf.select("id", "x", "y")
    best = min(n, key=lambda r: (((r[2] - 1500) ** 2 + (r[3] - 100) ** 2) ** 0.5, r[0]))
    assert [r["id"] for r in ge.nearest(p, 1500, 100, 900).collect()] == [best[0]]
    assert ge.nearest(p, 90_000, 0, 5).count() == 0 and ge.nearest_k(p, 1500, 100, 3).count() == 3
    assert ge.viewport(p, 0, 0, 1000, 100).count() == sum(0 <= r[2] <= 1000 and 0 <= r[3] <= 100 for r in n)
