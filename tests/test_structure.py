"""Hierarchies, nested documents and orphan references on small cases."""

import json
import random
from datetime import datetime

import numpy as np
from conftest import rows

from kinweft.operators.components import components
from kinweft.operators.flatten import date_written, flatten, read_document, related_tables
from kinweft.operators.hierarchy import conflicting_parents, descendants, hierarchy
from kinweft.operators.orphans import orphans, pack_bits, parent_list, reference_list, unpack_bits

EDGE = "tree string, parent string, child string"


def brute(edges):
    up = {}
    for t, p, c in edges:
        if p is not None and c is not None:
            up[t, c] = min(p, up.get((t, c), p))
    out = {}
    for t, n in {(t, x) for t, p, c in edges if p is not None and c is not None for x in (p, c)}:
        seen, k = [], n
        while k not in seen and (t, k) in up:
            seen.append(k)
            k = up[t, k]
        if k in seen:
            ring = seen[seen.index(k):]
            out[t, n] = (min(ring), 0, "on_cycle") if n in ring else (min(ring), seen.index(k), "below_cycle")
        else:
            out[t, n] = (k, len(seen), "rooted")
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    edges = [("m", f"n{rng.randrange(i) if i > 3 else (i + 1) % 3}", f"n{i}") for i in range(60)]
    edges += [("f", f"c{i}", f"c{i + 1}") for i in range(40)] + [("f", "x", "x"), ("f", "x", "y"), ("f", None, "z"), ("f", "z", None)]
    edges += edges[:5]
    e = spark.createDataFrame(edges, EDGE)
    told = [{(r["tree"], r["node"]): (r["root"], r["depth"], r["state"], r["subtree_size"], tuple(r["path"])) for r in hierarchy(e, with_path=True, small=small).collect()} for small in (0, 20, 1000)]
    assert {n: x[:3] for n, x in told[0].items()} == brute(edges)
    assert told[0] == told[1] == told[2]


def test_hierarchy_paths_sizes_and_descendants(spark):
    e = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "b", "d"), ("t", "c", "e")], EDGE)
    got = {r["node"]: (r["path"], r["subtree_size"]) for r in hierarchy(e, with_path=True).collect()}
    assert got["e"] == (["a", "b", "c", "e"], 1) and got["b"] == (["a", "b"], 4) and got["a"] == (["a"], 5)
    assert rows(descendants(e))[0] == ("t", "a", "b", 1) and descendants(e).count() == 8


def test_hierarchy_empty_and_extra_columns(spark):
    assert hierarchy(spark.createDataFrame([], EDGE)).count() == 0
    e = spark.createDataFrame([("t", "a", "b", "q", 1)], EDGE + ", node string, depth int")
    assert hierarchy(e).count() == 2
    two = spark.createDataFrame([("t", "a", "c"), ("t", "b", "c")], EDGE)
    assert rows(conflicting_parents(two)) == [("t", "c", 2)]
    assert {r["root"] for r in hierarchy(two).where("node = 'c'").collect()} == {"a"}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200, i) for i in range(201, 240)] + [(None, 3), (7, 7)]
    parent = {n: n for e in edges for n in e if n is not None} | {500: 500}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(components(spark.createDataFrame(edges, "src int, dst int"), nodes=spark.createDataFrame([(500,)], "node int"))))
    assert got == {n: find(n) for n in parent}


def doc(**more):
    return json.dumps({"animals": [{"id": "a1", "aliases": ["x", None, {"value": "y", "language": "en"}], "events": [{"id": "e1", "date": {"start": "2001", "end": "2002"}}]}, None, {"id": "a2"}]} | more)


def test_flatten_positions_and_parents(spark):
    data = [(1, "t", doc(events=[{"id": "e9", "animal_id": "a2", "date": "2003"}])), (2, "t", '{"animals": {"k1": {"aliases": {"en": ["p", "q"], "de": ["r"]}}, "k2": {"aliases": {"value": "lone", "language": "en"}}}}')]
    got = {(r["tag"], r["pk"]): (r["parent_id"], r["pos"]) for r in flatten(spark.createDataFrame(data, "payload_id long, atlas_id string, payload string")).collect()}
    assert got["animal", "a1"] == ("t", 0) and got["animal", "a2"] == ("t", 2)
    assert got["alias", "x"] == ("a1", 0) and got["alias", "y"] == ("a1", 2)
    assert got["event", "e1"] == ("a1", 0) and got["date", "2001/2002"] == ("e1", 0)
    assert got["event", "e9"] == ("a2", 0) and got["date", "2003"] == ("e9", 0)
    assert got["alias", "r"] == ("k1", 2) and got["alias", "lone"] == ("k2", 0) and got["animal", "k2"] == ("t", 1)


def test_flatten_envelopes_and_unreadable(spark):
    whole = json.loads(doc())
    for wrapped in (doc(), json.dumps(doc()), json.dumps({"sent_by": "x", "document": whole}), json.dumps({"meta": 1, "data": {"atlas": whole}})):
        assert read_document(wrapped)["animals"][0]["id"] == "a1"
    bad = [None, "", "  ", "null", "[1]", "<html>", doc()[:-4], '"text"', "{}"]
    data = [(i, None, p) for i, p in enumerate(bad)] + [(None, None, doc())]
    got = flatten(spark.createDataFrame(data, "payload_id long, atlas_id string, payload string"))
    assert {r["doc_key"] for r in got.collect()} == {None}
    assert flatten(spark.createDataFrame([], "payload_id long, atlas_id string, payload string")).count() == 0
    tables = related_tables(spark.createDataFrame(data + [(77, "t", doc())] * 2, "payload_id long, atlas_id string, payload string"))
    assert tables["event"].where("doc_key = 77").count() == 2 and tables["date"].select("x.start").where("start = '2001'").count() == 3


def test_date_written():
    assert date_written(["2001", "2002"]) == "2001/2002" and date_written({"value": "2001", "start": "x"}) == "2001"
    assert date_written({"precision": "unknown"}) is None and date_written("") is None and date_written(None) is None


def test_packed_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500, 5_000, 32_768):
        flags = np.zeros(32_768, bool)
        flags[rng.choice(32_768, n, replace=False)] = True
        assert (unpack_bits(pack_bits(np.packbits(flags, bitorder="little").tobytes())) == flags).all()


def test_orphans_reasons(spark):
    d = lambda *a: datetime(*a)
    refs = spark.createDataFrame(
        [("r1", " K1 ", d(2024, 5, 10)), ("r1", " K1 ", d(2024, 6, 1)), ("r2", "k2", d(2024, 5, 10)), ("r3", "k3", d(2024, 5, 10)), ("r4", "gone", d(2024, 5, 10)), ("r5", "", d(2024, 5, 10)), ("r6", None, None), ("r7", "gone", None), ("r8", "k4", d(2024, 5, 10))],
        "id string, ref string, loaded_at timestamp",
    )
    parents = spark.createDataFrame([("k1", d(2024, 5, 1), None), ("K2", d(2024, 5, 11), None), ("k3", d(2024, 1, 1), d(2024, 5, 9)), ("k4", d(2024, 5, 9), d(2024, 5, 11)), (None, None, None)], "id string, loaded_at timestamp, deleted_at timestamp")
    lit = __import__("pyspark.sql.functions", fromlist=["lit"]).lit
    got = orphans(reference_list(refs, "id", "ref", "t", "ref").withColumn("target", lit("p")), parent_list(parents).withColumn("target", lit("p")))
    assert rows(got.select("record_id", "ref_id", "reason", "load_month")) == [("r2", "k2", "late", "2024-05"), ("r3", "k3", "deleted", "2024-05"), ("r4", "gone", "missing", "2024-05"), ("r7", "gone", "missing", None)]
    none = parent_list(parents.limit(0)).withColumn("target", lit("p"))
    assert orphans(reference_list(refs, "id", "ref", "t", "ref").withColumn("target", lit("p")), none).count() == 6
