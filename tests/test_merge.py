"""Merging, integrity rules, scans, audits, documents and the rate limiter on small cases."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweft.operators import audit, scan
from kinweft.operators import merge as me
from kinweft.operators import validate as va
from kinweft.sources import documents as dc
from kinweft.streaming.rate_limit import rate_limit, step


def df(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_unions_and_conflicts(spark):
    a, b = df(spark, "id string, v string", ("1", "x"), ("2", "y")), df(spark, "id string, v string", ("2", "z"), ("3", "w"), ("3", "w"))
    assert rows(me.ordered_union(a, b, ["id"], "v")) == [("1", "x", 0), ("2", "y", 0), ("3", "w", 1)]
    m = me.merge_by_id(a, b.distinct(), "id", ["v"], strict=False)
    assert rows(m.select("id", "state")) == [("1", "kept"), ("2", "conflict"), ("3", "added")]
    with pytest.raises(Exception, match="records differ: 2"):
        me.merge_by_id(a, b.distinct(), "id", ["v"]).collect()
    assert rows(me.conflicts(a, b.distinct(), "id", ["v"])) == [("2", "v", "y", "z")]
    assert me.conflicts(a, df(spark, "id string, v string", ("2", "unknown"), ("1", None)), "id", ["v"]).count() == 0
    e = df(spark, "id string, s string, source_ids array<string>", ("b", "k", ["2", "1"]), ("a", "k", ["2"]), ("c", "l", []), ("d", "m", None))
    assert rows(me.semantic_dedup(e, ["s"], "id")) == [("k", "a", 2, "1,2"), ("l", "c", 1, ""), ("m", "d", 1, "")]
    assert rows(me.event_upsert(e.limit(1), e, ["s"])) == [("k", "1,2", "cited"), ("l", "", "inserted"), ("m", "", "inserted")]
    z = df(spark, "k array<string>, v array<int>", (["a", "b", "a"], [1, 2, 3]))
    assert [tuple(x) for x in z.select(me.aligned_dedup(F.col("k"), F.col("v"))).first()[0]] == [("a", 1), ("b", 2)]


def test_every_edge_has_one_outcome(spark):
    e = df(spark, "id string, child string, parent string, label string", ("1", "c", "m", "family"), ("2", "c", "m", "family"), ("3", "c", "f", "family"), ("4", "?", "m", "family"), ("5", "c", "?", "family"), ("6", "?", "!", "family"), ("7", "c", "c", "family"), ("8", "c", "m", "zoo"), ("9", None, "m", "family"))
    n = df(spark, "id string, sex string", ("c", None), ("m", "female"), ("f", "male"))
    d = me.edge_classify(e, n)
    got = {r["id"]: r["outcome"] for r in d.collect()}
    assert got == {"1": "mapped_mother", "2": "mapped_repeated", "3": "mapped_father", "4": "excluded_unknown_child", "5": "excluded_unknown_parent", "6": "excluded_both_unknown", "7": "excluded_self_parent", "8": "excluded_label", "9": "excluded_unknown_child"}
    assert all(r["n_source"] == r["n_mapped"] + r["n_excluded"] for r in audit.edge_accounting(d).collect())


def test_identity_fixpoint(spark):
    f = df(spark, "id string, k string", ("fg", "g"), ("fp", "p"), ("fc", "c"), ("t1", "t"), ("t2", "t"))
    o = df(spark, "id string, k string", ("og", "g"), ("op", "p"), ("oc", "c"), ("ot", "t"))
    fp, op = df(spark, "child string, parent string", ("fp", "fg"), ("fc", "fp")), df(spark, "child string, parent string", ("op", "og"), ("oc", "op"))
    got = me.identity_fixpoint(f, o, df(spark, "foreign string, own string"), fp, op, ["k"])
    assert rows(got) == [("fc", "oc"), ("fg", "og"), ("fp", "op")]


def test_rules(spark):
    animal = "id string, taxon string, sex string, status string, population string, name struct<canonical:string,language:string,source_ids:array<string>,localized:array<struct<value:string,language:string,source_ids:array<string>>>>, aliases array<struct<value:string,language:string,source_ids:array<string>>>, external_ids array<struct<namespace:string,value:string>>, review struct<status:string,reviewed_on:string,notes:string>"
    good = ("a", "Ailurus fulgens", "male", "living", None, ("N", "en", ["s"], [("M", "ja", ["s"])]), [("O", "en", ["s"])], [], ("reviewed", "2020-01-31", ""))
    assert va.animal_issues(df(spark, animal, good)).count() == 0
    for k, (at, value, code) in enumerate([(1, " ", "invalid_animal"), (2, "x", "invalid_animal"), (3, None, "invalid_animal"), (4, "x", "invalid_population"), (5, ("N", "en", [], None), "missing_evidence"), (5, ("N", "en", ["s"], [("M", "ja", None)]), "missing_evidence"), (6, [("", "en", ["s"])], "invalid_alias"), (6, [("x", "en", None)], "missing_evidence"), (8, ("x", "2020-01-31", None), "invalid_review"), (8, ("reviewed", "2020-02-30", ""), "invalid_review_date"), (8, ("reviewed", "2020-02-28", None), "invalid_review")]):
        bad = list(good)
        bad[at] = value
        assert [r["code"] for r in va.animal_issues(df(spark, animal, tuple(bad))).collect()] == [code], k
    rel = "id string, subject string, object string, type string, status string, source_ids array<string>, review struct<status:string,reviewed_on:string,notes:string>"
    assert rows(va.relation_issues(df(spark, rel, ("r", "a", "a", "social", "confirmed", ["s"], ("reviewed", "2020-01-31", "")))))[0][:2] == ("self_ancestry", "$.relationships[r].object")
    keys = [("one", df(spark, "id string", ("x",), ("x",), (None,)), "id"), ("two", df(spark, "id string", ("x",), ("y",)), "id")]
    assert rows(va.duplicates(keys).select("code", "path")) == [("duplicate_id", "$.one[x].id"), ("duplicate_internal_id", "$.two[x].id")]


def test_scans_and_audits(spark):
    t = df(spark, "id int, t string", (1, '<img src="a/b.png"> url(x.jpg) https://q.example/z <img src="https://q/y.png">'), (2, None), (3, ""))
    assert {(r["kind"]) for r in scan.content_scan(t, "id", "t").collect()} == {"local_image", "css_url", "web_url"}
    j = df(spark, "id int, p string", (1, '{"a": [{"photo": "x.png"}], "path": "y", "path2": 3}'), (2, "{"), (3, None))
    assert rows(scan.key_scan(j, "id", "p", ("photo", "path"), photos=False)) == [("1", "$.a[0].photo", "x.png"), ("1", "$.path", "y")]
    m = df(spark, "id int, p string", (1, '{"a": {"local_path": "x/Y.JPG?v=1", "relative_path": "z.txt", "my_local_path": "q.png"}, "m": [{"direct_remote_url": "https://h.example/x.png"}, {"direct_remote_url": "http://localhost/x.png"}, {"direct_remote_url": "data:image/png;x"}, {"direct_remote_url": "x.png"}, {"direct_remote_url": ""}]}'))
    assert [r[1] for r in rows(scan.key_scan(m, "id", "p"))] == ["$.a.local_path", "$.m[1].direct_remote_url", "$.m[2].direct_remote_url", "$.m[3].direct_remote_url"]
    n = df(spark, "g string, v int", *[("g", i) for i in range(1, 121)])
    assert tuple(audit.latency_summary(n, "g", "v").first())[1:] == (60, 114, 60.5, 120)
    arr = df(spark, "a array<int>", ([1, 2, 4, 9],), ([3],), ([],))
    assert [r[0] for r in arr.select(audit.even_median(F.col("a"))).collect()] == [3, 3, None]


def minimal():
    return {"release": {"schema_version": "1"}, "coverage": {"taxon": "t"}, "animals": [{"id": "a", "name": {"canonical": "N"}}, {"id": "b"}], "claims": [{"id": "c", "value": {"x": [1]}}], "relationships": [], "events": [], "institutions": [], "media": [], "sources": []}


def test_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text(dc.document_text(minimal()))
    (tmp_path / "bad.json").write_text("{nope")
    got = dc.read_documents(spark, str(tmp_path))
    assert rows(got["animals"].select("_ord", "id")) == [(0, "a"), (1, "b")] and got["claims"].count() == 1 and got["media"].count() == 0
    assert dc.bad_documents(dc.read_texts(spark, str(tmp_path))).count() == 1
    assert dc.unexpected_members(dc.read_texts(spark, str(tmp_path / "good.json"))).count() == 0
    extra = {k: v for k, v in minimal().items() if k != "media"} | {"zoo": 1}
    (tmp_path / "extra.json").write_text(json.dumps(extra))
    assert rows(dc.unexpected_members(dc.read_texts(spark, str(tmp_path / "extra.json"))).select("member", "code")) == [("media", "missing_collection"), ("zoo", "unexpected_field")]
    raw = (tmp_path / "good.json").read_bytes()
    assert dc.read_pinned(spark, str(tmp_path / "good.json"), hashlib.sha256(raw).hexdigest(), len(raw)).count() == 1
    with pytest.raises(Exception, match="not the pinned file"):
        dc.read_pinned(spark, str(tmp_path / "good.json"), "0", len(raw)).collect()
    assert dc.read_optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    out = str(tmp_path / "chunks")
    dc.write_chunks(spark.range(5).withColumn("chunk_id", F.col("id") % 2), out)
    assert spark.read.parquet(out).where("chunk_id = 1").count() == 2
    target = str(tmp_path / "site")
    dc.publish(spark.range(3), target)
    dc.publish(spark.range(4), target)
    assert spark.read.parquet(target).count() == 4
    assert rows(dc.json_lines(df(spark, "a int, b string", (1, None)))) == [('{"a":1}',)]


def brute(arrivals, limit, window):
    out, state = [], {}
    for k, at, _ in sorted(arrivals):
        s, ok, wait = step(state.get(k), int(at.timestamp() * 1e6), limit, window * 1_000_000)
        state[k] = s
        out.append((k, ok, wait))
    return out


def test_rate_limit_batch(spark):
    t = datetime(2024, 1, 1)
    arrivals = [("a", t + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 59, 60, 61, 200])] + [("b", t, 1)]
    data = spark.createDataFrame([*arrivals, (None, t, 1), ("c", None, 2)], "key string, at timestamp, order long")
    got = rate_limit(data, 3, 60).orderBy("key", "at", "order").collect()
    assert [(r["key"], r["allowed"], r["retry_after"]) for r in got] == brute(arrivals, 3, 60)
    assert [r["allowed"] for r in got][:8] == [True, True, True, False, False, True, True, True] and got[3]["retry_after"] == 57
