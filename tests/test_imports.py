"""Foreign graphs taken in: places, names, edges, photos, vertices; documents' own rules; focused views."""

import random

import pytest
from conftest import rows

from kinweft.operators import graph as gr
from kinweft.operators import imports as im
from kinweft.operators import layout as lo
from kinweft.operators import validate as va


def df(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_places(spark):
    own = df(spark, "id string, name string", ("i1", "Zoo Berg"), ("i1", "Bergzoo"), ("i2", "Park A"), ("i3", "Park-A"), ("new-7", "x"), (None, "y"), ("i4", None))
    foreign = df(spark, "id string, name string", ("1", "ZOO BERG"), ("2", "park a"), ("7", "other"), ("-7", None), ("9", "Zoo Berg"), ("9", "Zoo Berg"), (None, "z"))
    got = {r["old"]: tuple(r)[1:] for r in im.merge_places(own, foreign, df(spark, "old string, new string", ("9", "i4")), "new-").collect()}
    assert got == {"1": ("i1", "matched_name", ""), "2": ("new-2", "ambiguous_name", "i2,i3"), "-7": ("new-7-2", "new", ""), "7": ("new-7-3", "new", ""), "9": ("i4", "reviewed", "")}
    assert im.merge_places(own, foreign.limit(0), df(spark, "old string, new string"), "new-").count() == 0


def test_suffixes_go_round_taken_ids(spark):
    x = df(spark, "base string, o int", ("a", 1), ("a", 2), ("a", 3), ("b", 1))
    taken = df(spark, "id string", ("a",), ("a-3",), (None,))
    got = sorted((r["base"], r["o"], r["final_id"]) for r in im.suffixed_ids(x, "base", "o", taken).collect())
    assert got == [("a", 1, "a-2"), ("a", 2, "a-4"), ("a", 3, "a-5"), ("b", 1, "b")]


def test_edges_have_one_outcome(spark):
    e = df(spark, "id string, animal string, place string", ("1", "a", "p"), ("2", "b", "p"), ("3", "b", "q"), ("4", "none", "p"), ("5", "x", "p"), ("6", "c", "none"), ("7", "d", "?"), ("8", "f", "w"), ("9", "g", "w"), ("10", "h", "p"), ("11", None, None))
    a = df(spark, "old string, new string", *[(k, k.upper()) for k in "abcdfgh"])
    p = df(spark, "old string, new string", ("p", "P"), ("q", "Q"))
    assert {r["id"]: r["status"][9 if r["status"][0] == "e" else 7 :] for r in im.holding_outcomes(e, a, p).collect()} == {"1": "holding", "2": "several_places", "3": "several_places", "4": "unknown_animal", "5": "unmapped_animal", "6": "unknown_place", "7": "unmapped_place", "8": "unmapped_place", "9": "unmapped_place", "10": "holding", "11": "unmapped_animal"}
    born = df(spark, "animal string, born string", ("a", "2020"), ("f", "2021"), ("b", "2020"))
    got = {r["id"]: r["status"] for r in im.birthplace_outcomes(e, a, p, born, df(spark, "place string", ("w",))).collect()}
    assert got["1"] == "mapped_birth" and got["2"] == "excluded_several_places" and got["8"] == "mapped_birth_without_place" and got["9"] == "excluded_wild_without_birth" and got["10"] == "excluded_no_birth" and got["6"] == "excluded_unknown_place" and len(got) == 11


def test_names_photos_and_vertices(spark):
    own = df(spark, "id string, canonical string, localized array<struct<value:string,language:string>>, aliases array<struct<value:string,language:string>>", ("a", "Momo", [("桃", "ja")], [("Mo-Mo", "en"), ("Peach", "en")]), ("b", None, None, None))
    inc = df(spark, "id string, kind string, language string, value string", ("a", "localized", "ja", "桃"), ("a", "localized", "zh", "桃"), ("a", "localized", "en", "Momo"), ("a", "alias", "en", "PEACH"), ("a", "alias", "en", "Pip"), ("a", "alias", "de", "pip!"), ("b", "alias", "en", "Q"), ("b", "alias", None, " "), ("z", "alias", "en", "Q"))
    assert [tuple(r) for r in rows(im.attach_names(own, inc))] == [("a", "alias", "de", "pip!"), ("a", "localized", "zh", "桃"), ("b", "alias", "en", "Q")]
    photos = df(spark, "vertex string, kind string, place int, page string, direct string, owners array<string>", ("v", "media", 1, "https://p/1", None, ["a", "b", "x"]), ("v", "media", 2, "file:x", "https://d/2", ["a", "a"]), ("w", "media", 1, None, "x", ["a"]), ("u", "media", 1, "https://p/1", None, None), ("o", "other", 1, "https://p/1", None, ["a"]))
    out = im.photo_outcomes(photos, df(spark, "old string, new string", ("a", "A"), ("b", "B")))
    assert {(r["vertex"], r["place"]): (r["status"], r["targets"]) for r in out.collect()} == {("v", 1): ("mapped_media", ["A", "B"]), ("v", 2): ("mapped_media", ["A"]), ("w", 1): ("excluded_no_web_address", ["A"]), ("u", 1): ("excluded_unmapped_owner", []), ("o", 1): ("excluded_no_animal", ["A"])}
    assert sorted((r["animal_id"], r["page"]) for r in im.expand_media(out, "https://e/").collect()) == [("A", "https://e/"), ("A", "https://p/1"), ("B", "https://p/1")]
    v = df(spark, "id string, kind string", ("a", "animal"), ("x", "animal"), ("p", "place"), ("v", "media"), ("w", "media"), ("u", "media"), ("n", "none"), ("l", "links"), ("?", None))
    m = lambda *x: df(spark, "old string, new string, status string", *x)
    got = {r["id"]: r["status"] for r in im.vertex_outcomes(v, m(("a", "A", "matched")), m(("p", "P", "new")), df(spark, "vertex string, n_animals int, n_media int", ("v", 1, 1), ("w", 1, 0))).collect()}
    assert got == {"a": "matched", "x": "excluded_unmapped_animal", "p": "new", "v": "mapped_media", "w": "excluded_no_photo", "u": "excluded_photo_only", "n": "excluded_unknown_marker", "l": "excluded_link", "?": "excluded_other"}


def test_strict_list(spark):
    r = df(spark, "id string, a string, s string", ("1", "x", "ok"), ("2", None, "ok"), ("3", "z", "no"))
    assert im.strict_allowed(df(spark, "id string, a string", ("1", "x"), ("2", None), ("9", "q")), r, "id", ["a"], {"s": "ok"}).count() == 2
    for bad in (("1", "y"), ("3", "z")):
        with pytest.raises(Exception, match="record does not agree"):
            im.strict_allowed(df(spark, "id string, a string", bad), r, "id", ["a"], {"s": "ok"}).collect()


def test_release_coverage_claims_and_shapes(spark):
    rel = "document string, schema_version string, data_version string, engine_version string, build_date string, provenance string"
    assert rows(va.release_issues(df(spark, rel, ("d", "1", "1", " ", "2020-02-30", "p"), ("e", "1", "1", "1", "2020-02-28", "p"))).select("code", "path")) == [("invalid_release", "$.release[d].engine_version"), ("invalid_release_date", "$.release[d].build_date")]
    cov = "document string, taxon string, scope string, limitations array<string>, last_reviewed string, translations map<string,struct<scope:string,limitations:array<string>>>"
    good = ("g", "t", "s", ["a", "b"], "2020-01-01", {"ja": ("s", ["x", "y"]), "ru": ("s", ["x", "y"])})
    bad = ("b", "", "s", ["a", "b"], "2020", {"ja": ("", ["x"]), "fr": ("s", [])})
    got = rows(va.coverage_issues(df(spark, cov, good, bad, ("c", "t", "s", None, "2020-01-01", None))).select("code", "path"))
    assert got == [("invalid_coverage", "$.coverage[b].taxon"), ("invalid_coverage", "$.coverage[c].limitations"), ("invalid_coverage_date", "$.coverage[b].last_reviewed"), ("invalid_coverage_translation", "$.coverage[b].translations.ja.limitations"), ("invalid_coverage_translation", "$.coverage[b].translations.ja.scope"), ("missing_coverage_translation", "$.coverage[b].translations.ru"), ("missing_coverage_translation", "$.coverage[c].translations")]
    claims = df(spark, "id string, claim_type string, status string, source_ids array<string>, review struct<status:string,reviewed_on:string,notes:string>", ("1", " ", "x", [], None))
    assert {r["code"] for r in va.claim_issues(claims).collect()} == {"invalid_claim", "invalid_claim_status", "missing_evidence", "invalid_review"}
    t = df(spark, "path string, text string", ("x", '{"animals": {}, "claims": [1, {}], "events": [{}], "media": null}'), ("y", "{"), ("z", None))
    assert rows(va.shape_issues(t, ("animals", "claims", "events", "media", "sources")).select("code", "path")) == [("invalid_collection", "$[x].animals"), ("invalid_record", "$[x].claims")]


def test_focused_walks_alike(spark):
    rng = random.Random(5)
    data = [(f"e{k:02}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for k in range(26)] + [("x", None, "n1")]
    e = df(spark, "id string, subject string, object string", *data)
    for depth, cap in ((2, 4), (1, 3), (3, None)):
        one, many = ([tuple(r) for r in rows(gr.focused(e, "n1", depth, cap, small=s))] for s in (1000, 0))
        assert one == many and (cap is None or len(one) <= cap), (depth, cap)


def test_couples_and_precedence():
    assert lo.precedence(["a", "b", "c", "d"], [("d", "a"), ("b", "a")]) == ["b", "c", "d", "a"]
    assert lo.precedence(["a", "b", "c"], [("a", "b"), ("b", "a")]) == ["c", "a", "b"]
    assert lo.couples({0: ["f", "x", "m", "y"]}, [("m", "f"), ("y", "f")]) == {0: ["x", "m", "y", "f"]}
    rows_, before, after = lo.focused_order({0: ["a", "b"], 1: ["c", "d"]}, [("a", "d"), ("b", "c")], [])
    assert (before, after) == (1, 0) and sorted(rows_) == [0, 1]
