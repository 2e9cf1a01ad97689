"""Text, date and URL functions, search and index operators on small cases."""

from conftest import rows
from pyspark.sql import functions as F

from kinweft.functions import dates, text, urls
from kinweft.operators import index as ix
from kinweft.operators import search as se
from kinweft.session import id_key


def one(spark, schema, values, column):
    return [r[0] for r in spark.createDataFrame(values, schema).select(column).collect()]


def test_normalisers():
    assert text.search_text("  Schönbrunn   Zōo ") == "schonbrunn zoo" and text.search_text("カーガ") == "カカ"
    assert text.search_text(None) is None and text.search_text("") == "" and text.search_text("Straße") == "straße"
    assert text.merge_text("Straße 5-b") == "strasse5b" and text.facility_text(" ZOO  Berlin ") == "zoo berlin"
    assert text.legacy_text("名（めい）") == "名" and text.title_text("zoo_captive birth") == "Zoo Captive Birth"


def test_text_columns(spark):
    s = "v string"
    vals = [("a<b>&\"c'",), (None,), ("",)]
    assert one(spark, s, vals, text.html_escape(F.col("v"))) == ["a&lt;b&gt;&amp;&quot;c&#39;", None, ""]
    assert one(spark, s, [("--Ä b:c!-",), ("!!",), (None,)], text.safe_id(F.col("v"))) == ["b:c", "unknown", "unknown"]
    assert one(spark, s, [("Base (Reading)",), ("Plain",)], text.name_variants(F.col("v"))) == [["Base (Reading)", "Base", "Reading"], ["Plain"]]
    assert one(spark, s, [('"x"',), (None,), ("3",), ('{"a":1}',)], text.value_text(F.col("v"))) == ["x", "", "3", '{"a":1}']
    assert one(spark, s, [('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',)], text.canonical_hash(F.col("v")))[0] == one(spark, s, [('{"a":"é","b":1}',)], text.canonical_hash(F.col("v")))[0]
    assert one(spark, s, [("a",), ("other_thing",)], text.label(F.col("v"), {"a": "First"})) == ["First", "Other Thing"]


def test_dates(spark):
    s = "d struct<precision:string,value:string,start:string,end:string>"
    vals = [(("exact", "2020-02-29", None, None),), (("approximate", "2020", None, None),), (("range", None, "2019", "2020-05"),), (("range", None, "2019", None),), (("unknown", None, None, None),), (None,), (("range", None, "2021", "2020-12"),)]
    assert one(spark, s, vals, dates.date_label(F.col("d"))) == ["2020-02-29", "~2020", "2019–2020-05", None, None, None, "2021–2020-12"]
    assert one(spark, s, vals, dates.date_label_locale(F.col("d"), "en"))[2:5] == ["2019–2020-05", "2019–?", "Unknown"]
    assert one(spark, s, vals, dates.is_reversed_range(F.col("d"))) == [False] * 6 + [True]
    assert one(spark, s, vals, dates.sort_key(F.col("d"))) == ["2020-02-29", "2020", "2020-05", "2019", "", "", "2020-12"]
    t = "v string"
    given = [("2020.2.3",), ("2020/13",), ("2020-7",), ("1999",), ("2021-02-30",), ("",), (None,)]
    assert [tuple(x) if x else None for x in one(spark, t, given, dates.parse_foreign_date(F.col("v")))] == [("exact", "2020-02-03"), None, ("approximate", "2020-07"), ("approximate", "1999"), None, None, None]
    assert one(spark, t, [("2020-02-30",), ("0000",), ("2020-13",), ("2020-12",), (None,)], dates.is_partial_date(F.col("v"))) == [False, True, False, True, False]
    assert [x and x[0] for x in one(spark, t, [("2020-02-30",), ("2020",), ("x",)], dates.legacy_date(F.col("v")))] == ["exact", "approximate", None]


def test_urls(spark):
    t = "v string"
    given = [("https://a.example/x",), ("ftp://a",), ("http://",), ("not a url",), (None,), ("HTTP://A.example",)]
    assert one(spark, t, given, urls.is_web_url(F.col("v"))) == [True, False, False, False, False, True]
    ok = [("https://h.example/p/x.jpg",), ("https://h.example:8/p/x.jpg",), ("https://u@h.example/p/x.jpg",), ("https://h.example/p/x.jpg?q=1",), ("http://h.example/p/x.jpg",), ("https://h.example/q",)]
    assert one(spark, t, ok, urls.is_allowed_url(F.col("v"), "h.example", "/p/")) == [True] + [False] * 5
    assert one(spark, t, [("?animal=a%20b&x=1",), ("https://z.example/?x=1",)], urls.query_parameter(F.col("v"), "animal")) == ["a b", None]
    assert one(spark, t, [("a/b",), ("/a",), ("a\\..\\b",), (None,)], urls.is_safe_path(F.col("v"))) == [True, False, False, False]
    assert one(spark, t, [("8.8.8.8",), ("10.1.2.3",), ("192.168.0.1",), ("300.1.1.1",), (None,)], urls.is_public_ipv4(F.col("v"))) == [True, False, False, False, False]
    pair = spark.createDataFrame([("https://c.example/thumb/a/b/F%20x.jpg/320px-F x.jpg", "https://c.example/a/b/F%20x.jpg"), ("https://c.example/thumb/a/b/F.jpg/99px-F.jpg", "https://c.example/a/b/F.jpg")], "t string, o string")
    assert [r[0] for r in pair.select(urls.is_thumbnail_of(F.col("t"), F.col("o"), [320, 640], 640)).collect()] == [True, False]


ROW = "id string, taxon string, name struct<canonical:string,language:string,localized:array<struct<value:string,language:string>>>, aliases array<struct<value:string,language:string>>, external_ids array<struct<namespace:string,value:string>>, country_code string, institution_names array<string>, sex string, status string, population string, photo_confirmed boolean"


def search_rows(spark):
    return spark.createDataFrame(
        [
            ("r1", "Ailurus fulgens", ("Fūka", "en", [("風花", "ja")]), [], [("studbook", "77")], "JP", ["多摩"], "female", None, "zoo_captive", True),
            ("r2", "Ursus maritimus", ("Nanuq", "en", None), [("Ñandú", "es")], None, None, ["Schönbrunn"], None, "living", None, None),
            (None, None, None, None, None, None, None, None, None, None, False),
        ],
        ROW,
    )


def test_search(spark):
    ix_ = se.search_index(search_rows(spark))
    found = lambda *a, **k: sorted(r["id"] or "-" for r in se.search(ix_, *a, **k).collect())
    assert found("fuka") == ["r1"] and found("風花") == ["r1"] and found("SCHONBRUNN") == ["r2"] and found("nandu") == ["r2"]
    assert found("ursus") == ["r2"] and found("zoo_capt") == ["r1"] and found("jp") == [] and found("", taxon="URSUS  maritimus") == ["r2"]
    assert found("studbook") == [] and found("studbook:77") == ["r1"] and found("") == ["-", "r1", "r2"]
    assert found("", status="unknown") == ["-", "r1"] and found("", sex="UNKNOWN") == ["-", "r2"] and found("", country_code="jp") == ["r1"]
    assert found("", photo="confirmed") == ["r1"] and found("", photo="unconfirmed") == ["-", "r2"] and found("", photo="any") == ["-", "r1", "r2"]
    assert rows(se.facet_values(search_rows(spark), ["sex", "country_code"])) == [("country_code", "JP", 1), ("sex", "female", 1), ("sex", "unknown", 2)]
    assert [r["overflow"] for r in se.page(search_rows(spark), [F.col("id")], 2).collect()] == [1, 1]


def test_index(spark):
    e = spark.createDataFrame([("a", "x", "2020", 1), ("a", None, "2021", 2), ("a", "y", "2019", 3), ("b", "z", None, 4), (None, "q", "2020", 5)], "k string, v string, at string, o int")
    assert dict(rows(ix.last_value(e.where("k is not null"), "k", "v", "at", "o"))) == {"a": "x", "b": "z"}
    assert dict(rows(ix.unanimous(e.where("k is not null"), "k", "v"))) == {"a": None, "b": "z"}
    assert [r["chunk_id"] for r in ix.chunks(spark.range(10), "id", 4).orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert ix.chunks(spark.range(0), "id", 4).count() == 0
    n = spark.createDataFrame([([("b", "de"), ("z", "en"), ("c", "en")],), ([("b", "de"), ("a", "fr")],), ([],)], "n array<struct<value:string,language:string>>")
    assert [r[0] for r in n.select(ix.preferred(F.col("n"))).collect()] == ["c", "a", None]


def test_id_key_trims_what_the_pattern_trimmed(spark):
    blanks = [chr(c) for c in (*range(0x2100), 0x3000, 0xFEFF, 0x180E, 0x1F600) if not 0xD800 <= c < 0xE000]
    texts = [f"{b}An-1{b}x {b}" for b in blanks] + [f"{b}An\n{b}{b}" for b in blanks] + ["", "  ", "a \n", "\r\n a \n", "　 ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    was = F.nullif(F.lower(F.regexp_replace("t", r"(?U)^\s+|\s+$", "")), F.lit(""))
    assert df.where(~id_key("t").eqNullSafe(was)).count() == 0
    plan = df.select(id_key("t").alias("k")).where("k is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
