"""Taking a foreign property graph in: places, names, edges, photos and vertices, each with one outcome.

Foreign ids are mapped by tables (old, new); what is not mapped is kept with an outcome that says
why. Every operator gives each input row exactly one outcome, so that the outcomes can be counted
against the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.functions.text import merge_key, safe_id, stable_id
from kinweft.functions.urls import is_web_url

#: What marks an end of an edge that is not known.
UNKNOWN = "none"


def two_way_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """(alias, id): every id under itself and under its twin with or without a leading hyphen."""
    c = F.col(column)
    twin = F.when(F.startswith(c, F.lit("-")), F.substring(c, F.lit(2), F.length(c))).otherwise(F.concat(F.lit("-"), c))
    return ids.where(c.isNotNull()).select(F.explode(F.array(c, twin)).alias("alias"), c.alias("id")).distinct()


def edge_ordinals(edges: DataFrame, label: str, *order: str) -> DataFrame:
    """edges with edge_id: the label and the place within it, four digits or more."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(*order)).cast("string")
    return edges.withColumn("edge_id", F.concat(F.col(label), F.lit(":"), F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))))


def suffixed_ids(rows: DataFrame, base: str, order: str, taken: DataFrame) -> DataFrame:
    """rows with final_id: the base, or base-2, base-3 ... where it is taken or another row comes first.

    taken is (id). Rows of one base get the free numbers in order; numbers that are taken are left out.
    """
    known = taken.where("id is not null").select(F.regexp_replace("id", r"-\d+$", "").alias("stem"), "id").distinct()
    n = F.when(F.col("id") == F.col("stem"), F.lit(1)).otherwise(F.regexp_extract("id", r"-(\d+)$", 1).cast("int"))
    # An id that ends in a number may be a base itself.
    used = known.select(F.col("stem").alias("_b"), n.alias("n")).unionByName(known.select(F.col("id").alias("_b"), F.lit(1).alias("n")))
    used = used.groupBy("_b").agg(F.array_sort(F.collect_set("n")).alias("_used"))
    k = F.row_number().over(Window.partitionBy(base).orderBy(order))
    x = rows.withColumn("_k", k).join(used, F.col(base) == F.col("_b"), "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("_k") + F.size("_used")), F.col("_used"))
    x = x.withColumn("_n", F.element_at(free, F.col("_k")))
    return x.withColumn("final_id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_n").cast("string")))).drop("_k", "_b", "_used", "_n")


def merge_places(own: DataFrame, foreign: DataFrame, reviewed: DataFrame, prefix: str) -> DataFrame:
    """(old, new, status, candidates): what each foreign place (id, name) becomes.

    own is (id, name), a row for each name; reviewed is (old, new). A reviewed place is what the
    review says; else a name, as a merge key, that one own place bears is that place; else a new
    one is made, also where several places bear it (candidates lists them). A place without a name
    is new. Repeated rows count once.
    """
    names = own.select("id", merge_key("name").alias("k")).where("id is not null and k != ''").distinct()
    bearers = names.groupBy("k").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    r = reviewed.groupBy("old").agg(F.min("new").alias("said"))
    f = foreign.where("id is not null").groupBy(F.col("id").alias("old")).agg(F.min("name").alias("name"))
    x = f.withColumn("k", merge_key("name")).join(bearers, "k", "left").join(r, "old", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    status = F.when(F.col("said").isNotNull(), "reviewed").when(n == 1, "matched_name").when(n > 1, "ambiguous_name").otherwise("new")
    x = x.withColumn("status", status).withColumn("base", F.concat(F.lit(prefix), F.regexp_replace(safe_id(F.col("old")), "^-+", "")))
    made = suffixed_ids(x.where("status in ('ambiguous_name', 'new')"), "base", "old", own.select("id"))
    kept = x.where("status in ('reviewed', 'matched_name')").withColumn("final_id", F.coalesce("said", F.try_element_at("ids", F.lit(1))))
    candidates = F.when(F.col("status") == "ambiguous_name", F.array_join("ids", ",")).otherwise("")
    return made.unionByName(kept).select("old", F.col("final_id").alias("new"), "status", candidates.alias("candidates"))


def attach_names(own: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, kind, language, value): the incoming names that a record does not have yet, each once.

    own is (id, canonical, localized, aliases) with arrays of (value, language); incoming is
    (id, kind, language, value) with kind ``localized`` or ``alias``. A localised name is new if it
    is not the canonical one and not there in its language; an alias if its merge key is neither
    the canonical name's nor another alias's. Null and blank values are no names.
    """
    given = incoming.where("kind in ('localized', 'alias') and trim(value) != ''").groupBy("id", "kind", "language", "value").agg(F.lit(1)).withColumn("k", merge_key("value"))
    o = own.select("id", "canonical", merge_key("canonical").alias("ck"), "localized")
    old = own.select("id", F.explode("aliases.value").alias("value")).withColumn("k", merge_key("value")).select("id", "k").distinct()
    local = given.where("kind = 'localized'").join(o, "id").where("not (value <=> canonical) and not coalesce(exists(localized, x -> x.value = value and x.language <=> language), false)")
    alias = given.where("kind = 'alias' and k != ''").join(o, "id").where("not (k <=> ck)").join(old, ["id", "k"], "left_anti")
    first = Window.partitionBy("id", "k").orderBy("language", "value")
    alias = alias.withColumn("n", F.row_number().over(first)).where("n = 1")
    cols = ["id", "kind", "language", "value"]
    return local.select(*cols).unionByName(alias.select(*cols))


def _ends(edges: DataFrame, animals: DataFrame, places: DataFrame) -> DataFrame:
    """edges (id, animal, place) with what their ends are mapped to and how many edges the animal has."""
    a = animals.groupBy(F.col("old").alias("animal")).agg(F.min("new").alias("final_animal"))
    p = places.groupBy(F.col("old").alias("place")).agg(F.min("new").alias("final_place"))
    return edges.withColumn("n_edges", F.count("*").over(Window.partitionBy("animal"))).join(a, "animal", "left").join(p, "place", "left")


def holding_outcomes(edges: DataFrame, animals: DataFrame, places: DataFrame) -> DataFrame:
    """(id, final_animal, final_place, status) of edges (id, animal, place) that say where an animal is now."""
    status = (
        F.when(F.col("animal") == UNKNOWN, "excluded_unknown_animal")
        .when(F.col("final_animal").isNull(), "excluded_unmapped_animal")
        .when(F.col("place") == UNKNOWN, "excluded_unknown_place")
        .when(F.col("final_place").isNull(), "excluded_unmapped_place")
        .when(F.col("n_edges") != 1, "excluded_several_places")
        .otherwise("mapped_holding")
    )
    return _ends(edges, animals, places).select("id", "final_animal", "final_place", status.alias("status"))


def birthplace_outcomes(edges: DataFrame, animals: DataFrame, places: DataFrame, births: DataFrame, wild: DataFrame) -> DataFrame:
    """(id, final_animal, final_place, status) of edges (id, animal, place); births is (animal, born), wild (place)."""
    b = births.groupBy("animal").agg(F.min("born").alias("born"))
    w = wild.select("place", F.lit(True).alias("is_wild")).distinct()
    x = _ends(edges, animals, places).join(b, "animal", "left").join(w, "place", "left")
    status = (
        F.when(F.col("animal") == UNKNOWN, "excluded_unknown_animal")
        .when(F.col("final_animal").isNull(), "excluded_unmapped_animal")
        .when(F.col("n_edges") != 1, "excluded_several_places")
        .when(F.col("is_wild") & F.col("born").isNull(), "excluded_wild_without_birth")
        .when(F.col("is_wild"), "mapped_birth_without_place")
        .when(F.col("place") == UNKNOWN, "excluded_unknown_place")
        .when(F.col("final_place").isNull(), "excluded_unmapped_place")
        .when(F.col("born").isNull(), "excluded_no_birth")
        .otherwise("mapped_birth")
    )
    return x.select("id", "final_animal", "final_place", status.alias("status"))


def photo_outcomes(photos: DataFrame, animals: DataFrame) -> DataFrame:
    """(vertex, place, status, page, direct, targets) of photos (vertex, kind, place, page, direct, owners).

    kind ``other`` is a vertex that is no animal. Only web addresses are kept. targets are the
    mapped owners, sorted. Null lists have no owners.
    """
    p = photos.withColumns({"page": F.when(is_web_url(F.col("page")), F.col("page")), "direct": F.when(is_web_url(F.col("direct")), F.col("direct"))})
    m = animals.groupBy(F.col("old").alias("owner")).agg(F.min("new").alias("final"))
    owned = p.select("vertex", "place", F.explode("owners").alias("owner")).join(m, "owner").groupBy("vertex", "place").agg(F.array_sort(F.collect_set("final")).alias("targets"))
    status = (
        F.when(F.col("kind") == "other", "excluded_no_animal")
        .when(F.col("page").isNull() & F.col("direct").isNull(), "excluded_no_web_address")
        .when(F.col("targets").isNull(), "excluded_unmapped_owner")
        .otherwise("mapped_media")
    )
    return p.join(owned, ["vertex", "place"], "left").select("vertex", "place", status.alias("status"), "page", "direct", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def expand_media(outcomes: DataFrame, fallback_page: str, prefix: str = "media:") -> DataFrame:
    """(media_id, animal_id, page, direct, first_vertex): one row for each animal and pair of addresses, whatever photos have it."""
    x = outcomes.where("status = 'mapped_media'").select(F.explode("targets").alias("animal_id"), F.coalesce("page", F.lit(fallback_page)).alias("page"), "direct", "vertex")
    g = x.groupBy("animal_id", "page", "direct").agg(F.min("vertex").alias("first_vertex"))
    key = F.concat_ws("\0", "animal_id", "page", F.coalesce("direct", F.lit("")))
    return g.select(F.concat(F.lit(prefix), stable_id(key, 20)).alias("media_id"), "animal_id", "page", "direct", "first_vertex")


def url_sources(urls: DataFrame, column: str, existing: DataFrame, prefix: str = "source:url:") -> DataFrame:
    """(id, url, publisher): a source for each distinct web address that has none yet; existing is (id)."""
    u = urls.select(F.col(column).alias("url")).where(is_web_url(F.col("url"))).distinct()
    x = u.select(F.concat(F.lit(prefix), stable_id(F.col("url"), 16)).alias("id"), "url", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("publisher"))
    return x.join(existing.select("id"), "id", "left_anti")


def vertex_outcomes(vertices: DataFrame, animals: DataFrame, places: DataFrame, photos: DataFrame) -> DataFrame:
    """(id, kind, status, target): one outcome for every vertex (id, kind).

    animals and places are (old, new, status); photos is (vertex, n_animals, n_media), what the
    tags and photos of a vertex led to.
    """
    one = lambda df, name: df.groupBy(F.col("old").alias("id")).agg(F.min_by(F.struct("new", "status"), F.struct("new", "status")).alias(name))
    v = vertices.select("id", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    x = v.join(one(animals, "a"), "id", "left").join(one(places, "p"), "id", "left").join(photos.withColumnRenamed("vertex", "id"), "id", "left")
    kind = F.col("kind")
    status = (
        F.when(kind == "animal", F.coalesce("a.status", F.lit("excluded_unmapped_animal")))
        .when(kind == "place", F.coalesce("p.status", F.lit("excluded_unmapped_place")))
        .when((kind == "media") & (F.col("n_media") > 0), "mapped_media")
        .when((kind == "media") & (F.col("n_animals") > 0), "excluded_no_photo")
        .when(kind == "media", "excluded_photo_only")
        .when(kind == "none", "excluded_unknown_marker")
        .when(kind == "wild", "excluded_population_marker")
        .when(kind == "links", "excluded_link")
        .otherwise("excluded_other")
    )
    target = F.when(kind == "animal", F.col("a.new")).when(kind == "place", F.col("p.new"))
    return x.select("id", "kind", status.alias("status"), target.alias("target"))


def dated_gaps(records: DataFrame, events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(id, type, value): dates in the fields of records (id, ...) that no event (id, type, value) of their type has."""
    x = F.array(*[F.struct(F.lit(t).alias("type"), F.trim(F.col(f)).alias("value")) for f, t in fields.items()])
    said = records.select("id", F.explode(x).alias("x")).select("id", "x.*").where("value != ''").distinct()
    return said.join(events.select("id", "type", "value").distinct(), ["id", "type", "value"], "left_anti")


def merged_notes(*notes: Column) -> Column:
    """The notes that say something, each once, in order, on lines of their own; '' if there is none."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.array(*notes), F.trim), lambda x: F.coalesce(x != "", F.lit(False)))), "\n")


def without_tokens(texts: Column, tokens: list[str]) -> Column:
    """The texts of a list that hold none of the tokens, whatever their case."""
    return F.filter(texts, lambda t: ~F.exists(F.array(*[F.lit(k.lower()) for k in tokens]), lambda k: F.contains(F.lower(t), k)))


def preferred_name(names: Column, language: str = "en") -> Column:
    """struct<language,value,rest> of a map from languages to names: the one in the language, else the first by language."""
    known = F.filter(F.array_sort(F.map_entries(names)), lambda e: F.coalesce(~F.lower(F.trim(e["value"])).isin("", "none", "unknown"), F.lit(False)))
    pairs = F.transform(known, lambda e: F.struct(F.coalesce(F.nullif(F.lower(F.substring(e["key"], 1, 2)), F.lit("")), F.lit("en")).alias("language"), F.trim(e["value"]).alias("value")))
    best = F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["language"] == language), F.lit(1)), F.try_element_at(pairs, F.lit(1)))
    return F.when(best.isNotNull(), F.struct(best["language"].alias("language"), best["value"].alias("value"), F.filter(pairs, lambda p: p != best).alias("rest")))


def strict_allowed(items: DataFrame, records: DataFrame, key: str, same: list[str], fixed: dict[str, str]) -> DataFrame:
    """The items whose record agrees in every column of same and says what fixed says; the query fails at the first that does not.

    Items without a record are left out.
    """
    r = records.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in {**dict.fromkeys(same), **fixed}])
    ok = F.lit(True)
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c, v in fixed.items():
        ok = ok & F.col(f"_{c}").eqNullSafe(F.lit(v))
    j = items.join(r, key)
    return j.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("record does not agree: "), F.col(key))).cast("boolean"))).select(*items.columns)
