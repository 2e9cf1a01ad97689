"""Integrity rules over the collections, each a filter that yields (code, path, message).

A path is ``$.collection[key].field``: rows of tables have keys, not positions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.functions.dates import is_full_date, is_partial_date, is_reversed_range
from kinweft.functions.urls import is_web_url

# What the fields may say.
SEX = ["female", "male", "intersex", "unknown"]
STATUS = ["living", "deceased", "unknown"]
POPULATION = ["zoo_captive", "wild", "other_managed", "unknown"]
RELATION = ["biological_mother", "biological_father", "social", "foster", "adoptive"]
RELATION_STATUS = ["confirmed", "probable", "disputed", "unknown"]
REVIEW = ["reviewed", "needs_review", "unreviewed"]
PRECISION = ["exact", "approximate", "range", "unknown"]
TIER = ["A", "B", "C", "D", "discovery_only"]
EVENT = ["birth", "death", "move", "transfer", "release", "observation"]
EMBEDDING = ["allowed", "link_only", "denied", "unknown"]
OPEN_RIGHTS = ["cc0", "public_domain", "permission_granted", "license_allows_embedding", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0"]


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def outside(c: Column, allowed: list[str]) -> Column:
    """Not one of the allowed values; null is outside."""
    return ~F.coalesce(c.isin(allowed), F.lit(False))


Rule = tuple[str, str, Column, str]


def issues(rows: DataFrame, collection: str, key: str, rules: list[Rule], lists: list[tuple[str, Callable[[Column], list[Rule]]]] = ()) -> DataFrame:
    """(code, path, message) for each row and each rule (code, field, bad, message) that it breaks.

    lists has rules for each member of a list: (field, member -> rules); their fields follow the
    member's place in the path.
    """
    head = F.concat(F.lit(f"$.{collection}["), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("]."))
    hit = lambda at, rule: F.when(F.coalesce(rule[2], F.lit(False)), F.struct(F.lit(rule[0]).alias("code"), F.concat(head, at).alias("path"), F.lit(rule[3]).alias("message")))
    found = F.array(*[hit(F.lit(r[1]), r) for r in rules])
    for field, members in lists:
        place = lambda i, f: F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"]{f}"))  # noqa: B023, E731
        each = F.transform(F.col(field), lambda x, i: F.array(*[hit(place(i, r[1]), r) for r in members(x)]))  # noqa: B023
        found = F.concat(found, F.coalesce(F.flatten(each), F.array().cast("array<struct<code:string,path:string,message:string>>")))
    return rows.select(F.explode(F.array_compact(found)).alias("x")).select("x.*")


def unproven(c: Column) -> Column:
    """No source is cited."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def review_rules(r: Column) -> list[Rule]:
    """A status that is not known hides what else is wrong with a review."""
    known = ~outside(r["status"], REVIEW)
    return [
        ("invalid_review", "review", ~known, "review status is not known"),
        ("invalid_review_date", "review.reviewed_on", known & ~is_full_date(r["reviewed_on"]), "review date is no day"),
        ("invalid_review", "review.notes", known & r["notes"].isNull(), "review notes are no text"),
    ]


def animal_issues(animals: DataFrame) -> DataFrame:
    c = F.col
    named = ~(blank(c("name.canonical")) | blank(c("name.language")))
    rules = [
        ("invalid_id", "id", blank(c("id")), "id is blank"),
        ("invalid_animal", "taxon", blank(c("taxon")), "taxon is blank"),
        ("invalid_animal", "sex", outside(c("sex"), SEX), "sex is not known"),
        ("invalid_animal", "status", outside(c("status"), STATUS), "status is not known"),
        ("invalid_population", "population", c("population").isNotNull() & outside(c("population"), POPULATION), "population is not known"),
        ("missing_population", "population", c("population").isNull() & (c("taxon") == "Ursus maritimus"), "population is required"),
        ("invalid_name", "name", ~named, "name is incomplete"),
        ("missing_evidence", "name.source_ids", named & unproven(c("name.source_ids")), "no source is cited"),
        *review_rules(c("review")),
    ]
    whole = lambda a: ~(blank(a["value"]) | blank(a["language"]))
    return issues(animals, "animals", "id", rules, [
        ("name.localized", lambda x: [("invalid_name", "", x.isNull(), "name is empty"), ("missing_evidence", ".source_ids", named & x.isNotNull() & unproven(x["source_ids"]), "no source is cited")]),
        ("aliases", lambda x: [("invalid_alias", "", ~whole(x), "alias is incomplete"), ("missing_evidence", ".source_ids", whole(x) & unproven(x["source_ids"]), "no source is cited")]),
        ("external_ids", lambda x: [("invalid_external_id", "", blank(x["namespace"]) | blank(x["value"]), "external id is incomplete")]),
    ])


def claim_issues(claims: DataFrame) -> DataFrame:
    c = F.col
    return issues(claims, "claims", "id", [
        ("invalid_claim", "claim_type", blank(c("claim_type")), "type is blank"),
        ("invalid_claim_status", "status", outside(c("status"), RELATION_STATUS), "status is not known"),
        ("missing_evidence", "source_ids", unproven(c("source_ids")), "no source is cited"),
        *review_rules(c("review")),
    ])


def relation_issues(relations: DataFrame) -> DataFrame:
    c = F.col
    return issues(relations, "relationships", "id", [
        ("self_ancestry", "object", c("subject") == c("object"), "subject and object are one animal"),
        ("invalid_relationship_type", "type", outside(c("type"), RELATION), "type is not known"),
        ("invalid_relationship_status", "status", outside(c("status"), RELATION_STATUS), "status is not known"),
        ("missing_evidence", "source_ids", unproven(c("source_ids")), "no source is cited"),
        *review_rules(c("review")),
    ])


def event_issues(events: DataFrame) -> DataFrame:
    c, d = F.col, F.col("date")
    is_ = lambda p: d["precision"].eqNullSafe(F.lit(p))
    ends = is_partial_date(d["start"]) & is_partial_date(d["end"])
    return issues(events, "events", "id", [
        ("missing_event_subject", "animal_id", c("animal_id").isNull() & (F.coalesce(F.size("related_animal_ids"), F.lit(0)) <= 0), "no animal is named"),
        ("invalid_outcome_count", "outcome_count", c("outcome_count") < 1, "count is below one"),
        ("invalid_event_type", "type", outside(c("type"), EVENT), "type is not known"),
        ("invalid_date", "date", d.isNull(), "date is missing"),
        ("invalid_date", "date.precision", d.isNotNull() & outside(d["precision"], PRECISION), "precision is not known"),
        ("invalid_date", "date.value", is_("exact") & ~is_full_date(d["value"]), "exact date is no day"),
        ("invalid_date", "date.value", is_("approximate") & ~is_partial_date(d["value"]), "approximate date is no date"),
        ("invalid_date", "date", is_("range") & ~ends, "range has no two dates"),
        ("invalid_date_range", "date", is_("range") & ends & is_reversed_range(d), "range ends before it starts"),
        ("invalid_date", "date.notes", is_("unknown") & blank(d["notes"]), "unknown date has no note"),
        ("missing_evidence", "source_ids", unproven(c("source_ids")), "no source is cited"),
    ])


def media_issues(media: DataFrame) -> DataFrame:
    c = F.col
    given = lambda n: c(n).isNotNull() & ~is_web_url(c(n))
    return issues(media, "media", "media_id", [
        ("invalid_media_source", "source_page_url", ~is_web_url(c("source_page_url")), "page is no web address"),
        ("invalid_direct_media_url", "direct_remote_url", given("direct_remote_url"), "file is no web address"),
        ("invalid_direct_media_url", "direct_thumbnail_url", given("direct_thumbnail_url"), "thumbnail is no web address"),
        ("invalid_media_license_url", "license_url", given("license_url"), "licence is no web address"),
        ("unlicensed_embedding", "embedding_status", (c("embedding_status") == "allowed") & outside(F.lower(c("rights_status")), OPEN_RIGHTS), "embedding is allowed without rights"),
        ("invalid_embedding_status", "embedding_status", outside(c("embedding_status"), EMBEDDING), "embedding status is not known"),
        ("invalid_media_date", "checked_date", ~is_full_date(c("checked_date")), "check date is no day"),
        ("missing_evidence", "source_ids", unproven(c("source_ids")), "no source is cited"),
    ])


def source_issues(sources: DataFrame) -> DataFrame:
    c = F.col
    return issues(sources, "sources", "id", [
        *[("invalid_source", f, blank(c(f)), "text is blank") for f in ("title", "publisher", "source_type", "data_use")],
        ("invalid_source_url", "url", ~is_web_url(c("url")), "url is no web address"),
        ("invalid_source_date", "publication_date", c("publication_date").isNotNull() & ~is_partial_date(c("publication_date")), "publication date is no date"),
        ("invalid_source_date", "accessed_date", ~is_full_date(c("accessed_date")), "access date is no day"),
        ("invalid_provenance_tier", "tier", outside(c("tier"), TIER), "tier is not known"),
    ])


def duplicates(collections: list[tuple[str, DataFrame, str]], order: str = "loaded_at") -> DataFrame:
    """(code, path, message): keys that a collection repeats, and keys that several collections have."""
    parts = [df.select(F.lit(k).alias("rank"), F.lit(name).alias("collection"), F.col(key).alias("key")).where("key is not null") for k, (name, df, key) in enumerate(collections)]
    counted = reduce(DataFrame.unionByName, parts).groupBy("rank", "collection", "key").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("rank")
    path = F.concat(F.lit("$."), F.col("collection"), F.lit("["), F.col("key"), F.lit("].id"))
    shared = counted.withColumn("first", F.row_number().over(w) == 1)
    inner = shared.where("n > 1").select(F.lit("duplicate_id").alias("code"), path.alias("path"), F.lit("id is repeated").alias("message"))
    return inner.unionByName(shared.where("not first").select(F.lit("duplicate_internal_id").alias("code"), path.alias("path"), F.lit("id is used by an earlier collection").alias("message")))


def duplicate_numbers(animals: DataFrame) -> DataFrame:
    """(code, path, message): complete external numbers that were borne before, by an earlier animal (by id) or the same one."""
    x = animals.select("id", F.posexplode("external_ids").alias("at", "x")).where(~blank(F.col("x.namespace")) & ~blank(F.col("x.value")))
    w = Window.partitionBy("x.namespace", "x.value").orderBy("id", "at")
    x = x.withColumns({"n": F.row_number().over(w), "owner": F.first("id").over(w)}).where("n > 1")
    path = F.concat(F.lit("$.animals["), F.col("id"), F.lit("].external_ids["), F.col("at").cast("string"), F.lit("]"))
    return x.select(F.lit("duplicate_external_id").alias("code"), path.alias("path"), F.concat_ws(" ", F.concat_ws(":", "x.namespace", "x.value"), F.lit("belongs to"), "owner").alias("message"))


def dangling(refs: DataFrame, targets: DataFrame, code: str, key: str = "id") -> DataFrame:
    """(code, path, message) of refs (path, ref) whose target is not there."""
    t = targets.select(F.lower(F.trim(key)).alias("ref")).where("ref is not null").distinct()
    return refs.join(t, "ref", "left_anti").select(F.lit(code).alias("code"), "path", F.concat(F.lit("unknown id "), F.col("ref")).alias("message"))


def cross_group(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """Edges between nodes of different groups: (id, subject, object, subject_group, object_group)."""
    s = nodes.select(F.col("id").alias("subject"), F.col(group).alias("subject_group"))
    o = nodes.select(F.col("id").alias("object"), F.col(group).alias("object_group"))
    return edges.join(s, "subject").join(o, "object").where("subject_group != object_group").select("id", "subject", "object", "subject_group", "object_group")


def release_issues(releases: DataFrame) -> DataFrame:
    """(code, path, message) of release rows (document, ...)."""
    c = F.col
    texts = [("invalid_release", f, blank(c(f)), "text is blank") for f in ("schema_version", "data_version", "engine_version", "provenance")]
    return issues(releases, "release", "document", [*texts, ("invalid_release_date", "build_date", ~is_full_date(c("build_date")), "build date is no day")])


#: The languages that a coverage must be translated to.
LOCALES = ("ja", "ru")


def coverage_issues(coverages: DataFrame, locales: tuple[str, ...] = LOCALES) -> DataFrame:
    """(code, path, message) of coverage rows (document, taxon, scope, limitations, last_reviewed, translations)."""
    c, t = F.col, F.col("translations")
    listed = c("limitations")
    rules = [("invalid_coverage", f, blank(c(f)), "text is blank") for f in ("taxon", "scope")]
    rules.append(("invalid_coverage", "limitations", listed.isNull() | F.exists(listed, lambda x: x.isNull()), "limitations are no list of texts"))
    rules.append(("missing_coverage_translation", "translations", t.isNull(), "translations are missing"))
    for l in locales:
        x = F.try_element_at(t, F.lit(l))
        own = x["limitations"]
        bad = own.isNull() | F.exists(own, blank)
        rules += [
            ("missing_coverage_translation", f"translations.{l}", t.isNotNull() & x.isNull(), "translation is missing"),
            ("invalid_coverage_translation", f"translations.{l}.scope", x.isNotNull() & blank(x["scope"]), "text is blank"),
            ("invalid_coverage_translation", f"translations.{l}.limitations", x.isNotNull() & bad, "limitations are no list of texts"),
            ("invalid_coverage_translation", f"translations.{l}.limitations", x.isNotNull() & ~bad & listed.isNotNull() & (F.size(own) != F.size(listed)), "limitations are not as many as in the original"),
        ]
    rules.append(("invalid_coverage_date", "last_reviewed", ~is_full_date(c("last_reviewed")), "review date is no day"))
    return issues(coverages, "coverage", "document", rules)


def shape_issues(texts: DataFrame, collections: tuple[str, ...]) -> DataFrame:
    """(code, path, message): collections of documents (path, text) that are no lists, or hold what is no object.

    Texts that are no JSON object give no rows; ``bad_documents`` lists them.
    """
    v = texts.select(F.col("path").alias("document"), F.try_parse_json("text").alias("v"))
    found = []
    for k in collections:
        x = F.try_variant_get("v", f"$.{k}", "variant")
        kind = F.schema_of_variant(x)
        items = F.try_variant_get("v", f"$.{k}", "array<variant>")
        path = F.concat(F.lit("$["), F.col("document"), F.lit(f"].{k}"))
        none = x.isNull() | F.is_variant_null(x)
        found.append(F.when(~none & ~F.startswith(kind, F.lit("ARRAY")), F.struct(F.lit("invalid_collection").alias("code"), path.alias("path"), F.lit("collection is no list").alias("message"))))
        found.append(F.when(F.exists(items, lambda i: F.coalesce(~F.startswith(F.schema_of_variant(i), F.lit("OBJECT")), F.lit(True))), F.struct(F.lit("invalid_record").alias("code"), path.alias("path"), F.lit("an entry is no object").alias("message"))))
    return v.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")
