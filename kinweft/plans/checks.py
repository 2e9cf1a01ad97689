"""Queries of integrity rules, scans and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.functions import text, urls
from kinweft.operators import audit, scan
from kinweft.operators import validate as va
from kinweft.plans import tables as tb
from kinweft.plans.base import Registry
from kinweft.session import id_key, table

REG = Registry()


def _in(c: str, values: list[str]) -> str:
    return f"coalesce({c} in ({', '.join(map(repr, values))}), false)"


def _issue(code: str, path: str, message: str, source: str, where: str) -> str:
    return f"select '{code}' code, {path} path, '{message}' message from {source} where {where}"


def _p(collection: str, key: str, field: str) -> str:
    return f"'$.{collection}[' || {key} || '].{field}'"


_DAY = "(regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast({0} as date) is not null)"
_PART = "coalesce(regexp_full_match({0}, '\\d{{4}}') or regexp_full_match({0}, '\\d{{4}}-(0[1-9]|1[0-2])') or " + _DAY + ", false)"
_WEB = "coalesce(regexp_matches({0}, '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+'), false)"


_BLANK = "coalesce(trim({0}) = '', true)"


def _review(collection: str, source: str) -> list[str]:
    at, known = lambda f: _p(collection, "id", f), _in("review.status", va.REVIEW)
    return [
        _issue("invalid_review", at("review"), "review status is not known", source, f"not {known}"),
        _issue("invalid_review_date", at("review.reviewed_on"), "review date is no day", source, f"{known} and not coalesce({_DAY.format('review.reviewed_on')}, false)"),
        _issue("invalid_review", at("review.notes"), "review notes are no text", source, f"{known} and review.notes is null"),
    ]


_PARTS = """named as (select *, not (coalesce(trim(name.canonical) = '', true) or coalesce(trim(name.language) = '', true)) whole from an),
loc as (select id, whole, i - 1 i, name.localized[i] x from (select *, unnest(range(1, len(name.localized) + 1)) i from named)),
ali as (select id, i - 1 i, aliases[i] x from (select *, unnest(range(1, len(aliases) + 1)) i from an)),
ext as (select id, i - 1 i, external_ids[i] x from (select *, unnest(range(1, len(external_ids) + 1)) i from an))"""


def _at(field: str, rest: str = "") -> str:
    return f"'$.animals[' || id || '].{field}[' || i || ']{rest}'"


_WHOLE_ALIAS = "not (coalesce(trim(x.value) = '', true) or coalesce(trim(x.language) = '', true))"


@REG.add(
    "validate_animals",
    tb.ctes("an", more=_PARTS)
    + " union all ".join([
        _issue("invalid_animal", _p("animals", "id", "taxon"), "taxon is blank", "an", _BLANK.format("taxon")),
        _issue("invalid_animal", _p("animals", "id", "sex"), "sex is not known", "an", f"not {_in('sex', va.SEX)}"),
        _issue("invalid_animal", _p("animals", "id", "status"), "status is not known", "an", f"not {_in('status', va.STATUS)}"),
        _issue("invalid_population", _p("animals", "id", "population"), "population is not known", "an", f"population is not null and not {_in('population', va.POPULATION)}"),
        _issue("missing_population", _p("animals", "id", "population"), "population is required", "an", "population is null and taxon = 'Ursus maritimus'"),
        _issue("invalid_name", _p("animals", "id", "name"), "name is incomplete", "named", "not whole"),
        _issue("missing_evidence", _p("animals", "id", "name.source_ids"), "no source is cited", "named", "whole and coalesce(len(name.source_ids), 0) = 0"),
        _issue("invalid_name", _at("name.localized"), "name is empty", "loc", "x is null"),
        _issue("missing_evidence", _at("name.localized", ".source_ids"), "no source is cited", "loc", "whole and x is not null and coalesce(len(x.source_ids), 0) = 0"),
        _issue("invalid_alias", _at("aliases"), "alias is incomplete", "ali", f"not {_WHOLE_ALIAS}"),
        _issue("missing_evidence", _at("aliases", ".source_ids"), "no source is cited", "ali", f"{_WHOLE_ALIAS} and coalesce(len(x.source_ids), 0) = 0"),
        _issue("invalid_external_id", _at("external_ids"), "external id is incomplete", "ext", f"{_BLANK.format('x.namespace')} or {_BLANK.format('x.value')}"),
        *_review("animals", "an"),
    ]),
)
def validate_animals(spark: SparkSession, sf: str) -> DataFrame:
    return va.animal_issues(tb.animals(spark, sf))


@REG.add(
    "validate_relationships",
    tb.ctes("rel")
    + " union all ".join([
        _issue("self_ancestry", _p("relationships", "id", "object"), "subject and object are one animal", "rel", "subject = object"),
        _issue("invalid_relationship_type", _p("relationships", "id", "type"), "type is not known", "rel", f"not {_in('type', va.RELATION)}"),
        _issue("invalid_relationship_status", _p("relationships", "id", "status"), "status is not known", "rel", f"not {_in('status', va.RELATION_STATUS)}"),
        _issue("missing_evidence", _p("relationships", "id", "source_ids"), "no source is cited", "rel", "coalesce(len(source_ids), 0) = 0"),
        *_review("relationships", "rel"),
    ]),
)
def validate_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return va.relation_issues(tb.relationships(spark, sf))


_ENDS = f"({_PART.format('date.start')} and {_PART.format('date.end')})".replace("date.end", 'date."end"')


@REG.add(
    "validate_events",
    tb.ctes("ev")
    + " union all ".join([
        _issue("missing_event_subject", _p("events", "id", "animal_id"), "no animal is named", "ev", "animal_id is null and coalesce(len(related_animal_ids), 0) = 0"),
        _issue("invalid_outcome_count", _p("events", "id", "outcome_count"), "count is below one", "ev", "outcome_count < 1"),
        _issue("invalid_event_type", _p("events", "id", "type"), "type is not known", "ev", f"not {_in('type', va.EVENT)}"),
        _issue("invalid_date", _p("events", "id", "date"), "date is missing", "ev", "date is null"),
        _issue("invalid_date", _p("events", "id", "date.precision"), "precision is not known", "ev", f"date is not null and not {_in('date.precision', va.PRECISION)}"),
        _issue("invalid_date", _p("events", "id", "date.value"), "exact date is no day", "ev", f"date.precision = 'exact' and not coalesce({_DAY.format('date.value')}, false)"),
        _issue("invalid_date", _p("events", "id", "date.value"), "approximate date is no date", "ev", f"date.precision = 'approximate' and not {_PART.format('date.value')}"),
        _issue("invalid_date", _p("events", "id", "date"), "range has no two dates", "ev", f"date.precision = 'range' and not {_ENDS}"),
        _issue("invalid_date_range", _p("events", "id", "date"), "range ends before it starts", "ev", f"date.precision = 'range' and {_ENDS} and (case length(date.start) when 4 then date.start || '-01-01' when 7 then date.start || '-01' else date.start end) > (case length(date.\"end\") when 4 then date.\"end\" || '-99-99' when 7 then date.\"end\" || '-99' else date.\"end\" end)"),
        _issue("invalid_date", _p("events", "id", "date.notes"), "unknown date has no note", "ev", "date.precision = 'unknown' and coalesce(trim(date.notes) = '', true)"),
        _issue("missing_evidence", _p("events", "id", "source_ids"), "no source is cited", "ev", "coalesce(len(source_ids), 0) = 0"),
    ]),
)
def validate_events(spark: SparkSession, sf: str) -> DataFrame:
    return va.event_issues(tb.events(spark, sf))


@REG.add(
    "validate_media",
    tb.ctes("med")
    + " union all ".join([
        _issue("invalid_media_source", _p("media", "media_id", "source_page_url"), "page is no web address", "med", f"not {_WEB.format('source_page_url')}"),
        _issue("invalid_direct_media_url", _p("media", "media_id", "direct_remote_url"), "file is no web address", "med", f"direct_remote_url is not null and not {_WEB.format('direct_remote_url')}"),
        _issue("invalid_direct_media_url", _p("media", "media_id", "direct_thumbnail_url"), "thumbnail is no web address", "med", f"direct_thumbnail_url is not null and not {_WEB.format('direct_thumbnail_url')}"),
        _issue("invalid_media_license_url", _p("media", "media_id", "license_url"), "licence is no web address", "med", f"license_url is not null and not {_WEB.format('license_url')}"),
        _issue("unlicensed_embedding", _p("media", "media_id", "embedding_status"), "embedding is allowed without rights", "med", f"embedding_status = 'allowed' and not {_in('lower(rights_status)', va.OPEN_RIGHTS)}"),
        _issue("invalid_embedding_status", _p("media", "media_id", "embedding_status"), "embedding status is not known", "med", f"not {_in('embedding_status', va.EMBEDDING)}"),
        _issue("invalid_media_date", _p("media", "media_id", "checked_date"), "check date is no day", "med", f"not coalesce({_DAY.format('checked_date')}, false)"),
        _issue("missing_evidence", _p("media", "media_id", "source_ids"), "no source is cited", "med", "coalesce(len(source_ids), 0) = 0"),
    ]),
)
def validate_media(spark: SparkSession, sf: str) -> DataFrame:
    return va.media_issues(tb.media(spark, sf))


@REG.add(
    "validate_sources",
    tb.ctes("src")
    + " union all ".join([
        *[_issue("invalid_source", _p("sources", "id", f), "text is blank", "src", _BLANK.format(f)) for f in ("title", "publisher", "source_type", "data_use")],
        _issue("invalid_source_url", _p("sources", "id", "url"), "url is no web address", "src", f"not {_WEB.format('url')}"),
        _issue("invalid_source_date", _p("sources", "id", "publication_date"), "publication date is no date", "src", f"publication_date is not null and not {_PART.format('publication_date')}"),
        _issue("invalid_source_date", _p("sources", "id", "accessed_date"), "access date is no day", "src", f"not coalesce({_DAY.format('accessed_date')}, false)"),
        _issue("invalid_provenance_tier", _p("sources", "id", "tier"), "tier is not known", "src", f"not {_in('tier', va.TIER)}"),
    ]),
)
def validate_sources(spark: SparkSession, sf: str) -> DataFrame:
    return va.source_issues(table(spark, sf, "sources").where("id is not null"))


@REG.add(
    "validate_duplicates",
    "with k as (select 'animals' c, id from animals union all select 'relationships', id from relationships union all select 'events', id from atlas_events union all select 'media', media_id from media)\n"
    "select 'duplicate_id' code, '$.' || c || '[' || id || '].id' path, 'id is repeated' message from k where id is not null group by c, id having count(*) > 1",
)
def validate_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return va.duplicates([("animals", t("animals"), "id"), ("relationships", t("relationships"), "id"), ("events", t("atlas_events"), "id"), ("media", t("media"), "media_id")])


@REG.add(
    "validate_numbers",
    tb.ctes("an", more="x as (select id, i - 1 i, external_ids[i].namespace ns, external_ids[i].value v from (select id, external_ids, unnest(range(1, len(external_ids) + 1)) i from an)), r as (select *, row_number() over w n, first_value(id) over w o from x where trim(ns) <> '' and trim(v) <> '' window w as (partition by ns, v order by id, i))")
    + "select 'duplicate_external_id' code, '$.animals[' || id || '].external_ids[' || i || ']' path, ns || ':' || v || ' belongs to ' || o message from r where n > 1",
)
def validate_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return va.duplicate_numbers(tb.animals(spark, sf))


def _cited_sql(path: str, listed: str, source: str) -> str:
    return f"select {path} || '.source_ids[' || (j - 1) || ']' path, {tb.KEY.format('l[j]')} ref from (select *, unnest(range(1, len(l) + 1)) j from (select *, {listed} l from {source}))"


@REG.add(
    "validate_citations",
    tb.ctes("rel", "an", "ev", "med", more=_PARTS + ", c as (" + " union all ".join([
        _cited_sql("'$.animals[' || id || '].name'", "name.source_ids", "an"), _cited_sql(_at("name.localized"), "x.source_ids", "loc"), _cited_sql(_at("aliases"), "x.source_ids", "ali"),
        _cited_sql("'$.relationships[' || id || ']'", "source_ids", "rel"), _cited_sql("'$.events[' || id || ']'", "source_ids", "ev"), _cited_sql("'$.media[' || media_id || ']'", "source_ids", "med"),
    ]) + ")")
    + "select 'dangling_source' code, path, 'unknown id ' || ref message from c where ref is not null and ref not in (select lower(trim(id)) from sources where id is not null)",
)
def validate_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every citation of names, aliases, relationships, events and media without its source."""

    def of(df: DataFrame, collection: str, key: str, field: str, listed: str | None = None) -> DataFrame:
        head = F.concat(F.lit(f"$.{collection}["), F.col(key), F.lit(f"]{field}"))
        if listed:
            df = df.select(key, F.posexplode(listed).alias("i", "x"))
            head, ids = F.concat(head, F.lit(f".{listed}["), F.col("i").cast("string"), F.lit("]")), "x.source_ids"
        else:
            ids = f"{field[1:]}.source_ids" if field else "source_ids"
        x = df.select(head.alias("head"), F.posexplode(ids).alias("at", "s"))
        return x.select(F.concat("head", F.lit(".source_ids["), F.col("at").cast("string"), F.lit("]")).alias("path"), id_key("s").alias("ref")).where("ref is not null")

    a, r, e, m = tb.animals(spark, sf), tb.relationships(spark, sf), tb.events(spark, sf), tb.media(spark, sf)
    refs = [of(a, "animals", "id", ".name"), of(a, "animals", "id", "", "name.localized"), of(a, "animals", "id", "", "aliases"), of(r, "relationships", "id", ""), of(e, "events", "id", ""), of(m, "media", "media_id", "")]
    return va.dangling(reduce(DataFrame.unionByName, refs), table(spark, sf, "sources"), "dangling_source")


def _ref_sql(collection: str, source: str, key: str, field: str, target: str, code: str) -> str:
    return f"select '{code}' code, '$.{collection}[' || {key} || '].{field}' path, 'unknown id ' || {field} message from {source} where {field} is not null and {field} not in (select lower(trim(id)) from {target} where id is not null)"


@REG.add(
    "dangling_refs",
    tb.ctes("ev", "rel", "med")
    + " union all ".join([
        _ref_sql("events", "ev", "id", "animal_id", "animals", "dangling_animal"),
        _ref_sql("media", "med", "media_id", "animal_id", "animals", "dangling_animal"),
        _ref_sql("relationships", "rel", "id", "subject", "animals", "dangling_animal"),
        _ref_sql("relationships", "rel", "id", "object", "animals", "dangling_animal"),
        _ref_sql("events", "ev", "id", "institution_id", "institutions", "dangling_institution"),
        _ref_sql("events", "ev", "id", "from_institution_id", "institutions", "dangling_institution"),
        _ref_sql("events", "ev", "id", "to_institution_id", "institutions", "dangling_institution"),
    ]),
)
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    def refs(df: DataFrame, collection: str, key: str, fields: list[str]) -> DataFrame:
        x = F.array(*[F.struct(F.concat(F.lit(f"$.{collection}["), F.col(key), F.lit(f"].{f}")).alias("path"), F.col(f).alias("ref")) for f in fields])
        return df.select(F.explode(x).alias("x")).select("x.*").where("ref is not null")

    e, a, i = tb.events(spark, sf), table(spark, sf, "animals"), table(spark, sf, "institutions")
    to_animals = reduce(DataFrame.unionByName, [refs(e, "events", "id", ["animal_id"]), refs(tb.media(spark, sf), "media", "media_id", ["animal_id"]), refs(tb.relationships(spark, sf), "relationships", "id", ["subject", "object"])])
    places = refs(e, "events", "id", ["institution_id", "from_institution_id", "to_institution_id"])
    return va.dangling(to_animals, a, "dangling_animal").unionByName(va.dangling(places, i, "dangling_institution"))


@REG.add("cross_group_edges", tb.ctes("rel", "an") + "select r.id, r.subject, r.object, s.taxon subject_group, o.taxon object_group from rel r join an s on s.id = r.subject join an o on o.id = r.object where s.taxon <> o.taxon")
def cross_group_edges(spark: SparkSession, sf: str) -> DataFrame:
    return va.cross_group(tb.relationships(spark, sf), tb.animals(spark, sf).select("id", "taxon"), "taxon")


@REG.add("url_validate", f"select media_id, {_WEB.format('source_page_url')} ok from (select distinct media_id, source_page_url from media)")
def url_validate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media").select("media_id", "source_page_url").distinct().select("media_id", urls.is_web_url(F.col("source_page_url")).alias("ok"))


@REG.add("url_allowed", tb.ctes("med") + "select media_id, coalesce(regexp_full_match(direct_remote_url, 'https://photos-06\\.example/raw/[^?#]*'), false) ok from med")
def url_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return tb.media(spark, sf).select("media_id", urls.is_allowed_url(F.col("direct_remote_url"), "photos-06.example", "/raw/").alias("ok"))


@REG.add("url_param", "select doc_id, regexp_extract(text, '[?&]id=([^&#]*)', 1) id_param from documents where regexp_extract(text, '[?&]id=([^&#]*)', 1) <> ''")
def url_param(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "[?&]id=([^&#]*)", 1), F.lit("")).alias("id_param"))
    return d.where("id_param is not null")


# RE2 has no lookahead: what is not to be found is taken out afterwards.
_SCAN_SQL = r"""select distinct doc_id, kind, finding from (
  select doc_id, 'web_url' kind, unnest(regexp_extract_all(text, 'https?://[^\s"''<>)]+')) finding from documents
  union all select doc_id, 'data_uri', unnest(regexp_extract_all(text, '(?i)data:image/')) from documents
  union all select doc_id, 'local_image', unnest(regexp_extract_all(text, '(?i)(?:src|href)\s*=\s*(?:"[^''"]+\.(?:jpe?g|png|webp)(?:[?#][^''"]*)?"|''[^''"]+\.(?:jpe?g|png|webp)(?:[?#][^''"]*)?'')')) from documents
  union all select doc_id, 'css_url', unnest(regexp_extract_all(text, '(?i)url\(\s*(?:"[^)''"\s]+\.(?:jpe?g|png|webp)(?:[?#][^)''"\s]*)?"|''[^)''"\s]+\.(?:jpe?g|png|webp)(?:[?#][^)''"\s]*)?''|[^)''"\s]+\.(?:jpe?g|png|webp)(?:[?#][^)''"\s]*)?)\s*\)')) from documents)
where kind in ('web_url', 'data_uri') or not regexp_matches(finding, '[=(]\s*["'']?(https?://|//|data:)', 'i')"""


@REG.add("content_scan", _SCAN_SQL)
def content_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.content_scan(table(spark, sf, "documents"), "doc_id", "text")


@REG.add("key_scan", "select payload_id::varchar \"key\", replace(fullkey, '\"', '') path, value ->> '$' as \"value\" from (select payload_id, t.fullkey fullkey, t.key k, t.type type, t.value as value from (select * from atlas_payloads where json_valid(payload)) p, json_tree(p.payload) t) where k in ('date', 'value') and type = 'VARCHAR'")
def key_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The dates and values of the payloads by their names, whatever lies around them."""
    return scan.key_scan(table(spark, sf, "atlas_payloads"), "payload_id", "payload", ("date", "value"), photos=False)


@REG.add("url_stats", tb.ctes("med") + f"select coalesce(license_name, 'none') grp, family, count(*) n, count(distinct url) n_unique, count(*) filter (not {_WEB.format('url')}) n_bad from (select license_name, 'page' family, source_page_url url from med union all select license_name, 'file', direct_remote_url from med union all select license_name, 'thumbnail', direct_thumbnail_url from med) where url is not null and url <> '' group by all")
def url_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = tb.media(spark, sf).withColumn("license", F.coalesce("license_name", F.lit("none")))
    return audit.url_stats(m, "license", {"page": "source_page_url", "file": "direct_remote_url", "thumbnail": "direct_thumbnail_url"})


@REG.add("tier_audit", tb.ctes("rel") + f"select r.id, coalesce(s.tier, 'missing') tier, count(*) n from (select id, {tb.KEY.format('c')} c from (select id, unnest(source_ids) c from rel)) r left join sources s on s.id = r.c where r.c is not null group by all")
def tier_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = tb.relationships(spark, sf).select("id", F.transform("source_ids", lambda c: id_key(c)).alias("source_ids"))
    return audit.tier_audit(r, table(spark, sf, "sources").select("id", "tier"), "id")


@REG.add("latency_summary", "select event_type, quantile_disc(value, 0.5) median, quantile_disc(value, 0.95) p95, round(avg(value), 6) mean, count(value) n from events group by event_type")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.latency_summary(table(spark, sf, "events"), "event_type", "value")


@REG.add("count_delta", "select coalesce(b.taxon, a.taxon) taxon, coalesce(b.n, 0) n_before, coalesce(a.n, 0) n_after, coalesce(a.n, 0) - coalesce(b.n, 0) n_added from (select coalesce(taxon, 'none') taxon, count(*) n from animals where dataset = 'curated' group by 1) b full join (select coalesce(taxon, 'none') taxon, count(*) n from animals group by 1) a on a.taxon = b.taxon")
def count_delta(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "animals").select(F.coalesce("taxon", F.lit("none")).alias("taxon"), "dataset")
    return audit.count_delta(a.where("dataset = 'curated'"), a, "taxon")


@REG.add("repeatable", "select coalesce(id, 'none') id, min(sex) is not distinct from max(sex) and count(sex) > 0 as repeatable from animals group by 1 having count(sex) > 0")
def repeatable(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "animals").where("sex is not null").select(F.coalesce("id", F.lit("none")).alias("id"), "sex")
    return audit.repeatable(a, "id", "sex")


@REG.add("labels", tb.ctes("rel") + "select distinct type, case type when 'biological_mother' then 'Mother' when 'biological_father' then 'Father' else upper(type[1]) || type[2:] end label from rel")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    t = tb.relationships(spark, sf).select("type").distinct()
    return t.select("type", text.label(F.col("type"), {"biological_mother": "Mother", "biological_father": "Father"}).alias("label"))


