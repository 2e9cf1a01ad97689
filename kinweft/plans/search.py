"""Queries of the search index: facets, text, pages, places, names and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweft.functions import dates, text
from kinweft.operators import index as ix
from kinweft.operators import search as se
from kinweft.plans import tables as tb
from kinweft.plans.base import Registry
from kinweft.session import table

REG = Registry()
_NORM = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"


@REG.add("facet_filter", tb.ctes("sr") + f"select id, taxon, country_code from sr where {_NORM.format("coalesce(taxon, '')")} = 'ailurus fulgens' and {_NORM.format("coalesce(status, 'unknown')")} = 'unknown'")
def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = se.search_index(tb.search_rows(spark, sf))
    return se.search(rows, taxon="Ailurus  fulgens", status="Unknown").select("id", "taxon", "country_code")


@REG.add("facet_tristate", tb.ctes("sr") + "select case when photo_confirmed is true then 'confirmed' else 'unconfirmed' end facet, count(*) n from sr group by all")
def facet_tristate(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.search_rows(spark, sf)
    parts = [rows.where(se.photo_facet(f)).select(F.lit(f).alias("facet")) for f in ("confirmed", "unconfirmed")]
    return parts[0].unionByName(parts[1]).groupBy("facet").agg(F.count("*").alias("n"))


@REG.add(
    "facet_values",
    tb.ctes("sr") + "select facet, value, count(*) n from (select 'taxon' facet, coalesce(taxon, '') value from sr union all select 'sex', coalesce(sex, 'unknown') from sr union all select 'status', coalesce(status, 'unknown') from sr union all select 'population', coalesce(population, '') from sr union all select 'country_code', coalesce(country_code, '') from sr) where value <> '' group by all",
)
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return se.facet_values(tb.search_rows(spark, sf), ["taxon", "sex", "status", "population", "country_code"])


_HIT = """hit as (select id, name.canonical canonical, status, external_ids from sr where len(list_filter(
  list_concat([id, taxon, population, name.canonical], list_concat(coalesce(list_transform(name.localized, lambda x: x.value), []), list_concat(coalesce(list_transform(aliases, lambda x: x.value), []), list_concat(coalesce(institution_names, []), coalesce(list_transform(external_ids, lambda x: x.value), []))))),
  lambda x: contains(lower(strip_accents(x)), 'kar'))) > 0)"""


@REG.add("text_search", tb.ctes("sr", more=_HIT) + "select id, canonical from hit")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return se.search(se.search_index(tb.search_rows(spark, sf)), "Kar").select("id", F.col("name.canonical").alias("canonical"))


@REG.add("text_search_faceted", tb.ctes("sr", more=_HIT) + "select id, canonical from hit where trim(lower(coalesce(status, 'unknown'))) = 'living'")
def text_search_faceted(spark: SparkSession, sf: str) -> DataFrame:
    return se.search(se.search_index(tb.search_rows(spark, sf)), "kar", status="living").select("id", F.col("name.canonical").alias("canonical"))


@REG.add("search_taxon", tb.ctes("sr") + f"select id from sr where contains({_NORM.format('taxon')}, 'us mar')")
def search_taxon(spark: SparkSession, sf: str) -> DataFrame:
    """A query finds taxa, and no countries."""
    return se.search(se.search_index(tb.search_rows(spark, sf)), "US  Mar").select("id")


@REG.add("search_exact_id", "select distinct id, concat_ws(':', x.namespace, x.value) id_key from (select id, unnest(external_ids) x from animals) where concat_ws(':', lower(x.namespace), lower(x.value)) in ('isb:0000015', 'isb:0000074', 'isb:0000100')")
def search_exact_id(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "animals").select("id", F.explode("external_ids").alias("x")).select("id", F.concat_ws(":", "x.namespace", "x.value").alias("id_key"))
    return x.where(F.lower("id_key").isin("isb:0000015", "isb:0000074", "isb:0000100")).distinct()


@REG.add("search_page", tb.ctes("sr") + "select id, name.canonical canonical, greatest((select count(*) from sr) - 60, 0) overflow from sr order by id limit 60")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.search_rows(spark, sf).select("id", F.col("name.canonical").alias("canonical"))
    return se.page(rows, [F.col("id")]).select("id", "canonical", F.col("overflow").cast("bigint").alias("overflow"))


_LATIN = "regexp_full_match(canonical, '[A-Za-z \\-À-ÖØ-öø-ÿāēīōū]*')"


@REG.add("normalized_key", tb.ctes("sr") + f"select id, trim(regexp_replace(lower(strip_accents(canonical)), '\\s+', ' ', 'g')) name_key from (select id, name.canonical canonical from sr) where {_LATIN}")
def normalized_key(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.search_rows(spark, sf).select("id", F.col("name.canonical").alias("c")).where(F.col("c").rlike("^[A-Za-z \\-À-ÖØ-öø-ÿāēīōū]*$"))
    return n.select("id", text.normalized_key("c").alias("name_key"))


@REG.add("merge_keys")
def merge_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.animals(spark, sf).select("id", F.col("name.canonical").alias("c"), F.try_element_at("institution_names", F.lit(1)).alias("i"))
    return n.select("id", text.merge_key("c").alias("merge_key"), text.legacy_key("c").alias("legacy_key"), text.facility_key("i").alias("facility_key"))


@REG.add(
    "facility_history",
    tb.ctes("ev", "inst") + "select e.animal_id, e.p institution_id, i.country_code from (select distinct animal_id, unnest([from_institution_id, to_institution_id, institution_id]) p from ev where animal_id is not null) e join inst i on i.id = e.p",
)
def facility_history(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "institutions").select(F.col("id").alias("institution_id"), "country_code").where("institution_id is not null")
    h = ix.facility_history(tb.events(spark, sf), ["from_institution_id", "to_institution_id", "institution_id"], places, "animal_id", "institution_id")
    return h.select(F.col("owner").alias("animal_id"), "institution_id", "country_code")


_SORT = "coalesce(nullif(date.value, ''), nullif(date.\"end\", ''), nullif(date.start, ''), '')"


@REG.add(
    "last_location",
    tb.ctes("ev", "inst") + f"select e.animal_id, max_by(i.country_code, ({_SORT}, e.id, i.country_code)) country_code from ev e join inst i on i.id = coalesce(e.to_institution_id, e.institution_id) where i.country_code is not null and e.animal_id is not null group by all",
)
def last_location(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).where("animal_id is not null").select("animal_id", "id", dates.sort_key(F.col("date")).alias("at"), ix.destination("to_institution_id", "institution_id").alias("place"))
    i = table(spark, sf, "institutions").select(F.col("id").alias("place"), "country_code")
    return ix.last_value(e.join(i, "place"), "animal_id", "country_code", "at", "id")


@REG.add("unanimous", tb.ctes("ev") + "select animal_id, case when min(date.value) = max(date.value) then min(date.value) end birth from ev where type = 'birth' and animal_id is not null group by all")
def unanimous(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).where("type = 'birth' and animal_id is not null").select("animal_id", F.col("date.value").alias("birth"))
    return ix.unanimous(e, "animal_id", "birth")


@REG.add("preferred_name", "select id, list_min(list_transform(names, lambda x: {'a': x.language <> 'en', 'v': x.value})).v as name from institutions where id is not null and names is not null and len(list_filter(names, lambda x: x.language is null or x.value is null)) = 0")
def preferred_name(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "institutions").where(F.col("id").isNotNull() & F.col("names").isNotNull() & ~F.exists("names", lambda x: x["language"].isNull() | x["value"].isNull()))
    return i.select("id", ix.preferred(F.col("names")).alias("name"))


@REG.add("first_allowed", tb.ctes("med") + "select animal_id, min(media_id) media_id from med where embedding_status = 'allowed' and animal_id is not null group by all")
def first_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return ix.first_per_key(tb.media(spark, sf).where("embedding_status = 'allowed' and animal_id is not null"), "animal_id", "media_id", "media_id")


@REG.add(
    "catalog",
    tb.ctes("an", "med") + "select a.taxon, a.n_animals, a.countries, coalesce(m.n_media, 0) n_media, coalesce(m.n_not_allowed, 0) n_not_allowed from (select taxon, count(distinct id) n_animals, array_to_string(list_sort(list_distinct(list(country_code) filter (country_code is not null))), ',') countries from an where taxon is not null group by all) a left join (select an.taxon, count(*) n_media, count(*) filter (embedding_status is distinct from 'allowed') n_not_allowed from med join an on an.id = med.animal_id group by all) m on m.taxon = a.taxon",
)
def catalog(spark: SparkSession, sf: str) -> DataFrame:
    a = tb.animals(spark, sf).select("id", "taxon", "country_code").where("taxon is not null")
    m = tb.media(spark, sf).select("animal_id", "embedding_status").join(a.select(F.col("id").alias("animal_id"), "taxon"), "animal_id")
    return ix.catalog(a, m, "taxon")


@REG.add("localized_name", tb.ctes("sr") + "select id, coalesce(list_filter(name.localized, lambda x: x.language = 'ja')[1].value, name.canonical) as name from sr")
def localized_name(spark: SparkSession, sf: str) -> DataFrame:
    return tb.search_rows(spark, sf).select("id", text.localized(F.col("name.localized"), F.col("name.canonical"), "ja").alias("name"))


@REG.add("chunk_assign", tb.ctes("an") + "select id, (row_number() over (order by id) - 1) // 128 chunk_id from an")
def chunk_assign(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "animals").select("id").where("id is not null").distinct()
    return ix.chunks(ids, "id")


@REG.add(
    "chunk_sources",
    tb.ctes("src", more="c as (select id, (row_number() over (order by id) - 1) // 128 chunk_id from (select distinct id from animals where id is not null)), s as (select distinct id, unnest(name.source_ids) source_id from animals)") + "select distinct c.chunk_id, src.id source_id, src.tier from s join c on c.id = s.id join src on src.id = s.source_id",
)
def chunk_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "animals").where("id is not null")
    placed = ix.chunks(a.select("id").distinct(), "id")
    cited = a.select("id", F.explode("name.source_ids").alias("source_id")).distinct().join(placed, "id").select("chunk_id", "source_id").distinct()
    return cited.join(table(spark, sf, "sources").select(F.col("id").alias("source_id"), "tier"), "source_id").select("chunk_id", "source_id", "tier")


@REG.add(
    "resolve_priority",
    tb.ctes("an", "med", more="l as (select animal_id, min(media_id) m from med where offline_archive_eligible group by all), p as (select animal_id, min(media_id) m from med where embedding_status = 'allowed' group by all), w as (select animal_id, min(media_id) m from med where direct_remote_url is not null group by all)")
    + "select an.id animal_id, case when l.m is not null then 'local' when p.m is not null then 'approved' when w.m is not null then 'public' end source, coalesce(l.m, p.m, w.m) target from an left join l on l.animal_id = an.id left join p on p.animal_id = an.id left join w on w.animal_id = an.id",
)
def resolve_priority(spark: SparkSession, sf: str) -> DataFrame:
    m = tb.media(spark, sf).select("animal_id", F.col("media_id").alias("target"), "offline_archive_eligible", "embedding_status", "direct_remote_url")
    tiers = [("local", m.where("offline_archive_eligible")), ("approved", m.where("embedding_status = 'allowed'")), ("public", m.where("direct_remote_url is not null"))]
    refs = table(spark, sf, "animals").select(F.col("id").alias("animal_id")).where("animal_id is not null").distinct()
    return ix.resolve_priority(refs, tiers, "animal_id").select("animal_id", "source", "target")


_DATE = tb.ctes("ev")


@REG.add("date_label", _DATE + "select id, case date.precision when 'exact' then nullif(date.value, '') when 'approximate' then '~' || nullif(date.value, '') when 'range' then nullif(date.start, '') || '–' || nullif(date.\"end\", '') end label from ev")
def date_label(spark: SparkSession, sf: str) -> DataFrame:
    return tb.events(spark, sf).select("id", dates.date_label(F.col("date")).alias("label"))


@REG.add("date_label_locale", _DATE + "select id, case date.precision when 'exact' then coalesce(date.value, '不明') when 'approximate' then '約' || coalesce(date.value, '?') when 'range' then coalesce(date.start, '?') || '–' || coalesce(date.\"end\", '?') else '不明' end label from ev")
def date_label_locale(spark: SparkSession, sf: str) -> DataFrame:
    return tb.events(spark, sf).select("id", dates.date_label_locale(F.col("date"), "ja").alias("label"))


_FULL = "(regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast({0} as date) is not null)"


@REG.add("valid_partial_date", _DATE + f"select id, coalesce(regexp_full_match(date.value, '\\d{{4}}') or regexp_full_match(date.value, '\\d{{4}}-(0[1-9]|1[0-2])') or {_FULL.format('date.value')}, false) valid from ev")
def valid_partial_date(spark: SparkSession, sf: str) -> DataFrame:
    return tb.events(spark, sf).select("id", dates.is_partial_date(F.col("date.value")).alias("valid"))


@REG.add(
    "date_range_order",
    _DATE + "select id, date.precision is not distinct from 'range' and coalesce((case length(date.start) when 4 then date.start || '-01-01' when 7 then date.start || '-01' else date.start end) > (case length(date.\"end\") when 4 then date.\"end\" || '-99-99' when 7 then date.\"end\" || '-99' else date.\"end\" end), false) is_reversed from ev",
)
def date_range_order(spark: SparkSession, sf: str) -> DataFrame:
    return tb.events(spark, sf).select("id", dates.is_reversed_range(F.col("date")).alias("is_reversed"))


@REG.add(
    "parse_partial_date",
    "with d as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y.%-m.%-d') when 1 then strftime(o_orderdate, '%Y/%m') when 2 then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-13-%d') end raw, strftime(o_orderdate, '%Y-%m-%d') as the_day from orders)\n"
    "select o_orderkey, case o_orderkey % 4 when 0 then 'exact' when 3 then null else 'approximate' end as precision, case o_orderkey % 4 when 0 then the_day when 1 then left(the_day, 7) when 2 then left(the_day, 4) end as value from d",
)
def parse_partial_date(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy.M.d")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM")).when(k == 2, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-'13'-dd"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_foreign_date(raw).alias("d")).select("o_orderkey", F.col("d.precision").alias("precision"), F.col("d.value").alias("value"))


@REG.add("event_order", _DATE + f"select id, {_SORT} as sort_key from ev")
def event_order(spark: SparkSession, sf: str) -> DataFrame:
    return tb.events(spark, sf).select("id", dates.sort_key(F.col("date")).alias("sort_key"))


@REG.add("history_kinds", tb.ctes("ev") + f"select animal_id, id, case when row_number() over (partition by animal_id order by {_SORT}, id) = 1 then 'observation' else 'transfer' end kind from ev where animal_id is not null and institution_id is not null")
def history_kinds(spark: SparkSession, sf: str) -> DataFrame:


    e = tb.events(spark, sf).where("animal_id is not null and institution_id is not null").select("animal_id", "id", dates.sort_key(F.col("date")).alias("at"))
    n = F.row_number().over(Window.partitionBy("animal_id").orderBy("at", "id"))
    return e.select("animal_id", "id", F.when(n == 1, "observation").otherwise("transfer").alias("kind"))


@REG.add("institution_ids", "select id, regexp_replace(regexp_replace(names[1].value, '[^A-Za-z0-9._:-]+', '-', 'g'), '^[-:]+|[-:]+$', '', 'g') as safe, left(sha256(names[1].value), 16) as stable from institutions where id is not null and coalesce(names[1].value, '') <> '' and regexp_matches(names[1].value, '[A-Za-z0-9]')")
def institution_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = F.try_element_at("names", F.lit(1))["value"]
    i = table(spark, sf, "institutions").select("id", v.alias("v")).where("id is not null and v rlike '[A-Za-z0-9]'")
    return i.select("id", text.safe_id(F.col("v")).alias("safe"), text.stable_id(F.col("v")).alias("stable"))


@REG.add("stable_id", "select id, left(sha256(url), 16) stable from sources where id is not null and url is not null")
def stable_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").where("id is not null and url is not null").select("id", text.stable_id(F.col("url")).alias("stable"))


@REG.add("safe_id", "select id, coalesce(nullif(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._:-]+', '-', 'g'), '^[-:]+|[-:]+$', '', 'g'), ''), 'unknown') safe from sources where id is not null")
def safe_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").where("id is not null").select("id", text.safe_id(F.col("title")).alias("safe"))


@REG.add("html_escape", "select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) escaped from documents")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.html_escape(F.col("text"))).alias("escaped"))


