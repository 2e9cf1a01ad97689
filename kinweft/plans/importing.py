"""Queries of taking a foreign graph in: import_animals as its animals, their institution names as its places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.functions import display
from kinweft.operators import imports as im
from kinweft.operators.index import chunks
from kinweft.plans import tables as tb
from kinweft.plans.base import Registry
from kinweft.session import table

REG = Registry()
PREFIX = "place:new-"
_MK = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_SAFE = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._:-]+', '-', 'g'), '^[-:]+|[-:]+$', '', 'g'), '^-+', ''), ''), 'unknown')"

_IMP = "imp as (select distinct on (id) * from import_animals where id is not null order by id, loaded_at, bundle, name.canonical)"
_AMAP = "amap as (select imp.id old, min(u.id) \"new\" from imp join (select name.canonical n, min(id) id from animals where name.canonical is not null group by 1 having count(distinct id) = 1) u on u.n = imp.name.canonical group by 1)"
_EDGES = "edges as (select distinct id || ':' || place id, id animal, place from (select id, unnest(institution_names) place from import_animals where id is not null) where place is not null)"
_PLACES = f"""bear as (select k, list_sort(list(distinct id)) ids from (select id, {_MK.format('n')} k from (select id, unnest(names).value n from institutions where id is not null)) where k <> '' group by k),
pl as (select distinct place old from edges),
px as (select pl.old, bear.ids, coalesce(len(ids), 0) n from pl left join bear on bear.k = {_MK.format('pl.old')}),
pm as (select old, case when n = 1 then ids[1] end hit, case when n = 1 then 'matched_name' when n > 1 then 'ambiguous_name' else 'new' end status, case when n > 1 then array_to_string(ids, ',') else '' end candidates, '{PREFIX}' || {_SAFE.format('old')} base from px),
places as (select old, coalesce(hit, case when rn = 1 then base else base || '-' || rn end) "new", status, candidates from (select *, row_number() over (partition by base, hit is null order by old) rn from pm))"""


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "import_animals").where("id is not null")


def _animal_map(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "animals").select(F.col("name.canonical").alias("n"), "id").where("n is not null")
    one = a.groupBy("n").agg(F.min("id").alias("new"), F.max("id").alias("hi")).where("new = hi").drop("hi")
    first = F.min_by("name.canonical", F.struct("loaded_at", "bundle", "name.canonical")).alias("n")
    return _imports(spark, sf).groupBy(F.col("id").alias("old")).agg(first).join(one, "n").select("old", "new")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _imports(spark, sf).select(F.col("id").alias("animal"), F.explode("institution_names").alias("place")).where("place is not null").distinct()
    return e.select(F.concat_ws(":", "animal", "place").alias("id"), "animal", "place")


def _place_map(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "institutions").select("id", F.explode("names.value").alias("name"))
    foreign = _edges(spark, sf).select(F.col("place").alias("id"), F.col("place").alias("name")).distinct()
    none = spark.createDataFrame([], "old string, new string")
    return im.merge_places(own, foreign, none, PREFIX)


@REG.add("merge_places", tb.ctes(more=f"{_EDGES}, {_PLACES}").replace("\n,", "\n") + "select old, \"new\", status, candidates from places")
def merge_places(spark: SparkSession, sf: str) -> DataFrame:
    return _place_map(spark, sf)


@REG.add(
    "holding_outcomes",
    tb.ctes(more=f"{_IMP}, {_AMAP}, {_EDGES}, {_PLACES}")
    + "select e.id, a.\"new\" final_animal, p.\"new\" final_place, case when a.\"new\" is null then 'excluded_unmapped_animal' when p.\"new\" is null then 'excluded_unmapped_place' when count(*) over (partition by e.animal) <> 1 then 'excluded_several_places' else 'mapped_holding' end status from edges e left join amap a on a.old = e.animal left join places p on p.old = e.place",
)
def holding_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return im.holding_outcomes(_edges(spark, sf), _animal_map(spark, sf), _place_map(spark, sf))


_BORN = "born as (select animal_id, min(date.value) born from ev where type = 'birth' and date.value <> '' group by 1)"


@REG.add(
    "birthplace_outcomes",
    tb.ctes("ev", more=f"{_IMP}, {_AMAP}, {_EDGES}, {_PLACES}, {_BORN}")
    + "select e.id, a.\"new\" final_animal, p.\"new\" final_place, case when a.\"new\" is null then 'excluded_unmapped_animal' when count(*) over (partition by e.animal) <> 1 then 'excluded_several_places' when contains(e.place, 'Zoo') and b.born is null then 'excluded_wild_without_birth' when contains(e.place, 'Zoo') then 'mapped_birth_without_place' when p.\"new\" is null then 'excluded_unmapped_place' when b.born is null then 'excluded_no_birth' else 'mapped_birth' end status from edges e left join amap a on a.old = e.animal left join places p on p.old = e.place left join born b on b.animal_id = a.\"new\"",
)
def birthplace_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Places whose name has Zoo stand for the wild marker here, so that all outcomes occur."""
    e, a = _edges(spark, sf), _animal_map(spark, sf)
    born = tb.events(spark, sf).where("type = 'birth' and date.value != ''").groupBy(F.col("animal_id").alias("new")).agg(F.min("date.value").alias("born"))
    births = a.join(born, "new").select(F.col("old").alias("animal"), "born")
    return im.birthplace_outcomes(e, a, _place_map(spark, sf), births, e.where(F.contains("place", F.lit("Zoo"))).select("place"))


@REG.add(
    "attach_names",
    tb.ctes("an", more=f"""{_IMP}, {_AMAP},
inc as (select distinct amap."new" id, 'localized' kind, x.language, x.value from (select id, unnest(name.localized) x from import_animals) i join amap on amap.old = i.id union select amap."new", 'alias', x.language, x.value from (select id, unnest(aliases) x from import_animals) i join amap on amap.old = i.id),
incn as (select *, {_MK.format('value')} k from inc where trim(value) <> ''),
o as (select id, name.canonical canonical, {_MK.format('name.canonical')} ck, name.localized localized, list_transform(aliases, lambda x: {_MK.format('x.value')}) ak from an)""")
    + "select incn.id, kind, language, value from incn join o on o.id = incn.id where kind = 'localized' and value is distinct from canonical and coalesce(len(list_filter(localized, lambda x: x.value = incn.value and x.language is not distinct from incn.language)), 0) = 0\n"
    "union all select id, kind, language, value from (select incn.*, row_number() over (partition by incn.id, k order by language nulls first, value) n from incn join o on o.id = incn.id where kind = 'alias' and k <> '' and k is distinct from ck and not coalesce(list_contains(ak, k), false)) where n = 1",
)
def attach_names(spark: SparkSession, sf: str) -> DataFrame:
    own = tb.animals(spark, sf).select("id", F.col("name.canonical").alias("canonical"), "name.localized", "aliases")
    i = _imports(spark, sf).join(_animal_map(spark, sf).withColumnRenamed("old", "id"), "id")
    part = lambda c, kind: i.select(F.col("new").alias("id"), F.lit(kind).alias("kind"), F.explode(c).alias("x")).select("id", "kind", "x.language", "x.value")
    return im.attach_names(own, part("name.localized", "localized").unionByName(part("aliases", "alias")))


_PHOTOS = "ph as (select m.media_id vertex, case when m.identity_confidence is null then 'other' else 'media' end kind, 1 place, case when {w1} then source_page_url end page, case when {w2} then direct_remote_url end direct, animal_id owner from med m)".format(
    w1="coalesce(regexp_matches(source_page_url, '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+'), false)", w2="coalesce(regexp_matches(direct_remote_url, '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+'), false)"
)
_OUT = "known as (select distinct id from animals where id is not null), ow as (select ph.*, k.id target from ph left join known k on k.id = ph.owner), po as (select vertex, page, direct, target, case when kind = 'other' then 'excluded_no_animal' when page is null and direct is null then 'excluded_no_web_address' when target is null then 'excluded_unmapped_owner' else 'mapped_media' end status from ow)"


def _photos(spark: SparkSession, sf: str) -> DataFrame:
    m = tb.media(spark, sf)
    p = m.select(F.col("media_id").alias("vertex"), F.when(F.col("identity_confidence").isNull(), "other").otherwise("media").alias("kind"), F.lit(1).alias("place"), F.col("source_page_url").alias("page"), F.col("direct_remote_url").alias("direct"), F.array("animal_id").alias("owners"))
    ids = table(spark, sf, "animals").where("id is not null").select(F.col("id").alias("old"), F.col("id").alias("new")).distinct()
    return im.photo_outcomes(p, ids)


@REG.add("photo_outcomes", tb.ctes("med", more=f"{_PHOTOS}, {_OUT}") + "select vertex, status, coalesce(target, '') targets from po")
def photo_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _photos(spark, sf).select("vertex", "status", F.array_join("targets", ",").alias("targets"))


@REG.add("expand_media", tb.ctes("med", more=f"{_PHOTOS}, {_OUT}") + "select 'media:' || substr(sha256(target || chr(0) || coalesce(page, 'https://export.example/') || chr(0) || coalesce(direct, '')), 1, 20) media_id, target animal_id, coalesce(page, 'https://export.example/') page, direct, min(vertex) first_vertex from po where status = 'mapped_media' group by all")
def expand_media(spark: SparkSession, sf: str) -> DataFrame:
    return im.expand_media(_photos(spark, sf), "https://export.example/")


@REG.add("url_sources", tb.ctes("med", more=f"{_PHOTOS}") + "select 'source:url:' || substr(sha256(page), 1, 16) id, page url, lower(regexp_extract(page, '^[a-zA-Z]+://([^/?#:]+)', 1)) publisher from (select distinct page from ph where page is not null)")
def url_sources(spark: SparkSession, sf: str) -> DataFrame:
    return im.url_sources(tb.media(spark, sf), "source_page_url", table(spark, sf, "sources").select("id"))


@REG.add("photo_drops", tb.ctes("med", more=f"{_PHOTOS}, {_OUT}") + "select status reason, count(*) n from po where status <> 'mapped_media' group by all")
def photo_drops(spark: SparkSession, sf: str) -> DataFrame:
    """Why photos are left out, and how many for each reason."""
    return _photos(spark, sf).where("status != 'mapped_media'").groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("n"))


@REG.add(
    "vertex_outcomes",
    tb.ctes("med", more=f"{_IMP}, {_AMAP}, {_EDGES}, {_PLACES}, {_PHOTOS}, {_OUT}, v as (select id, 'animal' kind from imp union all select old, 'place' from places union all select vertex, 'media' from ph)")
    + "select v.id, v.kind, case v.kind when 'animal' then case when a.old is null then 'excluded_unmapped_animal' else 'matched' end when 'place' then p.status else case when po.status = 'mapped_media' then 'mapped_media' when po.target is not null then 'excluded_no_photo' else 'excluded_photo_only' end end status, case v.kind when 'animal' then a.\"new\" when 'place' then p.\"new\" end target from v left join amap a on v.kind = 'animal' and a.old = v.id left join places p on v.kind = 'place' and p.old = v.id left join po on v.kind = 'media' and po.vertex = v.id",
)
def vertex_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    a, p, ph = _animal_map(spark, sf).withColumn("status", F.lit("matched")), _place_map(spark, sf), _photos(spark, sf)
    v = _imports(spark, sf).select("id", F.lit("animal").alias("kind")).distinct().unionByName(p.select(F.col("old").alias("id"), F.lit("place").alias("kind"))).unionByName(ph.select(F.col("vertex").alias("id"), F.lit("media").alias("kind")))
    n = ph.select("vertex", F.size("targets").alias("n_animals"), F.when(F.col("status") == "mapped_media", F.size("targets")).otherwise(0).alias("n_media"))
    return im.vertex_outcomes(v, a, p, n)


@REG.add("two_way_ids", "select distinct x alias, id from (select id, unnest([id, case when starts_with(id, '-') then substr(id, 2) else '-' || id end]) x from import_animals where id is not null)")
def two_way_ids(spark: SparkSession, sf: str) -> DataFrame:
    return im.two_way_ids(_imports(spark, sf))


@REG.add("edge_ordinals", tb.ctes("rel") + "select id, type || ':' || case when n < 1000 then lpad(n::varchar, 4, '0') else n::varchar end edge_id from (select id, type, row_number() over (partition by type order by id) n from rel where type is not null)")
def edge_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return im.edge_ordinals(tb.relationships(spark, sf).where("type is not null"), "type", "id").select("id", "edge_id")


@REG.add("dated_gaps", tb.ctes("an", "ev") + "select an.id, 'birth' type, substr(review.reviewed_on, 1, 10) value from an where trim(review.reviewed_on) <> '' and (an.id, substr(review.reviewed_on, 1, 10)) not in (select (animal_id, date.value) from ev where type = 'birth' and animal_id is not null and date.value is not null)")
def dated_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Review dates stand for the dates of a legacy record that no event repeats."""
    r = tb.animals(spark, sf).select("id", F.col("review.reviewed_on").alias("born"))
    e = tb.events(spark, sf).where("animal_id is not null").select(F.col("animal_id").alias("id"), "type", F.col("date.value").alias("value"))
    return im.dated_gaps(r, e, {"born": "birth"})


@REG.add("merged_notes", tb.ctes("ev") + "select id, case when coalesce(trim(notes), '') = '' then coalesce(nullif(trim(date.notes), ''), '') when coalesce(trim(date.notes), '') = '' or trim(notes) = trim(date.notes) then trim(notes) else trim(notes) || chr(10) || trim(date.notes) end notes from (select distinct on (id) * from atlas_events where id is not null)")
def merged_notes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "atlas_events").drop("loaded_at").where("id is not null").dropDuplicates(["id"])
    return e.select("id", im.merged_notes(F.col("notes"), F.col("date.notes")).alias("notes"))


@REG.add("without_tokens", tb.ctes("sr") + "select id, array_to_string(list_filter(institution_names, lambda x: not contains(lower(x), 'zoo') and not contains(lower(x), 'park')), '|') kept from sr where institution_names is not null and len(list_filter(institution_names, lambda x: x is null)) = 0")
def without_tokens(spark: SparkSession, sf: str) -> DataFrame:
    r = tb.search_rows(spark, sf).where("institution_names is not null and not exists(institution_names, x -> x is null)")
    return r.select("id", F.array_join(im.without_tokens(F.col("institution_names"), ["ZOO", "Park"]), "|").alias("kept"))


@REG.add("preferred_foreign_name", tb.ctes("sr", more="n as (select id, list_filter(name.localized, lambda x: x.language is not null and trim(x.value) <> '' and lower(trim(x.value)) not in ('none', 'unknown')) l from sr), f as (select id, list_sort(list_transform(l, lambda x: {'a': x.language <> 'ja', 'k': x.language, 'v': trim(x.value)})) s from n where len(l) > 0 and len(list_distinct(list_transform(l, lambda x: x.language))) = len(l))") + "select id, s[1].v as \"value\", len(s) - 1 n_rest from f")
def preferred_foreign_name(spark: SparkSession, sf: str) -> DataFrame:
    known = F.filter("name.localized", lambda x: x["language"].isNotNull() & F.coalesce((F.trim(x["value"]) != "") & ~F.lower(F.trim(x["value"])).isin("none", "unknown"), F.lit(False)))
    r = tb.search_rows(spark, sf).select("id", known.alias("l")).where("size(l) > 0 and size(array_distinct(l.language)) = size(l)")
    best = im.preferred_name(F.map_from_entries(F.transform("l", lambda x: F.struct(x["language"], x["value"]))), "ja")
    return r.select("id", best.alias("b")).select("id", "b.value", F.size("b.rest").cast("bigint").alias("n_rest"))


@REG.add("edge_style", tb.ctes("rel") + "select id, case type when 'biological_mother' then '#9b6f55' when 'biological_father' then '#53768a' when 'foster' then '#7c6695' when 'adoptive' then '#7c6695' when 'social' then '#87978d' end stroke, case status when 'confirmed' then '' when 'probable' then '10.0,8.0' when 'disputed' then '16.0,8.0' when 'unknown' then '4.0,8.0' end dashes from rel")
def edge_style(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.relationships(spark, sf).select("id", display.edge_style(F.col("type"), F.col("status"), 2.0).alias("s"))
    return s.select("id", "s.stroke", F.array_join(F.transform("s.dashes", lambda x: x.cast("string")), ",").alias("dashes"))


@REG.add("preview_join", tb.ctes("an", "med", more="ok as (select animal_id, min(media_id) media_id from med where embedding_status = 'allowed' and identity_confidence = 'confirmed' and animal_id is not null group by 1)") + "select an.id, coalesce(name.canonical, an.id) \"name\", coalesce(sex, 'unknown') sex, coalesce(status, 'unknown') status, population, case when len(aliases) > 0 then len(aliases)::varchar end n_aliases, ok.media_id is not null photo_confirmed, ok.media_id from an left join ok on ok.animal_id = an.id")
def preview_join(spark: SparkSession, sf: str) -> DataFrame:
    """The compact index row of each animal: lists only where they hold something, defaults filled, the first cleared photo."""
    ok = tb.media(spark, sf).where("embedding_status = 'allowed' and identity_confidence = 'confirmed' and animal_id is not null").groupBy(F.col("animal_id").alias("id")).agg(F.min("media_id").alias("media_id"))
    a = tb.animals(spark, sf).join(ok, "id", "left")
    fill = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return a.select("id", F.coalesce("name.canonical", "id").alias("name"), fill("sex"), fill("status"), "population", F.when(F.size("aliases") > 0, F.size("aliases")).cast("string").alias("n_aliases"), F.col("media_id").isNotNull().alias("photo_confirmed"), "media_id")


@REG.add("strict_allowed", tb.ctes("med") + "select media_id, animal_id from med where embedding_status = 'allowed'")
def strict_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """The allow-list made of the cleared media: each item must agree with its record in every column."""
    m = tb.media(spark, sf)
    same = ["animal_id", "source_page_url", "direct_remote_url", "direct_thumbnail_url", "license_name", "license_url", "rights_status", "identity_confidence"]
    items = m.where("embedding_status = 'allowed'").select("media_id", *same)
    return im.strict_allowed(items, m, "media_id", same, {"embedding_status": "allowed"}).select("media_id", "animal_id")


@REG.add("country_codes", tb.ctes("an") + "select distinct lower(trim(country_code)) code from an where regexp_full_match(trim(country_code), '[A-Za-z]{2}')")
def country_codes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.lower(F.trim("country_code"))
    return tb.animals(spark, sf).where(F.trim("country_code").rlike("^[A-Za-z]{2}$")).select(c.alias("code")).distinct()


@REG.add("taxon_counts", tb.ctes("an") + "select t.taxon, v.status, count(an.id) n from (select distinct taxon from an where taxon is not null) t cross join (values ('living'), ('deceased'), ('unknown')) v(status) left join an on an.taxon = t.taxon and coalesce(an.status, 'unknown') = v.status group by all")
def taxon_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Animals of each taxon by status, with a row for a status that none has: a pivot, so that no rows are crossed."""
    a = tb.animals(spark, sf).where("taxon is not null").select("taxon", F.coalesce("status", F.lit("unknown")).alias("s"))
    n = a.groupBy("taxon").agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("living", "deceased", "unknown")])
    return n.unpivot("taxon", ["living", "deceased", "unknown"], "status", "n")


@REG.add("date_bounds", tb.ctes("ev") + "select type, max(date.value) latest, min(nullif(date.value, '')) earliest, coalesce(max(outcome_count), 0)::bigint most from ev group by all")
def date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf)
    return e.groupBy("type").agg(F.max("date.value").alias("latest"), F.min(F.nullif("date.value", F.lit(""))).alias("earliest"), F.coalesce(F.max("outcome_count"), F.lit(0)).cast("bigint").alias("most"))


@REG.add("declared_countries", tb.ctes("an", "inst") + "select a.taxon, coalesce(nullif(d.l, ''), a.l) countries from (select taxon, array_to_string(list_sort(list_distinct(list(country_code) filter (country_code is not null))), ',') l from an where taxon is not null group by all) a left join (select 'Ursus maritimus' taxon, array_to_string(list_sort(list_distinct(list(country_code) filter (country_code is not null))), ',') l from inst) d on d.taxon = a.taxon")
def declared_countries(spark: SparkSession, sf: str) -> DataFrame:
    """The declared list of countries where there is one, else those of the animals."""
    listed = F.array_join(F.array_sort(F.collect_set("country_code")), ",").alias("l")
    a = tb.animals(spark, sf).where("taxon is not null").groupBy("taxon").agg(listed)
    d = table(spark, sf, "institutions").where("id is not null").agg(listed.alias("d")).withColumn("taxon", F.lit("Ursus maritimus"))
    return a.join(d, "taxon", "left").select("taxon", F.coalesce(F.nullif("d", F.lit("")), "l").alias("countries"))


@REG.add("parent_subsets", tb.ctes("rel", more="b as (select object o, subject s, type from rel where type in ('biological_mother', 'biological_father')), x as (select o, list_sort(list(distinct s)) a from b group by 1), y as (select object o, list_sort(list(distinct subject)) a from rel group by 1)") + "select x.o animal_id, array_to_string(list_sort(list_distinct(list_concat(x.a, y.a))), ',') united, len(list_filter(x.a, lambda s: not list_contains(y.a, s))) = 0 is_subset, x.a = y.a is_same from x join y on x.o = y.o where x.o is not null")
def parent_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Biological parents against all relations of an animal: united, contained, equal as sets."""
    r = tb.relationships(spark, sf).where("object is not null")
    sets = lambda df, n: df.groupBy("object").agg(F.array_sort(F.collect_set("subject")).alias(n))
    j = sets(r.where("type in ('biological_mother', 'biological_father')"), "x").join(sets(r, "y"), "object")
    return j.select(F.col("object").alias("animal_id"), F.array_join(F.array_sort(F.array_union("x", "y")), ",").alias("united"), (F.size(F.array_except("x", "y")) == 0).alias("is_subset"), (F.col("x") == F.col("y")).alias("is_same"))


@REG.add("shared_names", tb.ctes("an", more="n as (select id, list_distinct(list_filter(list_concat([name.canonical], coalesce(list_transform(aliases, lambda x: x.value), [])), lambda x: x is not null)) l from an), i as (select distinct on (id) id, name.canonical c from import_animals where id is not null and name.canonical is not null order by id, name.canonical)") + "select i.id import_id, count(*) n_animals from i join (select id, unnest(l) v from n) x on x.v = i.c group by all")
def shared_names(spark: SparkSession, sf: str) -> DataFrame:
    """How many animals share a name of each import: an overlap of name sets, by join and not by pairs of lists."""
    names = F.array_distinct(F.filter(F.concat(F.array("name.canonical"), F.coalesce("aliases.value", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    a = tb.animals(spark, sf).select("id", F.explode(names).alias("v"))
    i = _imports(spark, sf).where("name.canonical is not null").groupBy(F.col("id").alias("import_id")).agg(F.min("name.canonical").alias("v"))
    return i.join(a, "v").groupBy("import_id").agg(F.count("*").alias("n_animals"))


@REG.add("grid_places", tb.ctes("sr", more="p as (select id, row_number() over (order by id) - 1 k, count(*) over () n from sr), q as (select *, greatest(1, ceil(sqrt(n * 1.55))::int) c from p), z as (select *, greatest(1, ceil(n / c)::int) r from q)") + "select id, (k % c)::int \"column\", (k // c)::int \"row\", round(24 + (k % c + 0.5) * (1152.0 / c), 4)::double x, round(24 + (k // c + 0.5) * ((greatest(360.0, least(1200.0, r * 28.0 + 48)) - 48) / r), 4)::double y from z")
def grid_places(spark: SparkSession, sf: str) -> DataFrame:
    """Places in a grid; positions come from chunks of one, so that no task numbers all rows."""
    ids = tb.search_rows(spark, sf).select("id")
    n = ids.agg(F.count("*").alias("n"))
    x = chunks(ids, "id", 1).join(F.broadcast(n)).select("id", display.grid_place(F.col("chunk_id"), F.col("n")).alias("g"))
    return x.select("id", "g.column", "g.row", F.round("g.x", 4).alias("x"), F.round("g.y", 4).alias("y"))
