"""Queries of set operations, crosswalks, conflicts and dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.operators import audit
from kinweft.operators import merge as me
from kinweft.plans import tables as tb
from kinweft.plans.base import Registry
from kinweft.session import id_key, table

REG = Registry()


def _side(spark: SparkSession, sf: str, dataset: str) -> DataFrame:
    """One record per animal of one dataset: the smallest value of each field, so that no order decides."""
    a = table(spark, sf, "animals").where((F.col("dataset") == dataset) & F.col("id").isNotNull())
    return a.groupBy("id").agg(F.min("taxon").alias("taxon"), F.min("sex").alias("sex"), F.min("status").alias("status"), F.min("population").alias("population"))


_SIDE = "(select id, min(taxon) taxon, min(sex) sex, min(status) status, min(population) population from animals where dataset = '{}' and id is not null group by id)"
_AB = f"with a as {_SIDE.format('curated')}, b as {_SIDE.format('upstream')}\n"


@REG.add("ordered_union", _AB + "select id, taxon, 0 side from a union all select id, taxon, 1 from b where id not in (select id from a)")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (_side(spark, sf, d).select("id", "taxon") for d in ("curated", "upstream"))
    return me.ordered_union(a, b, ["id"], "taxon").select("id", "taxon", "side")


@REG.add("merge_by_id", _AB + "select coalesce(a.id, b.id) id, coalesce(a.taxon, b.taxon) taxon, coalesce(a.sex, b.sex) sex, case when b.id is null then 'kept' when a.id is null then 'added' when a.taxon is not distinct from b.taxon and a.sex is not distinct from b.sex then 'merged' else 'conflict' end state from a full join b on a.id = b.id")
def merge_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return me.merge_by_id(_side(spark, sf, "curated"), _side(spark, sf, "upstream"), "id", ["taxon", "sex"], strict=False)


@REG.add("aligned_dedup", tb.ctes("sr", more="x as (select id, unnest(range(1, len(aliases) + 1)) i, aliases from sr), y as (select id, i, aliases[i].value v, aliases[i].language l, row_number() over (partition by id, aliases[i].value order by i) n from x)") + "select id, string_agg(coalesce(v, '') || '/' || coalesce(l, ''), ',' order by i) kept from y where n = 1 and v is not null group by id")
def aligned_dedup(spark: SparkSession, sf: str) -> DataFrame:
    r = tb.search_rows(spark, sf).where(F.size("aliases") > 0)
    kept = me.aligned_dedup(F.col("aliases.value"), F.col("aliases.language"))
    pairs = F.transform(F.filter(kept, lambda x: x["k"].isNotNull()), lambda x: F.concat(x["k"], F.lit("/"), F.coalesce(x["v0"], F.lit(""))))
    return r.select("id", F.array_join(pairs, ",").alias("kept")).where("kept != ''")


@REG.add("semantic_dedup", tb.ctes("rel") + f"select subject, object, type, min(id) id, count(distinct id) merged, coalesce(string_agg(distinct c, ',' order by c), '') source_ids from (select subject, object, type, id, {tb.KEY.format('c')} c from (select subject, object, type, id, unnest(case when len(source_ids) > 0 then source_ids else [null] end) c from rel)) group by all")
def semantic_dedup(spark: SparkSession, sf: str) -> DataFrame:
    r = tb.relationships(spark, sf).select("id", "subject", "object", "type", F.transform("source_ids", lambda c: id_key(c)).alias("source_ids"))
    return me.semantic_dedup(r, ["subject", "object", "type"], "id")


@REG.add("remap_ids", tb.ctes("rel", more="x as (select id old, min('p-' || substr(id, 4)) new from animals where id is not null group by id)") + "select r.id, coalesce(s.new, r.subject) subject, coalesce(o.new, r.object) object from rel r left join x s on s.old = r.subject left join x o on o.old = r.object")
def remap_ids(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "animals").where("id is not null").select(F.col("id").alias("old"), F.concat(F.lit("p-"), F.expr("substr(id, 4)")).alias("new")).distinct()
    return me.remap(tb.relationships(spark, sf).select("id", "subject", "object"), x, "subject", "object").select("id", "subject", "object")


_KNOWN = "{0} is not null and lower(trim({0})) not in ('unknown', '')"


@REG.add("conflicts", _AB + " union all ".join(f"select a.id, '{f}' field, a.{f} kept, b.{f} alternative from a join b on a.id = b.id where {_KNOWN.format('a.' + f)} and {_KNOWN.format('b.' + f)} and a.{f} <> b.{f}" for f in ("taxon", "sex", "status", "population")))
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return me.conflicts(_side(spark, sf, "curated"), _side(spark, sf, "upstream"), "id", ["taxon", "sex", "status", "population"])


@REG.add("fill_unknown", _AB + "select a.id, coalesce(nullif(a.sex, 'unknown'), b.sex, 'unknown') sex from a left join b on a.id = b.id")
def fill_unknown(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _side(spark, sf, "curated").select("id", "sex"), _side(spark, sf, "upstream").select("id", F.col("sex").alias("incoming"))
    return a.join(b, "id", "left").select("id", me.fill_unknown(F.col("sex"), F.col("incoming")).alias("sex"))


@REG.add("unpivot_claims", _AB + " union all ".join(f"select id, '{f}' claim_type, {f} as value from b where {f} is not null and lower(trim({f})) not in ('', 'none', 'unknown')" for f in ("sex", "status", "population")))
def unpivot_claims(spark: SparkSession, sf: str) -> DataFrame:
    return me.unpivot_claims(_side(spark, sf, "upstream"), "id", ["sex", "status", "population"])


@REG.add("event_upsert", tb.ctes("ev", more=f"x as (select animal_id, type, coalesce(date.value, '') at_, coalesce(institution_id, '') place, {tb.KEY.format('c')} c, case when notes is null then 0 else 1 end t from (select *, unnest(case when len(source_ids) > 0 then source_ids else [null] end) c from ev))") + "select animal_id, type, at_ as at, place, coalesce(string_agg(distinct c, ',' order by c), '') source_ids, case when min(t) = 1 then 'inserted' when max(t) = 1 then 'cited' else 'kept' end state from x group by animal_id, type, at_, place")
def event_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select("id", "notes", "animal_id", "type", F.coalesce("date.value", F.lit("")).alias("at"), F.coalesce("institution_id", F.lit("")).alias("place"), F.transform("source_ids", lambda c: id_key(c)).alias("source_ids"))
    return me.event_upsert(e.where("notes is null"), e.where("notes is not null"), ["animal_id", "type", "at", "place"])


_FOREIGN = tb.ctes("rel", more="n as (select id, max(sex) sex from animals where id is not null group by id having max(deleted_at) is null), f as (select id, object child, subject parent, case when type like 'bio%' then 'family' else type end label from rel), c as (select f.*, nc.id cid, np.id pid, np.sex psex, row_number() over (partition by parent, child, label order by f.id) k from f left join n nc on nc.id = f.child left join n np on np.id = f.parent), d as (select id, parent subject, child object, label, case when label <> 'family' then 'excluded_label' when cid is null and pid is null then 'excluded_both_unknown' when cid is null then 'excluded_unknown_child' when pid is null then 'excluded_unknown_parent' when child = parent then 'excluded_self_parent' when k > 1 then 'mapped_repeated' when psex = 'female' then 'mapped_mother' when psex = 'male' then 'mapped_father' else 'mapped_parent' end outcome from c)")


def _dispositions(spark: SparkSession, sf: str) -> DataFrame:
    r = tb.relationships(spark, sf)
    foreign = r.select("id", F.col("object").alias("child"), F.col("subject").alias("parent"), F.when(F.col("type").startswith("bio"), "family").otherwise(F.col("type")).alias("label"))
    nodes = table(spark, sf, "animals").where("id is not null").groupBy("id").agg(F.max("sex").alias("sex"), F.max("deleted_at").alias("gone")).where("gone is null").select("id", "sex")
    return me.edge_classify(foreign, nodes)


@REG.add("edge_classify", _FOREIGN + "select * from d")
def edge_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _dispositions(spark, sf)


@REG.add("edge_accounting", _FOREIGN + "select label, count(*) n_source, count(*) filter (outcome like 'mapped%') n_mapped, count(*) filter (outcome like 'excluded%') n_excluded from d group by label union all select 'total', count(*), count(*) filter (outcome like 'mapped%'), count(*) filter (outcome like 'excluded%') from d")
def edge_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return audit.edge_accounting(_dispositions(spark, sf))


@REG.add("unordered_pairs", tb.ctes("rel") + "select least(subject, object) lo, greatest(subject, object) hi, min(id) id, count(*) n from rel where subject <> object group by all")
def unordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return me.unordered_pairs(tb.relationships(spark, sf), "subject", "object", "id")


@REG.add("unique_lookup", "select name.canonical as name, min(id) id from animals where name.canonical is not null group by all having count(distinct id) = 1")
def unique_lookup(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "animals").select("id", F.col("name.canonical").alias("name")).where("name is not null")
    return me.unique_lookup(a, "name", "id").select("name", "id")


@REG.add("match_outcome", "with w as (select distinct id from import_animals where id is not null), i as (select distinct id, name.canonical n, taxon t from import_animals), a as (select distinct id, name.canonical n, taxon t from animals), c as (select i.id, count(distinct a.id) nc from i join a on a.n = i.n and a.t = i.t group by all)\nselect w.id, case when c.nc = 1 then 'composite' when c.nc > 1 then 'ambiguous' else 'new' end outcome, coalesce(c.nc, 0) n_candidates from w left join c on c.id = w.id")
def match_outcome(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "import_animals").select("id", F.col("name.canonical").alias("n"), "taxon").distinct()
    a = table(spark, sf, "animals").select(F.col("id").alias("target"), F.col("name.canonical").alias("n"), "taxon").distinct()
    found = i.join(a, ["n", "taxon"])
    return me.match_outcome(i.where("id is not null"), "id", found.where("false"), found)


@REG.add("near_match", "with i as (select id, min(name.canonical) n, min(taxon) t, min(country_code) c from import_animals where id is not null group by id), a as (select id, min(name.canonical) n, min(taxon) t, min(country_code) c from animals where id is not null group by id)\nselect i.id import_id, a.id animal_id, case when i.t is null or a.t is null or i.c is null or a.c is null then case when coalesce(i.t = a.t, false) and coalesce(i.c = a.c, false) then 'exact' else 'incomplete' end when i.t = a.t and i.c = a.c then 'exact' else 'other' end status from i join a on a.n = i.n")
def near_match(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t, p: table(spark, sf, t).where("id is not null").groupBy("id").agg(F.min("name.canonical").alias("n"), F.min("taxon").alias(f"{p}t"), F.min("country_code").alias(f"{p}c"))
    pairs = one("import_animals", "i").withColumnRenamed("id", "import_id").join(one("animals", "a").withColumnRenamed("id", "animal_id"), "n")
    return me.near_match(pairs, {"taxon": F.col("it") == F.col("at"), "country": F.col("ic") == F.col("ac")}).select("import_id", "animal_id", "status")


@REG.add("classify_tier", "select id, case when tier in ('A', 'B', 'C', 'D', 'discovery_only') then tier when source_type like 'studbook%' then 'A' when source_type like 'institution%' then 'B' when source_type = 'press' then 'C' when source_type = 'social_post' then 'D' else 'discovery_only' end tier from sources where id is not null")
def classify_tier(spark: SparkSession, sf: str) -> DataFrame:
    t, d = F.col("source_type"), F.col("tier")
    tier = F.when(d.isin("A", "B", "C", "D", "discovery_only"), d).when(t.startswith("studbook"), "A").when(t.startswith("institution"), "B").when(t == "press", "C").when(t == "social_post", "D").otherwise("discovery_only")
    return table(spark, sf, "sources").where("id is not null").select("id", tier.alias("tier"))
