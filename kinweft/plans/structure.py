"""Queries of problems 2, 4 and 6: hierarchies, nested records, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.operators.flatten import related_tables
from kinweft.operators.hierarchy import conflicting_parents, descendants, hierarchy
from kinweft.operators.orphans import orphans, parent_list, reference_list
from kinweft.plans.base import Registry
from kinweft.session import id_key, table

REG = Registry()
BIOLOGICAL = ("biological_mother", "biological_father")


def lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "relationships").where(F.col("type").isin(*BIOLOGICAL))
    return r.select(F.col("type").alias("rel_type"), id_key("subject").alias("parent"), id_key("object").alias("child"))


_EDGES = """edges as (select distinct type rel_type, lower(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')) p, lower(regexp_replace(object, '^\\s+|\\s+$', '', 'g')) v
  from relationships where type in ('biological_mother', 'biological_father'))"""
STATES_SQL = f"""with recursive {_EDGES},
reach(rel_type, v, a) as (select rel_type, v, p from edges union select r.rel_type, r.v, e.p from reach r join edges e on e.rel_type = r.rel_type and e.v = r.a),
loops as (select rel_type, v, (select min(r2.a) from reach r2 where r2.rel_type = reach.rel_type and r2.v = reach.v) low from reach where v = a),
up(rel_type, v, a, n) as (select rel_type, v, p, 1 from edges union all select u.rel_type, u.v, e.p, u.n + 1 from up u join edges e on e.rel_type = u.rel_type and e.v = u.a where not exists (select 1 from loops l where l.rel_type = u.rel_type and l.v = u.a)),
nodes as (select rel_type, p v from edges union select rel_type, v from edges)
"""


STATES_SELECT = """select n.rel_type, n.v animal_id,
  coalesce(l.low, lu.low, t.a, n.v) root_id, cast(case when l.v is not null then 0 else coalesce(lu.n, t.n, 0) end as int) depth,
  case when l.v is not null then 'on_cycle' when lu.v is not null then 'below_cycle' else 'rooted' end state
from nodes n
left join loops l on l.rel_type = n.rel_type and l.v = n.v
left join (select u.rel_type, u.v, l.low, min(u.n) n from up u join loops l on l.rel_type = u.rel_type and l.v = u.a group by all) lu on lu.rel_type = n.rel_type and lu.v = n.v
left join (select rel_type, v, max_by(a, n) a, max(n) n from up group by all) t on t.rel_type = n.rel_type and t.v = n.v"""


_UP = """reach(rel_type, v, a) as (select rel_type, v, p from edges union select r.rel_type, r.v, e.p from reach r join edges e on e.rel_type = r.rel_type and e.v = r.a),
ring as (select rel_type, v from reach where v = a),
up(rel_type, v, a, n) as (select rel_type, v, p, 1 from edges where (rel_type, v) not in (select (rel_type, v) from ring)
  union all select u.rel_type, u.v, e.p, u.n + 1 from up u join edges e on e.rel_type = u.rel_type and e.v = u.a where (u.rel_type, u.a) not in (select (rel_type, v) from ring))"""


@REG.add(
    "p2_found",
    STATES_SQL + STATES_SELECT,
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    h = hierarchy(lineage_edges(spark, sf), key="rel_type")
    return h.select("rel_type", F.col("node").alias("animal_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "state")


@REG.add(
    "p2_paths",
    f"""with recursive {_EDGES}, {_UP},
nodes as (select rel_type, p v from edges union select rel_type, v from edges),
above as (select rel_type, v, string_agg(a, '/' order by n desc) l from up group by all), below as (select rel_type, a, count(*) n from up group by all)
select n.rel_type, n.v animal_id, coalesce(above.l || '/', '') || n.v as path, coalesce(below.n, 0) + 1 subtree_size from nodes n left join above on above.rel_type = n.rel_type and above.v = n.v left join below on below.rel_type = n.rel_type and below.a = n.v""",
)
def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    h = hierarchy(lineage_edges(spark, sf), key="rel_type", with_path=True)
    return h.select("rel_type", F.col("node").alias("animal_id"), F.array_join("path", "/").alias("path"), F.col("subtree_size").cast("bigint").alias("subtree_size"))


@REG.add(
    "p2_descendants",
    f"""with recursive {_EDGES},
{_UP}
select rel_type, a animal_id, v descendant_id, cast(n as int) distance from up""",
)
def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    d = descendants(lineage_edges(spark, sf), key="rel_type")
    return d.select("rel_type", F.col("node").alias("animal_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


@REG.add("p2_conflicts", f"with {_EDGES}\nselect rel_type, v animal_id, count(*) parents from edges where p is not null and v is not null group by all having count(*) > 1")
def p2_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The animals with more than one parent of a type, whose other links no path follows."""
    return conflicting_parents(lineage_edges(spark, sf), key="rel_type").withColumnRenamed("node", "animal_id")


@REG.add("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    tables = related_tables(table(spark, sf, "atlas_payloads"))
    out = None
    for kind, t in tables.items():
        rows = t.select(F.col("doc_key").alias("payload_id"), F.lit(kind).alias("kind"), "parent_id", "pos", F.col("pk").alias("item_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@REG.add("p4_tables")
def p4_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Animals joined to their aliases and events again, over the links that the flat tables keep."""
    t = related_tables(table(spark, sf, "atlas_payloads"))
    count = lambda x, name: x.groupBy("doc_key", "parent_id").agg(F.count("*").alias(name))
    a = t["animal"].select("doc_key", F.col("pk").alias("parent_id"), "x.taxon", "x.sex", F.col("x.name.canonical").alias("canonical"))
    return (
        a.join(count(t["alias"], "aliases"), ["doc_key", "parent_id"], "left").join(count(t["event"], "events"), ["doc_key", "parent_id"], "left")
        .select(F.col("doc_key").alias("payload_id"), F.col("parent_id").alias("animal_id"), "taxon", "sex", "canonical", F.coalesce("aliases", F.lit(0)).alias("n_aliases"), F.coalesce("events", F.lit(0)).alias("n_events"))
    )


_KEY = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
_REFS = f"""refs as (
  select 'relationships' table_name, 'source_ids' field_name, 'sources' target, id record_id, {_KEY.format("x")} ref_id, seen from (select id, unnest(source_ids) x, min(loaded_at) over (partition by id) seen from relationships)
  union select 'atlas_events', 'institution_id', 'institutions', id, {_KEY.format("institution_id")}, min(loaded_at) over (partition by id) from atlas_events
  union select 'atlas_events', 'animal_id', 'animals', id, {_KEY.format("animal_id")}, min(loaded_at) over (partition by id) from atlas_events
  union select 'media', 'animal_id', 'animals', media_id, {_KEY.format("animal_id")}, min(loaded_at) over (partition by media_id) from media),
parents as (
  select 'sources' target, {_KEY.format("id")} ref_id, min(loaded_at) a, max(deleted_at) b from sources group by all
  union all select 'institutions', {_KEY.format("id")}, min(loaded_at), max(deleted_at) from institutions group by all
  union all select 'animals', {_KEY.format("id")}, min(loaded_at), max(deleted_at) from animals group by all),
found as (select table_name, field_name, record_id, r.ref_id, case when p.ref_id is null then 'missing' when r.seen < p.a then 'late' when p.b <= r.seen then 'deleted' end reason, strftime(r.seen, '%Y-%m') load_month
  from refs r left join parents p on p.target = r.target and p.ref_id = r.ref_id where r.ref_id is not null)"""


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    fields = [("relationships", "id", "source_ids", "sources"), ("atlas_events", "id", "institution_id", "institutions"), ("atlas_events", "id", "animal_id", "animals"), ("media", "media_id", "animal_id", "animals")]
    refs = parents = None
    for name, key, ref, target in fields:
        x = reference_list(table(spark, sf, name), key, ref, name, ref).withColumn("target", F.lit(target))
        refs = x if refs is None else refs.unionByName(x)
    for target in ("sources", "institutions", "animals"):
        x = parent_list(table(spark, sf, target)).withColumn("target", F.lit(target))
        parents = x if parents is None else parents.unionByName(x)
    return orphans(refs, parents)


@REG.add("p6_found", f"with {_REFS} select * from found where reason is not null")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


@REG.add("p6_report", f"with {_REFS} select table_name, field_name, reason, load_month, count(*) n_refs, count(distinct ref_id) n_keys from found where reason is not null group by all")
def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).groupBy("table_name", "field_name", "reason", "load_month").agg(F.count("*").alias("n_refs"), F.count_distinct("ref_id").alias("n_keys"))
