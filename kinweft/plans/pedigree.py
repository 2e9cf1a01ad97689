"""Queries of pedigree graphs: families, generations, neighbourhoods, profiles and rows of a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.operators import graph as gr
from kinweft.operators import layout as lo
from kinweft.operators.components import components as connected
from kinweft.operators.hierarchy import hierarchy
from kinweft.plans import structure as st
from kinweft.plans import tables as tb
from kinweft.plans.base import Registry
from kinweft.session import id_key, table

REG = Registry()
FOCUS = "an-000000100"


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "animals").select("id").where("id is not null").distinct()


def _edges(spark: SparkSession, sf: str, types: tuple[str, ...] | None = None) -> DataFrame:
    e = gr.known_edges(tb.relationships(spark, sf), _ids(spark, sf))
    return e.where(F.col("type").isin(*types)) if types else e


_KNOWN = "ids as (select distinct id from animals where id is not null), e as (select * from rel where subject in (select id from ids) and object in (select id from ids))"
_REACH = _KNOWN + ", both_ as (select subject a, object b from e union select object, subject from e), reach(a, b) as (select id, id from ids union select r.a, x.b from reach r join both_ x on x.a = r.b), comp as (select a animal_id, min(b) component from reach group by a)"


@REG.add("components", tb.ctes("rel", more=_REACH) + "select animal_id, component from comp")
def components(spark: SparkSession, sf: str) -> DataFrame:
    c = connected(_edges(spark, sf), "subject", "object", _ids(spark, sf), "id")
    return c.withColumnRenamed("node", "animal_id")


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    members = components(spark, sf).withColumnRenamed("animal_id", "node")
    a = tb.animals(spark, sf).select("id", F.col("country_code").alias("country"))
    return gr.component_stats(members, a, _edges(spark, sf))


_STATS = _REACH + ", st as (select c.component, count(*) n_nodes, count(distinct an.country_code) n_countries from comp c left join an on an.id = c.animal_id group by all), ne as (select c.component, count(*) n_edges from e join comp c on c.animal_id = e.subject group by all)"
_STATS_ALL = "select st.component, st.n_nodes, coalesce(ne.n_edges, 0) n_edges, st.n_countries from st left join ne on ne.component = st.component"


@REG.add("component_stats", tb.ctes("rel", "an", more=_STATS) + _STATS_ALL)
def component_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf)


@REG.add("largest_component", tb.ctes("rel", "an", more=_STATS) + _STATS_ALL + " order by st.n_nodes desc, st.component limit 1")
def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf).orderBy(F.desc("n_nodes"), "component").limit(1)


@REG.add("top_components", tb.ctes("rel", "an", more=_STATS) + _STATS_ALL + " order by st.n_nodes desc, st.component limit 12")
def top_components(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf).orderBy(F.desc("n_nodes"), "component").limit(12)


_GEN = _KNOWN + """, g as (select distinct subject p, object v from e where type in ('biological_mother', 'biological_father', 'foster', 'adoptive')),
up(v, a) as (select v, p from g union select u.v, g.p from up u join g on g.v = u.a), ring as (select distinct v from up where v = a),
bad as (select v from ring union select u.v from up u where u.a in (select v from ring)),
lp(v, n) as (select id, 0 from ids where id not in (select v from g) union select g.v, l.n + 1 from lp l join g on g.p = l.v where g.v not in (select v from bad)),
gen as (select ids.id animal_id, case when ids.id in (select v from bad) then null else (select max(n) from lp where lp.v = ids.id) end generation from ids)"""


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.relationships(spark, sf)
    return gr.levels(_ids(spark, sf), e.where(F.col("type").isin(*gr.GENERATION_TYPES)))


@REG.add("generations", tb.ctes("rel", more=_GEN) + "select animal_id, cast(coalesce(generation, -1) as int) generation from gen")
def generations(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select(F.col("node").alias("animal_id"), F.coalesce("generation", F.lit(-1)).alias("generation"))


@REG.add("acyclic", tb.ctes("rel", more=_GEN) + "select v animal_id from bad")
def acyclic(spark: SparkSession, sf: str) -> DataFrame:
    """The animals that no order of generations can place: on a loop or below one."""
    return _levels(spark, sf).where("generation is null").select(F.col("node").alias("animal_id"))


@REG.add("generation_widths", tb.ctes("rel", more=_GEN) + "select cast(generation as int) generation, count(*) n, min(animal_id) first_id, max(animal_id) last_id from gen where generation is not null group by all")
def generation_widths(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where("generation is not null").groupBy("generation").agg(F.count("*").alias("n"), F.min("node").alias("first_id"), F.max("node").alias("last_id"))


@REG.add(
    "gen_violations",
    st.STATES_SQL.rstrip() + f", st as ({st.STATES_SELECT}), rr as (select distinct on (id) id, lower(trim(regexp_replace(subject, '^\\s+|\\s+$', '', 'g'))) subject, lower(trim(regexp_replace(object, '^\\s+|\\s+$', '', 'g'))) object, type from relationships)\n"
    "select r.id, a.depth parent_generation, b.depth child_generation from rr r join st a on a.animal_id = r.subject and a.rel_type = 'biological_mother' join st b on b.animal_id = r.object and b.rel_type = 'biological_mother' where r.type = 'biological_father' and a.depth >= b.depth",
)
def gen_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Father links that run against the generations of the mothers' lines."""
    mothers = st.lineage_edges(spark, sf).where("rel_type = 'biological_mother'")
    levels = hierarchy(mothers, key="rel_type").select("node", F.col("depth").alias("generation"))
    fathers = tb.relationships(spark, sf).where("type = 'biological_father'")
    return gr.generation_violations(levels, fathers).select("id", F.col("parent_generation").cast("int").alias("parent_generation"), F.col("child_generation").cast("int").alias("child_generation"))


def _walk_sql(upward: bool) -> str:
    src, dst = ("object", "subject") if upward else ("subject", "object")
    return tb.ctes("rel", more=f"st as (select distinct id s from animals where id is not null), b as (select distinct {src} a, {dst} b from rel where type in ('biological_mother', 'biological_father')), w(s, node, n) using key (s, node) as (select s, s, 0 from st union select distinct w.s, b.b, w.n + 1 from w join b on b.a = w.node where b.b is not null and not exists (select 1 from recurring.w r where r.s = w.s and r.node = b.b))") + "select s start_id, node animal_id, cast(n as int) distance from w"


def _walk(spark: SparkSession, sf: str, upward: bool) -> DataFrame:
    """What every animal leads to, to the end of each line."""
    e = tb.relationships(spark, sf).where(F.col("type").isin(*st.BIOLOGICAL))
    return gr.walk(e, _ids(spark, sf).select(F.col("id").alias("start")), upward).select(F.col("start").alias("start_id"), F.col("node").alias("animal_id"), F.col("distance").cast("int").alias("distance"))


@REG.add("ancestors", _walk_sql(True))
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf, True)


@REG.add("descendants", _walk_sql(False))
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf, False)


@REG.add(
    "focused",
    tb.ctes("rel", more=f"g as (select distinct subject p, object v from rel where type in ('biological_mother', 'biological_father', 'foster', 'adoptive')), up(node, n) as (select '{FOCUS}', 0 union select g.p, up.n + 1 from up join g on g.v = up.node where up.n < 3), down(node, n) as (select '{FOCUS}', 0 union select g.v, down.n + 1 from down join g on g.p = down.node where down.n < 3), u as (select node, min(n) n from up group by all), d as (select node, min(n) n from down group by all)")
    + "select coalesce(u.node, d.node) animal_id, cast(case when u.node is not null then -u.n else d.n end as int) generation from u full join d on d.node = u.node",
)
def focused(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.relationships(spark, sf).where(F.col("type").isin(*gr.GENERATION_TYPES))
    return gr.focused(e, FOCUS, 3, None).select(F.col("node").alias("animal_id"), F.col("generation").cast("int").alias("generation"))


@REG.add("focused_capped", tb.ctes("rel", more=f"g as (select subject s, object o, min(id) id from rel where type in ('biological_mother', 'biological_father', 'foster', 'adoptive') group by all), one as (select s node, -1 gen, id from g where o = '{FOCUS}' and s <> '{FOCUS}'), two as (select o node, 1 gen, id from g where s = '{FOCUS}' and o <> '{FOCUS}' and o not in (select node from one)), all_ as (select node, gen, row_number() over (order by gen, id) k, count(*) over () n from (select * from one union all select * from two))") + f"select '{FOCUS}' animal_id, 0 generation, (select count(*) from all_) > 2 truncated union all select node, gen, n > 2 from all_ where k <= 2")
def focused_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The same view with room for three nodes: what is refused is told."""
    e = tb.relationships(spark, sf).where(F.col("type").isin(*gr.GENERATION_TYPES))
    return gr.focused(e, FOCUS, 1, 3).select(F.col("node").alias("animal_id"), "generation", "truncated")


@REG.add("focused_rows")
def focused_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the view around one animal, mothers left of fathers, couples side by side, crossings before and after."""
    near = focused(spark, sf)
    e = gr.induced_edges(tb.relationships(spark, sf), near, "animal_id").select("type", "subject", "object")
    return lo.focused_rows(near.select(F.col("animal_id").alias("id"), "generation"), e)


@REG.add("parent_pairs", tb.ctes("rel") + "select distinct m.object child, m.subject mother, f.subject father from rel m join rel f on f.object = m.object where m.type = 'biological_mother' and f.type = 'biological_father' and m.subject <> f.subject")
def parent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return gr.parent_pairs(tb.relationships(spark, sf))


@REG.add("incident_edges", tb.ctes("rel") + "select subject node, object other, 'parent' side, id from rel union all select object, subject, 'child', id from rel where subject <> object")
def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    return gr.incident_edges(tb.relationships(spark, sf)).select("node", "other", "side", "id")


@REG.add("profile_relations", tb.ctes("rel", "an") + "select x.node animal_id, x.id, x.side, x.type, an.name.canonical counterpart from (select subject node, object other, 'child of' side, id, type from rel union all select object, subject, 'parent of', id, type from rel where subject <> object) x join an on an.id = x.other")
def profile_relations(spark: SparkSession, sf: str) -> DataFrame:
    e = gr.incident_edges(tb.relationships(spark, sf)).select(F.col("node").alias("animal_id"), "id", F.when(F.col("side") == "parent", "child of").otherwise("parent of").alias("side"), "type", "other")
    names = tb.animals(spark, sf).select(F.col("id").alias("other"), F.col("name.canonical").alias("counterpart"))
    return e.join(names, "other").drop("other")


_CITED = f"cited as (select distinct id, {tb.KEY.format('c')} c from (select id, unnest(source_ids) c from rel))"


@REG.add("citations", tb.ctes("rel", more=_CITED) + "select cited.id, string_agg(s.title, ' | ' order by s.id) titles from cited join sources s on s.id = cited.c group by all")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    c = tb.relationships(spark, sf).select("id", F.explode("source_ids").alias("c")).select("id", id_key("c").alias("c")).distinct()
    s = table(spark, sf, "sources").select(F.col("id").alias("c"), "title")
    g = c.join(s, "c").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "title"))).alias("x"))
    return g.select("id", F.array_join("x.title", " | ").alias("titles"))


@REG.add(
    "profile",
    tb.ctes("an", "rel", "ev", "med")
    + "select an.id animal_id, an.name.canonical canonical, coalesce(r.n, 0) n_relations, coalesce(e.n, 0) n_events, coalesce(m.n, 0) n_media from an left join (select node, count(*) n from (select subject node from rel union all select object from rel where subject <> object) group by all) r on r.node = an.id left join (select animal_id, count(*) n from ev group by all) e on e.animal_id = an.id left join (select animal_id, count(*) n from med group by all) m on m.animal_id = an.id",
)
def profile(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda df, k, name: df.groupBy(F.col(k).alias("animal_id")).agg(F.count("*").alias(name))
    a = tb.animals(spark, sf).select(F.col("id").alias("animal_id"), F.col("name.canonical").alias("canonical"))
    out = a.join(n(gr.incident_edges(tb.relationships(spark, sf)), "node", "n_relations"), "animal_id", "left").join(n(tb.events(spark, sf), "animal_id", "n_events"), "animal_id", "left").join(n(tb.media(spark, sf), "animal_id", "n_media"), "animal_id", "left")
    return out.fillna(0, ["n_relations", "n_events", "n_media"])


@REG.add("edges_within_selection", tb.ctes("rel", "an") + "select id, subject, object from rel where subject in (select id from an where taxon = 'Ailurus fulgens') and object in (select id from an where taxon = 'Ailurus fulgens')")
def edges_within_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = tb.animals(spark, sf).where("taxon = 'Ailurus fulgens'").select("id")
    return gr.known_edges(tb.relationships(spark, sf), chosen).select("id", "subject", "object")


@REG.add(
    "induced_edges",
    REG.sql["focused"].replace("select coalesce(u.node, d.node) animal_id,", ", near as (select coalesce(u.node, d.node) animal_id,") + ") select id, type from rel where subject in (select animal_id from near) and object in (select animal_id from near)",
)
def induced_edges(spark: SparkSession, sf: str) -> DataFrame:
    return gr.induced_edges(tb.relationships(spark, sf), focused(spark, sf), "animal_id").select("id", "type")


_ROWS = _GEN + ", r as (select animal_id id, cast(generation as int) generation from gen where generation is not null), rp as (select id, generation, row_number() over (partition by generation order by id) - 1 pos, count(*) over (partition by generation) n from r)"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where("generation is not null").select(F.lit("all").alias("component"), "generation", F.col("node").alias("id"))


@REG.add("row_positions", tb.ctes("rel", more=_ROWS) + "select id, generation, cast(pos as int) as position, round((pos - (n - 1) / 2.0) * 240.0, 2) x from rp")
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    return gr.row_positions(_rows(spark, sf)).select("id", "generation", "position", F.round("x", 2).alias("x"))


@REG.add("parent_order", tb.ctes("rel", more=_ROWS) + "select distinct m.object child, m.subject mother, f.subject father from rel m join rel f on f.object = m.object join rp a on a.id = m.subject join rp b on b.id = f.subject where m.type = 'biological_mother' and f.type = 'biological_father' and m.subject <> f.subject and a.generation = b.generation and a.pos >= b.pos")
def parent_order(spark: SparkSession, sf: str) -> DataFrame:
    return gr.parent_order_violations(gr.row_positions(_rows(spark, sf)), tb.relationships(spark, sf))


@REG.add("locale_order")
def locale_order(spark: SparkSession, sf: str) -> DataFrame:
    """The animals of each country as a reader sorts them."""
    a = tb.animals(spark, sf).select("id", "country_code", F.col("name.canonical").alias("name"))
    return gr.locale_order(a, ["country_code"], "country_code", "name", "id", "ZZ").select("id", "country_code", "place")


@REG.add("normalized_rank", tb.ctes("rel", more=_ROWS) + "select id, round(pos / greatest(n - 1, 1), 6) rank01 from rp")
def normalized_rank(spark: SparkSession, sf: str) -> DataFrame:
    return gr.normalized_rank(_rows(spark, sf), "generation", "id").select("id", F.round("rank01", 6).alias("rank01"))


@REG.add("running_offset", tb.ctes("rel", more=_GEN) + "select cast(generation as int) generation, coalesce(sum(n * 240.0 + 80.0) over (order by generation rows between unbounded preceding and 1 preceding), 0.0)::double as \"offset\" from (select generation, count(*) n from gen where generation is not null group by all)")
def running_offset(spark: SparkSession, sf: str) -> DataFrame:
    w = _rows(spark, sf).groupBy("component", "generation").agg((F.count("*") * 240.0).alias("width"))
    return gr.running_offset(w, "component", "generation", "width", 80.0).select("generation", "offset")


@REG.add("shelf_pack")
def shelf_pack(spark: SparkSession, sf: str) -> DataFrame:
    tiles = _stats(spark, sf).select(F.col("component").alias("id"), (F.sqrt("n_nodes") * 60).alias("width"), (F.sqrt("n_edges") * 40 + 40).alias("height"))
    return gr.shelf_pack(tiles, 4000.0)


@REG.add("layout_rows")
def layout_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each family's rows in the order the optimiser leaves them, with the crossings before and after."""
    edges = _edges(spark, sf, gr.GENERATION_TYPES)
    placed = gr.generations(_ids(spark, sf), edges).where("generation is not null").select("component", "generation", F.col("node").alias("id"))
    return lo.optimised_rows(placed, edges)


@REG.add(
    "barycenter_rank",
    tb.ctes("rel", more=_ROWS + ", s as (select c.id, c.generation, avg(p.pos) score from rp c left join (select distinct subject, object from rel where type in ('biological_mother', 'biological_father')) k on k.object = c.id left join rp p on p.id = k.subject group by all)")
    + "select id, generation, row_number() over (partition by generation order by (score is null), score, id) - 1 as \"rank\" from s",
)
def barycenter_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.row_positions(_rows(spark, sf))
    e = tb.relationships(spark, sf).where(F.col("type").isin(*st.BIOLOGICAL)).select(F.col("subject").alias("p"), F.col("object").alias("id")).distinct()
    parents = e.join(rows.select(F.col("id").alias("p"), "position"), "p").select("id", "position")
    out = lo.barycenter_rank(rows.select(F.lit("all").alias("key"), F.col("generation").alias("row"), "id"), parents)
    return out.select("id", F.col("row").alias("generation"), F.col("rank").cast("bigint").alias("rank"))
