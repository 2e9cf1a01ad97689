"""Queries of the operators in this package, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.llm.abuse import score_documents
from kinweft.llm.golden import FIELDS, REVIEWS, TIERS, golden_records, survivors
from kinweft.llm.leakage import leaked
from kinweft.llm.matching import matches
from kinweft.llm.tokens import token_ids
from kinweft.llm.variants import linked, linked_pairs
from kinweft.plans.base import Registry
from kinweft.session import table

REG = Registry()


def _value_sql(field: str) -> str:
    forms = "".join(f" when x in ({', '.join(repr(f.rstrip('.')) for f in forms)}) then '{value}'" for value, forms in FIELDS[field].items())
    return f"(select case{forms} end from (select rtrim(lower(regexp_replace({field}, '^\\s+|\\s+$', '', 'g')), '.') x))"


def _rank_sql(c: str, levels: list[str]) -> str:
    return f"coalesce(list_position({levels!r}, {c}), 0)"


_SURVIVORS = f"""with r as (select distinct id, taxon, sex, status, population, name, aliases, external_ids, review, country_code, institution_names, dataset, deleted_at from animals where id is not null),
n as (select *, row_number() over () rn from r),
t as (select rn, max({_rank_sql("s.tier", TIERS)}) tier from (select rn, unnest(name.source_ids) c from n) x left join sources s on s.id = lower(trim(x.c)) group by rn),
j as (select n.rn, lower(trim(n.id)) k, {_value_sql("sex")} sex, {_value_sql("status")} status, {_value_sql("population")} population, coalesce(t.tier, 0) tier, {_rank_sql("review.status", REVIEWS)} review, coalesce(n.review.reviewed_on, '') at_ from n left join t using (rn)),
several as (select k from j group by k having count(*) > 1),
edge as (select k, min(at_) filter (status = 'deceased' and tier >= 4 and at_ <> '') dead_from, max(at_) filter (status = 'living' and tier >= 4 and at_ <> '') living_till from j group by k),
st as (select j.k, status v, at_, tier, review from j join edge using (k) where status is not null and not coalesce(tier <= 2 and ((status = 'living' and dead_from < at_) or (status = 'deceased' and living_till > at_)), false)),
best as (
  select k, 'sex' field_name, max_by(sex, (tier, review, at_, sex)) v from j where sex is not null group by k
  union all select k, 'population', max_by(population, (tier, review, at_, population)) from j where population is not null group by k
  union all select k, 'status', max_by(v, (at_, tier, review, v)) from st group by k)
"""


@REG.add("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return linked_pairs(table(spark, sf, "search_rows"))


@REG.add("p1_animals")
def p1_animals(spark: SparkSession, sf: str) -> DataFrame:
    """Each id with its animal's class and the number of ids linked in it."""
    g = linked(table(spark, sf, "search_rows"))
    return g.join(g.groupBy("animal").agg(F.count("*").alias("n_ids")), "animal").select("id", "animal", "n_ids")


@REG.add(
    "p3_found",
    _SURVIVORS + "select s.k animal_id, f.field_name, coalesce(b.v, 'unknown') kept_value from several s cross join (values ('sex'), ('status'), ('population')) f(field_name) left join best b on b.k = s.k and b.field_name = f.field_name",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    s = survivors(table(spark, sf, "animals"), table(spark, sf, "sources"))
    return s.select(F.col("k").alias("animal_id"), F.col("field").alias("field_name"), F.col("value").alias("kept_value"))


@REG.add(
    "p3_records",
    _SURVIVORS + "select s.k animal_id, coalesce(max(b.v) filter (b.field_name = 'sex'), 'unknown') sex, coalesce(max(b.v) filter (b.field_name = 'status'), 'unknown') status, coalesce(max(b.v) filter (b.field_name = 'population'), 'unknown') population from several s left join best b on b.k = s.k group by s.k",
)
def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return golden_records(table(spark, sf, "animals"), table(spark, sf, "sources")).withColumnRenamed("k", "animal_id")


@REG.add("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return matches(table(spark, sf, "import_animals"), table(spark, sf, "animals")).select("animal_id", "import_id")


@REG.add("p5_confidence")
def p5_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return matches(table(spark, sf, "import_animals"), table(spark, sf, "animals"))


@REG.add("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


@REG.add("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


@REG.add("p8_spans")
def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The word spans to take out of each document, whatever items they come from."""
    found = leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.select("doc_id", "item_id", F.round("share", 4).alias("share"), F.explode("spans").alias("s")).select("doc_id", "item_id", "share", F.col("s.start").alias("word_from"), F.col("s.end").alias("word_to"))


@REG.add("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "review_labels")).where("flagged").select("doc_id")


@REG.add("p9_rates")
def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_documents(table(spark, sf, "documents"), table(spark, sf, "review_labels"), keep=("source",))
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"))
