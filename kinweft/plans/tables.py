"""The catalogue's tables as one row per record, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.operators.index import latest
from kinweft.session import id_key, table

KEY = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
SQL = {
    "an": "an as (select * from (select *, row_number() over (partition by id order by loaded_at desc, coalesce(dataset, ''), coalesce(sex, ''), coalesce(status, '')) rn from animals where id is not null) where rn = 1)",
    "sr": "sr as (select distinct on (id) * from search_rows where id is not null)",
    "ev": f"ev as (select id, {KEY.format('animal_id')} animal_id, type, date, {KEY.format('institution_id')} institution_id, {KEY.format('from_institution_id')} from_institution_id, {KEY.format('to_institution_id')} to_institution_id, source_ids, related_animal_ids, outcome_count, notes from (select distinct on (id) * from atlas_events where id is not null))",
    "rel": f"rel as (select id, {KEY.format('subject')} subject, {KEY.format('object')} object, type, status, source_ids, review from (select distinct on (id) * from relationships where id is not null))",
    "med": f"med as (select distinct on (media_id) * exclude (animal_id), {KEY.format('animal_id')} animal_id from media where media_id is not null)",
    "inst": "inst as (select * from institutions where id is not null)",
    "src": "src as (select * from sources where id is not null)",
}


def ctes(*names: str, more: str = "") -> str:
    return "with recursive " + ",\n".join([*[SQL[n] for n in names], *([more] if more else [])]) + "\n"


def animals(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("loaded_at").desc_nulls_last(), *[F.coalesce(c, F.lit("")) for c in ("dataset", "sex", "status")]]
    return latest(table(spark, sf, "animals").where("id is not null"), "id", *order)


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "search_rows").drop("loaded_at").where("id is not null").dropDuplicates(["id"])


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "atlas_events").drop("loaded_at").where("id is not null").dropDuplicates(["id"])
    return e.withColumns({c: id_key(c) for c in ("animal_id", "institution_id", "from_institution_id", "to_institution_id")})


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "relationships").drop("loaded_at").where("id is not null").dropDuplicates(["id"])
    return r.withColumns({c: id_key(c) for c in ("subject", "object")})


def media(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media").drop("loaded_at").where("media_id is not null").dropDuplicates(["media_id"]).withColumn("animal_id", id_key("animal_id"))
