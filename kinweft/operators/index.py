"""Denormalised index rows: last values, unanimous values, first choices, chunks and catalogue counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.scratch import Scratch

CHUNK = 128


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key: the first by order. A window, since whole rows are kept; keys are expected to be many."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def facility_history(events: DataFrame, keys: list[str], places: DataFrame, owner: str, place: str = "id") -> DataFrame:
    """(owner, place columns): the places that any of several keys of an event name, each once; unknown ones are left out."""
    e = events.select(F.col(owner).alias("owner"), F.explode(F.array(*keys)).alias("_p")).where("_p is not null and owner is not null").distinct()
    return e.join(places, e["_p"] == places[place]).drop("_p")


def destination(to: str, at: str) -> Column:
    """Where an event leads to: its target, else where it is; empty counts as none."""
    return F.coalesce(F.nullif(F.col(to), F.lit("")), F.nullif(F.col(at), F.lit("")))


def last_value(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value): the value of the last row by order; rows without a value never replace one."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value where all rows that have one agree, else null."""
    return rows.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def preferred(names: Column, language: str = "en") -> Column:
    """The name in the preferred language, else the first by value."""
    return F.array_min(F.transform(names, lambda x: F.struct((x["language"] != language).alias("a"), x["value"].alias("v"))))["v"]


def first_per_key(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def chunks(rows: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    """rows with chunk_id: numbered in order, size to a chunk.

    The numbers of a total order come from counts per range partition, so that no task sees all
    rows: rows are range-partitioned, numbered within the partition, and shifted by the sizes of
    the partitions before.
    """


    store = Scratch(rows.sparkSession, "chunks")
    placed = store.write(
        rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn("chunk_id", F.floor((F.col("_row") + F.col("_before")) / size).cast("bigint")).drop("_m", "_part", "_row", "_before")


def catalog(animals: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """One row per dataset: animals, countries, media and media that are not cleared (unknown counts as not)."""
    a = animals.groupBy(key).agg(F.count_distinct("id").alias("n_animals"), F.array_join(F.array_sort(F.collect_set("country_code")), ",").alias("countries"))
    m = media.groupBy(key).agg(F.count("*").alias("n_media"), F.count_if(~F.col("embedding_status").eqNullSafe(F.lit("allowed"))).alias("n_not_allowed"))
    return a.join(m, key, "left").fillna(0, ["n_media", "n_not_allowed"])


def resolve_priority(refs: DataFrame, tiers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """refs with (source, target) from the first tier that has the key; null where none has."""
    out, found = refs, []
    for name, t in tiers:
        one = t.groupBy(key).agg(F.min("target").alias(f"_{name}"))
        out = out.join(one, key, "left")
        found.append(name)
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in found])
    return out.withColumn("source", source).withColumn("target", F.coalesce(*[F.col(f"_{n}") for n in found])).drop(*[f"_{n}" for n in found])
