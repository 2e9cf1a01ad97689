"""The best representative of each group of records, field by field.

Method: the fields of all records are unpivoted to long rows of normalised values; each row is a
vote of its record's source trust times its recency decay; votes are summed per value, winners are
chosen by max_by and pivoted back. Trust may come in levels of which a higher one always wins
(tier, then review, then date): votes then decide between values of the same level.

Votes are summed by (group, field, value, level, date) before anything is gathered by group, so a
group with a third of all rows arrives as a few rows per value and day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.session import id_key

# The spellings of each value, folded to lower case without surrounding blanks.
SEX = {
    "female": ["female", "f", "♀", "0.1", "メス", "雌", "weiblich", "w", "femelle", "hembra", "fem", "fem."],
    "male": ["male", "m", "♂", "1.0", "オス", "雄", "männlich", "mâle", "macho", "masc", "masc."],
    "intersex": ["intersex", "inter-sex", "inter sex", "intersexed", "hermaphrodite"],
}
STATUS = {
    "living": ["living", "alive", "lebt", "lebend", "生存", "生存中", "live", "vivo", "viva", "vivant", "vivante"],
    "deceased": ["deceased", "dead", "died", "verstorben", "tot", "gestorben", "死亡", "†", "mort", "morte", "muerto", "muerta"],
}
POPULATION = {
    "zoo_captive": ["zoo_captive", "zoo captive", "zoo-captive", "in zoo", "captive (zoo)", "captive", "zoo"],
    "wild": ["wild", "free-ranging", "free ranging", "in the wild"],
    "other_managed": ["other_managed", "other managed", "other-managed", "managed (other)", "managed other", "managed"],
}
FIELDS = {"sex": SEX, "status": STATUS, "population": POPULATION}
TIERS = ["discovery_only", "D", "C", "B", "A"]
REVIEWS = ["unreviewed", "needs_review", "reviewed"]
#: Days in which a vote loses half of its weight.
HALF_LIFE = 365.0
LOW, HIGH = 2, 4


def normalised(c: Column, spellings: dict[str, list[str]]) -> Column:
    """The value that c spells; null for null, blank, unknown and any other spelling."""
    folded = F.rtrim(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit("."))
    table = F.create_map(*[F.lit(x) for form, value in {f.rstrip("."): v for v, forms in spellings.items() for f in forms}.items() for x in (form, value)])
    return F.try_element_at(table, folded)


def rank(c: Column, levels: list[str]) -> Column:
    """1 for the first level, rising; 0 for null and any other."""
    return F.coalesce(reduce(lambda w, k: w.when(c == levels[k], F.lit(k + 1)), range(1, len(levels)), F.when(c == levels[0], F.lit(1))), F.lit(0))


def votes(animals: DataFrame, sources: DataFrame, fields: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(k, field, value, tier, review, at, vote, low, high): the summed votes, null values included.

    Records of one group that differ in loaded_at only are one record. low and high are the
    smallest and largest digest of the records behind a row.
    """
    same = [c for c in animals.columns if c != "loaded_at"]
    records = animals.select(
        id_key("id").alias("k"),
        F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in same]), {"ignoreNullFields": "false"}), 256).alias("h"),
        *[normalised(F.col(f), forms).alias(f) for f, forms in fields.items()],
        F.col("name.source_ids").alias("cited"),
        rank(F.col("review.status"), REVIEWS).alias("review"),
        F.coalesce(F.col("review.reviewed_on"), F.lit("")).alias("at"),
    ).where("k is not null").dropDuplicates(["k", "h"])
    tiers = sources.select(id_key("id").alias("s"), rank(F.col("tier"), TIERS).alias("t")).where("s is not null").groupBy("s").agg(F.max("t").alias("t"))
    cited = records.select("*", F.explode_outer("cited").alias("c")).withColumn("s", id_key("c"))
    keep = ["k", "h", *fields, "review", "at"]
    judged = cited.join(tiers, "s", "left").groupBy("k", "h").agg(*[F.first(c).alias(c) for c in keep[2:]], F.coalesce(F.max("t"), F.lit(0)).alias("tier"))
    trust = F.pow(F.lit(2.0), F.col("tier")) * F.pow(F.lit(2.0), F.col("review") - 3)
    decay = F.coalesce(F.exp(-F.log(F.lit(2.0)) * F.datediff(F.lit("2100-01-01").cast("date"), F.try_to_date("at")) / HALF_LIFE), F.lit(0.0))
    long = judged.select("k", "h", "tier", "review", "at", (trust * decay).alias("vote"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"))
    return long.groupBy("k", "x.field", "x.value", "tier", "review", "at").agg(F.sum("vote").alias("vote"), F.min("h").alias("low"), F.max("h").alias("high"))


def survivors(animals: DataFrame, sources: DataFrame) -> DataFrame:
    """(k, field, value): the surviving value of each field of each group of two or more records.

    A record is trusted by the best tier of the sources it cites, then its review, then its date;
    a date that is null is the oldest, a source that is missing or has no tier the least.
    ``status`` is what the newest record says, but a statement of a low tier (D, discovery_only) is
    left aside if an earlier record of tier A or B says deceased where it says living, or a later
    one living where it says deceased. Where all else ties, the votes decide, then the value's
    order. A field that no record states is ``unknown``. Groups of one record, and of records that
    differ in loaded_at only, give no rows, nor do null ids; extra columns make records differ.
    """
    v = votes(animals, sources, FIELDS)
    group = Window.partitionBy("k")
    said = lambda value: (F.col("field") == "status") & (F.col("value") == value) & (F.col("tier") >= HIGH) & (F.col("at") != "")
    v = v.withColumns({
        "several": F.min("low").over(group) < F.max("high").over(group),
        "dead_from": F.min(F.when(said("deceased"), F.col("at"))).over(group),
        "living_till": F.max(F.when(said("living"), F.col("at"))).over(group),
    }).where("several")
    aside = (F.col("field") == "status") & (F.col("tier") <= LOW) & (
        ((F.col("value") == "living") & (F.col("dead_from") < F.col("at")))
        | ((F.col("value") == "deceased") & (F.col("living_till") > F.col("at")))
    )
    v = v.withColumn("value", F.when(~F.coalesce(aside, F.lit(False)), F.col("value")))
    level = F.when(F.col("field") == "status", F.struct(F.col("at").alias("a"), F.col("tier").cast("string").alias("b"), F.col("review").cast("string").alias("c"))).otherwise(
        F.struct(F.col("tier").cast("string").alias("a"), F.col("review").cast("string").alias("b"), F.col("at").alias("c"))
    )
    by_value = v.groupBy("k", "field", "value").agg(F.max(level).alias("level"), F.sum("vote").alias("vote"))
    order = F.when(F.col("value").isNotNull(), F.struct("level", "vote", "value"))
    return by_value.groupBy("k", "field").agg(F.coalesce(F.max_by("value", order), F.lit("unknown")).alias("value"))


def golden_records(animals: DataFrame, sources: DataFrame) -> DataFrame:
    """The surviving values pivoted back: one row (k, sex, status, population) for each group."""
    s = survivors(animals, sources)
    return s.groupBy("k").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
