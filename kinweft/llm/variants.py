"""Variant spellings of names typed by people, linked by animal.

Method: metric-space partitioning. Names are points of a metric space: the edit distance of the
given names plus that of the houses. Pivots are the strings that are reached from a name by at
most r deletions; a name lies in the ball of each of them, and names within r of one another
share at least one, so that replicating every name to its pivots loses no pair (by the triangle
inequality a ball of radius r holds pairs up to 2r). Inside each ball the exact metric decides.

Distinct names, not rows, are partitioned, and a ball holds at most the strings that are r
insertions from its pivot: no ball grows with the rows, even if a third of them bear one name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.llm.golden import SEX, normalised
from kinweft.llm.names import parse
from kinweft.llm.spread import spread
from kinweft.operators.components import components
from kinweft.scratch import Scratch
from kinweft.session import id_key, plain, tasks

RADIUS = 2
#: Attributes that one animal never has two values of.
TRAITS = ("taxon", "sex", "country")


def typed_names(rows: DataFrame) -> DataFrame:
    """(id, name) of each record: its canonical, localised and other names."""
    flat = F.concat(
        F.array("name.canonical"),
        F.coalesce(F.col("name.localized.value"), F.array().cast("array<string>")),
        F.coalesce(F.col("aliases.value"), F.array().cast("array<string>")),
    )
    return rows.select(id_key("id").alias("id"), F.explode(flat).alias("name")).where("id is not null and name is not null")


def readings(names: DataFrame) -> DataFrame:
    """(id, given, house, ordinal, kind): how each typed name can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, *p) for i, n in zip(b["id"], b["name"]) for p in parse(n)]
            yield plain(pd.DataFrame(got, columns=["id", "given", "house", "ordinal", "kind"]))

    return spread(names).mapInPandas(run, "id string, given string, house string, ordinal int, kind string").distinct()


def dropped(c: Column, n: int) -> Column:
    """The string c and all that is left of it after up to n deletions."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    out = F.array(c)
    for _ in range(n):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def balls(points: DataFrame, keep: list[str], within: list[str], radius: int = RADIUS) -> DataFrame:
    """(*keep, ball): each point in the ball of each of its pivots; points of different within share none.

    A pivot is a pair of strings that takes at most radius deletions in both names together.
    """
    pairs = []
    for a in range(radius + 1):
        pairs.append(F.flatten(F.transform(dropped(F.col("given"), a), lambda g: F.transform(dropped(F.col("house"), radius - a), lambda h: F.xxhash64(g, h, *within)))))  # noqa: B023
    # Few rows become many: they are spread over all cores first.
    return points.repartition(tasks(points.sparkSession)).select(*keep, F.explode(F.array_distinct(F.flatten(F.array(*pairs)))).alias("ball"))


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): the numbers of left and right that share a ball, each pair once; both are (p, ball).

    Both sides go through one shuffle of plain numbers. A ball has distinct points only, at most the
    strings that are some insertions from its pivot, however many rows there are; most have one
    point, and go at once.
    """
    both = left.select("ball", F.col("p").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(right.select("ball", F.lit(None).cast("bigint").alias("a"), F.col("p").alias("b")))
    # Placed before they are gathered: gathering on the side of the writer, where few meet, only costs.
    met = both.repartition(tasks(left.sparkSession), "ball").groupBy("ball").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).where("size(a) > 0 and size(b) > 0")
    return met.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).distinct()


def radius_join(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of points of one ordinal within radius; points are (p, given, house, ordinal).

    Where both orders of a name are points, a needs only stand in the alphabetical one.
    """
    b = balls(points.withColumn("first", F.col("given") <= F.col("house")), ["p", "first"], ["ordinal"], radius)
    met = b.repartition(tasks(points.sparkSession), "ball").groupBy("ball").agg(F.collect_list(F.when(F.col("first"), F.col("p"))).alias("a"), F.collect_list("p").alias("b")).where("size(a) > 0 and size(b) > 1")
    met = met.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).where("a != b").distinct()
    end = lambda n: points.select(F.col("p").alias(n), F.col("given").alias(f"g{n}"), F.col("house").alias(f"h{n}"))
    far = F.levenshtein("ga", "gb") + F.levenshtein("ha", "hb")
    return met.join(end("a"), "a").join(end("b"), "b").where(far <= radius).select("a", "b")


def _profile(traits: DataFrame, key: str) -> DataFrame:
    return traits.groupBy(key).agg(*[f(t).alias(f"{n}_{t}") for t in TRAITS for n, f in (("lo", F.min), ("hi", F.max))])


def _agree(x: str, y: str) -> Column:
    """No trait on which x and y each have one value, and not the same."""
    out = F.lit(True)
    for t in TRAITS:
        lx, hx, ly, hy = (F.col(f"{s}.{n}_{t}") for s in (x, y) for n in ("lo", "hi"))
        out = out & F.coalesce(~((lx == hx) & (ly == hy) & (lx != ly)), F.lit(True))
    return out


def linked(rows: DataFrame) -> DataFrame:
    """(id, animal): each id of the rows with the smallest id of the animal it stands for.

    Two ids are linked where a reading of a name of one lies within ``RADIUS`` of one of the
    other, with the same ordinal, and no trait (taxon, sex, country) speaks against it; links are
    transitive. Ids whose names are all short (an initial, a pet form, a single word) are linked to
    the one animal that their house, ordinal, letters and traits leave, or to one another if they
    read the same and their traits agree (a null agrees where the others leave one animal). Ids without any readable name stay
    alone too. Repeated rows of one id are one record; a null id is no record. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    store = Scratch(spark, "variants")
    base = rows.select("id", "name", "aliases", "taxon", "sex", "country_code")
    traits = base.select(id_key("id").alias("id"), F.lower(F.trim("taxon")).alias("taxon"), normalised(F.col("sex"), SEX).alias("sex"), F.upper(F.trim("country_code")).alias("country")).where("id is not null")
    traits = store.write(traits.groupBy("id").agg(*[F.max(t).alias(t) for t in TRAITS]), "traits")
    read = store.write(readings(typed_names(base).distinct()), "readings")
    full = read.where("kind in ('full', 'open')").withColumn("p", F.xxhash64("given", "house", "ordinal"))
    points = full.groupBy("p").agg(F.first("given").alias("given"), F.first("house").alias("house"), F.first("ordinal").alias("ordinal"))
    profile = _profile(full.select("id", "p").join(traits, "id"), "p")
    near = radius_join(points)
    x, y = profile.alias("x"), profile.alias("y")
    sound = near.join(x, F.col("a") == F.col("x.p")).join(y, F.col("b") == F.col("y.p")).where(_agree("x", "y")).select("a", "b")
    sound = store.write(sound, "links")
    first = full.groupBy("id").agg(F.min("p").alias("a"))
    own = full.join(first, "id").select("a", F.col("p").alias("b"))
    named = components(sound.unionByName(own.where("a != b")), "a", "b", points, "p")
    placed = store.write(first.join(named, F.col("a") == F.col("node")).select("id", F.col("component").alias("g")), "placed")
    # An id alone in its group that may as well bear a pet form is placed with the short names.
    sure = full.groupBy("id").agg(F.max(F.col("kind") == "full").alias("sure"))
    sizes = placed.groupBy("g").agg(F.count("*").alias("n"))
    open_ = placed.join(sizes, "g").join(sure, "id").where("n = 1 and not sure").select("id", "g")
    return _short(store, read, traits, placed.join(open_, "id", "left_anti"), open_)


def _short(store: Scratch, read: DataFrame, traits: DataFrame, placed: DataFrame, open_: DataFrame) -> DataFrame:
    """Places the ids that have short names only, and gives each group its smallest id.

    Groups are gathered by what a short name can know of them (letters, house, ordinal, traits) and
    come with their smallest and largest number, so that a house or first letters that a third of
    the names have make no more rows than there are traits.
    """
    loose = read.join(placed, "id", "left_anti").where("kind not in ('full', 'open')")
    sides = [f"{n}_{t}" for t in TRAITS for n in ("lo", "hi")]
    groups = _profile(placed.join(traits, "id"), "g")
    full = read.where("kind in ('full', 'open')").join(placed, "id").select("g", "given", "house", "ordinal").distinct().join(groups, "g")
    full = store.write(full, "full")
    t = traits.select("id", *[F.col(c).alias(f"{n}_{c}") for c in TRAITS for n in ("lo", "hi")])

    def kinds(known: DataFrame, by: list[str]) -> DataFrame:
        return known.groupBy(*by, *sides).agg(F.min("g").alias("g1"), F.max("g").alias("g2"))

    # Initials and pet forms: the house within one edit, by the same pivots; the given name by its first letters.
    fits = []
    for kind, head in (("initial", 1), ("pet", 3)):
        mine = loose.where((F.col("kind") == kind) & (F.col("house") != "")).select("id", F.col("given").alias("ga"), F.col("house").alias("ha"), "ordinal", F.substring("given", 1, head).alias("head"))
        theirs = kinds(full.withColumn("head", F.substring("given", 1, head)), ["head", "house", "ordinal", *(["given"] if kind == "pet" else [])])
        one = lambda df, c: df.withColumn("ball", F.explode(dropped(F.col(c), 1)))
        x = one(mine, "ha").join(one(theirs, "house").hint("merge"), ["ordinal", "head", "ball"]).where(F.levenshtein("ha", "house") <= 1)
        fits.append((x if kind == "initial" else x.where(F.expr("startswith(given, ga)"))).select("id", "g1", "g2", *sides))
    housed = store.write(reduce(DataFrame.unionByName, fits), "housed")
    # Single words: a given name, or from four letters on, what one begins with.
    single = loose.where("house = ''").join(housed.select("id").distinct(), "id", "left_anti").select("id", F.col("given").alias("ga"), "ordinal", F.substring("given", 1, 4).alias("head"))
    given = kinds(full.withColumn("head", F.substring("given", 1, 4)), ["head", "given", "ordinal"])
    alone = single.join(given.hint("merge"), ["ordinal", "head"]).where("ga = given or (length(ga) >= 4 and startswith(given, ga))").select("id", "g1", "g2", *sides)
    named = lambda df, n: df.select("id", "g1", "g2", F.struct(*sides).alias(n))
    both = named(housed.unionByName(alone), "x").join(t.select("id", F.struct(*sides).alias("y")), "id").where(_agree("x", "y"))
    only = both.groupBy("id").agg(F.min("g1").alias("g"), F.max("g2").alias("g2")).where("g = g2").select("id", "g")
    kept = open_.join(only, "id", "left_anti")
    # The rest link to one another by equal readings, null traits agreeing where the others leave one animal.
    rest = loose.join(only.unionByName(kept), "id", "left_anti").join(traits, "id")
    whole = rest.groupBy("given", "house", "ordinal").agg(reduce(lambda a, c: a & c, [F.coalesce(F.min(c) == F.max(c), F.lit(True)) for c in TRAITS]).alias("whole"))
    key = [F.when(F.col("whole"), F.lit("")).otherwise(F.coalesce(c, F.lit(""))) for c in TRAITS]
    same = rest.join(whole, ["given", "house", "ordinal"]).groupBy("id").agg(F.min(F.xxhash64("given", "house", "ordinal", *key)).alias("g"))
    got = store.write(placed.unionByName(only).unionByName(kept).unionByName(same), "groups")
    lowest = got.groupBy("g").agg(F.min("id").alias("animal"))
    return traits.select("id").join(got.join(lowest, "g").select("id", "animal"), "id", "left").select("id", F.coalesce("animal", "id").alias("animal"))


def linked_pairs(rows: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids of one animal."""
    g = linked(rows)
    return g.select("animal", F.col("id").alias("id_a")).join(g.select("animal", F.col("id").alias("id_b")), "animal").where("id_a < id_b").select("id_a", "id_b")
