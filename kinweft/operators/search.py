"""Faceted search over an index of records with one precomputed key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.functions.text import normalized_lists, search_text

#: What a missing facet counts as: sex and status have a value for it, the others have none.
MISSING = {"sex": "unknown", "status": "unknown", "country_code": "", "taxon": "", "population": ""}


FACETS = tuple(MISSING)


def search_index(rows: DataFrame) -> DataFrame:
    """rows with search_key (texts joined by NUL, so that no match spans two), id_keys (namespace:value) and facets, all normalised.

    The texts are id, taxon, population, the names, the aliases, the values of the external ids and
    the institutions. All keys of a row are made in one pass, once for all queries.
    """
    empty = F.array().cast("array<string>")
    listed = [F.coalesce(F.col(c), empty) for c in ("name.localized.value", "aliases.value", "external_ids.value", "institution_names")]
    texts = F.concat(F.array("id", "taxon", "population", "name.canonical"), *listed)
    ids = F.transform("external_ids", lambda x: F.concat(F.coalesce(x["namespace"], F.lit("null")), F.lit(":"), F.coalesce(x["value"], F.lit("null"))))
    facets = F.array(*[F.coalesce(F.col(c), F.lit(MISSING[c])) for c in FACETS])
    keys = normalized_lists(texts, F.coalesce(ids, empty), facets)
    rows = rows.withColumn("_k", keys)
    rows = rows.withColumn("search_key", F.array_join(F.filter("_k.a", lambda x: x != ""), "\0")).withColumn("id_keys", F.col("_k.b"))
    return rows.withColumn("facets", F.map_from_arrays(F.array(*map(F.lit, FACETS)), "_k.c")).drop("_k")


def facet_is(column: str, value: str) -> Column:
    """Whether a row of an index has a facet, both normalised; null counts as the facet's missing value."""
    return F.col("facets")[column] == (search_text(value) or "")


def photo_facet(value: str, column: str = "photo_confirmed") -> Column | None:
    """confirmed: true; unconfirmed: anything else, null included; other values filter nothing."""
    if value == "confirmed":
        return F.col(column).eqNullSafe(F.lit(True))
    return ~F.col(column).eqNullSafe(F.lit(True)) if value == "unconfirmed" else None


def search(index: DataFrame, query: str = "", photo: str = "", **facets: str) -> DataFrame:
    """The rows of an index (by ``search_index``) that match a query and all facets that are not empty.

    A query matches where its key lies within one text of a record, or where it is exactly
    ``namespace:value`` of one of its ids; an empty query matches every row.
    """
    for column, value in facets.items():
        if search_text(value):
            index = index.where(facet_is(column, value))
    flag = photo_facet(search_text(photo) or "")
    if flag is not None:
        index = index.where(flag)
    q = search_text(query) or ""
    if q:
        index = index.where(F.contains(F.col("search_key"), F.lit(q)) | F.exists("id_keys", lambda k: k == q))
    return index


def page(rows: DataFrame, order: list[Column], size: int = 60) -> DataFrame:
    """The first rows in order, with overflow: how many more there are."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(size).crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.col("total") - size, F.lit(0))).drop("total")


def facet_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): the values of each facet and how many rows have them; missing ones only where they have a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit(MISSING[c])).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).select("x.*").where("value != ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
