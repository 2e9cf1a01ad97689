"""Merging of tables with evidence kept: unions, conflicts, dispositions, crosswalks and fixpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.scratch import Scratch


def ordered_union(first: DataFrame, second: DataFrame, key: list[str], order: str) -> DataFrame:
    """All of first, then of second what is new by key; of equal rows the one first in order stays."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy("_side", order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumnRenamed("_side", "side")


def merge_by_id(first: DataFrame, second: DataFrame, key: str, same: list[str], united: str | None = None, strict: bool = True) -> DataFrame:
    """A full outer merge: rows of one key must agree in the columns of same; lists in united are united.

    With strict a disagreement fails the query; without, state says ``conflict``. state is else
    ``kept``, ``added`` or ``merged``.
    """
    a = first.select(key, F.struct(*same, *([united] if united else [])).alias("a"))
    b = second.select(key, F.struct(*same, *([united] if united else [])).alias("b"))
    j = a.join(b, key, "full")
    equal = reduce(lambda x, c: x & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), same, F.lit(True))
    clash = F.raise_error(F.concat(F.lit("records differ: "), F.col(key).cast("string"))).cast("string") if strict else F.lit("conflict")
    state = F.when(F.col("b").isNull(), "kept").when(F.col("a").isNull(), "added").when(equal, "merged").otherwise(clash)
    cols = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in same]
    if united:
        empty = F.array().cast("array<string>")
        cols.append(F.array_sort(F.array_union(F.coalesce(F.col(f"a.{united}"), empty), F.coalesce(F.col(f"b.{united}"), empty))).alias(united))
    return j.select(key, *cols, state.alias("state"))


def aligned_dedup(c: Column, *others: Column) -> Column:
    """Parallel lists as one list of structs, repeats of the first column dropped with their partners."""
    rows = F.arrays_zip(c.alias("k"), *[o.alias(f"v{i}") for i, o in enumerate(others)])
    keys = F.transform(rows, lambda x: x["k"])
    return F.filter(rows, lambda x, i: F.array_position(keys, x["k"]) == i + 1)


def semantic_dedup(rows: DataFrame, signature: list[str], order: str, cited: str = "source_ids") -> DataFrame:
    """(signature, first id, merged, cited): one row of each signature, all citations united in order of value."""
    one = rows.select(*signature, order, F.explode_outer(cited).alias("_c"))
    return one.groupBy(*signature).agg(F.min(order).alias(order), F.count_distinct(order).alias("merged"), F.array_join(F.array_sort(F.collect_set("_c")), ",").alias(cited))


def remap(rows: DataFrame, crosswalk: DataFrame, *columns: str) -> DataFrame:
    """rows with the ids in columns replaced where the crosswalk (old, new) has them."""
    for c in columns:
        x = crosswalk.groupBy(F.col("old").alias(c)).agg(F.min("new").alias("_new"))
        rows = rows.join(x, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows


def conflicts(a: DataFrame, b: DataFrame, key: str, fields: list[str], unknown: tuple[str, ...] = ("unknown", "")) -> DataFrame:
    """(key, field, kept, alternative): fields that both sides know and say differently; a is kept."""
    known = lambda c: c.isNotNull() & ~F.lower(F.trim(c)).isin(*unknown)
    j = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("kept"), F.col(f"b_{f}").alias("alternative")) for f in fields])
    x = j.select(key, F.explode(rows).alias("x")).select(key, "x.*")
    return x.where(known(F.col("kept")) & known(F.col("alternative")) & (F.col("kept") != F.col("alternative")))


def fill_unknown(current: Column, incoming: Column, unknown: str = "unknown") -> Column:
    return F.coalesce(F.nullif(current, F.lit(unknown)), incoming, F.lit(unknown))


def unpivot_claims(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, claim_type, value): one row per field that says something."""
    x = F.array(*[F.struct(F.lit(f).alias("claim_type"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(key, F.explode(x).alias("x")).select(key, "x.*").where("value is not null and lower(trim(value)) not in ('', 'none', 'unknown')")


def event_upsert(current: DataFrame, incoming: DataFrame, same: list[str], cited: str = "source_ids") -> DataFrame:
    """Events equal in same get the incoming citations, the others are added: (same, citations, state)."""
    tag = lambda df, t: df.select(*same, F.lit(t).alias("_t"), F.explode_outer(cited).alias("_c"))
    g = tag(current, 0).unionByName(tag(incoming, 1)).groupBy(*same).agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.array_join(F.array_sort(F.collect_set("_c")), ",").alias(cited))
    return g.withColumn("state", F.when(F.col("lo") == 1, "inserted").when(F.col("hi") == 1, "cited").otherwise("kept")).drop("lo", "hi")


def edge_classify(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (id, child, parent, label) with outcome: what becomes of each, every edge exactly once.

    Foreign edges run from child to parent. The order of the tests is the order of the outcomes.
    """
    n = nodes.groupBy("id").agg(F.max("sex").alias("sex"))
    e = edges.join(n.select(F.col("id").alias("child"), F.lit(True).alias("has_child")), "child", "left").join(n.select(F.col("id").alias("parent"), F.lit(True).alias("has_parent"), F.col("sex").alias("parent_sex")), "parent", "left")
    w = Window.partitionBy("parent", "child", "label").orderBy("id")
    outcome = (
        F.when(F.col("label") != "family", "excluded_label")
        .when(F.col("has_child").isNull() & F.col("has_parent").isNull(), "excluded_both_unknown")
        .when(F.col("has_child").isNull(), "excluded_unknown_child")
        .when(F.col("has_parent").isNull(), "excluded_unknown_parent")
        .when(F.col("child") == F.col("parent"), "excluded_self_parent")
        .when(F.row_number().over(w) > 1, "mapped_repeated")
        .when(F.col("parent_sex") == "female", "mapped_mother")
        .when(F.col("parent_sex") == "male", "mapped_father")
        .otherwise("mapped_parent")
    )
    return e.select("id", F.col("parent").alias("subject"), F.col("child").alias("object"), "label", outcome.alias("outcome"))


def unordered_pairs(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Pairs without direction: (lo, hi, first id, n); the first in order creates the pair, the rest map to it."""
    return rows.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.min(order).alias(order), F.count("*").alias("n"))


def unique_lookup(names: DataFrame, name: str, target: str) -> DataFrame:
    """(name, target): names that stand for exactly one target; the others have none."""
    return names.groupBy(name).agg(F.min(target).alias(target), F.max(target).alias("_hi")).where(F.col(target) == F.col("_hi")).drop("_hi")


def match_outcome(wanted: DataFrame, key: str, explicit: DataFrame, composite: DataFrame) -> DataFrame:
    """(key, outcome, n): explicit by crosswalk, else by how many composite candidates there are."""
    e = explicit.groupBy(key).agg(F.count_distinct("target").alias("ne"))
    c = composite.groupBy(key).agg(F.count_distinct("target").alias("nc"))
    j = wanted.select(key).distinct().join(e, key, "left").join(c, key, "left")
    out = F.when(F.col("ne") == 1, "explicit").when(F.col("nc") == 1, "composite").when(F.col("nc") > 1, "ambiguous").otherwise("new")
    return j.select(key, out.alias("outcome"), F.coalesce("nc", F.lit(0)).alias("n_candidates"))


def near_match(pairs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """pairs with matched, failed (lists of check names) and status: exact, parent_only, incomplete or other."""
    names = lambda ok: F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)) if ok else ~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])), ",")
    missing = reduce(lambda a, c: a | c.isNull(), checks.values(), F.lit(False))
    out = pairs.withColumn("matched", names(True)).withColumn("failed", names(False)).withColumn("_missing", missing)
    status = F.when(F.col("failed") == "", "exact").when(F.col("_missing"), "incomplete").when(F.col("failed") == "parents", "parent_only").otherwise("other")
    return out.withColumn("status", status).drop("_missing")


def identity_fixpoint(foreign: DataFrame, own: DataFrame, known: DataFrame, foreign_parents: DataFrame, own_parents: DataFrame, keys: list[str]) -> DataFrame:
    """(foreign, own): foreign records matched when their keys agree and all their parents are matched to all of the own one's.

    foreign and own are (id, *keys), parents (child, parent), known is the crosswalk to start from.
    A match needs exactly one candidate and is never taken back, so rounds reach the same end as
    matching one by one; there are as many as the pedigree is deep.
    """
    store = Scratch(foreign.sparkSession, "fixpoint")
    done = store.write(known.select("foreign", "own").distinct(), "known")
    pairs = store.write(foreign.select(F.col("id").alias("foreign"), *keys).join(own.select(F.col("id").alias("own"), *keys), keys).select("foreign", "own"), "pairs")
    fp = store.write(foreign_parents.select(F.col("child").alias("foreign"), F.col("parent").alias("fp")).distinct(), "fp")
    op = store.write(own_parents.select(F.col("child").alias("own"), F.col("parent").alias("op")).distinct(), "op")
    nf, no = fp.groupBy("foreign").agg(F.count("*").alias("nf")), op.groupBy("own").agg(F.count("*").alias("no"))
    base = store.write(pairs.join(nf, "foreign", "left").join(no, "own", "left").fillna(0, ["nf", "no"]).where("nf = no"), "base")
    while True:
        left = base.join(done, "foreign", "left_anti").join(done, "own", "left_anti")
        link = done.select(F.col("foreign").alias("fp"), F.col("own").alias("op"))
        both = left.join(fp, "foreign").join(link, "fp").join(op, ["own", "op"]).groupBy("foreign", "own").agg(F.count("*").alias("hit"))
        fit = left.join(both, ["foreign", "own"], "left").where(F.coalesce("hit", F.lit(0)) == F.col("nf"))
        one = lambda k: fit.groupBy(k).agg(F.count("*").alias("n")).where("n = 1").select(k)  # noqa: B023, E731
        new = store.write(fit.join(one("foreign"), "foreign").join(one("own"), "own").select("foreign", "own"), "new")
        if new.isEmpty():
            return done
        done = store.write(done.unionByName(new), "done")


def require(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows, failing the query with message where bad holds."""
    return rows.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
