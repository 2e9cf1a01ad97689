"""Counts that must add up, tiers behind facts, and statistics of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.functions.urls import is_web_url


def edge_accounting(dispositions: DataFrame, label: str = "label", outcome: str = "outcome") -> DataFrame:
    """(label, n_source, n_mapped, n_excluded) per label and, under ``total``, in all; mapped and excluded make up source."""
    mapped = F.count_if(F.startswith(F.col(outcome), F.lit("mapped")))
    out = dispositions.rollup(label).agg(F.count("*").alias("n_source"), mapped.alias("n_mapped"), F.count_if(F.startswith(F.col(outcome), F.lit("excluded"))).alias("n_excluded"), F.grouping(label).alias("_g"))
    return out.withColumn(label, F.when(F.col("_g") == 1, "total").otherwise(F.coalesce(label, F.lit("none")))).drop("_g")


def count_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n_before, n_after, n_added)."""
    b, a = before.groupBy(key).agg(F.count("*").alias("n_before")), after.groupBy(key).agg(F.count("*").alias("n_after"))
    return b.join(a, key, "full").fillna(0, ["n_before", "n_after"]).withColumn("n_added", F.col("n_after") - F.col("n_before"))


def url_stats(rows: DataFrame, group: str, families: dict[str, str]) -> DataFrame:
    """(group, family, n, n_unique, n_bad): occurrences and distinct ones of each URL column."""
    x = F.array(*[F.struct(F.lit(f).alias("family"), F.col(c).alias("url")) for f, c in families.items()])
    u = rows.select(F.col(group).alias("grp"), F.explode(x).alias("x")).select("grp", "x.*").where("url is not null and url != ''")


    return u.groupBy("grp", "family").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_unique"), F.count_if(~is_web_url(F.col("url"))).alias("n_bad"))


def tier_audit(facts: DataFrame, sources: DataFrame, key: str, cited: str = "source_ids") -> DataFrame:
    """(key, tier, n): how many sources of each tier each fact cites; a source that is not there is ``missing``."""
    f = facts.select(key, F.explode(cited).alias("source")).where("source is not null")
    s = sources.groupBy(F.col("id").alias("source")).agg(F.max("tier").alias("tier"))
    return f.join(s, "source", "left").groupBy(key, F.coalesce("tier", F.lit("missing")).alias("tier")).agg(F.count("*").alias("n"))


def latency_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank median and 95th percentile, mean and count of each group."""
    v = F.col(value)
    return rows.groupBy(group).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n"),
    )


def even_median(c: Column) -> Column:
    """The median of an array of integers, the floor of the mean of the middle two."""
    s, n = F.array_sort(c), F.size(c)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.try_element_at(s, mid + 1)).otherwise(F.floor((F.try_element_at(s, mid) + F.try_element_at(s, mid + 1)) / 2))


def repeatable(runs: DataFrame, case: str, signature: str) -> DataFrame:
    """(case, repeatable): whether all runs of a case have one signature."""
    return runs.groupBy(case).agg((F.min(signature) == F.max(signature)).alias("repeatable"))
