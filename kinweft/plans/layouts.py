"""Queries of geometry over points and segments laid out by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.operators import geometry as ge
from kinweft.plans.base import Registry
from kinweft.session import table

REG = Registry()
_PTS = "pts as (select c_custkey id, ((c_custkey * 7919) % 200000)::double x, ((c_custkey * 10477) % 200000)::double y, c_nationkey grp from customer)"
_SEG = f"with {_PTS}, seg as (select id, grp, x x1, y y1, x + (id * 131) % 4001 - 2000 x2, y + (id * 173) % 4001 - 2000 y2 from pts)"
WIDTH, HEIGHT = 2400.0, 1600.0


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), ((k * 7919) % 200000).cast("double").alias("x"), ((k * 10477) % 200000).cast("double").alias("y"), F.col("c_nationkey").alias("group"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    p, k = points(spark, sf), F.col("id")
    return p.select("id", "group", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + (k * 131) % 4001 - 2000).cast("double").alias("x2"), (F.col("y") + (k * 173) % 4001 - 2000).cast("double").alias("y2"))


@REG.add("viewport", f"with {_PTS} select id, x, y from pts where x between 20000 and 90000 and y between 10000 and 60000")
def viewport(spark: SparkSession, sf: str) -> DataFrame:
    return ge.viewport(points(spark, sf), 20000, 10000, 90000, 60000).select("id", "x", "y")


@REG.add("nearest", f"with {_PTS} select id, round(distance, 2) distance from (select id, sqrt((x - 50000) ** 2 + (y - 50000) ** 2) distance from pts) where distance < 20000 order by distance, id limit 1")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ge.nearest(points(spark, sf), 50000, 50000, 20000).select("id", F.round("distance", 2).alias("distance"))


@REG.add("nearest_k", f"with {_PTS} select id, round(distance, 2) distance from (select id, sqrt((x - 50000) ** 2 + (y - 50000) ** 2) distance from pts) order by distance, id limit 180")
def nearest_k(spark: SparkSession, sf: str) -> DataFrame:
    return ge.nearest_k(points(spark, sf), 50000, 50000).select("id", F.round("distance", 2).alias("distance"))


_B = "(({u}) ** 3 * {a} + 3 * ({u}) ** 2 * ({t}) * {b} + 3 * ({u}) * ({t}) ** 2 * {c} + ({t}) ** 3 * {d})"


def _at(k: str, a: str, b: str, c: str, d: str) -> str:
    return _B.format(u=f"1 - {k} / 24.0::double", t=f"{k} / 24.0::double", a=a, b=b, c=c, d=d)


_DX = f"({_at('k', 'x1', 'x1', 'x2', 'x2')} - {_at('(k - 1)', 'x1', 'x1', 'x2', 'x2')})"
_DY = f"({_at('k', 'y1', '(y1 + y2) / 2', '(y1 + y2) / 2', 'y2')} - {_at('(k - 1)', 'y1', '(y1 + y2) / 2', '(y1 + y2) / 2', 'y2')})"


@REG.add("route_length", f"{_SEG} select id, round(sum(sqrt({_DX} ** 2 + {_DY} ** 2)), 2) length from seg, range(1, 25) r(k) group by id")
def route_length(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return segments(spark, sf).select("id", F.round(ge.route_length(c("x1"), c("y1"), c("x2"), c("y2")), 2).alias("length"))


_CR = "(({b}.{x2} - {b}.{x1}) * ({p}.{py} - {b}.{y1}) - ({b}.{y2} - {b}.{y1}) * ({p}.{px} - {b}.{x1}))"


def _side(line: str, p: str, k: int) -> str:
    return _CR.format(b=line, x1="x1", y1="y1", x2="x2", y2="y2", p=p, px=f"x{k}", py=f"y{k}")


@REG.add("segment_crossings", f"{_SEG} select a.id a, b.id b from seg a join seg b on a.id < b.id and a.grp <> b.grp and least(a.x1, a.x2) <= greatest(b.x1, b.x2) and least(b.x1, b.x2) <= greatest(a.x1, a.x2) and least(a.y1, a.y2) <= greatest(b.y1, b.y2) and least(b.y1, b.y2) <= greatest(a.y1, a.y2) where {_side('a', 'b', 1)} * {_side('a', 'b', 2)} < -1e-8 and {_side('b', 'a', 1)} * {_side('b', 'a', 2)} < -1e-8")
def segment_crossings(spark: SparkSession, sf: str) -> DataFrame:
    return ge.segment_crossings(segments(spark, sf), 2048.0)


@REG.add(
    "edge_box_hits",
    f"{_SEG}, j as (select s.id segment, p.id box, s.x1, s.y1, s.x2 - s.x1 dx, s.y2 - s.y1 dy, p.x - {WIDTH} / 2 lx, p.x + {WIDTH} / 2 hx, p.y - {HEIGHT} / 2 ly, p.y + {HEIGHT} / 2 hy from seg s join pts p on p.id <> s.id and least(s.x1, s.x2) <= p.x + {WIDTH} / 2 and p.x - {WIDTH} / 2 <= greatest(s.x1, s.x2) and least(s.y1, s.y2) <= p.y + {HEIGHT} / 2 and p.y - {HEIGHT} / 2 <= greatest(s.y1, s.y2))\n"
    "select segment, box from j where greatest(0, case when abs(dx) < 1e-8 then 0 else least((lx - x1) / dx, (hx - x1) / dx) end, case when abs(dy) < 1e-8 then 0 else least((ly - y1) / dy, (hy - y1) / dy) end) <= least(1, case when abs(dx) < 1e-8 then 1 else greatest((lx - x1) / dx, (hx - x1) / dx) end, case when abs(dy) < 1e-8 then 1 else greatest((ly - y1) / dy, (hy - y1) / dy) end)",
)
def edge_box_hits(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf).withColumn("from", F.col("id")).withColumn("to", F.col("id"))
    return ge.edge_box_hits(s, points(spark, sf), WIDTH, HEIGHT, 2048.0)


@REG.add("overlaps", "with n as (select c_custkey id, c_nationkey row_, ((c_custkey * 7919) % 20000)::double x, ((c_custkey * 31) % 100)::double y from customer) select a.id a, b.id b from n a join n b on a.row_ = b.row_ and a.id < b.id and abs(a.x - b.x) < 176 and abs(a.y - b.y) < 74")
def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    n = table(spark, sf, "customer").select(k.alias("id"), F.col("c_nationkey").alias("row"), ((k * 7919) % 20000).cast("double").alias("x"), ((k * 31) % 100).cast("double").alias("y"))
    return ge.overlaps(n)


@REG.add("inversions", "with n as (select o_custkey k, o_orderkey p, (o_orderkey * 7919) % 1009 v from orders) select a.k, count(*) n from n a join n b on b.k = a.k and a.p < b.p and a.v > b.v group by all")
def inversions(spark: SparkSession, sf: str) -> DataFrame:
    """Crossings between two rows: pairs in order on one side and out of it on the other, per group."""
    n = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"), ((F.col("o_orderkey") * 7919) % 1009).alias("v"))
    b = n.select("k", F.col("p").alias("p2"), F.col("v").alias("v2"))
    return n.join(b, "k").where("p < p2 and v > v2").groupBy("k").agg(F.count("*").alias("n"))
