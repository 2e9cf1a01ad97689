"""Expressions of the views: styles of edges, places in grids, steps through lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour of each type of edge and the dashes of each status.
STROKES = {"biological_mother": "#9b6f55", "biological_father": "#53768a", "foster": "#7c6695", "adoptive": "#7c6695", "social": "#87978d"}
DASHES: dict[str, list[int]] = {"confirmed": [], "probable": [5, 4], "disputed": [8, 4], "unknown": [2, 4]}


def edge_style(kind: Column, status: Column, scale: float = 1.0) -> Column:
    """struct<stroke,dashes>: the type gives the colour, the status the line; null for values that are not known."""
    strokes = F.create_map(*[F.lit(x) for kv in STROKES.items() for x in kv])
    dashes = F.create_map(*[x for k, v in DASHES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<double>"))])
    return F.struct(F.try_element_at(strokes, kind).alias("stroke"), F.transform(F.try_element_at(dashes, status), lambda d: d * scale).alias("dashes"))


def next_index(current: Column, step: int, count: Column) -> Column:
    """One step through a ring of count places; from outside to its first or last place, -1 where there is none."""
    outside = (current < 0) | (current >= count)
    return F.when(count <= 0, F.lit(-1)).when(outside, F.lit(0) if step > 0 else count - 1).otherwise(F.pmod(current + step, count))


def clamped(c: Column, fallback: int, low: int, high: int) -> Column:
    """The floor of a number between low and high; null and not a number are the fallback."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(fallback)).otherwise(F.floor(c).cast("int"))))


def grid_place(position: Column, count: Column, width: float = 1200.0, margin: float = 24.0, ratio: float = 1.55, row_height: float = 28.0) -> Column:
    """struct<column,row,x,y> of the place of a position (from 0) in a grid of ceil(sqrt(count * ratio)) columns."""
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(count * ratio)).cast("int"))
    rows = F.greatest(F.lit(1), F.ceil(count / columns).cast("int"))
    height = F.greatest(F.lit(360.0), F.least(F.lit(1200.0), rows * row_height + 2 * margin))
    column, row = F.pmod(position, columns), F.floor(position / columns).cast("int")
    return F.struct(
        column.cast("int").alias("column"), row.alias("row"),
        (margin + (column + 0.5) * ((width - 2 * margin) / columns)).alias("x"), (margin + (row + 0.5) * ((height - 2 * margin) / rows)).alias("y"),
    )
