"""References to records that do not exist, are deleted, or arrive later.

Method: keys are dictionary-encoded as integers, references and parents become bitmaps per key
range and period, and ``references AND NOT parents`` leaves bits that are decoded into suspects.
The parent bitmap of a period holds the parents that were there from before the period to its
end, so that a reference of the period to one of them is sound whatever its time; only suspects
are then compared by their exact times.

Per range of 32,768 keys and period at most one bitmap is made, by a partial aggregate before any
shuffle, and packed (sorted offsets, or deflated bits): a key that a third of the rows refer to
is one bit. No rows are collected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweft.scratch import Scratch
from kinweft.session import id_key

RANGE_BITS = 32_768


def reference_list(df: DataFrame, record: str, ref: str | Column, table_name: str, field_name: str, loaded: str = "loaded_at") -> DataFrame:
    """(table_name, field_name, record_id, ref_id, ref_at): each reference of each record once.

    ref may be an array. Refs are trimmed and in lower case; null and blank ones are no
    references. ref_at is the earliest load of the record, null if none is known.
    """
    c = F.col(ref) if isinstance(ref, str) else ref
    is_list = isinstance(df.select(c.alias("x")).schema["x"].dataType, T.ArrayType)
    rows = df.select(F.col(record).alias("record_id"), (F.explode(c) if is_list else c).alias("ref_id"), F.col(loaded).alias("ref_at"))
    rows = rows.select("record_id", id_key("ref_id").alias("ref_id"), "ref_at").where("ref_id is not null")
    first = df.groupBy(F.col(record).alias("record_id")).agg(F.min(loaded).alias("first_at"))
    one = rows.groupBy("record_id", "ref_id").agg(F.min("ref_at").alias("ref_at"))
    return (
        one.alias("o").join(first.alias("f"), F.col("o.record_id").eqNullSafe(F.col("f.record_id")), "left")
        .select(F.lit(table_name).alias("table_name"), F.lit(field_name).alias("field_name"), "o.record_id", "o.ref_id", F.coalesce("f.first_at", "o.ref_at").alias("ref_at"))
    )


def parent_list(df: DataFrame, key: str = "id", loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(ref_id, from_at, to_at): from the earliest load to the latest deletion of each key."""
    return (
        df.select(id_key(key).alias("ref_id"), F.col(loaded).alias("a"), F.col(deleted).alias("b")).where("ref_id is not null")
        .groupBy("ref_id").agg(F.min("a").alias("from_at"), F.max("b").alias("to_at"))
    )


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a sound parent: (table_name, field_name, record_id, ref_id, reason, load_month).

    refs as by ``reference_list``, with target naming the parent table; parents as by
    ``parent_list``, with target. reason is ``missing`` (no such key at all), else ``late`` (loaded
    before the parent), else ``deleted`` (the parent's deletion is not after the load). A
    reference of unknown load is only ever missing, and its month is null. An empty side gives no
    rows, or every reference as missing.
    """
    store = Scratch(refs.sparkSession, "orphans")
    refs = store.write(refs.select("target", "table_name", "field_name", "record_id", "ref_id", "ref_at", F.date_format("ref_at", "yyyy-MM").alias("period")), "refs")
    parents = parents.select("target", "ref_id", "from_at", "to_at")
    keys = parents.select("target", "ref_id").unionByName(refs.select("target", "ref_id")).distinct()
    code = _encode(keys, store)
    coded_refs = refs.groupBy("target", "ref_id", "period").agg(F.lit(1)).join(code, ["target", "ref_id"]).select("target", "bucket", "bit", "period")
    coded_parents = parents.join(code, ["target", "ref_id"]).select("target", "bucket", "bit", "from_at", "to_at")

    pack, left = _pack(), _and_not()
    ref_bits = coded_refs.groupBy("target", "bucket", "period").agg(F.bitmap_construct_agg("bit").alias("b")).select("target", "bucket", "period", pack("b").alias("refs"))
    # The parents of a period, once for each range and period that has references. A parent loaded
    # before the period's first day and not deleted by its last is sound in all of it.
    periods = ref_bits.select("target", "bucket", "period").withColumn("a", F.to_timestamp(F.concat("period", F.lit("-01"))))
    periods = periods.withColumn("b", F.add_months("a", 1).cast("timestamp"))
    sound = (
        coded_parents.join(periods, ["target", "bucket"])
        .where("period is null or (from_at <= a and (to_at is null or to_at >= b))")
        .groupBy("target", "bucket", "period").agg(F.bitmap_construct_agg("bit").alias("b"))
        .select("target", "bucket", "period", pack("b").alias("parents"))
    )
    r, s = ref_bits.alias("r"), sound.alias("s")
    same = (F.col("r.target") == F.col("s.target")) & (F.col("r.bucket") == F.col("s.bucket")) & F.col("r.period").eqNullSafe(F.col("s.period"))
    suspect = (
        r.join(s, same, "left").select("r.target", "r.bucket", "r.period", F.explode(left("refs", "parents")).alias("bit"))
        .join(code, ["target", "bucket", "bit"]).select("target", "ref_id", "period")
    )
    x, q = refs.alias("x"), suspect.alias("q")
    hit = (F.col("x.target") == F.col("q.target")) & (F.col("x.ref_id") == F.col("q.ref_id")) & F.col("x.period").eqNullSafe(F.col("q.period"))
    out = x.join(q, hit, "left_semi").join(parents.withColumn("there", F.lit(True)), ["target", "ref_id"], "left")
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("ref_at") < F.col("from_at"), "late")
        .when(F.col("to_at") <= F.col("ref_at"), "deleted")
    )
    return out.select("table_name", "field_name", "record_id", "ref_id", reason.alias("reason"), F.col("period").alias("load_month")).where("reason is not null")


def _encode(keys: DataFrame, store: Scratch) -> DataFrame:
    """(target, ref_id, bucket, bit): a dense integer bucket * RANGE_BITS + bit for each key.

    Keys are range-partitioned and numbered within their partition, so no task holds more than a
    partition, and neighbouring keys share bitmaps.
    """
    spark = keys.sparkSession
    placed = keys.repartitionByRange("target", "ref_id").sortWithinPartitions("target", "ref_id").select("target", "ref_id", F.monotonically_increasing_id().alias("n"))
    # monotonically_increasing_id is partition << 33 | row: dense within the partition.
    wide = F.shiftright("n", 33) * F.lit(1 << 18) + F.shiftright(F.col("n").bitwiseAND(F.lit((1 << 33) - 1)), 15)
    return store.write(placed.select("target", "ref_id", wide.alias("bucket"), F.col("n").bitwiseAND(F.lit(RANGE_BITS - 1)).alias("bit")), "keys")


def pack_bits(raw: bytes) -> bytes:
    """A bitmap as ``a`` + sorted 16-bit offsets, or ``z`` + deflated bits, whichever is shorter."""
    bits = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    if len(at) <= 512:
        return b"a" + at.astype("<u2").tobytes()
    z = zlib.compress(raw, 1)
    return b"z" + z if len(z) < 2 * len(at) else b"a" + at.astype("<u2").tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    """The flags of a packed bitmap."""
    if packed[:1] == b"z":
        return np.unpackbits(np.frombuffer(zlib.decompress(packed[1:]), np.uint8), bitorder="little").astype(bool)
    flags = np.zeros(RANGE_BITS, bool)
    flags[np.frombuffer(packed[1:], "<u2")] = True
    return flags


def _pack():
    @F.pandas_udf("binary")
    def pack(b: pd.Series) -> pd.Series:
        return b.map(pack_bits)

    return pack


def _and_not():
    @F.pandas_udf("array<long>")
    def and_not(refs: pd.Series, parents: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(unpack_bits(a) & ~unpack_bits(b) if b is not None else unpack_bits(a)) for a, b in zip(refs, parents)])

    return and_not
