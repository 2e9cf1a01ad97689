"""Session settings that the engine relies on, and small helpers for reading tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinweft")
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: All that counts as a blank, as the class s of Unicode patterns does.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def id_key(c: Column | str) -> Column:
    """An id reference as it is meant: without surrounding blanks and case; blank is null.

    Joins look at it several times a row, so that a pattern over the whole text would cost.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c, F.lit(BLANKS))), F.lit(""))


def tasks(spark: SparkSession) -> int:
    """Tasks that can run at once, at least the shuffle partitions: for spreading Python work."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """df with its text and nested columns as Python objects, empty ones too: other forms of them do not all reach Arrow."""
    return df.astype({c: object for c, t in df.dtypes.items() if not (pd.api.types.is_bool_dtype(t) or pd.api.types.is_numeric_dtype(t) or pd.api.types.is_datetime64_any_dtype(t))})


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins of what is run within send no side through the driver; the settings are as before afterwards.

    Every broadcast table takes driver memory and threads that stay for a while, so that some
    hundred small ones add up.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
