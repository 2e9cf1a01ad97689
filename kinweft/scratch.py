"""Tables written between the rounds of iterative operators.

A written table cuts the lineage and survives the loss of any executor, since it lies in the
folder that every executor shares (``spark.checkpoint.dir``). Nothing here uses
``localCheckpoint`` or a folder of one machine of a cluster.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; in local mode, where none is set, a temporary one.

    Raises RuntimeError on a cluster without ``spark.checkpoint.dir``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="kinweft-")
    return "file://" + _LOCAL_DIR[app]


class Scratch:
    """A folder of written tables that belongs to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinweft/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        # Unions that keep the partitioning of their inputs fail where adaptive execution has
        # coalesced those differently ("can't zip RDDs with unequal numbers of partitions").
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        _at_exit(spark)

    def path(self, label: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{label}"

    def write(self, df: DataFrame, label: str = "t", partition_by: str | None = None) -> DataFrame:
        """Write df and return it as read back; an empty df comes back with its columns."""
        path = self.path(label)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path = getattr(t, "scratch_path", None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_REGISTERED: set[str] = set()


def _at_exit(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _REGISTERED:
        return
    _REGISTERED.add(app)
    root = f"{shared_dir(spark)}/kinweft/{app}"

    def clean() -> None:
        try:
            _delete(spark, root)
        except Exception:  # the session may be gone already
            pass

    atexit.register(clean)
