"""Tables in the folder that the driver and all executors share, cutting lineage, and ids that follow an order."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROOTS: dict[str, weakref.ref] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _root(spark: SparkSession) -> str:
    """This application's own folder below the shared one, deleted when the driver ends."""
    base = shared_dir(spark)
    for root, owner in _ROOTS.items():
        if root.startswith(base) and owner() is spark.sparkContext:
            return root
    root = f"{base}/quillspark-{uuid.uuid4().hex}"
    _ROOTS[root] = weakref.ref(spark.sparkContext)
    atexit.register(_remove, root)
    return root


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        delete(spark, path)
    except Exception:  # the session may be gone at exit
        pass


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def persist_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and fixes the rows: a lost executor makes Spark read the files again instead of
    recomputing what led to them.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quillspark_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from :func:`persist_table` that no later plan reads."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        delete(df.sparkSession, path)


#: Seconds that :func:`release` waits at most, for events of finished queries and for the cleaner, and between two looks at it.
_PATIENCE, _LOOK = 10, 0.1


def _shuffles(spark: SparkSession) -> int:
    """Shuffles whose files are kept."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner acts when the driver's JVM collects garbage.

    Spark's event loops hold the last query's events, and so its plan and its shuffles, until the next events come: a job of one row
    sends some. The cleaner works beside the driver, so the next step waits until it finds no more.
    """
    gc.collect()
    spark.range(1, numPartitions=1).collect()
    with contextlib.suppress(Py4JJavaError):  # not empty in time
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(_PATIENCE * 1000)
    before = _shuffles(spark)
    spark.sparkContext._jvm.System.gc()
    until, same = time.monotonic() + _PATIENCE, 0
    while before and same < 3 and time.monotonic() < until:
        time.sleep(_LOOK)
        now = _shuffles(spark)
        same = same + 1 if now == before else 0
        before = now


def checkpointed(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` from compressed files in the shared folder; the shuffle files that led to it go."""
    out = persist_table(df, name, compression="zstd")
    release(df.sparkSession)
    return out


#: Rows of a slice, until there are as many slices as a table may be made in.
SLICE, MOST_SLICES = 1_000_000, 8


def slices(rows: int, most: int = MOST_SLICES) -> int:
    """How many slices a step over so many rows is made in."""
    return max(1, min(most, -(-rows // SLICE)))


def checkpointed_in_slices(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts, one at least, as :func:`checkpointed` gives them. Parts are made one after the other: shuffle files are there for one only."""
    path = schema = spark = None
    for part in parts:
        if path is None:
            first = checkpointed(part, name)
            path, schema, spark = first._quillspark_path, first.schema, part.sparkSession
        else:
            part.write.mode("append").option("compression", "zstd").parquet(path)
            release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._quillspark_path = path
    return out


def ranges(keys: DataFrame, column: str) -> list[Column]:
    """Conditions on a column that each row of a table fits one of, in ascending order, for slices of about the same size.

    keys: the column's values. A sample of them, about 1,000 for each slice, says where slices meet.
    """
    rows = keys.count()
    n = slices(rows)
    if n == 1:
        return [F.lit(True)]
    found = sorted(r[0] for r in keys.where(F.col(column).isNotNull()).sample(min(1.0, 1000 * n / rows), seed=7).select(column).collect())
    cuts = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []
    if not cuts:
        return [F.lit(True)]
    between = [(F.col(column) >= a) & (F.col(column) < b) for a, b in zip(cuts, cuts[1:])]
    return [F.col(column).isNull() | (F.col(column) < cuts[0]), *between, F.col(column) >= cuts[-1]]


#: Rows that a join may send to every task.
FEW = 200_000


def sent_if_few(rows: DataFrame, limit: int = FEW) -> DataFrame:
    """Narrow rows for one side of a join: broadcast if they are at most ``limit``, by count; else the join shuffles."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def with_dense_ids(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ids from 0 without gaps, in the given order.

    A range partitioning sorts in parallel; only one count for each partition comes to the driver.
    """
    ranged = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    firsts, n = [], 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        firsts.append((r["_part"], n))
        n += r["count"]
    offsets = df.sparkSession.createDataFrame(firsts, "_part int, _first long")
    out = ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_first")).select(*df.columns, name)
    out._quillspark_path = ranged._quillspark_path
    return out
