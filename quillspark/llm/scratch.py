"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import durable
from ..plans.durable import drop_table, persist_table, release, shared_dir

#: Rows of ids that a join may send to every task: some 30 MB there.
FEW = 1_000_000


def sent_if_few(ids: DataFrame, limit: int = FEW) -> DataFrame:
    """Narrow rows for one side of a join: broadcast if they are at most ``limit``, by count; else the join shuffles."""
    return durable.sent_if_few(ids, limit)


#: Rows from which a key counts as hot, the share of rows that is looked at to find such keys, and how many there are at most;
#: their rows are dealt to so many salts.
HOT_ROWS, HOT_SHARE, MOST_HOT, SALTS = 2048, 16, 50_000, 64


def join_facts(rows: DataFrame, keys: list[str], facts: Callable[[DataFrame], DataFrame], of: DataFrame | None = None) -> DataFrame:
    """``rows`` joined by ``keys`` with ``facts(of)``, an aggregation by them (``of``: the same rows).

    The rows of keys that a sample finds often are salted, and their facts copied to every salt, so that no task gets all rows
    of one key. Which keys those are changes nothing in the result. The first key is a 64-bit hash: a salted one takes its place in
    the join, so that rows carry no more than before.
    """
    of = rows if of is None else of
    least = max(HOT_ROWS // HOT_SHARE, 2)
    seen = rows.select(*keys).sample(1 / HOT_SHARE, seed=7).groupBy(*keys).count().where(F.col("count") >= least)
    hot = persist_table(seen.orderBy(F.desc("count"), *keys).limit(MOST_HOT).select(*keys, F.lit(True).alias("_hot")), "hot")
    if not hot.take(1):
        return rows.join(facts(of), keys)
    first, *others = keys
    salted = lambda salt: F.when(F.col("_hot"), F.xxhash64(first, salt.cast("long"))).otherwise(F.col(first)).alias("_key")
    dealt = rows.join(F.broadcast(hot), keys, "left").select(salted(F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))), *(c for c in rows.columns if c != first))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = facts(of).join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every))
    copies = copies.withColumn("_key", salted(F.col("_salt"))).drop("_salt", "_hot")
    return dealt.join(copies, ["_key", *others]).drop("_key")


#: Rows of texts that go to Python at once, at most; texts can be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size, so that a task holds few texts at a time on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


__all__ = ["drop_table", "join_facts", "persist_table", "release", "sent_if_few", "shared_dir", "small_batches"]
