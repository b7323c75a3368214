"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of so many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that they share every folder."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not one_machine(spark):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc.getCheckpointDir()


#: Folders of the checkpoints made in each open ``scratch``, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside are removed at the end, when what needed them has been written or cut itself."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and survives lost executors.

    With ``keep`` it outlives the innermost ``scratch``.

    A checkpoint keeps the size that the plan before it was guessed at. In loops with joins these guesses multiply, round by
    round, to numbers of millions of digits, so the result forgets them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    plan = df.checkpoint(eager=True)._jdf.queryExecution().analyzed()
    scopes = _open.get()[: -1 if keep else None]
    if scopes and (folder := plan.rdd().getCheckpointFile()).isDefined():
        scopes[-1].append(folder.get())
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), plan.schema(), False), spark)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; it is counted, so it should be cut off or cheap."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
