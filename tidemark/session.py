"""Spark session settings and table access shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC keeps epoch arithmetic independent of the host; ANSI stays on so that a raw division fails loudly.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which is one machine, gets one of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that ``materialise`` writes within it go to a folder of their own, which is removed in the end: write what depends on them before."""
    folder = f"{shared_folder(spark)}/tidemark-scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and lost executors cost no recomputation.

    The table stays until the folder is cleared, or the surrounding ``scratch`` ends.
    """
    path = f"{_scratch.get() or shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(held: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``held`` marked for broadcast if it has ``most`` rows at most: they are counted, so what is sent has a bound. A larger table is joined by a shuffle."""
    return F.broadcast(held) if held.limit(most + 1).count() <= most else shuffled(held)


def shuffled(held: DataFrame) -> DataFrame:
    """``held`` marked so that its join shuffles and sorts both sides.

    Spark sizes a table by its compressed files and doesn't see how often an explode repeats its rows. By that guess it may broadcast either side of
    a join, and the driver then holds far more than the threshold for broadcasts says.
    """
    return held.hint("merge")
