"""Tables in the folder that driver and executors share; what long lineages are cut with."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local one stands in only where none is named and nothing is distributed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints/castleflow"
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_castleflow"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``settle`` writes meanwhile, in order; for whoever can tell when they are no longer read."""
    token = _written.set([])
    try:
        yield _written.get()
    finally:
        _written.reset(token)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
