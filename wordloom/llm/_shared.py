"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from wordloom.sources.catalog import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where unset (as in tests) one of our own."""
    return shared_folder(spark)


def spool(df: DataFrame, name: str, compression: str = "none", by: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage at a replicated file, so later branches neither
    recompute it nor depend on executors that may be lost.  Hashes and small
    tables gain nothing from a codec, whose buffers outside the heap stay until
    it is collected; tables with texts ask for one.  ``by`` names a column of few
    values; rows of each stand in a folder of their own.  A row group, which a
    task holds whole when it writes or reads, has 100 rows at least; for rows of
    megabytes ``group_bytes`` ends it as soon as it has so many.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom/{name}-{uuid.uuid4().hex}"
    options = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.mode("overwrite").option("compression", compression).options(**options).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input (as its files or statistics tell) for one task of an explicit exchange.
TASK_BYTES = 64 << 20


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks of an explicit exchange: spark.sql.shuffle.partitions, or more if the input is large.

    The size is the optimizer's estimate, which costs no job; one that is unknown is ignored.
    """
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // task_bytes), 1 << 20)) if size < 1 << 57 else least


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, for what is run inside: texts and sets are wide."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in most}
    for name, value in most.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
