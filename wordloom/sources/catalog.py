"""Results kept as tables, found again by the configuration that made them."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset under a local master (as in tests), one temporary folder
    for each application; a cluster run is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='wordloom-')}"
    return _own_folders[context.applicationId]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage of iterative work at a shared table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def made_from(spark: SparkSession, path: str, n: int) -> bool:
    """Whether the table at ``path`` is noted as made from ``n`` rows."""
    note = f"{path}.made"
    return exists(spark, path) and exists(spark, note) and spark.read.schema("n long").json(note).first()["n"] == n


def note_made(spark: SparkSession, path: str, n: int) -> None:
    """Note beside a table from how many rows it was made; some of them may have no rows there."""
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").json(f"{path}.made")


def print_of(*columns: str) -> Column:
    """An aggregate: a fingerprint of a group's rows, in whatever order they come."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string") for seed in ("a", "b")]
    return F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *[F.coalesce(x, F.lit("0")) for x in sums]), 256)


def fingerprint(table: DataFrame) -> str:
    """Of all rows and columns of a table, whatever their order."""
    return table.agg(print_of(*sorted(table.columns)).alias("print")).first()["print"]


@dataclass(frozen=True)
class RunKey:
    """What a result depends on: settings, the resolution among them, and a fingerprint of what it is made from."""

    kind: str
    language: str
    dataset: str
    model: str
    layer: str
    distance: str = ""
    threshold: float | None = None
    k: int | None = None
    lmbda: float | None = None
    resolution: float | None = None
    inputs: str = ""

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class Catalog:
    """Tables under ``root``, one folder for each run; an index row names key, folder, seconds and time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _index(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.root}/index"):
            return None
        return self.spark.read.schema("key string, folder string, seconds double, made timestamp").parquet(f"{self.root}/index")

    def find(self, key: RunKey) -> tuple[DataFrame, float] | None:
        """The newest result for ``key`` and its seconds."""
        index = self._index()
        if index is None:
            return None
        row = index.where(F.col("key") == key.text()).agg(F.max_by(F.struct("folder", "seconds"), "made").alias("x")).first()["x"]
        return None if row is None else (self.spark.read.parquet(row["folder"]), row["seconds"])

    def put(self, key: RunKey, df: DataFrame) -> DataFrame:
        """Write a result; its seconds are those of the plan that the write runs."""
        folder, began = f"{self.root}/runs/{uuid.uuid4().hex}", time.time()
        df.write.parquet(folder)
        row = self.spark.createDataFrame([(key.text(), folder, time.time() - began)], "key string, folder string, seconds double")
        row.withColumn("made", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/index")
        return self.spark.read.parquet(folder)

    def get_or_make(self, key: RunKey, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.find(key)
        return found[0] if found else self.put(key, make())

    def tiles(self, key: RunKey) -> TileStore:
        """The store of rows that are made for ``key`` tile by tile."""
        return TileStore(self.spark, f"{self.root}/tiles/{hashlib.sha256(key.text().encode()).hexdigest()[:32]}")


class TileStore:
    """Rows made tile by tile, so that a run that was stopped goes on where it was.

    Each round writes its rows to a folder of its own, then enters its tiles, with
    round and seconds, into an index; rows of a round that is not entered do not count.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def finished(self) -> DataFrame | None:
        """The tiles made so far, with round and seconds."""
        return self.spark.read.parquet(f"{self.folder}/index") if exists(self.spark, f"{self.folder}/index") else None

    def rows(self) -> DataFrame | None:
        done = self.finished()
        if done is None:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/rounds").parquet(f"{self.folder}/rounds")
        return rows.join(done.select("round").distinct(), "round", "left_semi").drop("round")

    def fill(self, tiles: DataFrame, make: Callable[[DataFrame], DataFrame], tiles_a_round: int = 4096) -> DataFrame:
        """All rows of ``tiles``; ``make`` gives those of the tiles that are not there yet."""
        by = tiles.columns
        while True:
            batch = materialise(append_missing(self.finished(), tiles, by).orderBy(*by).limit(tiles_a_round), "tiles")
            if batch.isEmpty():
                break
            name, began = uuid.uuid4().hex, time.time()
            make(batch).write.parquet(f"{self.folder}/rounds/round={name}")
            entered = batch.withColumn("round", F.lit(name)).withColumn("seconds", F.lit(time.time() - began))
            entered.coalesce(1).write.mode("append").parquet(f"{self.folder}/index")
        return self.rows()


def append_missing(done: DataFrame | None, tiles: DataFrame, by: list[str]) -> DataFrame:
    """The tiles that a resumed run still has to make."""
    return tiles if done is None else tiles.join(done.select(*by).distinct(), by, "left_anti")
