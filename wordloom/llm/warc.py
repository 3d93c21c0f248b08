"""WARC records and a Merkle fixity audit of replicas, in Spark expressions.

``write_warc`` keeps pages as WARC/1.1 files and ``read_index`` makes an index of
the bytes that such files, or others (plain or gzipped), hold.

``archive`` turns pages into WARC/1.1 resource records and places them in
files: a file is chosen by a digest of page id and URL, records follow each
other by page id, and offsets are running byte counts.

``tree`` hashes an index of records (file_id, offset, length, digest): the
records that start in one range of ``RANGE_BYTES`` offsets hash, in order, into
a node; ``FANOUT`` neighbouring nodes hash into one of the next level, up to
one node for each file; then neighbouring files, up to a single root.

``audit`` compares the roots of two replicas and descends, level by level, only
below nodes that differ or that one side lacks; at the leaves it names records
that are altered, missing or extra, with their offset ranges.

Defined results: null urls and pages count as empty, a null page id as no id;
rows that repeat are records of their own, one after the other; an empty table
gives an empty tree, and two empty trees agree; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm._shared import spool, tasks_for
from wordloom.llm._warcfile import entries

RECORDS_PER_FILE = 1000
RANGE_BYTES, FANOUT = 1 << 16, 16
#: Rows of a stored file's index in a batch.
ENTRIES = 8192
INDEX = pa.schema([("file_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC/1.1 resource record."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Block-Digest: sha256:"),
        F.sha2(payload, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )


def bucket(n: int, *parts: Column) -> Column:
    """A number in 0..n-1 from the md5 digest of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(n))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url and the record's text."""
    row = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    return row.select("page_id", "url", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def archive(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """The index of an archive of ``pages``: file_id, offset, length, digest, page_id, url.

    Records are hashed where they are read; only index rows are shuffled, and a
    file's rows, about ``records_per_file``, are what one window sorts.
    """
    files = -(-pages.count() // records_per_file) or 1
    hashed = records(pages).select(
        bucket(files, F.col("page_id"), F.col("url")).alias("file_id"),
        "page_id",
        "url",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
    )
    order = Window.partitionBy("file_id").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("file_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length", "digest", "page_id", "url")


def write_warc(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "none") -> None:
    """Keep ``pages`` as WARC files, ``folder``/file_id=N/, in the order and at the offsets of :func:`archive`.

    Each file is a text file whose lines are records: a record ends with a line
    break, so their concatenation is WARC, byte for byte.
    """
    files = -(-pages.count() // records_per_file) or 1
    rows = records(pages).select(bucket(files, F.col("page_id"), F.col("url")).alias("file_id"), "page_id", "url", "record")
    line = F.expr("substring(record, 1, char_length(record) - 1)").alias("value")
    dealt = rows.withColumn("digest", F.sha2("record", 256)).repartition(tasks_for(pages), "file_id").sortWithinPartitions("file_id", "page_id", "url", "digest")
    dealt.select("file_id", line).write.mode("errorifexists").partitionBy("file_id").option("compression", compression).option("lineSep", "\n").text(folder)


def _opened(path: str) -> pa.NativeFile:
    """A stored file that can seek, by the path that Spark lists."""
    scheme, rest = re.fullmatch(r"(?:([a-z][a-z0-9]*):)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, below = rest.removeprefix("//").partition("/")
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem().open_input_file(f"{host}/{below}")
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0].open_input_file(f"/{below}")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, offset, length, digest of the records that the WARC files below ``folder`` hold, from their bytes.

    Offsets are those of the unpacked file; where a file is damaged, the bytes up
    to the next record are one entry (:mod:`wordloom.llm._warcfile`).  Spark lists
    the files and deals them to tasks by their bytes, without their contents; a
    task reads its files one after the other as streams, so neither files nor
    records need to fit in memory.  Files of other origin are numbered by 63 bits
    of a hash of their path below ``folder``, so that replicas in different
    folders share numbers.  Paths are those of a file system that pyarrow opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch.column("path").to_pylist(), batch.column("file_id").to_pylist(), strict=True):
                with _opened(path) as file:
                    found = entries(file)
                    while some := list(islice(found, ENTRIES)):
                        yield pa.RecordBatch.from_pydict({"file_id": [number] * len(some), **dict(zip(("offset", "length", "digest"), zip(*some, strict=True), strict=True))}, INDEX)

    own = F.regexp_extract("path", "/file_id=([0-9]+)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    below = F.when(F.startswith("path", F.lit(top)), F.expr(f"substring(path, {len(top) + 1})")).otherwise(F.col("path"))
    foreign = F.xxhash64(below).bitwiseAND(F.lit((1 << 63) - 1))
    named = files.select(F.when(own != "", own.cast("long")).otherwise(foreign).alias("file_id"), "path")
    return spool(named.mapInArrow(run, "file_id long, offset long, length long, digest string"), "warc-read")


def shape(*indexes: DataFrame) -> list[tuple[str, int]]:
    """The steps from records to the root that trees of all ``indexes`` share."""
    ends = [x.agg(F.max("offset").alias("offset"), F.max("file_id").alias("file")).first() for x in indexes]
    place = max((e["offset"] or 0 for e in ends), default=0) // RANGE_BYTES
    file = max((e["file"] or 0 for e in ends), default=0)
    steps = [("place", RANGE_BYTES)]
    while place:
        place //= FANOUT
        steps.append(("place", FANOUT))
    while file:
        file //= FANOUT
        steps.append(("file_id", FANOUT))
    return steps


def _up(step: tuple[str, int]) -> list[Column]:
    """file_id and place of a node's parent."""
    column, span = step
    return [(F.floor(F.col(c) / span).cast("long") if c == column else F.col(c)).alias(c) for c in ("file_id", "place")]


def tree(index: DataFrame, steps: list[tuple[str, int]]) -> list[DataFrame]:
    """Levels of a Merkle tree, records first, the root last: file_id, place, hash.

    A node covers the records that start in one offset range, then FANOUT nodes
    or files at most; each level is a written table, a fraction of the one below.
    """
    hashed = index.groupBy("file_id", F.col("offset").alias("place")).agg(F.array_sort(F.collect_list(F.concat_ws("|", "length", "digest"))).alias("kept"))
    levels = [spool(hashed.select("file_id", "place", F.sha2(F.array_join("kept", "\n"), 256).alias("hash")), "warc-tree")]
    for step in steps:
        child = F.struct("file_id", "place", "hash").alias("child")
        nodes = levels[-1].select(*_up(step), child).groupBy("file_id", "place").agg(F.array_sort(F.collect_list("child")).alias("children"))
        lines = F.transform("children", lambda c: F.concat_ws("|", c["file_id"], c["place"], c["hash"]))
        levels.append(spool(nodes.select("file_id", "place", F.sha2(F.array_join(lines, "\n"), 256).alias("hash")), "warc-tree"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that differ or that one side lacks."""
    both = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), ["file_id", "place"], "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file_id", "place")


def audit(index: DataFrame, other: DataFrame) -> DataFrame:
    """The records in which two replicas differ, with the digests of both sides.

    file_id, offset, status (altered, missing or extra in ``other``), n, length,
    digest, other_n, other_length, other_digest; n counts the records at that
    offset, and length and digest are the least ones.
    """
    steps = shape(index, other)
    ours, theirs = tree(index, steps), tree(other, steps)
    bad = spool(_differing(ours[-1], theirs[-1]), "warc-audit")
    for step, a, b in zip(reversed(steps), reversed(ours[:-1]), reversed(theirs[:-1]), strict=True):
        parent = [c.alias(f"up_{n}") for c, n in zip(_up(step), ("file_id", "place"), strict=True)]
        above = bad.select(F.col("file_id").alias("up_file_id"), F.col("place").alias("up_place"))
        below = [x.select("*", *parent).join(above, ["up_file_id", "up_place"], "left_semi").select("file_id", "place", "hash") for x in (a, b)]
        bad = spool(_differing(*below), "warc-audit")

    def at(x: DataFrame, prefix: str) -> DataFrame:
        least = F.min(F.struct("length", "digest"))
        found = x.join(bad.withColumnRenamed("place", "offset"), ["file_id", "offset"], "left_semi").groupBy("file_id", "offset")
        return found.agg(F.count(F.lit(1)).alias(f"{prefix}n"), least.alias("least")).select("file_id", "offset", f"{prefix}n", F.col("least.length").alias(f"{prefix}length"), F.col("least.digest").alias(f"{prefix}digest"))

    both = at(index, "").join(at(other, "other_"), ["file_id", "offset"], "full")
    status = F.when(F.col("n").isNull(), "extra").when(F.col("other_n").isNull(), "missing").otherwise("altered")
    return both.select("file_id", "offset", status.alias("status"), "n", "length", "digest", "other_n", "other_length", "other_digest")


def damaged(pages: DataFrame, index: DataFrame, seed: str, altered: int, lost: int) -> DataFrame:
    """A replica's index after simulated damage, each record hashed from its own bytes.

    By a digest of id and URL, one record in ``lost`` is gone and one in
    ``altered`` of the others has its last byte overwritten.
    """
    hit = lambda n, kind: bucket(n, F.lit(f"{seed}-{kind}"), F.col("page_id"), F.col("url")) == 0
    stored = records(pages).where(~hit(lost, "lost"))
    spoiled = F.when(hit(altered, "altered"), F.concat(F.expr("substring(record, 1, char_length(record) - 1)"), F.lit("?"))).otherwise(F.col("record"))
    # where a record lies is known from the index; its own bytes give length and digest
    stored = stored.select("page_id", "url", F.sha2("record", 256).alias("digest"), spoiled.alias("record")).select(
        "page_id", "url", "digest", F.octet_length("record").cast("long").alias("other_length"), F.sha2("record", 256).alias("other_digest")
    )
    stored = stored.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "url", "digest").orderBy("other_digest")))
    places = index.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "url", "digest").orderBy("offset"))).select("file_id", "offset", "page_id", "url", "digest", "k")
    a, b = places.alias("a"), stored.alias("b")
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.url") == F.col("b.url")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.k") == F.col("b.k"))
    return a.join(b, same).select("a.file_id", "a.offset", F.col("b.other_length").alias("length"), F.col("b.other_digest").alias("digest"))
