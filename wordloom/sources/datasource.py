"""TextGrid, .npy and partition files as Spark data sources, to read and to write.

After ``register(spark)``, ``spark.read.format(name).load(folder)`` gives

* ``wordloom_textgrid``: filename, tier, pos, xmin, xmax, label, corrupt, as
  :func:`~wordloom.sources.alignments.read_textgrids` does;
* ``wordloom_npy``: node, frame, vec, a row for each row of a matrix;
* ``wordloom_partition``: cluster, filename, start, end, rest, as
  :func:`~wordloom.sources.partitions.read_partition` does.

A scan's partitions are ranges of about ``bytes`` (an option, 128 MiB) of the
files in order of name.  TextGrids stay whole; matrices are split between rows
and partition files between blocks, so neither needs to fit in memory (a matrix
in column order does, and a block is one task's).  Equality and IN on filename,
tier, node and cluster are pushed into the scan: other files are not opened,
other blocks not parsed.  Files and folders whose names begin with ``_`` or
``.`` do not count.  An empty folder has no rows; a path that is not there is
an error.

The writers (:func:`write_textgrids`, :func:`write_npy`, :func:`write_partitions`)
put each file under a hidden name and rename it when it is whole, so a task that
runs twice leaves one copy.  ``append`` keeps other files, replacing those of
equal names; ``overwrite`` removes the old ones once all new ones are there.
Paths are those of a file system that pyarrow opens, the same from all executors.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from wordloom.sources.alignments import TIERS, columns_of

#: Bytes of files in a scan's partition, and of vectors in a batch; intervals in a batch, at least.
SCAN_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 8 << 20, 1 << 14


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below ``path``, in order of name."""
    store, top = _store(path)
    at = store.get_file_info(top)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.is_file else store.get_file_info(fs.FileSelector(top, recursive=True))
    hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path.removeprefix(top).split("/"))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix) and not hidden(f))


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, first, end) of files."""

    parts: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    """A scan of files with ``SUFFIX``; values wanted of ``KEYS`` come from filters, and the first key names a file if ``BY_FILE``."""

    SUFFIX, KEYS, SPLIT, BY_FILE = "", (), False, False

    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], max(1, int(options.get("bytes", SCAN_BYTES)))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.KEYS:
                values = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.wanted[f.attribute[0]] = values & self.wanted.get(f.attribute[0], values)
            else:
                yield f

    def _is_wanted(self, key: str, value: object) -> bool:
        return key not in self.wanted or value in self.wanted[key]

    def partitions(self) -> list[InputPartition]:
        files = [(p, n) for p, n in _files(self.path, self.SUFFIX) if not self.BY_FILE or self._is_wanted(self.KEYS[0], _stem(p))]
        groups, filled = [[]], 0
        for path, size in files:
            step = self.bytes if self.SPLIT else max(size, 1)
            for first in range(0, max(size, 1), step):
                end = min(first + step, size)
                if groups[-1] and filled + end - first > self.bytes:
                    groups.append([])
                    filled = 0
                groups[-1].append((path, first, end))
                filled += end - first
        return [Ranges(g) for g in groups]

    def read(self, partition: Ranges) -> Iterator[tuple | pa.RecordBatch]:
        store = _store(self.path)[0]
        for path, first, end in partition.parts:
            with store.open_input_file(path) as f:
                yield from self.rows(io.BufferedReader(f), _stem(path), first, end)

    def rows(self, f: io.BufferedReader, stem: str, first: int, end: int) -> Iterator[tuple | pa.RecordBatch]:
        raise NotImplementedError


class TextGridReader(_Reader):
    SUFFIX, KEYS, BY_FILE = ".TextGrid", ("filename", "tier"), True

    def read(self, partition):
        """Batches of several small files' intervals."""
        held, n = [], 0
        for batch in super().read(partition):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def rows(self, f, stem, first, end):
        for tier, starts, ends, labels, corrupt in columns_of(f.read()):
            if self._is_wanted("tier", tier):
                n = len(labels)
                ordinal = pa.array(np.arange(n), pa.int32()) if corrupt is None else pa.nulls(n, pa.int32())
                columns = [pa.repeat(pa.scalar(stem, pa.string()), n), pa.repeat(pa.scalar(tier, pa.string()), n), ordinal]
                columns += [pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.array(labels, pa.string()), pa.repeat(pa.scalar(corrupt, pa.string()), n)]
                yield pa.RecordBatch.from_arrays(columns, names=["filename", "tier", "pos", "xmin", "xmax", "label", "corrupt"])


class NpyReader(_Reader):
    SUFFIX, KEYS, SPLIT, BY_FILE = ".npy", ("node",), True, True

    def rows(self, f, stem, first, end):
        """The rows of a matrix whose first byte is in the range; a vector is one row."""
        version = np.lib.format.read_magic(f)
        head = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = head(f)
        if dtype.hasobject or len(shape) > 2:
            raise ValueError(f"{stem}.npy is no matrix of numbers")
        count, width = (1, *shape)[-2:] if shape else (1, 1)
        start, row_bytes = f.tell(), max(1, width * dtype.itemsize)
        if by_column:
            a, b = (0, count) if first == 0 else (0, 0)
        else:
            a, b = (min(count, max(0, -(-(x - start) // row_bytes))) for x in (first, end))
            b = count if end >= start + count * row_bytes else b
            f.seek(start + a * row_bytes)
        step = count if by_column else max(1, BATCH_BYTES // row_bytes)
        for k in range(a, b, max(1, step)):
            n = min(step, b - k)
            raw = f.read(n * width * dtype.itemsize)
            if len(raw) < n * width * dtype.itemsize:
                raise ValueError(f"{stem}.npy ends within row {k + len(raw) // row_bytes}")
            block = np.frombuffer(raw, dtype).reshape((n, width), order="F" if by_column else "C").astype(np.float64)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([stem] * n), pa.array(np.arange(k, k + n), pa.int32()), vec], names=["node", "frame", "vec"])


_WHOLE = re.compile(r"[+-]?\d+")


def _number(text: str) -> float | None:
    try:
        return None if "_" in text else float(text)
    except ValueError:
        return None


class PartitionReader(_Reader):
    KEYS, SPLIT = ("cluster",), True

    def rows(self, f, stem, first, end):
        """Blocks whose header line begins in the range."""
        f.seek(max(0, first - 1))
        at = f.tell() + (len(f.readline()) if first else 0)
        cluster = None
        for line in f:
            start, at = at, at + len(line)
            if line.startswith(b"Class "):
                if start >= end:
                    return
                head = line[6:].decode("utf-8", "replace").strip()
                cluster = int(head) if _WHOLE.fullmatch(head) and self._is_wanted("cluster", int(head)) else None
            elif cluster is not None:
                part = line.decode("utf-8", "replace").rstrip("\r\n").strip(" ").split(" ")
                if len(part) >= 3:
                    yield cluster, part[0], _number(part[1]), _number(part[2]), " ".join(part[3:])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Files of one job below ``path``."""

    COLUMNS: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        missing = [c for c in self.COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        store, top = _store(self.path)
        there = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        self.before = [f.base_name for f in there if f.is_file and not f.base_name.startswith(("_", "."))]

    def write(self, iterator: Iterator[Row] | Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        names: set[str] = set()

        def put(name: str, fill: Callable[[pa.NativeFile], None]) -> None:
            if "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} cannot be a file's name")
            if name in names:
                raise ValueError(f"rows of {name} do not follow each other")
            hidden = f"{top}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                fill(f)
            store.move(hidden, f"{top}/{name}")
            names.add(name)

        self.fill(iterator, put)
        return Written(sorted(names))

    def fill(self, rows: Iterator[Row] | Iterator[pa.RecordBatch], put: Callable[[str, Callable[[pa.NativeFile], None]], None]) -> None:
        raise NotImplementedError

    def _names(self, messages: list[Written | None]) -> set[str]:
        return {n for m in messages if m is not None for n in m.names}

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        for name in set(self.before) - self._names(messages) if self.overwrite else ():
            store.delete_file(f"{top}/{name}")
        store.open_output_stream(f"{top}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        for name in self._names(messages) - set(self.before):
            store.delete_file(f"{top}/{name}")


class TextGridWriter(_Writer, DataSourceArrowWriter):
    """A file for each filename, whose rows follow each other in order of tier and pos."""

    COLUMNS = ("filename", "tier", "pos", "xmin", "xmax", "label")

    def fill(self, rows, put):
        for name, of_file in groupby(_runs(rows), key=lambda r: r[0]):
            tiers: list[tuple[str, list, list, list]] = []
            for _, tier, *columns in of_file:
                if tiers and tiers[-1][0] == tier:  # a tier that goes on in the next batch
                    for held, more in zip(tiers[-1][1:], columns, strict=True):
                        held += more
                else:
                    tiers.append((tier, *columns))
            if name is None or any(t[0] is None for t in tiers):
                raise ValueError("a row without filename or tier")
            put(f"{name}.TextGrid", lambda f, tiers=tiers: f.write(_textgrid(tiers).encode()))


def _listed(column: pa.Array) -> list:
    """Values of a column; numbers with nulls among them would become NaN in numpy."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None, list, list, list]]:
    """filename, tier and lists of xmin, xmax, label of rows that follow each other in a batch."""
    for batch in batches:
        names, tiers, starts, ends, labels = (batch.column(c) for c in ("filename", "tier", "xmin", "xmax", "label"))
        bounds = np.union1d(*(pc.run_end_encode(x).run_ends.to_numpy() for x in (names, tiers))).tolist()
        starts, ends, labels = _listed(starts), _listed(ends), _listed(labels)
        for first, end in zip([0, *bounds], bounds, strict=False):
            yield names[first].as_py(), tiers[first].as_py(), starts[first:end], ends[first:end], labels[first:end]


def _textgrid(tiers: list[tuple[str, list, list, list]]) -> str:
    quoted = lambda s: '"' + (s or "").replace('"', '""') + '"'
    low, high = min(min(starts) for _, starts, _, _ in tiers), max(max(ends) for _, _, ends, _ in tiers)
    lines = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", f"xmin = {low!r}", f"xmax = {high!r}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for k, (name, starts, ends, labels) in enumerate(tiers, 1):
        lines += [f"    item [{k}]:", '        class = "IntervalTier"', f"        name = {quoted(name)}", f"        xmin = {low!r}", f"        xmax = {high!r}", f"        intervals: size = {len(labels)}"]
        lines += [f"        intervals [{n}]:\n            xmin = {a!r}\n            xmax = {b!r}\n            text = {quoted(t)}" for n, (a, b, t) in enumerate(zip(starts, ends, labels, strict=True), 1)]
    return "\n".join(lines) + "\n"


class NpyWriter(_Writer):
    """A matrix for each row (node, frames)."""

    COLUMNS = ("node", "frames")

    def fill(self, rows, put):
        for r in rows:
            frames = np.asarray(r["frames"] or [], np.float64)
            put(f"{r['node']}.npy", lambda f, frames=frames: np.save(f, frames if frames.ndim == 2 else frames.reshape(0, 0)))


class PartitionWriter(_Writer):
    """Lines (cluster, line) in one file for each task; a blank line ends a cluster's block, which begins with its header."""

    COLUMNS = ("cluster", "line")

    def fill(self, rows, put):
        def lines(f: pa.NativeFile) -> None:
            done: set[int] = set()
            for cluster, block in groupby(rows, key=lambda r: r["cluster"]):
                if cluster in done:
                    raise ValueError(f"lines of cluster {cluster} do not follow each other")
                done.add(cluster)
                for k, r in enumerate(block):
                    if (k == 0) != r["line"].startswith("Class "):
                        raise ValueError(f"cluster {cluster} does not begin with its only header")
                    f.write(f"{r['line']}\n".encode())
                f.write(b"\n")

        from pyspark import TaskContext

        task = TaskContext.get()
        put(f"part-{task.partitionId() if task else 0:05d}-{self.job}.txt", lines)


class _Source(DataSource):
    NAME, SCHEMA, READER, WRITER = "", "", _Reader, _Writer

    @classmethod
    def name(cls) -> str:
        return cls.NAME

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.READER(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self.WRITER(self.options, schema, overwrite)


class TextGridSource(_Source):
    NAME, SCHEMA, READER, WRITER = "wordloom_textgrid", TIERS, TextGridReader, TextGridWriter


class NpySource(_Source):
    NAME, SCHEMA, READER, WRITER = "wordloom_npy", "node string, frame int, vec array<double>", NpyReader, NpyWriter


class PartitionSource(_Source):
    NAME, SCHEMA, READER, WRITER = "wordloom_partition", "cluster bigint, filename string, start double, end double, rest string", PartitionReader, PartitionWriter


def register(spark: SparkSession) -> SparkSession:
    """The session with the three formats, filters pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TextGridSource, NpySource, PartitionSource):
        spark.dataSource.register(source)
    return spark


def _save(rows: DataFrame, source: type[_Source], path: str, mode: str) -> None:
    register(rows.sparkSession)
    rows.write.format(source.NAME).mode(mode).save(path)


def write_textgrids(tiers: DataFrame, path: str, mode: str = "append") -> None:
    """One TextGrid for each filename of (filename, tier, pos, xmin, xmax, label); a task holds one file's intervals at a time."""
    rows = tiers.select(*TextGridWriter.COLUMNS).repartition("filename").sortWithinPartitions("filename", "tier", "pos")
    _save(rows, TextGridSource, path, mode)


def write_npy(words: DataFrame, path: str, mode: str = "append") -> None:
    """One matrix for each row of (node, frames); nodes are distinct."""
    _save(words.select(*NpyWriter.COLUMNS), NpySource, path, mode)


def write_partitions(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Blocks of (cluster, position, line), as :func:`~wordloom.sources.partitions.partition_lines` makes them, streamed to a file for each task."""
    rows = lines.repartition("cluster").sortWithinPartitions("cluster", "position").select(*PartitionWriter.COLUMNS)
    _save(rows, PartitionSource, path, mode)
