"""Word and phone alignments: TextGrid, WRD/PHN and CSV."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom import schema

#: Names that a tier may have, in order of preference.
WORD_TIERS = ("words", "word", "Words", "Word")
PHONE_TIERS = ("phones", "phone", "Phones", "Phone")
#: The schema of the intervals of TextGrids.
TIERS = "filename string, tier string, pos int, xmin double, xmax double, label string, corrupt string"


def parse_textgrid(text: str) -> dict[str, list[tuple[float, float, str]]]:
    """Interval tiers of a TextGrid, in the long or the short format."""
    if "item [" in text or "intervals [" in text:
        tiers: dict[str, list[tuple[float, float, str]]] = {}
        for block in re.split(r"item \[\d+\]:", text)[1:]:
            if '"IntervalTier"' not in block:
                continue
            name = re.search(r'name = "((?:[^"]|"")*)"', block)
            if name is None:
                raise ValueError("a tier without a name")
            found = re.findall(r'xmin = (\S+)\s+xmax = (\S+)\s+text = "((?:[^"]|"")*)"', block)
            tiers[name[1]] = [(float(a), float(b), t.replace('""', '"')) for a, b, t in found]
        return tiers
    values = re.findall(r'"((?:[^"]|"")*)"|(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)', text.split("<exists>", 1)[1])
    flat = [n if n else s.replace('""', '"') for s, n in values]
    tiers, at = {}, 1
    for _ in range(int(flat[0])):
        kind, name, count = flat[at], flat[at + 1], int(flat[at + 4])
        at += 5
        width = 3 if kind == "IntervalTier" else 2
        if width == 3:
            tiers[name] = [(float(flat[k]), float(flat[k + 1]), flat[k + 2]) for k in range(at, at + 3 * count, 3)]
        at += width * count
    return tiers


def columns_of(content: bytes) -> list[tuple]:
    """tier, lists of xmin, xmax and label, corrupt (null) of the words and phones of one file.

    A broken file is one row with ``corrupt`` set, not the end of a scan.
    """
    try:
        tiers, found = parse_textgrid(content.decode("utf-8")), []
        for kind, names in (("words", WORD_TIERS), ("phones", PHONE_TIERS)):
            tier = next((tiers[n] for n in names if n in tiers), None)
            if not tier:
                raise ValueError(f"no tier of {kind}")
            found.append((kind, *map(list, zip(*tier, strict=True)), None))
        return found
    except Exception as e:
        return [(None, [None], [None], [None], f"{type(e).__name__}: {e}")]


def tiers_of(name: str, content: bytes) -> list[tuple]:
    """Rows of TIERS of one file."""
    found = columns_of(content)
    return [(name, tier, k if corrupt is None else None, a, b, label, corrupt) for tier, starts, ends, labels, corrupt in found for k, (a, b, label) in enumerate(zip(starts, ends, labels, strict=True))]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["filename", "tier", "pos", "xmin", "xmax", "label", "corrupt"]
    for batch in batches:
        rows = [r for path, content in zip(batch["path"], batch["content"], strict=True) for r in tiers_of(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], bytes(content))]
        yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32"})


def read_textgrids(spark: SparkSession, folder: str) -> DataFrame:
    """filename, tier (words or phones), pos, xmin, xmax, label, corrupt.

    A file that cannot be parsed or lacks a tier gives one row with ``corrupt`` set.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").load(folder)
    return files.select("path", "content").mapInPandas(_scan, TIERS)


def textgrid_words(tiers: DataFrame) -> DataFrame:
    """Word intervals with word_id from 1 over all of a file's word intervals."""
    words = tiers.where("tier = 'words'")
    return words.select((F.col("pos") + 1).alias("word_id"), "filename", F.col("xmin").alias("word_start"), F.col("xmax").alias("word_end"), F.trim("label").alias("text"))


def textgrid_phones(tiers: DataFrame) -> DataFrame:
    return tiers.where("tier = 'phones'").select("filename", F.col("xmin").alias("start"), F.col("xmax").alias("end"), F.trim("label").alias("phone"), "pos")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """shard, line_no, filename, start, end, token of lines of four fields, in file order.

    A file is read whole, for line order is defined within it only; files are spread over tasks.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("shard"), "value")
    lines = files.select("shard", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    part = F.split(F.trim("line"), r"\s+")
    return lines.where(F.size(part) == 4).select("shard", "line_no", part[0].alias("filename"), part[1].try_cast("double").alias("start"), part[2].try_cast("double").alias("end"), part[3].alias("token"))


def write_boundaries(words: DataFrame, path: str) -> None:
    words.withColumn("phones", F.array_join("phones", ",")).select("word_id", "filename", "word_start", "word_end", "text", "phones").write.mode("errorifexists").csv(path, header=True)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """An empty field of phones is null, which later steps count as silence."""
    table = spark.read.schema(schema.BOUNDARIES_CSV).csv(path, header=True)
    return table.withColumn("phones", F.when(F.col("phones") != "", F.split("phones", ",")))


def write_segments(segments: DataFrame, path: str) -> None:
    segments.select("seg_id", "filename", "start", "end").write.mode("errorifexists").csv(path, header=True)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SEGMENTS).csv(path, header=True)
