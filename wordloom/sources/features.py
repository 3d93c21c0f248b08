"""Audio listings and feature matrices kept as .npy files."""

from __future__ import annotations

import importlib
import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.sources.catalog import exists, made_from, note_made
from wordloom.sources.flac import read_flac

#: The audio suffix of each language.
SUFFIX = {"english": "flac", "mandarin": "wav"}
#: The encoders that a caller may plug in.
MODELS = ("wavlm-large", "hubert-large", "hubert-soft", "mhubert", "chinese-hubert")
SAMPLE_RATE, BUDGET_HOURS = 16_000, 50.0
#: The model that gives units, whatever the layer.
UNIT_MODEL = "hubert-soft"


def list_audio(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """path, length (bytes); empty for a language that is not known."""
    suffix = SUFFIX.get(language, "none-such")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(folder)
    return files.select("path", "length")


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, frames = [], []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            matrix = np.atleast_2d(np.load(io.BytesIO(bytes(content)), allow_pickle=False)).astype(np.float64)
            nodes.append(path.rsplit("/", 1)[-1].removesuffix(".npy"))
            frames.append(matrix.tolist())
        yield pd.DataFrame({"node": nodes, "frames": frames})


def read_npy(spark: SparkSession, folder: str) -> DataFrame:
    """node (the file's stem), frames array<array<double>>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(folder)
    return files.select("path", "content").mapInPandas(_load, "node string, frames array<array<double>>")


def as_frames(words: DataFrame) -> DataFrame:
    """One row for each frame: node, frame, vec."""
    return words.select("node", F.posexplode("frames").alias("frame", "vec"))


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """node, frames of a folder that :func:`write_features` made, or of .npy files."""
    return spark.read.parquet(folder) if exists(spark, f"{folder}/_SUCCESS") else read_npy(spark, folder)


def write_features(features: DataFrame, folder: str) -> None:
    features.select("node", "frames").write.mode("overwrite").parquet(folder)


def features_or_make(spark: SparkSession, folder: str, expected: int, make: Callable[[], None]) -> DataFrame:
    """Features of a folder; made first if there are fewer than ``expected`` and it is not noted that they were made from so many.

    Utterances or segments without samples have no features, so these may stay fewer.
    """
    if not made_from(spark, folder, expected) and (not exists(spark, folder) or read_features(spark, folder).count() < expected):
        make()
        note_made(spark, folder, expected)
    return read_features(spark, folder)


def read_wave(content: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1 of the mean of all channels, and samples a second, of PCM in a WAV container."""
    with wave.open(io.BytesIO(content)) as f:
        width, raw = f.getsampwidth(), f.readframes(f.getnframes())
        if width == 3:
            padded = np.zeros((len(raw) // 3, 4), np.uint8)
            padded[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            x = padded.view("<i4").ravel() / 2.0**31
        elif width == 1:
            x = np.frombuffer(raw, np.uint8) / 128.0 - 1
        else:
            x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
        return x.reshape(-1, f.getnchannels()).mean(axis=1).astype(np.float32), f.getframerate()


def read_audio(content: bytes) -> tuple[np.ndarray, int]:
    """:func:`read_wave`, or for FLAC files :func:`~wordloom.sources.flac.read_flac`, as the first bytes tell."""
    return read_wave(content) if content[:4] == b"RIFF" else read_flac(content)


def resample(samples: np.ndarray, rate: int, wanted: int = SAMPLE_RATE, lobes: int = 16) -> np.ndarray:
    """Samples at another rate, by a sinc under a Hann window of ``lobes`` zero crossings a side."""
    if rate == wanted or not len(samples):
        return samples.astype(np.float32)
    cut = min(1.0, wanted / rate)
    reach = int(np.ceil(lobes / cut))
    padded = np.concatenate([np.zeros(reach), samples, np.zeros(reach + 1)])
    out = np.zeros(int(np.ceil(len(samples) * wanted / rate)), np.float32)
    for first in range(0, len(out), 1 << 14):
        at = np.arange(first, min(first + (1 << 14), len(out))) * (rate / wanted)
        base = np.floor(at).astype(np.int64)
        taps = np.arange(-reach + 1, reach + 1)
        away = at[:, None] - base[:, None] - taps[None, :]
        weight = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / reach, -1, 1)))
        out[first : first + len(at)] = (padded[base[:, None] + taps[None, :] + reach] * weight).sum(axis=1)
    return out


#: An encoder takes samples at SAMPLE_RATE and gives the hidden layers, each frames x dimensions, or one matrix of units.
Encoder = Callable[[np.ndarray], list[np.ndarray] | np.ndarray]


@lru_cache(maxsize=4)
def load_encoder(spec: str, model: str) -> Encoder:
    """``module:function`` called with the model's name, once for each worker."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)(model)


def _hidden(encoder: Encoder, samples: np.ndarray, model: str, layer: int) -> np.ndarray:
    """The wanted layer, counted from 1; a model of units has only one."""
    out = encoder(samples)
    return np.asarray(out if model == UNIT_MODEL else out[int(layer) - 1], np.float64)


def encode(audio: DataFrame, spec: str, model: str, layer: int, decode: Callable[[bytes], tuple[np.ndarray, int]] = read_audio) -> DataFrame:
    """node, frames of audio (node, content): decoded, brought to SAMPLE_RATE, encoded; one layer kept.

    If ``audio`` has spans (array<struct<seg_id, start, end>> in seconds), each is
    a row of its own, called ``{node}_{seg_id}``; an empty one is left out.  The
    speech models are not part of this package: ``spec`` names a function that
    loads one.  WAV and FLAC are decoded; others need a ``decode`` of the caller's.
    """
    if model not in MODELS:
        raise ValueError(f"no model {model!r}; there are {', '.join(MODELS)}")
    by_segment = "spans" in audio.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(spec, model)
        for batch in batches:
            nodes, frames = [], []
            for k, (node, content) in enumerate(zip(batch["node"], batch["content"], strict=True)):
                samples = resample(*decode(bytes(content)))
                spans = [(f"{node}_{s['seg_id']}", int(s["start"] * SAMPLE_RATE), int(s["end"] * SAMPLE_RATE)) for s in batch["spans"][k]] if by_segment else [(node, 0, len(samples))]
                for name, first, end in spans:
                    if len(samples[first:end]):
                        nodes.append(name)
                        frames.append(_hidden(encoder, samples[first:end], model, layer).tolist())
            yield pd.DataFrame({"node": nodes, "frames": frames})

    columns = ["node", "content", *(["spans"] if by_segment else [])]
    return audio.select(*columns).mapInPandas(run, "node string, frames array<array<double>>")


def hours_of(audio: DataFrame, decode: Callable[[bytes], tuple[np.ndarray, int]] = read_audio) -> DataFrame:
    """name, hours of audio (node, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = [(len(x) / rate / 3600) for x, rate in (decode(bytes(c)) for c in batch["content"])]
            yield pd.DataFrame({"name": batch["node"], "hours": lengths})

    return audio.select("node", "content").mapInPandas(run, "name string, hours double")


def extract(
    spark: SparkSession, language: str, folder: str, out: str, spec: str, model: str, layer: int, segments: DataFrame | None = None, for_kmeans: bool = False,
    decode: Callable[[bytes], tuple[np.ndarray, int]] = read_audio, suffix: str | None = None,
) -> DataFrame:
    """Features of all audio files of a folder, kept in ``out``: of whole utterances of english, of speech segments of mandarin.

    They are made only if ``out`` holds fewer than there are files (segments).
    With ``for_kmeans``, files go in order of name until the sum of hours is over
    the budget.  ``suffix`` replaces the language's.
    """
    if language not in SUFFIX:
        raise ValueError(f"no features for language {language!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix or SUFFIX[language]}").load(folder)
    audio = files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("node"), "content")
    if language == "mandarin":
        if segments is None:
            raise ValueError("mandarin needs speech segments")
        spans = segments.groupBy(F.col("filename").alias("node")).agg(F.array_sort(F.collect_list(F.struct("seg_id", "start", "end"))).alias("spans"))
        audio = audio.join(spans, "node")
        expected = segments.count()
    else:
        if for_kmeans:
            chosen = within_budget(hours_of(audio, decode)).select(F.col("name").alias("node"))
            audio = audio.join(chosen, "node", "left_semi")
        expected = audio.count()
    return features_or_make(spark, out, expected, lambda: write_features(encode(audio, spec, model, layer, decode), out))


def within_budget(files: DataFrame, hours: float = BUDGET_HOURS, by: str | None = None) -> DataFrame:
    """Files, in order of name, until the first that takes the sum of hours over the budget.

    ``files``: name, hours.  Running sums are made over groups of names by their
    first characters (``by``), then over the groups, so no task orders all files.
    """
    group = F.col(by) if by else F.substring("name", 1, 3)
    keyed = files.withColumn("g", group)
    sums = keyed.groupBy("g").agg(F.sum("hours").alias("all"))
    before = sums.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    own = Window.partitionBy("g").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.join(before.select("g", "before"), "g").withColumn("running", F.col("before") + F.sum("hours").over(own))
    return running.where(F.col("running") <= hours).select("name", "hours", "running")
