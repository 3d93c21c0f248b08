"""Command line: python -m wordloom.plans.cli COMMAND ...

Paths may be anything that Spark reads.  Feature files are .npy, one for each
word (named ``{filename}_{word_id}``) or, for ``cut``, one for each utterance.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import evaluate, features, intervals, lookup, pairwise, quantise
from wordloom.plans import flows
from wordloom.sources import alignments, partitions
from wordloom.sources.catalog import Catalog, RunKey, exists, fingerprint, made_from, note_made
from wordloom.sources.features import MODELS, as_frames, extract, read_features
from wordloom.sources.units import units_or_make


def make_boundaries(spark: SparkSession, language: str, folder: str, out: str) -> DataFrame:
    """Alignments to a table of words with phones; one that is there is read and left as it is."""
    if exists(spark, out):
        return alignments.read_boundaries(spark, out)
    if language == "english":
        tiers = alignments.read_textgrids(spark, folder)
        words = intervals.overlap_join(alignments.textgrid_words(tiers), alignments.textgrid_phones(tiers))
    elif language == "mandarin":
        lines = intervals.run_ordinals(alignments.read_lines(spark, f"{folder}/*.wrd"))
        words = lines.select("word_id", "filename", F.col("start").alias("word_start"), F.col("end").alias("word_end"), F.col("token").alias("text"))
        phones = alignments.read_lines(spark, f"{folder}/*.phn").select("filename", "start", "end", F.col("token").alias("phone"), F.col("line_no").alias("pos"))
        words = intervals.containment_join(words, phones)
    else:
        raise ValueError(f"unknown language {language!r}")
    alignments.write_boundaries(words, out)
    return alignments.read_boundaries(spark, out)


def make_segments(spark: SparkSession, boundaries: str, out: str) -> DataFrame:
    """Speech segments; a table that is there is read and left as it is."""
    if exists(spark, out):
        return alignments.read_segments(spark, out)
    alignments.write_segments(intervals.speech_segments(alignments.read_boundaries(spark, boundaries)), out)
    return alignments.read_segments(spark, out)


def cut(spark: SparkSession, feature_folder: str, boundaries: str, out: str, segments: str | None = None) -> DataFrame:
    """Word frames of utterance features; of segment features ({filename}_{seg_id}) if ``segments`` is given.

    A table that is there is read if it was made from as many words as the
    boundaries have, or has as many, else made again.  Words without frames have no
    rows, so the number is noted beside the table.
    """
    words = alignments.read_boundaries(spark, boundaries)
    n = words.count()
    if made_from(spark, out, n) or (exists(spark, out) and spark.read.parquet(out).select("node").distinct().count() == n):
        return spark.read.parquet(out)
    frames = as_frames(read_features(spark, feature_folder))
    if segments is None:
        found = intervals.cut_frames(words, frames.withColumnRenamed("node", "filename"))
    else:
        kept = frames.withColumn("filename", F.regexp_extract("node", "^(.*)_[^_]*$", 1)).withColumn("seg_id", F.regexp_extract("node", "_([0-9]+)$", 1).cast("int"))
        found = intervals.cut_segment_frames(words, alignments.read_segments(spark, segments), kept)
    found.select(F.concat_ws("_", "filename", "word_id").alias("node"), "filename", "word_id", "frame", "vec").write.mode("overwrite").parquet(out)
    note_made(spark, out, n)
    return spark.read.parquet(out)


def _nested(frames: DataFrame) -> DataFrame:
    return frames.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "vec"))), lambda x: x["vec"]).alias("frames"))


def _members(nodes: DataFrame, labels: DataFrame, frames: DataFrame) -> DataFrame:
    keys = frames.select("node", "filename", "word_id").distinct()
    return labels.join(nodes.select("node_id", "node"), "node_id").join(keys, "node").select("filename", "word_id", F.col("label").alias("cluster"))


class Corpus:
    """Frames and words of one run, and where its results are kept (nowhere without a catalog)."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a = spark, a
        self.frames, self.words = spark.read.parquet(a.frames), alignments.read_boundaries(spark, a.boundaries)
        self.nodes = lookup.node_ids(self.frames.select("node").distinct())
        self.store = Catalog(spark, a.catalog) if a.catalog else None

    def key(self, kind: str, *inputs: str, **settings: object) -> RunKey:
        """The key of what is made from the frames and from tables with the fingerprints ``inputs``."""
        return RunKey(kind, self.a.language, self.a.dataset or self.a.frames, self.a.model, self.a.layer, inputs="/".join((self.prints["frames"], *inputs)), **settings)

    @cached_property
    def prints(self) -> dict[str, str]:
        """Fingerprints of the inputs; nothing is read where nothing is kept."""
        tables = {"frames": self.frames, "words": self.words, "train": self.spark.read.parquet(self.a.train_frames) if self.a.train_frames else None}
        if self.a.units and exists(self.spark, self.a.units):
            tables["units"] = self.spark.read.parquet(self.a.units)
        found = {name: fingerprint(t) if self.store and t is not None else "" for name, t in tables.items()}
        return {"units": "", **found, "train": found["train"] or found["frames"]}

    def kept(self, key: RunKey, make: Callable[[], DataFrame]) -> DataFrame:
        return self.store.get_or_make(key, make) if self.store else make()

    def codebook(self, k: int) -> DataFrame:
        """Centres of the training split's frames, which are those at hand unless --train_frames names others."""
        dataset = quantise.train_split(self.a.language) if self.a.language else self.a.train_frames or self.a.frames
        key = RunKey("codebook", self.a.language, dataset, self.a.model, self.a.layer, k=k, inputs=f"{self.prints['train']}/{self.a.batch_files or 'all'}")
        train = self.spark.read.parquet(self.a.train_frames) if self.a.train_frames else self.frames
        if self.a.batch_files:
            return self.kept(key, lambda: quantise.train_codebook_by_batches(train.select("node", "frame", "vec"), k, self.a.batch_files))
        return self.kept(key, lambda: quantise.train_codebook(train.select("vec"), k))

    def units(self, k: int, lmbda: float) -> DataFrame:
        def make() -> DataFrame:
            return quantise.quantise(_nested(self.frames), self.codebook(k), lmbda, 10)

        if self.a.units:
            return units_or_make(self.spark, self.a.units, self.nodes.count(), make)
        return self.kept(self.key("units", *self._trained(), k=k, lmbda=lmbda), make)

    def _trained(self) -> tuple[str, ...]:
        """What units depend on besides the frames."""
        return self.prints["train"], str(self.a.batch_files or "all"), self.prints["units"]

    def edges(self, distance: str, threshold: float, k: int | None, lmbda: float | None) -> DataFrame:
        key = self.key("edges", *(self._trained() if distance == "ed" else ()), distance=distance, threshold=threshold, k=k, lmbda=lmbda)
        if distance == "ed" and (k is None or lmbda is None):
            raise ValueError("ed needs --k and --lmbda")
        makers = {"cos": self._cosine, "dtw": self._warped, "ed": lambda x: self._edits(x, k, lmbda)}
        if distance not in makers:
            raise ValueError(f"unknown distance {distance!r}")
        return self.kept(key, lambda: makers[distance](threshold))

    def _cosine(self, threshold: float) -> DataFrame:
        made = features.pool(features.project(self.frames.select("node", "vec")))
        return pairwise.build_graph("cos", threshold, embeddings=made.join(self.nodes, "node").select("node_id", "emb"))

    def _warped(self, threshold: float) -> DataFrame:
        made = _nested(features.project(self.frames.select("node", "frame", "vec"))).join(self.nodes, "node").select("node_id", "node", "frames")
        if self.store is None:
            return pairwise.build_graph("dtw", threshold, words=made)
        pairs = pairwise.kept_dtw_pairs(self.store.tiles(RunKey("pairs", self.a.language, "", self.a.model, self.a.layer, "dtw", threshold)), made, below=threshold)
        return pairwise.dtw_graph(pairs, threshold)

    def _edits(self, threshold: float, k: int, lmbda: float) -> DataFrame:
        return pairwise.build_graph("ed", threshold, units=self.units(k, lmbda).join(self.nodes, "node").select("node_id", "units"))

    def typed(self, phone_level: bool = False) -> DataFrame:
        """node, filename, word_id, text of the words with frames."""
        return flows.with_types(self.frames.select("node", "filename", "word_id").distinct(), self.words, phone_level)


def graph(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Similarity graph, communities as many as there are word types, partition file and scores.

    With a catalog, codebook, units, edges, DTW tiles and communities that an earlier run made are read.
    """
    began, c = time.time(), Corpus(spark, a)
    edges = c.edges(a.distance, a.threshold, a.k, a.lmbda)
    key = c.key("graph", c.prints["words"], *(c._trained() if a.distance == "ed" else ()), distance=a.distance, threshold=a.threshold, k=a.k, lmbda=a.lmbda, resolution=a.res)
    labels = flows.graph_clusters(c.nodes, edges, lookup.type_count(c.words).first()[0], a.res, catalog=c.store, key=key)
    return _finish(spark, _members(c.nodes, labels, c.frames), c.words, a.out, began)


def oracle_types(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Clustering that starts from the true types: communities or k-means."""
    began, c = time.time(), Corpus(spark, a)
    typed = c.typed(a.phone_level)
    if a.kind == "graph":
        units = c.units(a.k, a.lmbda).join(typed.select("node", "text"), "node")
        placed, labels = lookup.node_ids(units.select("node")), flows.graph_from_types(units, a.threshold)
    else:
        pooled = flows.pooled_by_word(c.frames.select("node", "vec"), 350)
        placed = lookup.node_ids(pooled.select("node"))
        labels = flows.kmeans_from_types(pooled, typed).join(placed, "node").select("node_id", "label")
    partitions.write_partition(_members(placed, labels, c.frames), c.words, a.out)
    return score(spark, a.out, c.words, a.phone_level).withColumn("seconds", F.lit(round(time.time() - began)))


def oracle_means(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Clustering of idealised representations; with --res, the partition that is there is only scored."""
    began, c = time.time(), Corpus(spark, a)
    if a.res is not None:
        return score(spark, a.out, c.words)
    typed = c.typed()
    if a.kind == "graph":
        units = c.units(a.k, a.lmbda).join(typed.select("node", "text"), "node")
        placed, labels = lookup.node_ids(units.select("node")), flows.graph_of_replicas(units, a.threshold)
    else:
        placed = lookup.node_ids(typed.select("node"))
        pooled = flows.pooled_by_word(c.frames.select("node", "vec"))
        labels = flows.kmeans_of_noise(pooled, typed.select("node", "text")).join(placed, "node").select("node_id", "label")
    return _finish(spark, _members(placed, labels, c.frames), c.words, a.out, began)


def centroid(spark: SparkSession, frames_path: str, boundaries: str, out: str, kind: str, no_pca: bool) -> DataFrame:
    """Pooled embeddings clustered by kmeans, birch or agg, partition file and scores."""
    began = time.time()
    frames, words = spark.read.parquet(frames_path), alignments.read_boundaries(spark, boundaries)
    emb = features.pool(features.project(frames.select("node", "vec"), no_pca=no_pca))
    labels = flows.centroid_clusters(emb, kind, lookup.type_count(words).first()[0])
    nodes = lookup.node_ids(emb.select("node"))
    members = _members(nodes, labels.join(nodes, "node").select("node_id", "label"), frames)
    return _finish(spark, members, words, out, began)


def _finish(spark: SparkSession, members: DataFrame, words: DataFrame, out: str, began: float) -> DataFrame:
    partitions.write_partition(members, words, out)
    return score(spark, out, words).withColumn("seconds", F.lit(round(time.time() - began)))


def score(spark: SparkSession, partition: str, words: DataFrame, phone_level: bool = False) -> DataFrame:
    found = partitions.read_partition(spark, partition)
    fragments = found.select(F.concat_ws("|", "cluster", "filename", "start", "end").alias("frag_id"), "filename", "start", "end", "cluster").dropDuplicates(["frag_id"])
    gold, _ = intervals.gold_intervals(words)
    matched = intervals.match_fragments(fragments, gold)
    return evaluate.report(matched, words, phone_level)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wordloom")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        return p

    def add_corpus(name: str, kinds: str, choices: list[str], **defaults: object) -> argparse.ArgumentParser:
        p = add(name, "frames", "boundaries", "out")
        p.add_argument(kinds, choices=choices)
        p.add_argument("--k", type=int, default=defaults.get("k"))
        p.add_argument("--lmbda", type=float, default=defaults.get("lmbda"))
        p.add_argument("--catalog", help="folder of results that later runs read")
        p.add_argument("--units", help="folder of unit sequences, made if they are not there")
        p.add_argument("--train_frames", help="frames of the split that trains the codebook")
        p.add_argument("--batch_files", type=int, help="train the codebook by batches of so many files")
        for key in ("language", "dataset", "model", "layer"):
            p.add_argument(f"--{key}", default="")
        return p

    add("boundaries", "language", "folder", "out")
    add("vad", "boundaries", "out")
    e = add("extract", "language", "audio", "out")
    e.add_argument("model", choices=MODELS)
    e.add_argument("layer", type=int)
    e.add_argument("--encoder", required=True, help="module:function that loads a model by its name")
    e.add_argument("--segments")
    e.add_argument("--suffix")
    e.add_argument("--for_kmeans", action="store_true", help="only so many hours as train a codebook")
    add("cut", "features", "boundaries", "out").add_argument("--segments")
    g = add_corpus("graph", "distance", ["ed", "cos", "dtw"])
    g.add_argument("threshold", type=float)
    g.add_argument("--res", type=float, default=0.3)
    c = add("avg", "frames", "boundaries", "out")
    c.add_argument("kind", choices=["kmeans", "agg", "birch"])
    c.add_argument("--no_pca", action="store_true")
    add("evaluate", "partition", "boundaries").add_argument("--phone_level", action="store_true")
    for name in ("oracle_types", "oracle_means"):
        o = add_corpus(name, "kind", ["graph", "kmeans"], k=500, lmbda=100.0)
        o.add_argument("--threshold", type=float, default=0.65)
        if name == "oracle_types":
            o.add_argument("--phone_level", action="store_true", help="types are phone sequences")
        else:
            o.add_argument("--res", type=float, help="score the partition that is there")
    return top


def run(spark: SparkSession, argv: list[str] | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    if a.command == "boundaries":
        return make_boundaries(spark, a.language, a.folder, a.out)
    if a.command == "vad":
        return make_segments(spark, a.boundaries, a.out)
    if a.command == "extract":
        segments = alignments.read_segments(spark, a.segments) if a.segments else None
        return extract(spark, a.language, a.audio, a.out, a.encoder, a.model, a.layer, segments, a.for_kmeans, suffix=a.suffix)
    if a.command == "cut":
        return cut(spark, a.features, a.boundaries, a.out, a.segments)
    if a.command == "avg":
        return centroid(spark, a.frames, a.boundaries, a.out, a.kind, a.no_pca)
    if a.command == "evaluate":
        return score(spark, a.partition, alignments.read_boundaries(spark, a.boundaries), a.phone_level)
    return {"graph": graph, "oracle_types": oracle_types, "oracle_means": oracle_means}[a.command](spark, a)


if __name__ == "__main__":
    run(SparkSession.builder.appName("wordloom").getOrCreate()).show(50, False)
