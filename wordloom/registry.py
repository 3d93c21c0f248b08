"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom import fixtures as fx
from wordloom.functions import phones as ph
from wordloom.functions.vectors import dot, pair_of_index
from wordloom.operators import clustering, communities, evaluate, features, intervals, lookup, pairwise, quantise
from wordloom.plans import flows
from wordloom.sources import datasource
from wordloom.sources.catalog import materialise, shared_folder
from wordloom.sources.features import within_budget
from wordloom.sources.partitions import parse_partition, partition_lines, partition_texts
from wordloom.streaming.segments import session_segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Thresholds that suit the generated vectors.
COSINE, EDIT, DTW = 0.7, 0.4, 0.42
LAMBDA, NEIGHBOURS = 0.4, 4

# --- SQL twins of the fixtures -------------------------------------------------

W = """w AS (
  SELECT filename, word_id, text, start_cs, dur, start_cs / 100.0 AS word_start, (start_cs + dur) / 100.0 AS word_end
  FROM (SELECT 'u' || user_id AS filename, event_type AS text, row_number() OVER o - 1 AS word_id, CAST(round(value * 100) AS BIGINT) AS dur,
          CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT) + CASE WHEN event_type = 'error' THEN 100 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_cs
        FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
NOISE = "CASE k % 3 WHEN 0 THEN upper(c) || '1' WHEN 2 THEN c || '0' ELSE c END"
RAW = f"""chars AS (SELECT filename, word_id, text, start_cs, dur, unnest(range(length(text))) AS k FROM w),
  noisy AS (SELECT *, substr(text, CAST(k + 1 AS INT), 1) AS c, {NOISE} AS phone FROM (SELECT *, substr(text, CAST(k + 1 AS INT), 1) AS c FROM chars)),
  raw AS (SELECT filename, word_id, list_concat(['sil'], list(phone ORDER BY k), ['', 'SIL', '1']) AS raw FROM noisy GROUP BY ALL)"""
P = f"""chars AS (SELECT filename, word_id, text, start_cs, dur, unnest(range(length(text))) AS k FROM w),
  p AS (SELECT filename, (start_cs + dur * k // length(text)) / 100.0 AS p_start, (start_cs + dur * (k + 1) // length(text)) / 100.0 AS p_end, {NOISE} AS phone, word_id * 16 + k AS pos
        FROM (SELECT *, substr(text, CAST(k + 1 AS INT), 1) AS c FROM chars)
        UNION ALL SELECT filename, (start_cs + dur) / 100.0, (start_cs + dur + 100) / 100.0, 'sil', word_id * 16 + 15 FROM w WHERE text = 'error')"""
CLEAN = "list_transform(list_filter({0}, lambda x: x NOT IN ('sp', 'sil', 'spn', '')), lambda x: lower(regexp_replace(x, '\\d+', '', 'g')))"
FRAG = """d AS (SELECT filename || '_' || word_id AS frag_id, filename, (start_cs + (word_id % 5 - 2) * 2) / 100.0 AS d_start, (start_cs + dur + (word_id % 5 - 2) * 2) / 100.0 AS d_end,
        CAST((word_id % 3) * 10 + length(text) AS BIGINT) AS cluster FROM w)"""
MATCH = FRAG + """,
  cand AS (SELECT frag_id, d.filename, cluster, word_start AS gold_start, word_end AS gold_end, text, round(word_end - word_start, 2) AS gd,
             round(least(word_end, d_end) - greatest(word_start, d_start), 2) AS od, word_start <= d_start AND word_end >= d_end AS inside
           FROM d JOIN w ON d.filename = w.filename AND word_start < d_end AND d_start < word_end),
  m AS (SELECT * EXCLUDE (gd, od, inside) FROM cand
        WHERE inside OR (gd >= 0.06 - 1e-9 AND od >= 0.03 - 1e-9) OR (gd < 0.06 - 1e-9 AND CASE WHEN gd > 0 THEN od / gd ELSE 0 END > 0.5)
        QUALIFY row_number() OVER (PARTITION BY frag_id ORDER BY gold_start, gold_end, text) = 1)"""
FR = """fr AS (SELECT 'L' || label AS filename, label, 3 + label % 3 AS span, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""
WF = FR + """,
  wf AS (SELECT filename || '_' || (frame // span) AS node, filename, frame // span AS word_id, frame % span AS frame, vec FROM fr)"""
STD = WF + """,
  ex AS (SELECT node, frame, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM wf),
  st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM ex GROUP BY i),
  sx AS (SELECT node, frame, i, (x - m) / s AS x FROM ex JOIN st USING (i)),
  po AS (SELECT node, i, avg(x) AS x FROM sx GROUP BY node, i),
  un AS (SELECT node, i, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS x FROM po),
  ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_id FROM (SELECT DISTINCT node FROM wf)),
  emb AS (SELECT node, node_id, list(x ORDER BY i) AS emb FROM un JOIN ids USING (node) GROUP BY ALL)"""
COS = STD + f""",
  edges AS (SELECT a.node_id AS i, b.node_id AS j, list_dot_product(a.emb, b.emb) AS w FROM emb a JOIN emb b ON a.node_id < b.node_id AND list_dot_product(a.emb, b.emb) > 1 - {COSINE})"""
CODES = WF + """,
  book AS (SELECT label AS code, list(x ORDER BY i) AS cvec FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM fr) GROUP BY ALL) GROUP BY label),
  dist AS (SELECT node, frame, code, list_sum(list_transform(list_zip(vec, cvec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM wf CROSS JOIN book),
  near AS (SELECT *, row_number() OVER (PARTITION BY node, frame ORDER BY d, code) AS r FROM dist)"""
COMPONENTS = """both_ways AS (SELECT i AS a, j AS b FROM edges UNION ALL SELECT j, i FROM edges),
  reach AS (SELECT node_id AS a, node_id AS b FROM ids UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)"""


def _units(lmbda: float, n: int) -> str:
    """CTEs up to ``u`` (node, units): the shortest path over at most five frames."""
    steps = [CODES, f"c0 AS (SELECT node, frame, code, d FROM near WHERE r <= {n})", "v0 AS (SELECT node, code, d AS cost, [code] AS units FROM c0 WHERE frame = 0)"]
    for t in range(1, 5):
        steps.append(
            f"v{t} AS (SELECT c.node, c.code, min(v.cost - CASE WHEN v.code = c.code THEN {lmbda} ELSE 0 END) + any_value(c.d) AS cost, "
            f"list_append(arg_min(v.units, v.cost - CASE WHEN v.code = c.code THEN {lmbda} ELSE 0 END), c.code) AS units "
            f"FROM c0 c JOIN v{t - 1} v ON c.node = v.node WHERE c.frame = {t} GROUP BY c.node, c.code)"
        )
    every = " UNION ALL ".join(f"SELECT node, cost, units FROM v{t}" for t in range(5))
    # only the paths as long as the word count
    steps.append("lens AS (SELECT node, count(*) AS n FROM wf GROUP BY node), u AS (SELECT node, arg_min(units, cost) AS units FROM (" + every + ") x JOIN lens USING (node) WHERE len(units) = lens.n GROUP BY node)")
    return ",\n  ".join(steps)


def _dtw_sql() -> str:
    """CTEs up to ``dp`` (i, j, dist): warping paths over at most five by five frames, cell by cell."""
    cells = []
    for a in range(1, 6):
        for b in range(1, 6):
            before = [f"t{x}{y}" for x, y in ((a - 1, b), (a, b - 1), (a - 1, b - 1)) if x and y]
            come = "" if not before else f" + least({', '.join(before)})" if len(before) > 1 else f" + {before[0]}"
            cells.append(f"1 - list_cosine_similarity(a[{a}], b[{b}]){come} AS t{a}{b}")
    table = "[" + ", ".join("[" + ", ".join(f"t{a}{b}" for b in range(1, 6)) + "]" for a in range(1, 6)) + "]"
    return WF + f""",
  nst AS (SELECT row_number() OVER (ORDER BY node) - 1 AS id, list(vec ORDER BY frame) AS f FROM wf GROUP BY node),
  pr AS (SELECT x.id AS i, y.id AS j, x.f AS a, y.f AS b FROM nst x JOIN nst y ON x.id < y.id),
  cells AS (SELECT i, j, len(a) AS n, len(b) AS m, {", ".join(cells)} FROM pr),
  dp AS (SELECT i, j, {table}[n][m] / (n + m) AS dist FROM cells)"""


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- alignments ------------------------------------------------------------------


@register(f"WITH {W}, {RAW} SELECT filename, word_id, array_to_string({CLEAN.format('raw')}, ',') AS phones FROM raw")
def phone_clean_en(spark, sf_dir):
    raw = fx.raw_phones(fx.words(spark, sf_dir))
    return raw.select("filename", "word_id", F.array_join(ph.clean_phones(F.col("raw")), ",").alias("phones"))


@register(f"WITH {W}, {RAW} SELECT filename, word_id, array_to_string(list_filter(raw, lambda x: x NOT IN ('sp', 'sil', 'spn', '')), ',') AS phones FROM raw")
def phone_clean_zh(spark, sf_dir):
    raw = fx.raw_phones(fx.words(spark, sf_dir))
    return raw.select("filename", "word_id", F.array_join(ph.clean_phones(F.col("raw"), mandarin=True), ",").alias("phones"))


@register(f"WITH {W}, {RAW} SELECT filename, word_id, array_to_string({CLEAN.format('list_transform(raw, lambda x: trim(x))')}, ',') AS phones FROM raw")
def phone_clean_analysis(spark, sf_dir):
    raw = fx.raw_phones(fx.words(spark, sf_dir))
    return raw.select("filename", "word_id", F.array_join(ph.clean_phones_stripped(F.col("raw")), ",").alias("phones"))


@register(f"""WITH {W}, {P}, j AS (SELECT w.filename, word_id, list(phone ORDER BY pos) AS raw FROM w JOIN p ON p.filename = w.filename AND p_end > word_start AND p_start < word_end GROUP BY ALL)
  SELECT filename, word_id, array_to_string({CLEAN.format('raw')}, ',') AS phones FROM j WHERE len({CLEAN.format('raw')}) > 0""")
def overlap_join_words_phones(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    joined = intervals.overlap_join(w, fx.phones(w))
    return joined.select("filename", "word_id", F.array_join("phones", ",").alias("phones"))


@register(f"SELECT * FROM ({ORACLES['overlap_join_words_phones']}) WHERE word_id % 7 <> 0 AND word_id % 11 <> 0")
def merge_overlap_words_phones(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    text = F.when(F.col("word_id") % 7 == 0, "<unk>").when(F.col("word_id") % 11 == 0, "").otherwise(F.col("text"))
    joined = intervals.merge_overlap(w.withColumn("text", text), fx.phones(w))
    return joined.select("filename", "word_id", F.array_join("phones", ",").alias("phones"))


@register(f"WITH {W} SELECT filename, count(*) AS n, (SELECT count(*) FROM w WHERE word_id % 5 <> 0) AS kept FROM w WHERE word_id % 5 <> 0 GROUP BY filename")
def gold_intervals(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    gold, kept = intervals.gold_intervals(w.withColumn("phones", F.when(F.col("word_id") % 5 != 0, F.col("phones"))))
    return gold.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(kept).cast("long"))


@register(f"""WITH {W}, {P}, j AS (SELECT w.filename, word_id, list(phone ORDER BY pos) FILTER (phone IS NOT NULL) AS raw FROM w LEFT JOIN p ON p.filename = w.filename AND p_start >= word_start AND p_end <= word_end GROUP BY ALL)
  SELECT filename, word_id, coalesce(array_to_string(list_filter(raw, lambda x: x NOT IN ('sp', 'sil', 'spn', '')), ','), '') AS phones FROM j""")
def containment_join_words_phones(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    joined = intervals.containment_join(w, fx.phones(w))
    return joined.select("filename", "word_id", F.array_join("phones", ",").alias("phones"))


@register(f"WITH {W}, {P}, n AS (SELECT filename, p_start AS start, phone AS text, row_number() OVER (PARTITION BY filename ORDER BY p_start, p_end) AS word_id FROM p WHERE p_end > p_start) SELECT * FROM n WHERE lower(text) NOT IN ('', 'sil', 'sp', 'spn')")
def word_ordinal_files(spark, sf_dir):
    p = fx.phones(fx.words(spark, sf_dir)).where(F.col("end") > F.col("start")).select("filename", "start", "end", F.col("phone").alias("text"))
    return intervals.file_ordinals(p).select("filename", "start", "text", "word_id")


@register("""WITH l AS (SELECT CAST(user_id % 8 AS BIGINT) AS shard, event_id AS line_no, event_type AS filename FROM events),
  c AS (SELECT *, CASE WHEN lag(filename) OVER (PARTITION BY shard ORDER BY line_no) = filename THEN 0 ELSE 1 END AS new FROM l),
  r AS (SELECT *, sum(new) OVER (PARTITION BY shard ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT line_no, filename, row_number() OVER (PARTITION BY shard, run ORDER BY line_no) - 1 AS word_id FROM r""")
def word_ordinal_runs(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("shard"), F.col("event_id").alias("line_no"), F.col("event_type").alias("filename"))
    return intervals.run_ordinals(lines).select("line_no", "filename", "word_id")


ISLANDS = f"""WITH {W}, g AS (SELECT *, CASE WHEN abs(lag(word_end) OVER (PARTITION BY filename ORDER BY word_id) - word_start) >= 1e-4 THEN 1 ELSE 0 END AS new FROM w),
  s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY filename ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS INT) AS seg_id FROM g)
  SELECT filename, seg_id, arg_min(word_start, word_id) AS "start", arg_max(word_end, word_id) AS "end" FROM s GROUP BY filename, seg_id"""


@register(ISLANDS)
def vad_islands(spark, sf_dir):
    return intervals.speech_segments(fx.words(spark, sf_dir))


@register(f"""WITH {W}, s AS (SELECT filename, start_cs, dur FROM w), b AS (SELECT *, CASE WHEN start_cs - lag(start_cs + dur) OVER (PARTITION BY filename ORDER BY start_cs) >= 50 THEN 1 ELSE 0 END AS new FROM s),
  r AS (SELECT *, sum(new) OVER (PARTITION BY filename ORDER BY start_cs ROWS UNBOUNDED PRECEDING) AS run FROM b)
  SELECT filename, min(start_cs) / 100.0 AS "start", max(start_cs + dur) / 100.0 AS "end", count(*) AS n_words FROM r GROUP BY filename, run""")
def speech_sessions(spark, sf_dir):
    return session_segments(fx.words(spark, sf_dir))


@register(f"""WITH {FR}, ws AS (SELECT DISTINCT filename, span, frame // span AS word_id FROM fr),
  b AS (SELECT filename, word_id, CAST(trunc(word_id * span / 50.0 * 50) AS INT) AS f0, CAST(trunc((word_id + 1) * span / 50.0 * 50) AS INT) AS f1 FROM ws)
  SELECT b.filename, CAST(word_id AS INT) AS word_id, count(*) AS n_frames, round(sum(vec[1]), 6) AS first_sum FROM b JOIN fr ON fr.filename = b.filename AND frame >= f0 AND frame < f1 GROUP BY ALL""")
def cut_frames_english(spark, sf_dir):
    f = fx.frames(spark, sf_dir)
    cut = intervals.cut_frames(fx.frame_words(f), f.select("filename", F.col("frame").cast("int").alias("frame"), "vec"))
    return cut.groupBy("filename", "word_id").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.sum(F.get("vec", F.lit(0))), 6).alias("first_sum"))


@register(f"""WITH {FR}, ws AS (SELECT DISTINCT filename, span, frame // span AS word_id FROM fr),
  b AS (SELECT filename, word_id, word_id * span / 50.0 AS a, (word_id + 1) * span / 50.0 AS z FROM ws),
  sg AS (SELECT DISTINCT filename, frame // 40 AS seg_id, (frame // 40) * 40 / 50.0 AS s0, (frame // 40 + 1) * 40 / 50.0 AS s1 FROM fr),
  c AS (SELECT b.filename, word_id, seg_id, CAST(trunc((a - s0) * 50) AS INT) AS f0, CAST(trunc((z - s0) * 50) AS INT) AS f1 FROM b JOIN sg ON sg.filename = b.filename AND a >= s0 AND z <= s1)
  SELECT c.filename, CAST(word_id AS INT) AS word_id, count(*) AS n_frames, round(sum(vec[1]), 6) AS first_sum
  FROM c JOIN fr ON fr.filename = c.filename AND fr.frame // 40 = seg_id AND frame % 40 >= f0 AND frame % 40 < f1 GROUP BY ALL""")
def cut_frames_segments(spark, sf_dir):
    f = fx.frames(spark, sf_dir)
    seg = F.floor(F.col("frame") / 40)
    segments = f.select("filename", seg.alias("seg_id")).distinct().select("filename", "seg_id", (F.col("seg_id") * 40 / F.lit(50.0)).alias("start"), ((F.col("seg_id") + 1) * 40 / F.lit(50.0)).alias("end"))
    stored = f.select("filename", seg.alias("seg_id"), (F.col("frame") % 40).cast("int").alias("frame"), "vec")
    cut = intervals.cut_segment_frames(fx.frame_words(f), segments, stored)
    return cut.groupBy("filename", "word_id").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.sum(F.get("vec", F.lit(0))), 6).alias("first_sum"))


def _matched(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    return w, fx.fragments(w), intervals.match_fragments(fx.fragments(w), w.select("filename", "word_start", "word_end", "text", "phones"))


@register(f"WITH {W}, {MATCH} SELECT * FROM m")
def boundary_match(spark, sf_dir):
    return _matched(spark, sf_dir)[2].drop("phones")


@register(f"WITH {W}, {MATCH} SELECT frag_id, cluster FROM d WHERE frag_id NOT IN (SELECT frag_id FROM m)")
def unmatched_fragments(spark, sf_dir):
    _, d, m = _matched(spark, sf_dir)
    return intervals.unmatched(d, m).select("frag_id", "cluster")


# --- lookups and counts ------------------------------------------------------------

TOKENS = "tokens AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents))"


def _tokens(spark, sf_dir):
    parts = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("pos", "token"))


@register(f"WITH {TOKENS}, f AS (SELECT token, min(doc_id * 1000000 + pos) AS first FROM tokens GROUP BY token) SELECT token, row_number() OVER (ORDER BY first) - 1 AS code FROM f")
def first_appearance_codes(spark, sf_dir):
    tokens = _tokens(spark, sf_dir).select("token", F.struct("doc_id", "pos").alias("place"))
    return lookup.first_appearance_codes(tokens, "token", "place")


@register(f"WITH {TOKENS} SELECT count(DISTINCT token) + max(CASE WHEN token IS NULL THEN 1 ELSE 0 END) AS n_types FROM tokens")
def type_count(spark, sf_dir):
    return lookup.type_count(_tokens(spark, sf_dir), "token")


@register(f"WITH {W} SELECT regexp_replace(text, '(.)', '\\1-', 'g')[:-2] AS phones, count(*) AS n FROM w GROUP BY text")
def gold_partition(spark, sf_dir):
    return lookup.gold_partition(fx.words(spark, sf_dir)).select("phones", "n")


@register(f"WITH {W} SELECT count(text) AS n_words, count(DISTINCT text) AS n_types FROM w")
def phone_type_counts(spark, sf_dir):
    return lookup.phone_type_counts(fx.words(spark, sf_dir))


@register(f"""WITH {W}, top AS (SELECT text, row_number() OVER (ORDER BY min(filename || '_' || word_id)) - 1 AS code FROM w GROUP BY text),
  n AS (SELECT filename, word_id, row_number() OVER (ORDER BY filename || '_' || word_id) - 1 AS node_id FROM (SELECT filename, word_id FROM w UNION ALL SELECT 'none', 0))
  SELECT n.node_id, coalesce(code, (SELECT max(code) FROM top) + 1 + n.node_id) AS code FROM n LEFT JOIN w USING (filename, word_id) LEFT JOIN top USING (text)""")
def true_types(spark, sf_dir):
    w = fx.words(spark, sf_dir).withColumn("node", F.concat_ws("_", "filename", "word_id"))
    none = spark.createDataFrame([("none", 0, "none_0")], "filename string, word_id int, node string")
    nodes = lookup.node_ids(w.select("filename", "word_id", "node").unionByName(none))
    return lookup.true_types(nodes, w, lookup.first_appearance_codes(w, "text", "node"))


@register(f"WITH {W} SELECT event_id, filename, word_id, text FROM (SELECT event_id, 'u' || user_id AS filename, CAST(event_id % 100 AS INT) AS word_id FROM events) e LEFT JOIN w USING (filename, word_id)")
def word_lookup(spark, sf_dir):
    members = fx.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("filename"), (F.col("event_id") % 100).cast("int").alias("word_id"))
    return lookup.lookup_words(members, fx.words(spark, sf_dir)).select("event_id", "filename", "word_id", "text")


@register("SELECT k, i, j FROM (SELECT row_number() OVER (ORDER BY a.r_regionkey, b.r_regionkey) - 1 AS k, CAST(a.r_regionkey AS BIGINT) AS i, CAST(b.r_regionkey AS BIGINT) AS j FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey)")
def pair_index(spark, sf_dir):
    n = fx.table(spark, sf_dir, "region").count()
    return spark.range(n * (n - 1) // 2).select(F.col("id").alias("k"), pair_of_index(F.col("id"), F.lit(n)).alias("p")).select("k", "p.i", "p.j")


@register("""WITH c AS (SELECT event_type AS label, user_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  l AS (SELECT node_id, label FROM c WHERE r = 1), h AS (SELECT label, row_number() OVER (ORDER BY min(node_id)) - 1 AS cluster FROM l GROUP BY label) SELECT cluster, node_id FROM l JOIN h USING (label)""")
def clusters_by_first_member(spark, sf_dir):
    first = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node_id")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("label"))
    return lookup.clusters_by_first_member(first)


@register("""WITH o AS (SELECT c_mktsegment || '-' || c_custkey AS name, round(c_acctbal / 1000.0, 2) AS hours FROM customer WHERE c_acctbal > 0),
  r AS (SELECT name, CAST(round(hours * 100) AS BIGINT) AS hours, sum(CAST(round(hours * 100) AS BIGINT)) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS running FROM o)
  SELECT name, CAST(hours AS DOUBLE) AS hours, CAST(running AS DOUBLE) AS running FROM r WHERE running <= 5000""")
def audio_hours_cap(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    files = c.select(F.concat_ws("-", "c_mktsegment", "c_custkey").alias("name"), F.round(F.round(F.col("c_acctbal") / 1000, 2) * 100).cast("double").alias("hours"))
    return within_budget(files, 5000.0)


# --- features and units ----------------------------------------------------------


def _frames(spark, sf_dir):
    return fx.word_frames(fx.frames(spark, sf_dir))


def _pooled(spark, sf_dir):
    return features.pool(features.standardise(_frames(spark, sf_dir).select("node", "vec")))


def _embeddings(spark, sf_dir):
    return lookup.node_ids(_pooled(spark, sf_dir))


@register(f"WITH {STD} SELECT node, i, round(x, 6) + 0.0 AS x FROM un")
def standardise_pool_l2(spark, sf_dir):
    rows = _pooled(spark, sf_dir).select("node", F.posexplode("emb").alias("i", "x"))
    return rows.select("node", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@register(f"WITH {STD} SELECT text, i, round(avg(x), 6) + 0.0 AS x FROM (SELECT split_part(node, '_', 1) AS text, i, x FROM po) GROUP BY text, i")
def type_centroids(spark, sf_dir):
    f = _frames(spark, sf_dir)
    pooled = features.pool(features.standardise(f.select("node", "vec")), normalise=False)
    types = f.select("node", F.col("filename").alias("text")).distinct()
    rows = features.type_centroids(pooled, types).select("text", F.posexplode("centroid").alias("i", "x"))
    return rows.select("text", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@register(f"""WITH {STD}, nx AS (SELECT a.node, a.frame, a.x * b.x AS p FROM sx a JOIN sx b ON a.node = b.node AND a.frame + 1 = b.frame AND a.i = b.i)
  SELECT node, CAST(frame + 1 AS INT) AS frame, round(sum(p), 5) + 0.0 AS gram FROM nx GROUP BY node, frame""")
def pca_gram(spark, sf_dir):
    """Inner products of neighbouring frames on all components, which a rotation of standardised frames leaves as they are."""
    p = features.project(_frames(spark, sf_dir).select("node", "frame", "vec"), 64)
    nxt = p.select("node", (F.col("frame") + 1).alias("frame"), F.col("vec").alias("last"))
    return p.join(nxt, ["node", "frame"]).select("node", F.col("frame").cast("int").alias("frame"), (F.round(dot(F.col("vec"), F.col("last")), 5) + 0.0).alias("gram"))


#: As many components as the query keeps; the twin finds them one after another by squaring the covariance until one direction is left.
PCA_KEPT, PCA_SQUARINGS = 16, 16
_SQUARED = "list_transform(list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))), lambda r: list_transform(r, lambda x: x / t))"


def _pca_sql() -> str:
    return f"""WITH RECURSIVE {STD},
  cv AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM wf) AS x FROM sx a JOIN sx b ON a.node = b.node AND a.frame = b.frame GROUP BY ALL),
  mat AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(x ORDER BY j) AS r FROM cv GROUP BY i)),
  pw AS (
    SELECT 1 AS k, 0 AS s, c, c AS m, CAST(NULL AS DOUBLE) AS v FROM mat
    UNION ALL
    SELECT k + CAST(s = {PCA_SQUARINGS} AS INT), CASE WHEN s = {PCA_SQUARINGS} THEN 0 ELSE s + 1 END, CASE WHEN s = {PCA_SQUARINGS} THEN d ELSE c END, CASE WHEN s = {PCA_SQUARINGS} THEN d ELSE q END,
      CASE WHEN s = {PCA_SQUARINGS} THEN lam END
    FROM (SELECT *, list_transform(list_zip(c, m), lambda z: list_transform(list_zip(z[1], z[2]), lambda y: y[1] - lam * y[2])) AS d
          FROM (SELECT *, list_sum(list_transform(list_zip(c, m), lambda z: list_dot_product(z[1], z[2]))) AS lam, {_SQUARED} AS q
                FROM (SELECT *, list_sum(list_transform(m, lambda a: list_dot_product(a, a))) AS t FROM pw WHERE k <= {PCA_KEPT})))
  )
  SELECT CAST(k - 1 AS BIGINT) AS component, round(v, 6) AS variance FROM pw WHERE v IS NOT NULL"""


@register(_pca_sql())
def pca_variances(spark, sf_dir):
    """The variance of the frames along each of the first components, greatest first."""
    p = features.project(_frames(spark, sf_dir).select("node", "frame", "vec"), PCA_KEPT)
    rows = p.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"))
    return rows.select((F.col("i") + 1).cast("long").alias("component"), F.round("v", 6).alias("variance"))


def _book(spark, sf_dir):
    f = fx.frames(spark, sf_dir)
    return features.pool(f.select("label", "vec"), by="label", normalise=False).select(F.col("label").cast("int").alias("code"), F.col("emb").alias("vec"))


@register(f"WITH {CODES} SELECT node, CAST(frame AS INT) AS frame, CAST(r AS INT) AS r, code, round(d, 6) AS d FROM near WHERE r <= {NEIGHBOURS}")
def codebook_nearest_topk(spark, sf_dir):
    near = quantise.nearest_codes(_frames(spark, sf_dir).select("node", "frame", "vec"), _book(spark, sf_dir), NEIGHBOURS)
    rows = near.select("node", "frame", F.posexplode("codes").alias("r", "c"))
    return rows.select("node", "frame", (F.col("r") + 1).alias("r"), "c.code", F.round("c.d", 6).alias("d"))


def _unit_table(spark, sf_dir, lmbda=LAMBDA):
    return quantise.quantise(fx.nested(_frames(spark, sf_dir)), _book(spark, sf_dir), lmbda, NEIGHBOURS)


@register(f"WITH {_units(LAMBDA, NEIGHBOURS)} SELECT node, array_to_string(units, ',') AS units FROM u")
def viterbi_units(spark, sf_dir):
    return _unit_table(spark, sf_dir).select("node", F.array_join("units", ",").alias("units"))


@register(f"WITH {_units(LAMBDA, NEIGHBOURS)} SELECT node, array_to_string(list_transform(list_filter(list_zip(units, list_prepend(-1, units)), lambda z: z[1] IS NOT NULL AND z[1] <> z[2]), lambda z: z[1]), ',') AS units FROM u")
def dedup_units(spark, sf_dir):
    u = _unit_table(spark, sf_dir)
    return u.select("node", F.array_join(quantise.without_repeats(F.col("units")), ",").alias("units"))


@register(f"""WITH {_units(LAMBDA, NEIGHBOURS)}, pick AS (SELECT split_part(node, '_', 1) AS text, arg_min(units, md5('42|' || node) || node) AS units FROM u GROUP BY 1)
  SELECT node, text, array_to_string(pick.units, ',') AS units FROM (SELECT node, split_part(node, '_', 1) AS text FROM u) JOIN pick USING (text)""")
def sample_and_replicate(spark, sf_dir):
    u = _unit_table(spark, sf_dir).withColumn("text", F.split("node", "_")[0])
    return lookup.replicate_sample(u).select("node", "text", F.array_join("units", ",").alias("units"))


def _drawn(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '42', node, {', '.join(parts)})), 1, 13) AS BIGINT) + 1) / 4503599627370496.0"


@register(f"""WITH {STD}, means AS (SELECT split_part(node, '_', 1) AS text, i, avg(x) AS x FROM po GROUP BY ALL),
  z AS (SELECT node, means.i, x, 0.005 + 0.01 * ({_drawn("'sigma'")}) AS sigma, {_drawn("'radius'", "CAST(means.i AS VARCHAR)")} AS u, {_drawn("'angle'", "CAST(means.i AS VARCHAR)")} AS v FROM ids JOIN means ON split_part(node, '_', 1) = text)
  SELECT node, CAST(i AS INT) AS i, round(x + sigma * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS x FROM z""")
def noisy_type_means(spark, sf_dir):
    types = _types(spark, sf_dir)
    pooled = flows.pooled_by_word(_frames(spark, sf_dir).select("node", "vec"))
    noisy = features.noisy_type_means(types, features.type_centroids(pooled, types))
    return noisy.select("node", F.posexplode("emb").alias("i", "x")).select("node", "i", F.round("x", 6).alias("x"))


def _apart(table, label, vector):
    """Vectors with ten more dimensions that set labels far apart, so that clusters are known."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == label, 50.0).otherwise(0.0))
    return table.withColumn(vector, F.concat(vector, marks))


def _label(node="node"):
    return F.expr(f"CAST(substring(split({node}, '_')[0], 2) AS INT)")


@register(f"""WITH {WF}, ex AS (SELECT CAST(substr(split_part(node, '_', 1), 2) AS INT) AS label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM wf)
  SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS x FROM ex GROUP BY ALL""")
def trained_codebook(spark, sf_dir):
    """Centres of frames whose labels lie far apart: the labels' means."""
    book = quantise.train_codebook(_apart(_frames(spark, sf_dir), _label(), "vec").select("vec"), 10)
    size = F.size("vec") - 10
    mark = F.array_position(F.transform(F.slice("vec", size + 1, 10), lambda x: x > 25), True) - 1
    return book.select(mark.cast("int").alias("label"), F.posexplode(F.slice("vec", F.lit(1), size)).alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


# --- graphs --------------------------------------------------------------------------


def _cos(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return emb, pairwise.cosine_graph(emb.select("node_id", "emb"), COSINE)


@register(f"WITH {COS} SELECT i, j, round(w, 6) AS w FROM edges")
def cos_graph(spark, sf_dir):
    return _cos(spark, sf_dir)[1].select("i", "j", F.round("w", 6).alias("w"))


ED = ", s AS (SELECT row_number() OVER (ORDER BY node) - 1 AS id, array_to_string(list_transform(units, lambda x: chr(CAST(65 + x AS INT))), '') AS s FROM {0}), e AS (SELECT a.id AS i, b.id AS j, levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) AS d FROM s a JOIN s b ON a.id < b.id) SELECT i, j, round(1 - d, 6) AS w FROM e WHERE d < " + str(EDIT)


@register(f"WITH {_units(LAMBDA, NEIGHBOURS)}" + ED.format("u"))
def ed_graph(spark, sf_dir):
    u = lookup.node_ids(_unit_table(spark, sf_dir))
    return pairwise.edit_graph(u.select("node_id", "units"), EDIT).select("i", "j", F.round("w", 6).alias("w"))


@register(f"""WITH {_units(LAMBDA, NEIGHBOURS)}, pick AS (SELECT split_part(node, '_', 1) AS text, arg_min(units, md5('42|' || node) || node) AS units FROM u GROUP BY 1),
  ru AS (SELECT node, pick.units AS units FROM (SELECT node, split_part(node, '_', 1) AS text FROM u) JOIN pick USING (text))""" + ED.format("ru"))
def ed_graph_replicated(spark, sf_dir):
    u = _unit_table(spark, sf_dir).withColumn("text", F.split("node", "_")[0])
    r = lookup.node_ids(lookup.replicate_sample(u))
    return pairwise.edit_graph(r.select("node_id", "units"), EDIT).select("i", "j", F.round("w", 6).alias("w"))


def _dtw_words(spark, sf_dir):
    return lookup.node_ids(fx.nested(_frames(spark, sf_dir))).select("node_id", "frames")


@register(f"WITH {_dtw_sql()} SELECT i, j, round(dist, 6) + 0.0 AS dist FROM dp")
def dtw_pairs(spark, sf_dir):
    return pairwise.dtw_pairs(_dtw_words(spark, sf_dir)).select("i", "j", (F.round("dist", 6) + 0.0).alias("dist"))


@register(f"WITH {_dtw_sql()} SELECT i, j, round(1 - dist, 6) AS w FROM dp WHERE dist < {DTW}")
def dtw_graph(spark, sf_dir):
    return pairwise.build_graph("dtw", DTW, words=_dtw_words(spark, sf_dir)).select("i", "j", F.round("w", 6).alias("w"))


@register(f"WITH RECURSIVE {COS}, {COMPONENTS} SELECT a AS node_id, min(b) AS component FROM reach GROUP BY a")
def graph_components(spark, sf_dir):
    emb, edges = _cos(spark, sf_dir)
    return communities.components(emb, edges)


@register(f"""WITH {COS}, l AS (SELECT node_id, node_id % 7 AS label FROM ids),
  ins AS (SELECT coalesce(sum(w), 0) AS inside FROM edges JOIN l a ON i = a.node_id JOIN l b ON j = b.node_id WHERE a.label = b.label)
  SELECT count(*) AS clusters, round((SELECT inside FROM ins) - 0.3 * sum(n * (n - 1) / 2), 6) AS objective FROM (SELECT label, count(*) AS n FROM l GROUP BY label)""")
def cpm_objective(spark, sf_dir):
    emb, edges = _cos(spark, sf_dir)
    labels = emb.select("node_id", (F.col("node_id") % 7).alias("label"))
    return communities.cpm_objective(edges, labels, 0.3).select("clusters", F.round("objective", 6).alias("objective"))


#: Cliques of weight 1, joined in a row by edges of weight 0.1: at a resolution between, the cliques are the optimum.
CLIQUES = f"{STD}, g AS (SELECT node_id, split_part(node, '_', 1) || '.' || CAST(split_part(node, '_', 2) AS INT) // 4 AS clique FROM ids)"


@register(f"WITH {CLIQUES} SELECT node_id, min(node_id) OVER (PARTITION BY clique) AS label FROM g")
def cpm_partition(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    part = F.split("node", "_")
    nodes = emb.select("node_id", F.concat_ws(".", part[0], F.floor(part[1].cast("int") / 4)).alias("clique"))
    a, b = nodes.select(F.col("node_id").alias("i"), F.col("clique").alias("c")), nodes.select(F.col("node_id").alias("j"), F.col("clique").alias("d"))
    weight = F.when(F.col("c") == F.col("d"), 1.0).otherwise(0.1)
    edges = a.join(b, ((F.col("c") == F.col("d")) & (F.col("i") < F.col("j")))).union(a.join(b, (F.col("i") + 1 == F.col("j")) & (F.col("c") != F.col("d"))))
    found = communities.cpm_partition(nodes.select("node_id"), edges.select("i", "j", weight.alias("w")), nodes.select("clique").distinct().count())
    return _by_least(found, "node_id").select("node_id", F.col("cluster").alias("label"))


@register(f"WITH {COS} SELECT node_id, count(n) AS degree, round(coalesce(sum(w), 0), 6) AS strength, CAST(0 AS BIGINT) AS improving, CAST(1 AS BIGINT) AS pieces FROM ids LEFT JOIN (SELECT i AS n, w FROM edges UNION ALL SELECT j, w FROM edges) ON node_id = n GROUP BY node_id")
def communities_real_graph(spark, sf_dir):
    """Communities of the real cosine graph: whether a node would gain by moving, and into how many pieces its community falls.

    The partition is not unique; what its optimality asks of each node is.
    """
    emb, edges = _cos(spark, sf_dir)
    nodes, edges = materialise(emb.select("node_id"), "nodes"), materialise(edges.select("i", "j", "w"), "edges")
    found = materialise(communities.communities(communities.component_graph(nodes, edges), communities.RESOLUTION, stable=True).select("node_id", "label"), "communities")
    ends = edges.select(F.col("i").alias("node_id"), "w").unionAll(edges.select("j", "w")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    judged = communities.best_gains(edges, found, communities.RESOLUTION).join(communities.pieces(edges, found), "label").join(ends, "node_id", "left")
    return judged.select("node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.round(F.coalesce("strength", F.lit(0.0)), 6).alias("strength"), (F.col("gain") > 1e-9).cast("long").alias("improving"), "pieces")


# --- centroid clustering -----------------------------------------------------------


def _lloyd_sql(rounds: int) -> str:
    ctes = [STD, "k0 AS (SELECT node_id AS label, emb AS c FROM emb WHERE node_id < 10)"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT node, emb, arg_min(label, d) AS label FROM (SELECT node, emb, label, list_sum(list_transform(list_zip(emb, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM emb CROSS JOIN k{r}) GROUP BY ALL)")
        ctes.append(f"k{r + 1} AS (SELECT label, coalesce(m, c) AS c FROM k{r} LEFT JOIN (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(emb))) AS i, unnest(emb) AS x FROM a{r}) GROUP BY ALL) GROUP BY label) USING (label))")
    return f"WITH {', '.join(ctes)} SELECT node, label FROM a{rounds}"


def _first_centres(emb):
    return [r["emb"] for r in emb.where("node_id < 10").orderBy("node_id").select("emb").collect()]


@register(_lloyd_sql(2))
def kmeans_lloyd_fixed_init(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return clustering.lloyd(emb, _first_centres(emb), 2)[0].select("node", "label")


@register(_lloyd_sql(0))
def kmeans_assign(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return clustering.assign(emb, _first_centres(emb)).select("node", "label")


#: Clusters of vectors whose labels lie far apart.
APART = f"WITH {WF} SELECT node, min(node) OVER (PARTITION BY split_part(node, '_', 1)) AS cluster FROM (SELECT DISTINCT node FROM wf)"


@register(APART)
def kmeans_clusters(spark, sf_dir):
    return _by_least(clustering.kmeans(_apart(_pooled(spark, sf_dir), _label(), "emb"), 10))


@register(APART)
def ward_clusters(spark, sf_dir):
    return _by_least(clustering.ward(_apart(_pooled(spark, sf_dir), _label(), "emb"), 10))


#: K-means++ with three runs: centres, rounds of Lloyd.
PLUS_K, PLUS_ROUNDS = 4, 2


def _plus_plus_sql() -> str:
    square = "list_sum(list_transform(list_zip({0}.emb, {1}.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes, ends = [STD], []
    for run in range(clustering.KMEANS_RUNS):
        for step in range(PLUS_K):
            u = f"((CAST('0x' || substr(md5('0|{run}|{step}|' || emb.node), 1, 12) AS BIGINT) + 1) / 281474976710656.0)"
            far = "1.0" if step == 0 else f"(SELECT min({square.format('emb', 'q')}) FROM ({' UNION ALL '.join(f'SELECT c FROM p{run}_{s}' for s in range(step))}) q)"
            ctes.append(f"p{run}_{step} AS MATERIALIZED (SELECT {step} AS label, emb AS c FROM (SELECT emb, node, -ln(u) / far AS wait FROM (SELECT emb.emb, emb.node, {u} AS u, {far} AS far FROM emb) WHERE far > 0) ORDER BY wait, node LIMIT 1)")
        ctes.append(f"k{run}_0 AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM p{run}_{s}' for s in range(PLUS_K))})")
        for r in range(PLUS_ROUNDS + 1):
            ctes.append(f"a{run}_{r} AS MATERIALIZED (SELECT node, emb, arg_min(label, d) AS label, min(d) AS d FROM (SELECT node, emb, label, {square.format('x', 'k')} AS d FROM emb x CROSS JOIN k{run}_{r} k) GROUP BY ALL)")
            ctes.append(f"k{run}_{r + 1} AS MATERIALIZED (SELECT label, coalesce(m, c) AS c FROM k{run}_{r} LEFT JOIN (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(emb))) AS i, unnest(emb) AS x FROM a{run}_{r}) GROUP BY ALL) GROUP BY label) USING (label))")
        ends.append(f"SELECT {run} AS run, node, label, sum(d) OVER () AS inertia FROM a{run}_{PLUS_ROUNDS}")
    return f"WITH {', '.join(ctes)}, e AS ({' UNION ALL '.join(ends)}) SELECT node, min(node) OVER (PARTITION BY label) AS cluster FROM e WHERE run = (SELECT arg_min(run, inertia) FROM e)"


@register(_plus_plus_sql())
def kmeans_plus_plus(spark, sf_dir):
    """The best of three runs from k-means++ on the pooled vectors as they are."""
    return _by_least(clustering.kmeans(_pooled(spark, sf_dir), PLUS_K, rounds=PLUS_ROUNDS))


#: Ward linkage step by step: the two clusters whose union costs least are joined until WARD_K are left.
WARD_K = 10


@register(f"""WITH RECURSIVE {STD}, c AS (SELECT CAST(0 AS BIGINT) AS step, node_id AS id, [node] AS members, CAST(1 AS DOUBLE) AS size, emb AS mean FROM emb
  UNION ALL SELECT * FROM (WITH pairs AS (SELECT x.id AS a, y.id AS b, x.size * y.size / (x.size + y.size) * list_sum(list_transform(list_zip(x.mean, y.mean), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM c x JOIN c y ON x.id < y.id),
    best AS (SELECT arg_min(a, d) AS a, arg_min(b, d) AS b FROM pairs)
    SELECT step + 1, c.id, c.members, c.size, c.mean FROM c, best WHERE c.id NOT IN (best.a, best.b) AND (SELECT count(*) FROM c) > {WARD_K}
    UNION ALL SELECT x.step + 1, x.id, list_concat(x.members, y.members), x.size + y.size, list_transform(list_zip(x.mean, y.mean), lambda z: (z[1] * x.size + z[2] * y.size) / (x.size + y.size))
    FROM best JOIN c x ON x.id = best.a JOIN c y ON y.id = best.b WHERE (SELECT count(*) FROM c) > {WARD_K}))
  SELECT m AS node, min(m) OVER (PARTITION BY id) AS cluster FROM (SELECT id, unnest(members) AS m FROM c WHERE step = (SELECT max(step) FROM c))""")
def ward_real_vectors(spark, sf_dir):
    """Rounds of mutual nearest neighbours in tiles of 64 until 100 clusters are left, on the pooled vectors as they are."""
    return _by_least(clustering.ward(_pooled(spark, sf_dir), WARD_K, block=64, most=100))


@register(f"WITH {STD} SELECT i, count(*) AS n, round(sum(x), 5) + 0.0 AS total, (SELECT round(sum(x * x), 5) FROM un) AS squares FROM un GROUP BY i")
def birch_leaf_totals(spark, sf_dir):
    """Counts, sums and squares of all sub-clusters of the tree add up to those of the vectors."""
    leaves = clustering.birch_leaves(_pooled(spark, sf_dir), 0.6, 64, 8)
    whole = leaves.agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("squares"), 5).alias("squares")).first()
    sums = leaves.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg((F.round(F.sum("x"), 5) + 0.0).alias("total"))
    return sums.select(F.col("i").cast("long").alias("i"), F.lit(whole["n"]).alias("n"), "total", F.lit(whole["squares"]).alias("squares"))


@register(APART)
def birch_clusters(spark, sf_dir):
    return _by_least(clustering.birch(_apart(_pooled(spark, sf_dir), _label(), "emb"), 10))


# --- scores ----------------------------------------------------------------------

LAB = f"{W}, {MATCH}, lab AS (SELECT text AS t, cluster AS c, gold_start, gold_end FROM m), tc AS (SELECT t, c, count(*) AS n FROM lab GROUP BY t, c)"
#: The pooled mean from counted sequences; equal sequences are at distance 0.
NED_COUNTED = "SELECT round(CASE WHEN (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM tc GROUP BY c)) > 0 THEN coalesce(sum(a.n * b.n * levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))), 0) / (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM tc GROUP BY c)) ELSE 0 END, 5) AS ned FROM tc a JOIN tc b ON a.c = b.c AND a.t < b.t"
PURITY = "SELECT round(sum(top) / sum(al), 5) AS {0} FROM (SELECT max(n) AS top, sum(n) AS al FROM tc GROUP BY {1})"
ENT = """e AS (SELECT (SELECT sum(n) FROM tc) AS n, (SELECT sum(n * ln(n)) FROM tc) AS stc, (SELECT sum(x * ln(x)) FROM (SELECT sum(n) AS x FROM tc GROUP BY t)) AS st, (SELECT sum(x * ln(x)) FROM (SELECT sum(n) AS x FROM tc GROUP BY c)) AS sc),
  h AS (SELECT ln(n) - st / n AS ht, ln(n) - sc / n AS hc, ln(n) - stc / n AS htc FROM e),
  hc2 AS (SELECT CASE WHEN ht <= 1e-12 THEN 1 ELSE 1 - (htc - hc) / ht END AS h, CASE WHEN hc <= 1e-12 THEN 1 ELSE 1 - (htc - ht) / hc END AS c FROM h)"""
VM = "SELECT abs(round(h, 5)) AS homogeneity, abs(round(c, 5)) AS completeness, abs(round(CASE WHEN h + c <= 1e-12 THEN 0 ELSE 2 * h * c / (h + c) END, 5)) AS v FROM hc2"
BITS = "SELECT round((sum(x) * log2(sum(x)) - sum(x * log2(x))) / (SELECT sum(word_end - word_start) FROM w), 8) AS bitrate FROM (SELECT sum(n) AS x FROM tc GROUP BY c)"
COUNTS = "SELECT count(DISTINCT c) AS n_pred, count(DISTINCT t) AS n_true, abs(count(DISTINCT c) - count(DISTINCT t)) AS difference FROM tc"


def _labels(spark, sf_dir):
    w, _, m = _matched(spark, sf_dir)
    return w, m, m.select(F.col("text").alias("true"), F.col("cluster").alias("pred"))


@register(f"WITH {LAB} {NED_COUNTED}")
def ned(spark, sf_dir):
    return evaluate.ned(_matched(spark, sf_dir)[2])


@register(f"WITH {LAB} " + PURITY.format("purity", "c"))
def purity(spark, sf_dir):
    return evaluate.purity(_labels(spark, sf_dir)[2])


@register(f"WITH {LAB} " + PURITY.format("completeness_star", "t"))
def completeness_star(spark, sf_dir):
    return evaluate.majority_completeness(_labels(spark, sf_dir)[2])


@register(f"WITH {LAB}, {ENT} {VM}")
def homogeneity_v(spark, sf_dir):
    return evaluate.v_measure(_labels(spark, sf_dir)[2])


@register(f"WITH {LAB} {BITS}")
def bitrate(spark, sf_dir):
    w, _, labels = _labels(spark, sf_dir)
    return evaluate.bitrate(labels, w).select(F.round("bitrate", 8).alias("bitrate"))


@register(f"WITH {LAB} {COUNTS}")
def cluster_counts(spark, sf_dir):
    return evaluate.cluster_counts(_labels(spark, sf_dir)[2])


@register(f"WITH {LAB}, {ENT} SELECT * FROM ({NED_COUNTED}), ({PURITY.format('purity', 'c')}), ({PURITY.format('completeness_star', 't')}), ({VM}), ({BITS}), ({COUNTS})")
def evaluation_report(spark, sf_dir):
    w, m, _ = _labels(spark, sf_dir)
    return evaluate.report(m, w).withColumn("bitrate", F.round("bitrate", 8))


@register(f"""WITH {LAB}, sz AS (SELECT c, sum(n) AS size FROM tc GROUP BY c),
  dd AS (SELECT a.c, sum(a.n * b.n * levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))) AS total FROM tc a JOIN tc b ON a.c = b.c AND a.t < b.t GROUP BY a.c)
  SELECT c AS cluster, CAST(size AS BIGINT) AS size, round(total / (size * (size - 1) / 2), 5) AS ned, array_to_string(regexp_extract_all(t, '.'), '-') AS phones, round(n / size, 5) AS share FROM tc JOIN sz USING (c) JOIN dd USING (c) WHERE total > 0""")
def variant_proportions(spark, sf_dir):
    return evaluate.variants(_matched(spark, sf_dir)[2])


@register(f"""WITH tc AS (SELECT l_returnflag AS t, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY ALL), {ENT} {VM}""")
def v_measure_lineitem(spark, sf_dir):
    return evaluate.v_measure(fx.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("WITH tc AS (SELECT o_orderpriority AS t, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL) " + PURITY.format("purity", "c"))
def purity_orders(spark, sf_dir):
    return evaluate.purity(fx.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


# --- partition files and flows ----------------------------------------------------


def _members(w):
    return w.select("filename", "word_id", ((F.col("word_id") % 3) * 10 + F.char_length("text")).cast("long").alias("cluster"))


@register(f"""WITH {W}, x AS (SELECT (word_id % 3) * 10 + length(text) AS cluster, row_number() OVER (PARTITION BY (word_id % 3) * 10 + length(text) ORDER BY filename, word_id) AS position,
    filename || ' ' || format('{{:.3f}}', word_start) || ' ' || format('{{:.3f}}', word_end) || ' ' || text || ' ' || array_to_string(regexp_extract_all(text, '.'), '-') AS line FROM w)
  SELECT cluster, position, line FROM x UNION ALL SELECT DISTINCT cluster, 0, 'Class ' || cluster FROM x""")
def partition_file_lines(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    return partition_lines(_members(w), w, decimals=3, joiner="-")


@register(f"WITH {W} SELECT (word_id % 3) * 10 + length(text) AS cluster, filename, word_start AS \"start\", word_end AS \"end\" FROM w")
def partition_roundtrip(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    return parse_partition(partition_texts(partition_lines(_members(w), w, decimals=2))).drop("rest")


# --- files through data sources ---------------------------------------------------


def _through_files(spark, name, write, rows):
    """What ``rows`` are after they were written to a folder of their own and read by the data source."""
    folder = f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"
    write(rows, folder)
    return spark.read.format(f"wordloom_{name}").load(folder)


@register(f"""WITH {W}, {P} SELECT filename, 'words' AS tier, CAST(row_number() OVER (PARTITION BY filename ORDER BY word_id) - 1 AS INT) AS pos, word_start AS xmin, word_end AS xmax, text AS label FROM w
  UNION ALL SELECT filename, 'phones', CAST(row_number() OVER (PARTITION BY filename ORDER BY pos) - 1 AS INT), p_start, p_end, phone FROM p""")
def textgrid_files(spark, sf_dir):
    """Words and phones as TextGrids, one a file of speech, and all intervals read back."""
    w = fx.words(spark, sf_dir)
    spoken = w.select("filename", F.lit("words").alias("tier"), F.col("word_id").cast("int").alias("pos"), F.col("word_start").alias("xmin"), F.col("word_end").alias("xmax"), F.col("text").alias("label"))
    phones = fx.phones(w).select("filename", F.lit("phones").alias("tier"), "pos", F.col("start").alias("xmin"), F.col("end").alias("xmax"), F.col("phone").alias("label"))
    return _through_files(spark, "textgrid", datasource.write_textgrids, spoken.unionByName(phones)).drop("corrupt")


@register(f"WITH {WF} SELECT node, CAST(frame AS INT) AS frame, i, round(x, 6) + 0.0 AS x FROM (SELECT node, frame, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM wf)")
def npy_files(spark, sf_dir):
    """Frames of words as .npy files, one a word, read back frame by frame."""
    words = fx.nested(_frames(spark, sf_dir))
    read = _through_files(spark, "npy", datasource.write_npy, words)
    return read.select("node", "frame", F.posexplode("vec").alias("i", "x")).select("node", "frame", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@register(f"WITH {W} SELECT (word_id % 3) * 10 + length(text) AS cluster, filename, word_start AS \"start\", word_end AS \"end\", text || ' ' || array_to_string(regexp_extract_all(text, '.'), ',') AS rest FROM w")
def partition_files(spark, sf_dir):
    """A partition as files of blocks, read back."""
    w = fx.words(spark, sf_dir)
    lines = partition_lines(_members(w), w, decimals=2)
    return _through_files(spark, "partition", datasource.write_partitions, lines)


@register(f"""WITH RECURSIVE {COS}, {COMPONENTS}, tc AS (SELECT split_part(node, '_', 1) AS t, c, count(*) AS n FROM (SELECT a AS node_id, min(b) AS c FROM reach GROUP BY a) JOIN ids USING (node_id) GROUP BY ALL),
  {ENT} SELECT * FROM ({PURITY.format('purity', 'c')}), ({PURITY.format('completeness_star', 't')}), ({VM}), ({COUNTS})""")
def graph_flow_cos(spark, sf_dir):
    return flows.flagship(spark, sf_dir, COSINE)


def _typed_units(spark, sf_dir):
    return _unit_table(spark, sf_dir).withColumn("text", F.split("node", "_")[0])


def _types(spark, sf_dir):
    return _frames(spark, sf_dir).select("node", F.col("filename").alias("text")).distinct()


def _by_least(labels, name="node"):
    """Clusters named by their least member, so that numbering does not count."""
    least = labels.groupBy("label").agg(F.min(name).alias("cluster"))
    return labels.join(least, "label").select(name, "cluster")


@register()
def hacked_graph_clusters(spark, sf_dir):
    return flows.graph_from_types(_typed_units(spark, sf_dir), EDIT)


#: K-means from the types' means, round by round until nothing can move any more.
def _from_types_sql(rounds: int) -> str:
    ctes = [STD, "raw AS (SELECT node, split_part(node, '_', 1) AS text, i, x FROM po)"]
    ctes.append("k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) - 1 AS label, c FROM (SELECT text, list(x ORDER BY i) AS c FROM (SELECT text, i, avg(x) AS x FROM raw GROUP BY ALL) GROUP BY text))")
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT node, emb, arg_min(label, d) AS label FROM (SELECT node, emb, label, list_sum(list_transform(list_zip(emb, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM emb CROSS JOIN k{r}) GROUP BY ALL)")
        ctes.append(f"k{r + 1} AS MATERIALIZED (SELECT label, coalesce(m, c) AS c FROM k{r} LEFT JOIN (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(emb))) AS i, unnest(emb) AS x FROM a{r}) GROUP BY ALL) GROUP BY label) USING (label))")
    return f"WITH {', '.join(ctes)} SELECT node, label FROM a{rounds}"


@register(_from_types_sql(clustering.KMEANS_ROUNDS))
def hacked_kmeans_clusters(spark, sf_dir):
    pooled = flows.pooled_by_word(_frames(spark, sf_dir).select("node", "vec"))
    return flows.kmeans_from_types(pooled, _types(spark, sf_dir))


@register()
def hacked_representation_graph(spark, sf_dir):
    return flows.graph_of_replicas(_typed_units(spark, sf_dir), EDIT)


@register(f"WITH {WF} SELECT node, min(node) OVER (PARTITION BY split_part(node, '_', 1)) AS cluster FROM (SELECT DISTINCT node FROM wf)")
def hacked_representation_kmeans(spark, sf_dir):
    """The noise is small beside the distances of means, so the clusters must be the types."""
    pooled = flows.pooled_by_word(_frames(spark, sf_dir).select("node", "vec"))
    return _by_least(flows.kmeans_of_noise(pooled, _types(spark, sf_dir)))
