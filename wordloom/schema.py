"""Explicit schemas of the tables that the engine exchanges."""

from __future__ import annotations

BOUNDARIES = "word_id int, filename string, word_start double, word_end double, text string, phones array<string>"
BOUNDARIES_CSV = "word_id int, filename string, word_start double, word_end double, text string, phones string"
PHONES = "filename string, start double, end double, phone string, pos int"
SEGMENTS = "seg_id int, filename string, start double, end double"
FRAMES = "node string, frame int, vec array<double>"
WORD_FRAMES = "node string, frames array<array<double>>"
EMBEDDINGS = "node string, emb array<double>"
CODEBOOK = "code int, vec array<double>"
UNITS = "node string, units array<int>"
PAIRS = "i long, j long, dist double"
EDGES = "i long, j long, w double"
PARTITION = "node string, cluster long"
FRAGMENTS = "cluster long, filename string, start double, end double"
