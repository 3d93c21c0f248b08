"""Secret scan: base patterns, and a battery of randomness tests with false-discovery control.

Runs of 20 and more characters are candidates, and so are such runs between the
slashes of one.  The encoding is inferred as the smallest alphabet that holds all
characters of the candidate; under it three statistics are worked out:
chi-squared uniformity of the symbols, runs about the middle of the alphabet, and
serial correlation at lag one.

A report says "this is random", so that is what must be proved: the hypothesis
tested is that a candidate is structured, departing from a random string by at
least ``MATCH``, ``RUN_SHIFT`` or ``CORRELATION``.  Each test is one of
equivalence (the noncentral chi-squared distribution for uniformity, the normal
one for the others), the candidate must pass all three, and so the greatest of
their p-values is its p-value.  Benjamini-Hochberg over all candidates of the
table, within strata of length, reports those below its threshold; so it is the
reports of which at most ``rate`` are structured in expectation.  How short a
string can be told is left to the tests' own power, no length or alphabet is
passed over.

p-values are rounded up to a grid of ``GRID`` steps a unit of the logarithm, so the
procedure needs only a table of counts of bounded size, and no ordering of all
candidates.  Everything is linear in the length of texts and candidates.

Runs on Spark expressions only.  Defined results: a null text counts as empty;
rows with repeated or null ids are scanned each by itself; texts and candidates
of any length are scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm._native import cut_at, let, running_starts, running_tops, unmarked
from wordloom.llm._shared import spool

#: The base patterns in the order of kinds.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are maximal, so a least length in the pattern is the same as dropping short matches.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: A token may follow a name and '='; '=' belongs to it as padding at its end only.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+/_-]))?"
KINDS = ("assign", "access", "hex", "random")
LEAST_GROUP = 6

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (pattern of the token, alphabet), smallest alphabet first; the last one holds every candidate.
ENCODINGS = (
    ("[0-9]+", DIGITS),
    ("[0-9a-f]+", DIGITS + LOWER[:6]),
    ("[0-9A-F]+", DIGITS + UPPER[:6]),
    ("[a-z]+", LOWER),
    ("[A-Z]+", UPPER),
    ("[A-Z2-7]+", UPPER + "234567"),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[A-Za-z]+", UPPER + LOWER),
    ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS),
    ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "_-"),
    ("[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGITS + "+/_-"),
)
#: What makes a string structured: two of its symbols match this often, or symbols vary that much more than
#: random ones (alphabets of few symbols); changes between halves of the alphabet are off one in two by as
#: much; neighbouring symbols correlate as much.
MATCH, LEAST_EXCESS, RUN_SHIFT, CORRELATION = 0.05, 0.5, 0.35, 0.7
LEAST_LENGTH, FALSE_DISCOVERY_RATE = 20, 0.05
STRATA = (20, 32, 64)
GRID, GRID_TOP = 16, 1023


def _matches(text: Column, pattern: str, code: int, keep=None) -> Column:
    """array<struct<start,kind,end>> of the leftmost non-overlapping matches."""
    pieces = F.transform(cut_at(text, pattern), lambda p, i: F.struct(p.alias("p"), F.char_length(p).cast("long").alias("n"), (i % 2 == 1).alias("hit")))

    def placed(found: Column) -> Column:
        starts = running_starts(F.transform(found, lambda x: x["n"]))
        spans = F.zip_with(found, starts, lambda x, s: F.struct(s.alias("start"), F.lit(code).alias("kind"), (s + x["n"]).alias("end"), x["p"].alias("p"), x["hit"].alias("hit")))
        return F.filter(spans, lambda x: x["hit"] & keep(x["p"]) if keep else x["hit"])

    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(code).alias("kind"), F.lit(0).cast("long").alias("end"), F.lit("").alias("p"), F.lit(False).alias("hit"))), lambda x: x["hit"])
    return let(pieces, lambda found: F.when(F.size(found) > 1, placed(found)).otherwise(none))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _below(z: Column) -> Column:
    """Normal distribution function, by the formula 26.2.17 of Abramowitz and Stegun (fixed values)."""

    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly

    return let(z, lambda x: F.when(x < 0, tail(-x)).otherwise(1 - tail(x)))


def _inferred(token: Column) -> Column:
    """The token without padding and the smallest alphabet that holds it."""

    def of(bare: Column) -> Column:
        alphabet = F.lit(None).cast("string")
        for pattern, symbols in reversed(ENCODINGS):
            alphabet = F.when(bare.rlike(f"^{pattern}$"), F.lit(symbols)).otherwise(alphabet)
        return F.struct(bare.alias("bare"), alphabet.alias("alphabet"))

    return let(F.regexp_replace(token, "=+$", ""), of)


def _sums(x: Column) -> Column:
    """What the tests need of a token, each in one pass over its symbols."""
    size = F.char_length(x["alphabet"])
    symbols = F.filter(F.split(x["bare"], ""), lambda c: c != "")
    counts = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: (F.char_length(x["bare"]) - F.char_length(F.replace(x["bare"], x["alphabet"].substr(i, F.lit(1)), F.lit("")))).cast("double"),
    )
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)

    def of(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return let(
            pairs,
            lambda two: F.struct(
                F.size(codes).cast("double").alias("n"),
                size.cast("double").alias("size"),
                F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
                total(codes).alias("sum"),
                F.aggregate(codes, F.lit(0.0), lambda a, c: a + c * c).alias("second"),
                F.aggregate(two, F.lit(0.0), lambda a, p: a + p["a"] * p["b"]).alias("cross"),
                F.aggregate(two, F.lit(0.0), lambda a, p: a + ((p["a"] * 2 >= size) != (p["b"] * 2 >= size)).cast("double")).alias("changes"),
                (F.element_at(codes, 1) + F.element_at(codes, -1)).alias("ends"),
            ),
        )

    return let(F.transform(symbols, lambda c: (F.position(c, x["alphabet"]) - 1).cast("double")), of)


def _p_values(x: Column) -> list[Column]:
    """Of the three tests; ``x`` is a struct of :func:`_sums`."""
    n, size = x["n"], x["size"]
    # uniformity: the noncentral chi-squared distribution at the least structure, by Abdel-Aty's cube root
    chi, free = size / n * x["squares"] - n, size - 1
    shift = n * F.greatest(F.lit(LEAST_EXCESS), MATCH * size - 1)
    width = 2 * (free + 2 * shift) / (free + shift) / (9 * (free + shift))
    uniform = _below((F.pow(F.greatest(chi, F.lit(0.0)) / (free + shift), F.lit(1 / 3)) - (1 - width)) / F.sqrt(width))
    # runs about the middle of the alphabet: random neighbours lie in different halves one time in two
    runs = _below((F.abs(x["changes"] / (n - 1) - 0.5) - RUN_SHIFT) / F.sqrt((0.25 - RUN_SHIFT**2) / (n - 1)))
    # serial correlation at lag one, by Fisher's transform
    mean = x["sum"] / n
    variance = x["second"] - n * mean * mean
    lagged = x["cross"] - mean * (2 * x["sum"] - x["ends"]) + (n - 1) * mean * mean
    r = F.when(variance > 1e-9, F.least(F.abs(lagged / F.greatest(variance, F.lit(1e-9))), F.lit(0.999))).otherwise(F.lit(0.999))
    serial = _below((F.atanh(r) - math.atanh(CORRELATION)) * F.sqrt(n - 3))
    return [uniform, runs, serial]


def _stratum(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def _judged(t: Column) -> Column:
    """A candidate (start, end, p) with its p-value, step of the grid and stratum."""
    p = let(_inferred(t["p"]), lambda x: let(_sums(x), lambda s: F.greatest(*_p_values(s))))
    step = lambda v: F.least(F.floor(-F.log(F.greatest(v, F.lit(1e-300))) * GRID), F.lit(GRID_TOP)).cast("int")
    return let(p, lambda v: F.struct(t["start"].alias("start"), t["end"].alias("end"), v.alias("p"), _stratum(t["end"] - t["start"]).alias("stratum"), step(v).alias("step")))


def _parts(t: Column) -> Column:
    """The runs of a token between slashes that are candidates too."""

    def placed(pieces: Column) -> Column:
        starts = running_starts(F.transform(pieces, lambda p: (F.char_length(p) + 1).cast("long")))
        spans = F.zip_with(pieces, starts, lambda p, s: F.struct((t["start"] + s).alias("start"), (t["start"] + s + F.char_length(p)).alias("end"), p.alias("p")))
        return F.filter(spans, lambda x: (F.char_length(x["p"]) >= LEAST_LENGTH) & x["p"].rlike(f"^[A-Za-z0-9+_-]{{{LEAST_LENGTH},}}"))

    none = F.filter(F.array(F.struct(t["start"].alias("start"), t["end"].alias("end"), t["p"].alias("p"))), lambda x: F.lit(False))
    return F.when(t["p"].contains("/"), let(F.split(t["p"], "/"), placed)).otherwise(none)


def _outside(tokens: Column, base: Column) -> Column:
    """The tokens that lie in no base span: no span that starts before one, or where it does, reaches its end."""
    event = lambda x, kind, p: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), p.alias("p"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b, 0, F.lit(""))), F.transform(tokens, lambda t: event(t, 1, t["p"]))))

    def marked(found: Column) -> Column:
        tops = running_tops(F.transform(found, lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(F.lit(0).cast("long"))))
        return F.filter(F.zip_with(found, tops, lambda e, top: F.struct(e.alias("e"), (top >= e["end"]).alias("inside"))), lambda x: (x["e"]["kind"] == 1) & ~x["inside"])

    free = F.transform(let(events, marked), lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["p"].alias("p")))
    plain = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["p"].alias("p")))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), plain).otherwise(free)


def _thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """For each stratum the lowest grid step, so the greatest p-value, that is reported (Benjamini-Hochberg)."""
    every = F.flatten(F.transform("tokens", lambda t: F.concat(F.array(t["whole"]), t["parts"])))
    counts = found.where(F.size("tokens") > 0).select(F.explode(every).alias("t")).groupBy("t.stratum", "t.step").count()
    at_least = Window.partitionBy("stratum").orderBy(F.desc("step"))
    reported = F.exp(-F.col("step") / GRID) <= rate * F.sum("count").over(at_least) / F.sum("count").over(Window.partitionBy("stratum"))
    steps = counts.withColumn("reported", reported).where("reported").groupBy("stratum").agg(F.min("step").alias("step"))
    return {r["stratum"]: r["step"] for r in steps.collect()}  # a row for each stratum at most


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base and tokens: each candidate outside base spans (whole) and its parts, with p-value, grid step and stratum."""
    text = F.col("text")
    long_group = lambda p: F.char_length(F.regexp_extract(p, ASSIGN, 1)) >= LEAST_GROUP
    spans = docs.select(F.col("doc_id").cast("long").alias("doc_id"), unmarked(F.col("text").cast("string")).alias("text")).select(
        "doc_id",
        _plain(F.concat(_matches(text, ASSIGN, 0, long_group), _matches(text, ACCESS, 1), _matches(text, HEX, 2))).alias("base"),
        _matches(text, TOKEN, 3).alias("tokens"),
    )
    spans = spans.select("doc_id", "base", _outside(F.col("tokens"), F.col("base")).alias("tokens"))
    return spans.select("doc_id", "base", F.transform("tokens", lambda t: F.struct(_judged(t).alias("whole"), F.transform(_parts(t), _judged).alias("parts"))).alias("tokens"))


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """doc_id, base and found: arrays of struct<start, kind, end> in code points, end exclusive.

    ``kind`` indexes ``KINDS``; ``found`` holds what the battery adds, outside base
    spans.  Parts of a candidate that is reported itself are not reported again.
    """
    found = spool(judge(docs), "secrets")
    limits = _thresholds(found, rate)
    kept = F.flatten(F.transform("tokens", lambda t: F.when(_accepted(t["whole"], limits), F.array(t["whole"])).otherwise(F.filter(t["parts"], lambda x: _accepted(x, limits)))))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))).alias("found"))


def _accepted(t: Column, limits: dict[int, int]) -> Column:
    out = F.lit(False)
    for k in limits:
        out = out | ((t["stratum"] == k) & (t["step"] >= limits[k]))
    return out


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
