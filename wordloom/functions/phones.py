"""Phone labels, sequence distances and the boundary predicate, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mark silence.
SILENCES = ("sp", "sil", "spn", "")
#: First code point that stands for an integer unit in an encoded sequence, and how many there are.
UNIT_BASE, UNITS = 0x10000, 0x100000


def _sounding(phones: Column) -> Column:
    return F.filter(phones, lambda p: ~p.isin(*SILENCES))


def clean_phones(phones: Column, mandarin: bool = False) -> Column:
    """Drop silence labels; unless ``mandarin``, then strip digits and fold case.

    Silence is told from the label as it is, so ``SIL`` stays, as ``sil``.
    """
    sounding = _sounding(phones)
    return sounding if mandarin else F.transform(sounding, lambda p: F.lower(F.regexp_replace(p, r"\d+", "")))


def clean_phones_stripped(phones: Column) -> Column:
    """The analysis variant: strip white space first, test for silence, strip digits, fold case."""
    stripped = F.transform(phones, lambda p: F.trim(F.regexp_replace(p, "\n", "")))
    return F.transform(_sounding(stripped), lambda p: F.lower(F.trim(F.regexp_replace(p, r"\d+", ""))))


def code_point(number: Column) -> Column:
    """The character of a code point of U+10000 and up; none of these is a surrogate."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def units_as_text(units: Column) -> Column:
    """Integers as code points, so that the built-in edit distance counts units."""
    wrong = F.raise_error(F.lit(f"units must lie in 0..{UNITS - 1}")).cast("string")
    return F.array_join(F.transform(units, lambda u: F.when((u >= 0) & (u < UNITS), code_point(u.cast("long") + UNIT_BASE)).otherwise(wrong)), "")


def normalised_edit(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Edit distance over the longer length; ``both_empty`` if neither has a symbol."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(both_empty)).otherwise(F.levenshtein(a, b) / longest)


def either_empty_is_one(a: Column, b: Column) -> Column:
    """The evaluation's distance: 1 as soon as a side is empty."""
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(1.0)).otherwise(normalised_edit(a, b))


def boundary_matches(gold_start: Column, gold_end: Column, start: Column, end: Column) -> Column:
    """A fragment matches a gold word that contains it or that it overlaps enough.

    Gold words of 0.06 s and more need 0.03 s of overlap, shorter ones over half
    of their length; both are rounded to hundredths, with a guard for the last bit.
    """
    contains = (gold_start <= start) & (gold_end >= end)
    length = F.round(gold_end - gold_start, 2)
    overlap = F.round(F.least(gold_end, end) - F.greatest(gold_start, start), 2)
    share = F.when(length > 0, overlap / length).otherwise(F.lit(0.0))
    enough = ((length >= 0.06 - 1e-9) & (overlap >= 0.03 - 1e-9)) | ((length < 0.06 - 1e-9) & (share > 0.5))
    return contains | enough
