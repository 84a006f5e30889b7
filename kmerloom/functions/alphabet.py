"""Alphabets and what they say about characters, as column expressions."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PROTEIN_VALID = "ACDEFGHIKLMNPQRSTVWY"
PROTEIN_AMBIGUOUS = "XBJZOU"
NUCLEOTIDE_VALID = "ACGTU"
NUCLEOTIDE_AMBIGUOUS = "RYKMSWBDHVN"
GAPS = "-."
MOST_VALID = 253


@dataclass(frozen=True)
class Alphabet:
    """Sets of characters. Lower case counts as invalid unless ``allow_lowercase``, which makes sequences upper case first."""

    name: str
    valid: str
    ambiguous: str = ""
    gaps: str = GAPS
    allow_lowercase: bool = False

    def __post_init__(self):
        if not self.valid or len(set(self.valid)) > MOST_VALID:
            raise ValueError(f"an alphabet has 1 to {MOST_VALID} valid characters")

    def any_of(self, chars: str) -> str:
        return "[" + "".join(re.escape(c) for c in chars) + "]"

    def none_of(self, chars: str) -> str:
        return "[^" + "".join(re.escape(c) for c in chars) + "]"


PROTEIN = Alphabet("protein", PROTEIN_VALID, PROTEIN_AMBIGUOUS)
NUCLEOTIDE = Alphabet("nucleotide", NUCLEOTIDE_VALID, NUCLEOTIDE_AMBIGUOUS)
_NAMES = {"protein": PROTEIN, "amino_acid": PROTEIN, "aa": PROTEIN, "nucleotide": NUCLEOTIDE, "dna": NUCLEOTIDE, "rna": NUCLEOTIDE}


def alphabet(name: str | Alphabet) -> Alphabet:
    """The alphabet of a name, in any case; an unknown name means protein, with a warning."""
    if isinstance(name, Alphabet):
        return name
    if name.lower() not in _NAMES:
        warnings.warn(f"unknown alphabet {name!r}: taken as protein", stacklevel=2)
    return _NAMES.get(name.lower(), PROTEIN)


def custom(valid: str, ambiguous: str = "", gaps: str = GAPS, allow_lowercase: bool = False) -> Alphabet:
    return Alphabet("custom", valid, ambiguous, gaps, allow_lowercase)


def normalized(sequence: Column, a: Alphabet) -> Column:
    return F.upper(sequence) if a.allow_lowercase else sequence


def is_valid(text: Column, a: Alphabet) -> Column:
    """Not empty and made of valid characters only."""
    return text.rlike(f"^{a.any_of(a.valid)}+$")


def count_of(sequence: Column, a: Alphabet, chars: str) -> Column:
    return (F.length(sequence) - F.length(F.regexp_replace(sequence, a.any_of(chars), ""))).cast("long") if chars else F.lit(0).cast("long")


def class_counts(sequence: Column, a: Alphabet) -> dict[str, Column]:
    """Characters of each class; whatever is in no set is invalid. A character valid in the alphabet counts as that first."""
    s = normalized(sequence, a)
    ambiguous = "".join(c for c in a.ambiguous if c not in a.valid)
    total, valid, amb, gap = F.length(s).cast("long"), count_of(s, a, a.valid), count_of(s, a, ambiguous), count_of(s, a, a.gaps)
    return {"total": total, "valid": valid, "ambiguous": amb, "gap": gap, "invalid": total - valid - amb - gap}


def classify(char: Column, a: Alphabet) -> Column:
    """Valid, Ambiguous, Gap or Invalid."""
    c = normalized(char, a)
    found = F.when(c.isin(*a.valid), "Valid").when(c.isin(*a.gaps), "Gap")
    return (found.when(c.isin(*a.ambiguous), "Ambiguous") if a.ambiguous else found).otherwise("Invalid")


def invalid_characters(rows: DataFrame, a: Alphabet = PROTEIN, strict: bool = False, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(keys, place from 0, char, class): invalid characters, and ambiguous ones in strict mode; never gaps.

    Only rows that hold such a character are exploded.
    """
    fine = a.valid + a.gaps + ("" if strict else a.ambiguous)
    s = normalized(F.col("sequence"), a)
    bad = rows.where(s.rlike(a.none_of(fine)))
    each = bad.select(*keys, F.posexplode(F.split(F.col("sequence"), "")).alias("place", "char")).where("char <> ''")
    kept = ("Invalid", "Ambiguous") if strict else ("Invalid",)
    return each.withColumn("class", classify(F.col("char"), a)).where(F.col("class").isin(*kept))


def unique_invalid_characters(rows: DataFrame, a: Alphabet = PROTEIN) -> DataFrame:
    return invalid_characters(rows, a, keys=()).select("char").distinct()
