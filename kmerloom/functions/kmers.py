"""Sliding windows over aligned sequences and k-mer codes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.alphabet import NUCLEOTIDE_VALID, PROTEIN, PROTEIN_VALID, Alphabet, is_valid, normalized

# Largest and default window of the two standard alphabets.
MOST_K = {"protein": 14, "nucleotide": 27}
DEFAULT_K = {"protein": 9, "nucleotide": 27}
#: Digits of k-mer codes, in order.
DIGITS = {"protein": PROTEIN_VALID, "nucleotide": NUCLEOTIDE_VALID}


def check_k(k: int | None, a: Alphabet) -> int:
    k = DEFAULT_K.get(a.name, 9) if k is None else k
    most = MOST_K.get(a.name)
    if k < 1 or most and k > most:
        raise ValueError(f"k is 1 to {most or 'the length of the alignment'} here, not {k}")
    return k


def windows(rows: DataFrame, k: int, a: Alphabet = PROTEIN, keep: tuple[str, ...] = ("seq_id",), valid_only: bool = True) -> DataFrame:
    """(keep, position from 1, kmer). Windows with a character that is not valid are left out, or are "NA" if ``valid_only`` is false.

    Sequences shorter than k have none. The explode is narrow; nothing is shuffled.
    """
    each = _cut(rows, k, a, keep)
    return each.where("kmer IS NOT NULL") if valid_only else each.fillna("NA", "kmer")


def _cut(rows: DataFrame, k: int, a: Alphabet, keep: tuple[str, ...]) -> DataFrame:
    """(keep, position, kmer), null for windows that are not valid.

    Characters that are not valid become a mark once a sequence, so that a window needs no regex. Where all valid characters are ASCII, a
    marked sequence is too, and windows are cut from its bytes: a cut from a string walks there from the start.
    """
    mark = next(c for c in map(chr, range(len(a.valid) + 1)) if c not in a.valid)
    s = F.regexp_replace(normalized(F.col("sequence"), a), a.none_of(a.valid), mark)
    ascii_only = a.valid.isascii()
    own = rows.where(F.length("sequence") >= k).select(*keep, (s.cast("binary") if ascii_only else s).alias("__s"))
    each = own.select(*keep, "__s", F.explode(F.sequence(F.lit(1), F.length("__s") - (k - 1))).alias("position"))
    cut = F.substring("__s", F.col("position"), F.lit(k))
    fine = ~F.contains(cut, F.lit(mark.encode() if ascii_only else mark))
    return each.select(*keep, "position", F.when(fine, cut.cast("string")).alias("kmer"))


def collapsed(rows: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """(sequence, fields, weight): equal sequences with equal fields as one row. Every statistic is a function of counts."""
    return rows.groupBy("sequence", *fields).agg(F.count(F.lit(1)).alias("weight"))


def count_kmers(rows: DataFrame, k: int, a: Alphabet = PROTEIN, collapse: bool = False, gaps: bool = False) -> DataFrame:
    """(position, kmer, count). Map-side partial counts keep conserved positions from skewing the shuffle.

    ``collapse`` makes equal sequences one row first, which shuffles every distinct sequence: it pays where most sequences repeat.
    ``gaps`` also counts the windows that are not valid, as a null k-mer: such counts hold every position of the alignment.
    """
    own = collapsed(rows) if collapse else rows.select("sequence", F.lit(1).cast("long").alias("weight"))
    each = _cut(own, k, a, ("weight",)) if gaps else windows(own, k, a, ("weight",))
    return each.groupBy("position", "kmer").agg(F.sum("weight").alias("count"))


def occurrences(rows: DataFrame, k: int, a: Alphabet = PROTEIN) -> DataFrame:
    """(position, kmer, seq_id): where each k-mer occurs, a row for each occurrence."""
    return windows(rows, k, a).select("position", "kmer", "seq_id")


def spine(rows: DataFrame, k: int) -> DataFrame:
    """All positions of the alignment, also those without a valid window."""
    longest = rows.agg(F.max(F.length("sequence")).alias("n")).where(F.col("n") >= k)
    return longest.select(F.explode(F.sequence(F.lit(1), F.col("n") - (k - 1))).alias("position"))


def shape(rows: DataFrame) -> DataFrame:
    """One row: sequences, min_length, max_length."""
    return rows.agg(F.count(F.lit(1)).alias("sequences"), F.min(F.length("sequence")).alias("min_length"), F.max(F.length("sequence")).alias("max_length"))


def uneven(rows: DataFrame) -> DataFrame:
    """Rows whose length differs from that of the first sequence (smallest seq_id)."""
    first = rows.agg(F.min_by(F.length("sequence"), "seq_id").alias("__first"))
    return rows.crossJoin(F.broadcast(first)).where(F.length("sequence") != F.col("__first")).drop("__first")


def check_alignment(rows: DataFrame, k: int, threshold: int | None = None) -> int:
    """Stop on no sequences, unequal lengths, or sequences all shorter than k; warn of a threshold above the number of sequences, which
    is returned."""
    r = shape(rows).first()
    if not r["sequences"]:
        raise ValueError("there are no sequences")
    if r["min_length"] != r["max_length"]:
        raise ValueError(f"aligned sequences have one length; these have {r['min_length']} to {r['max_length']}")
    if r["max_length"] < k:
        raise ValueError(f"all sequences are shorter than k = {k}")
    if threshold is not None and threshold > r["sequences"]:
        warnings.warn(f"the support threshold {threshold} is above the number of sequences, {r['sequences']}", stacklevel=2)
    return r["sequences"]


def encode(kmer: Column, a: Alphabet = PROTEIN) -> Column:
    """The k-mer as a number with the alphabet's characters as digits; null if it holds any other character or would overflow."""
    digits = DIGITS.get(a.name, a.valid)
    most = MOST_K.get(a.name, int(63 / len(digits).bit_length()))
    code = F.aggregate(F.split(kmer, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * len(digits) + F.instr(F.lit(digits), c) - 1))
    return F.when(is_valid(kmer, a) & (F.length(kmer) <= most), code)


def decode(code: Column, k: int, a: Alphabet = PROTEIN) -> Column:
    digits = DIGITS.get(a.name, a.valid)
    n = len(digits)
    powers = F.array(*[F.lit(n**i).cast("long") for i in range(k - 1, -1, -1)])
    digit = F.transform(powers, lambda p: F.call_function("div", code, p))
    return F.when(code.isNotNull(), F.array_join(F.transform(digit, lambda d: F.substring(F.lit(digits), F.pmod(d, F.lit(n)).cast("int") + 1, F.lit(1))), ""))
