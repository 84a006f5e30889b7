"""The whole analysis: from aligned rows to summary, positions and variants."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kmerloom.functions import headers
from kmerloom.functions.alphabet import Alphabet, alphabet
from kmerloom.functions.kmers import check_alignment, check_k, count_kmers
from kmerloom.operators import diversity
from kmerloom.operators.entropy import with_entropy
from kmerloom.sources.shared import stored


@dataclass(frozen=True)
class Analysis:
    summary: DataFrame
    positions: DataFrame
    variants: DataFrame


def analyze(
    rows: DataFrame,
    k: int | None = None,
    threshold: int = 100,
    name: str = "",
    header_format: str | Sequence[str] | None = None,
    kind: str | Alphabet = "protein",
    fill: str = headers.FILL,
    metadata_fields: Sequence[str] | None = None,
    mode: str = "expected",
    seed: int = 0,
    collapse: bool = False,
    check: bool = True,
    stream: bool = False,
    store: bool = True,
) -> Analysis:
    """Diversity of ``rows(seq_id, header, sequence)``, which are aligned.

    ``kind`` is an alphabet or its name; ``header_format`` names the fields of headers, ``metadata_fields`` those to count for each variant;
    ``mode`` is that of the entropy correction; ``collapse`` makes equal sequences one row before windows are cut. ``check`` runs the
    aggregates that stop on bad input: unequal lengths, no windows, too many headers that do not parse (a stream only warns).
    ``store`` writes counts and positions once below spark.checkpoint.dir, and all results are read from there; without it each result is a
    plan from the rows on, which are then read for every one.
    """
    a = alphabet(kind)
    k = check_k(k, a)
    if threshold < 1:
        raise ValueError("the support threshold is at least 1")
    if metadata_fields and not header_format:
        warnings.warn("metadata fields are named without a header format: none is counted", stacklevel=2)
    sequences = check_alignment(rows, k, threshold) if check else rows.count()
    counts = count_kmers(rows, k, a, collapse, gaps=True)
    counts = stored(counts, "counts") if store else counts
    own = diversity.position_stats(counts, threshold)
    found = diversity.variants(counts, own)
    stats = with_entropy(own, threshold, mode, seed)
    stats = stored(stats, "positions") if store else stats
    if header_format:
        fields = headers.check_format(header_format)
        if check:
            headers.check_headers(rows, fields, fill, None if stream else headers.MOST_FAILED)
        only = headers.wanted(fields, metadata_fields)
        table = headers.with_fields(rows, fields, fill, only)
        found = diversity.with_metadata(found, diversity.metadata_counts(table, only, k, a)) if only else found
    return Analysis(diversity.summary(stats, sequences, threshold, k, name), stats, found)
