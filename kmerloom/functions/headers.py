"""Header lines into metadata fields."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILL = "Unknown"
MOST_DELIMITERS, MOST_BYTES = 1000, 1_000_000
#: Share of headers that may fail before a run on files stops.
MOST_FAILED = 0.05
# What is stripped from field values (zero-width, directional and format characters, soft hyphen, controls).
INVISIBLE = r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{206F}\x{FEFF}\x{00AD}\x{0000}-\x{001F}\x{007F}-\x{009F}]"


def check_format(fields: Sequence[str]) -> list[str]:
    """The fields of a header format (a sequence or a string with "|"), which must be named, and differ."""
    own = fields.split("|") if isinstance(fields, str) else list(fields)
    own = [f.strip() for f in own]
    if not own or not all(own):
        raise ValueError("a header format needs names for all its fields")
    if len(set(own)) < len(own):
        raise ValueError("a header format names a field twice")
    return own


def wanted(fields: Sequence[str], only: Sequence[str] | None) -> list[str]:
    """Fields in the order of the format, those asked for; unknown names are left out."""
    return [f for f in fields if only is None or f in set(only)]


def parts(header: Column, fill: str = FILL) -> Column:
    trimmed = F.transform(F.split(header, r"\|", -1), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.transform(trimmed, lambda x: F.when(x == "", F.lit(fill)).otherwise(x))


def parsed(header: Column, fields: Sequence[str], fill: str = FILL) -> Column:
    """The values of a header in the order of the format; null if the number differs, one is empty, or it is too long."""
    own = parts(header, fill)
    fits = (F.size(own) == len(fields)) & (F.size(own) <= MOST_DELIMITERS + 1) & (F.octet_length(header) <= MOST_BYTES) & F.forall(own, lambda x: x != "")
    return F.when(fits, F.transform(own, lambda x: F.regexp_replace(x, INVISIBLE, "")))


def with_fields(rows: DataFrame, fields: Sequence[str], fill: str = FILL, only: Sequence[str] | None = None) -> DataFrame:
    """rows with a nullable column for each field asked for; all null where the header does not parse."""
    fields = check_format(fields)
    out = rows.withColumn("__parts", parsed(F.col("header"), fields, fill))
    keep = wanted(fields, only)
    return out.select(*[c for c in rows.columns if c not in keep], *[F.element_at("__parts", fields.index(f) + 1).alias(f) for f in keep])


def diagnostics(rows: DataFrame, fields: Sequence[str], fill: str = FILL) -> DataFrame:
    """One row: records, header_parse_failures, failure_rate."""
    bad = F.count_if(parsed(F.col("header"), check_format(fields), fill).isNull())
    n = F.count(F.lit(1))
    return rows.agg(n.alias("records"), bad.alias("header_parse_failures"), F.coalesce(bad / n, F.lit(0.0)).alias("failure_rate"))


def check_headers(rows: DataFrame, fields: Sequence[str], fill: str = FILL, most: float | None = MOST_FAILED) -> None:
    """Stop if more than the share ``most`` of headers fails (None: only warn)."""
    r = diagnostics(rows, fields, fill).first()
    if r["failure_rate"] > (MOST_FAILED if most is None else most):
        said = f"{r['header_parse_failures']} of {r['records']} headers do not match the format"
        if most is not None:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)


def detect_format(rows: DataFrame, sample: int | None = 5) -> DataFrame:
    """One row: delimiter, fields and format of the first ``sample`` headers (None: all): the delimiter that cuts all headers into
    the same number of fields, above one, largest number first, then in the order | tab ; ,"""
    heads = rows.select("seq_id", "header")
    heads = heads if sample is None else heads.orderBy("seq_id").limit(sample)
    sizes = [F.size(F.split("header", d, -1)) for d in (r"\|", "\t", ";", ",")]
    cut = heads.agg(*[x for i, s in enumerate(sizes) for x in (F.min(s).alias(f"lo{i}"), F.max(s).alias(f"hi{i}"))])
    names = ["|", "\t", ";", ","]
    same = F.array(*[F.struct(F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(0).alias("n"), F.lit(-i).alias("i")) for i in range(4)])
    best = F.array_max(F.filter(same, lambda x: x["n"] > 1))
    out = cut.select(best.alias("best"))
    some = F.col("best").isNotNull()
    delimiter = F.when(some, F.element_at(F.array(*map(F.lit, names)), F.lit(1) - F.col("best.i")))
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.col("best.n")), lambda i: F.concat(F.lit("field"), i.cast("string"))), "|")
    return out.select(delimiter.alias("delimiter"), F.when(some, F.col("best.n")).otherwise(0).alias("field_count"), F.when(some, F.replace(listed, F.lit("|"), delimiter)).alias("format"))
