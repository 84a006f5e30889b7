"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are ranged by doc_id, encoded, and written in ascending order, a file for each range; stripes are read in parallel, and
readers that ask for some doc_ids skip stripes and row groups by the indexes. A worker keeps the ids of chunks it has met.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import fresh_path, kept, ship, table, written

END = 2
CACHE_CHUNKS = 400_000
#: Bytes of texts for which a range is made; no input has fewer ranges than shuffle partitions.
RANGE_BYTES = 128 << 20
#: Rows of a row group of the index, bytes of a stripe.
INDEX_ROWS, STRIPE_BYTES = 1000, 16 << 20
SCHEMA = "doc_id long, part int, place long, ids array<int>"
#: A digit, which the tokenizer's split keeps by itself.
_MARK = "0"
#: Punctuation that may follow a word; special tokens end in none of it.
_TAIL = ".,;:!?*&%$#"
#: Letters that the tokenizer's normalizer leaves alone but for their case, one for one, and such a tail: one word of its split, then one of punctuation.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?*&%$#]*)").fullmatch
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


class Coder:
    """The tokenizer of a file, asked once for each space-separated chunk it has not met (its split never crosses white space)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        only = self._ids(_MARK)
        self.mark = only[0] if len(only) == 1 else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool) if suffix else None
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, new: list[str]) -> None:
        """Put the ids of new chunks into the cache. A chunk that ends in ASCII punctuation after a letter is cut there, as the
        tokenizer cuts it; plain words go in lower case, as it makes them; so fewer are new to it."""
        cut = [m.groups() if m else None for m in map(_PLAIN, new)]
        odd = [i for i, x in enumerate(cut) if x is None]
        for i in odd:
            c = new[i]
            b = c.rstrip(_TAIL)
            cut[i] = (b, c[len(b) :]) if b and b[-1].isalpha() and b[-1].isascii() else (c, "")
        bodies, tails = [b for b, _ in cut], [t for _, t in cut]
        rest = [bodies[i] for i in odd]
        for i in odd:
            bodies[i] = ""
        bodies = list(map(str.lower, bodies))
        pieces = self.pieces
        plain = list(set(bodies).difference(pieces))
        other = list(set(rest).union(tails).difference(pieces, plain))
        self.ask_words(plain)
        self.ask(other)
        for i, b in zip(odd, rest, strict=True):
            bodies[i] = b
        self.cache.update(zip(new, [pieces[b] + pieces[t] for b, t in zip(bodies, tails, strict=True)], strict=True))
        full = len(pieces) > CACHE_CHUNKS
        for c in (c for x in (plain, other) for c in x if full or len(c) > 1000):
            del pieces[c]

    def ask_words(self, new: list[str]) -> None:
        """Put the tokenizer's ids of new plain words among the pieces. Many go as one text; as each is one word of its split, it ends with the one id
        that marks the end of a word. Where the numbers of both differ, they are asked with marks between."""
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            ids = np.array(self._ids(" ".join(part)), "<i4") if self.last is not None else np.empty(0, "<i4")
            ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else ids
            if len(ends) != len(part) or ends[-1] != len(ids):
                self.ask(part)
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def ask(self, new: list[str]) -> None:
        """Put the tokenizer's ids of new pieces among the pieces. Many go as one text with marks between, a word that none of them holds and that has an id
        to itself, as a call for each costs more than its ids."""
        plain = [c for c in new if _MARK not in c] if self.mark is not None else []
        for at in range(0, len(plain), 5000):
            part = plain[at : at + 5000]
            ids = np.array(self._ids(f" {_MARK} ".join(part)), "<i4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(part):
                plain = plain[:at]
                break
            raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1] + 1))
            self.pieces.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))
        rest = [c for c in new if c not in self.pieces]
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            done = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.pieces.update((c, np.array(e.ids, "<i4").tobytes()) for c, e in zip(part, done, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without special tokens."""
        # what Python calls white space and the tokenizer does not: such texts are split at plain ASCII space only
        split = [_SPACE.split(t) if _ODD.search(t) else t.split() for t in texts]
        cache = self.cache
        new = list(set().union(*split).difference(cache))
        self.learn(new)
        out = [b"".join(map(cache.__getitem__, chunks)) for chunks in split]
        # what comes early comes often: a full cache keeps what it has
        for c in new if len(cache) > CACHE_CHUNKS else [c for c in new if len(c) > 1000]:
            del cache[c]
        return out


def coder(path: str) -> Coder:
    return kept(("token_orc", path), lambda: Coder(path))


def _file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str, end: int):
    tail = np.array([end], "<i4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from kmerloom.llm import token_orc

        own, part, place = token_orc.coder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = [x + tail for x in own.encode([t or "" for t in b.column(1).to_pylist()])]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), lists], names=["doc_id", "part", "place", "ids"])
                place += n

    return encode


def _ranges(docs: DataFrame) -> int:
    """Ranges for docs: as many as the bytes of their texts, which one aggregate sums, ask for."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // RANGE_BYTES))


def _fixed(values: list, kind: str) -> Column:
    """A constant array, made of one string: many values need no expression each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _ranged(docs: DataFrame, n: int) -> DataFrame:
    """docs dealt by n ranges of doc_id of about equal number, a null being the smallest. The bounds come from the ids alone: a sort by range would
    read all texts to sample them. A row's range is found by halving, so many ranges cost little. An id at which several ranges end
    has that many for itself, over which its rows are dealt by a hash of the text, so no id is bound to one task."""
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    cuts = docs.agg(F.percentile_approx(key, _fixed([i / n for i in range(1, n)], "double"), max(10_000, 4 * n))).first()[0] if n > 1 else None
    ends = sorted(Counter(cuts or []).items())
    if not ends:
        return docs.repartition(1)
    steps = len(ends).bit_length()
    spare = (1 << steps) - 1 - len(ends)
    bounds = _fixed([v for v, _ in ends] + [(1 << 63) - 1] * spare, "bigint")
    shares = _fixed([c for _, c in ends] + [1] * (spare + 1), "int")
    firsts = _fixed([0, *accumulate(c for _, c in ends)] + [0] * spare, "int")
    halves = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    # how many bounds are below the id
    below = F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.element_at(bounds, at + h) < key, at + h).otherwise(at))
    own = docs.withColumn("__below", below)
    at = F.col("__below") + 1
    hot = (F.element_at(shares, at) > 1) & (at <= len(ends)) & (F.get(bounds, F.col("__below")) == key)
    part = F.element_at(firsts, at) + F.when(hot, F.pmod(F.xxhash64("text"), F.element_at(shares, at)).cast("int")).otherwise(0)
    return own.repartitionById(sum(c for _, c in ends) + 1, part).drop("__below")


def write_tokens(docs: DataFrame, at: str, path: str | None = None, end: int = END) -> None:
    """Write the ids of ``docs(doc_id, text)`` with ``end`` after each document to ORC files under ``at``.

    Rows are (doc_id, part, place, ids), ascending by doc_id over parts and within them; rows of one doc_id are ordered by text within a part, null
    ids come first; null and empty texts have the end id only; other columns are ignored. The tokenizer's path must hold on executors.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = _ranged(own, _ranges(own)).sortWithinPartitions("doc_id", "text").mapInArrow(_encoder(path or _file(), end), SCHEMA)
    (
        coded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.encoding.strategy", "SPEED")
        .option("compression", "snappy")
        .orc(at)
    )


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, part, place, ids) of the files under ``at``; filters on doc_id skip stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(at)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(values)).cast("B")
        sums = np.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums)], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def starts(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files; sums run within a part, and over the list of parts."""
    ship(spark)
    rows = written(read_tokens(spark, at).mapInArrow(_measure, "doc_id long, part int, place long, n_tokens long, ids_crc32 long"), "measured")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("__before"))
    own = rows.withColumn("__within", before(Window.partitionBy("part").orderBy("place")))
    return own.join(parts, "part").select("doc_id", (F.col("__before") + F.col("__within")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), at)
    return starts(spark, at)


QUERIES = {"op9_token_orc": op9_token_orc}
ORACLES: dict[str, str] = {}
