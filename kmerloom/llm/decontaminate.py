"""Benchmark decontamination with a generalised suffix automaton over the normalised test items.

Items are dealt to blocks of about ``block_words`` words by a hash; each block's automaton is built in a task and written to the shared
folder. Documents pass ``AT_ONCE`` automatons at a time in the same tasks, without a shuffle, so what is broadcast at once has a fixed
bound; where there are more, each pass writes what it found, which is then merged by document. A document's words are streamed
through the transitions while the length of the longest match is tracked; runs of words that no item holds, or too
short for any window, reset the match and are skipped.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import let_go, ship, sliced, table, written

WINDOW = 10
BLOCK_WORDS = 200_000
#: Automatons that a task holds at once.
AT_ONCE = 2
MAX_COVERAGE = 0.5
#: A-Z to a-z; 0-9, a-z and all bytes from 0x80 on are word bytes, the rest separate words.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; every state knows the windows that end a match reaching it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in seq]) for item, seq in items if seq]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        found: list[dict[int, set[str]]] = [{} for _ in self.next]
        self.least = min((min(window, len(s)) for _, s in coded), default=window)
        for item, seq in coded:
            size, state, length = min(window, len(seq)), 0, 0
            for i, c in enumerate(seq):
                state, length = self.step(state, length, c)
                if i + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    found[at].setdefault(size, set()).add(item)
        # windows at a state and at its suffixes, longest first
        self.ends: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.ends[self.link[v]] if v else ()
            own = tuple((n, tuple(sorted(x))) for n, x in sorted(found[v].items(), reverse=True))
            self.ends[v] = own + above

    def _extend(self, last: int, c: int) -> int:
        to = self.next[last].get(c)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, to, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        to = self.next[state].get(c)
        while to is None and state:
            state = self.link[state]
            length = self.length[state]
            to = self.next[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans that windows cover, merged and in order, and the items whose windows occur."""
        get = self.vocab.get
        codes = np.fromiter((get(w, -1) for w in seq), np.int64, len(seq))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        known: set[int] = set()
        runs = edges.reshape(-1, 2)
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist():
            state = length = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                state, length = self.step(state, length, c)
                if length >= self.least and (ends := self.ends[state]):
                    widest = 0
                    for size, names in ends:
                        if size <= length:
                            widest = max(widest, size)
                            if id(names) not in known:
                                known.add(id(names))
                                items.update(names)
                    if widest:
                        start = i - widest
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i))
        return spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _raw(b: pa.RecordBatch) -> pa.Array:
    """The texts as UTF-8, in the memory of the batch."""
    return b.column(b.schema.names.index("text")).cast(pa.binary())


#: What the matcher adds to a row.
FOUND = "__words long, __spans array<struct<start:int,end:int>>, __items array<string>"
_OURS = ("__words", "__spans", "__items")
_SPANS, _ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())


def _matcher(held: list, cut: bool):
    """Adds what the held automatons find to the columns of FOUND. cut: the spans leave the text; each covers a whole window of an item,
    so a short one is a whole short item."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        autos: list[Automaton] = [pickle.loads(h.value) for h in held]
        for b in sliced(batches):
            n_words, spans, items = [], [], []
            for text in _raw(b):
                seq = words(text.as_py())
                own: list[tuple[int, int]] = []
                found: set[str] = set()
                for auto in autos:
                    s, names = auto.scan(seq)
                    own, found = _merged(own, s) if own else s, found | names
                n_words.append(len(seq))
                spans.append([{"start": x, "end": y} for x, y in own])
                items.append(sorted(found))
            yield _with(b, cut, n_words, spans, items)

    return match


def _with(b: pa.RecordBatch, cut: bool, n_words: list, spans: list, items: list) -> pa.RecordBatch:
    names = [k for k in b.schema.names if k not in ("__words", "__spans", "__items")]
    own = [b.column(k) for k in names]
    if cut and any(spans):
        at = names.index("text")
        own[at] = pa.array([_cut(t.as_py(), s) for t, s in zip(own[at], spans, strict=True)], b.schema.field("text").type)
    return pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=[*names, "__words", "__spans", "__items"])


def _finisher(cut: bool):
    """Makes one of spans, found by several passes, that meet; and cuts."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans = [[{"start": x, "end": y} for x, y in _merged([(s["start"], s["end"]) for s in own or ()], [])] for own in b.column("__spans").to_pylist()]
            yield _with(b, cut, [len(words(t.as_py())) for t in _raw(b)], spans, [x or [] for x in b.column("__items").to_pylist()])

    return finish


def automatons(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, automaton) of ``benchmark(item_id, text)``: a pickled Automaton for each block, built by tasks; a written table."""
    ship(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))

    def build(rows: pa.Table) -> pa.Table:
        own = sorted(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True))
        auto = Automaton([(item, words(text.encode("utf-8", "surrogatepass"))) for item, text in own], window)
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "automaton": pa.array([pickle.dumps(auto, 5)], pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"), "automatons")


def _one_by_one(built: DataFrame) -> Iterator[bytes]:
    """The automatons, of which the driver holds one at a time."""
    for (block,) in sorted(built.select("block").collect()):
        yield bytes(built.where(F.col("block") == block).first()["automaton"])


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, cut: bool, at_once: int) -> DataFrame:
    """(__row, text, __words, __spans, __items): ``__row`` is a struct of all other columns of docs, so no name of theirs meets one of ours."""
    spark = docs.sparkSession
    ship(spark)
    built = automatons(benchmark, window, block_words)
    n = built.count()
    found = T._parse_datatype_string(FOUND).fields
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(True).alias("none")]
    own = docs.select(F.struct(*others).alias("__row"), "text")
    send = spark.sparkContext.broadcast
    if n <= at_once:
        held = [send(a) for a in _one_by_one(built)] or [send(pickle.dumps(Automaton([], window)))]
        return own.mapInArrow(_matcher(held, cut), T.StructType([*own.schema.fields, *found]))
    # more than a task can hold: every pass writes the spans it found, by number of row, and lets its automatons go
    own = written(own.withColumn("__number", F.monotonically_increasing_id()), "documents")
    held, passes = [], []

    def run() -> None:
        key = own.select("__number", "text")
        hits = key.mapInArrow(_matcher(held, False), T.StructType([*key.schema.fields, *found])).where(F.size("__items") > 0)
        passes.append(written(hits.select("__number", "__spans", "__items"), "pass"))
        for h in held:
            h.destroy()
        held.clear()

    for auto in _one_by_one(built):
        held.append(send(auto))
        if len(held) == at_once:
            run()
    if held:
        run()
    each = reduce(DataFrame.unionByName, passes)
    merged = each.groupBy("__number").agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    # a table of the rows that were hit, of known size: the texts are only shuffled if it is too large to send
    both = own.join(written(merged, "hits"), "__number", "left").select("__row", "text", F.lit(None).cast("long").alias("__words"), "__spans", "__items")
    return both.mapInArrow(_finisher(cut), both.schema)


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """docs with ``__words`` (count), ``__spans`` (word spans inside windows, merged) and ``__items`` (ids of items found).

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. Null and blank texts have no words; items
    without words have no windows; a null item_id is written "null"; repeated items count once; an empty benchmark finds
    nothing; other columns of docs pass through, but for those three names, which are replaced. With ``cut`` the
    spans also leave the text, see ``decontaminate``.
    """
    docs = docs.drop(*_OURS)
    found = _matched(docs, benchmark, window, block_words, cut, at_once)
    return found.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns], "__words", "__spans", "__items")


def _cut(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for s in spans:
        out.append(raw[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without benchmark passages.

    All spans are cut from the text, those of items shorter than a window too; a document of which spans cover more than
    ``max_coverage`` goes. Documents that hold no passage stay as they are, null texts too; other columns pass through, but
    those named as ``match`` names its own are dropped; see there for other cases.
    """
    found = _matched(docs, benchmark, window, block_words, True, AT_ONCE)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.where(hit <= F.col("__words") * F.lit(max_coverage)).select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns if c not in _OURS])


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def plain_hits(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Brute force for tests: words, words hit, items found."""
    seq = words(text.encode() if text is not None else None)
    hit, found = [False] * len(seq), set()
    for item, t in items:
        own = words(t.encode())
        size = min(window, len(own))
        if not size:
            continue
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(seq) - size + 1):
            if tuple(seq[i : i + size]) in grams:
                found.add(item)
                hit[i : i + size] = [True] * size
    return len(seq), sum(hit), sorted(found)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {_SQL_WORDS} AS w FROM benchmark),
s AS (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM s, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
x AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM d, (SELECT DISTINCT size FROM s), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
h AS (SELECT r, size, i, item FROM x JOIN g USING (size, gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""
}
