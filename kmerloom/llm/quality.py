"""Quality classifier on supervised subword embeddings.

A word's vector is the mean of learned rows for its hashed form and its hashed character n-grams; a document's vector is the mean over its
words and over pseudo-words that mark repeats; softmax over two classes. Rows and output are trained together by numpy
stochastic gradient descent in one task, on a bounded sample of labelled rows; scoring runs over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import let_go, ship, sliced, table

#: At most so many labelled rows, and so many bytes of their texts, train the model: those with the smallest hash of their id and text.
#: The bounds of the one training task.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 8_000, 128 << 20
BUCKETS = 1 << 15
DIM = 8
#: Passes over the sample, whatever its size.
EPOCHS = 5
RATE = 0.2
BATCH = 8
SEED = 17
THRESHOLD = 0.3
CACHE_WORDS = 200_000
#: Pseudo-words: a word equal to the one before it, and a word not equal.
_SAME, _OTHER = 0, 1


#: Character classes by code point: 1 upper, 2 other letters, 3 digits, else the code point itself; beyond the table, letters.
_CLASS = np.array([1 if chr(i).isupper() else 2 if chr(i).isalpha() else 3 if chr(i).isdigit() else i + 4 for i in range(0x2400)], np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _PRIME
    h ^= h >> np.uint64(31)
    return (2 + (h * _PRIME >> np.uint64(33)) % np.uint64(BUCKETS - 2)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features and which word each belongs to: a word's whole form, its shape (runs of a class of characters as one) and its
    character n-grams of 2 to 4, with the ends marked. Words are not empty."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.minimum(np.arange(len(chars)) - starts[of], len(_POWERS) - 1)
    whole = np.add.reduceat(chars * _POWERS[place], starts)
    cls = np.where(chars < len(_CLASS), _CLASS[np.minimum(chars, len(_CLASS) - 1).astype(np.int64)], 2)
    turn = np.ones(len(chars), bool)
    turn[1:] = (cls[1:] != cls[:-1]) | (of[1:] != of[:-1])
    rank = np.cumsum(turn)
    rank = np.minimum(rank - rank[starts][of], len(_POWERS) - 1)
    shape = np.add.reduceat(np.where(turn, cls * _POWERS[rank], 0), starts)
    ids, owner = [_bucket(whole, 1), _bucket(shape, 2)], [np.arange(len(words))] * 2
    gram = chars
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        inside = of[: len(gram)] == of[n - 1 :]
        ids.append(_bucket(gram[inside], n))
        owner.append(of[: len(gram)][inside])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], owner[order]


class Words:
    """Vectors of words met so far; a full cache keeps what it has."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.at = vectors, {}
        self.rows = np.zeros((1024, vectors.shape[1]), np.float32)

    def learn(self, new: list[str]) -> None:
        n = len(self.at)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))
        if len(self.at) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(self.at) - len(self.rows)), self.rows.shape[1]), np.float32)])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids, owner = features(part)
            ends = np.searchsorted(owner, np.arange(1, len(part) + 1))
            sums = np.concatenate([np.zeros((1, self.vectors.shape[1])), np.cumsum(self.vectors[ids], 0, dtype=np.float64)])[ends]
            sums[1:] -= sums[:-1].copy()
            self.rows[n + i : n + i + len(part)] = sums / np.diff(ends, prepend=0)[:, None]

    def means(self, docs: list[list[str]]) -> np.ndarray:
        """Mean vector of each document's words and pseudo-words."""
        at = self.at
        new = list(set().union(*docs).difference(at))
        if new:
            self.learn(new)
        out = np.zeros((len(docs), self.vectors.shape[1]))
        for i, words in enumerate(docs):
            if words:
                codes = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                same = int((codes[1:] == codes[:-1]).sum())
                total = self.rows[codes].sum(0, dtype=np.float64)
                out[i] = (total + same * self.vectors[_SAME] + (len(words) - same) * self.vectors[_OTHER]) / (2 * len(words))
        if len(at) > CACHE_WORDS:
            for w in new:
                del at[w]
        return out


def train(texts: list[str | None], labels: list[int], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (BUCKETS x DIM) and output (DIM + 1 x 2) by stochastic gradient descent over shuffled mini-batches."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out = np.zeros((DIM + 1, 2), np.float32)
    out[:DIM] = rng.normal(0, 0.1, (DIM, 2))
    bags = []
    for t in texts:
        words = (t or "").split()
        if not words:
            bags.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        same = sum(map(str.__eq__, words, words[1:])) / len(words)
        counts = Counter(words)
        ids, owner = features(list(counts))
        weights = (np.fromiter(counts.values(), np.float64, len(counts)) / np.bincount(owner))[owner] / (2 * len(words))
        bag, at = np.unique(np.concatenate([ids, [_SAME, _OTHER]]), return_inverse=True)
        bags.append((bag.astype(np.int32), np.bincount(at, np.append(weights, [same / 2, (1 - same) / 2])).astype(np.float32)))
    y = np.array(labels, np.int64)
    # step sizes adapt to each weight by its sum of squared gradients, as rare n-grams get few
    vectors_sq, out_sq = np.full(vectors.shape, 1e-10, np.float32), np.full(out.shape, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            hidden = np.stack([bags[i][1] @ vectors[bags[i][0]] if len(bags[i][0]) else np.zeros(DIM, np.float32) for i in own])
            logits = hidden @ out[:DIM] + out[DIM]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            back = p @ out[:DIM].T
            g = np.concatenate([hidden.T @ p, p.sum(0, keepdims=True)]) / len(own)
            out_sq += g * g
            out -= rate * g / np.sqrt(out_sq)
            for j, i in enumerate(own):
                ids, weight = bags[i]
                if len(ids):
                    g = weight[:, None] * back[j]
                    vectors_sq[ids] += g * g
                    vectors[ids] -= rate * g / np.sqrt(vectors_sq[ids])
    return vectors, out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``, trained by one task on at most ``max_rows`` rows and ``max_bytes``
    bytes of text.

    Rows without a label of 0 or 1, ids that have both labels, and null texts do not train; rows that repeat an id and a text train once;
    with no labelled rows at all, every score is 0.5. What comes back to the driver is the model, of fixed size.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text", F.lit(SEED)).alias("h"), "text")
    keys = own.select("id", "h", F.octet_length("text").alias("n")).join(marks, "id").groupBy("id", "h").agg(F.max("n").alias("n"), F.max("y").alias("y"))
    # the bounds are applied to keys of rows, of which there are max_rows at most from here on; only the chosen texts are shuffled
    order = [F.xxhash64("id", "h"), F.col("id"), F.col("h")]
    some = keys.orderBy(*order).limit(max_rows)
    chosen = some.withColumn("sum", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= max_bytes).select("id", "h", "y")
    rows = own.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y")).select("id", "text", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        got = sorted((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=lambda r: (r[0], r[1]))
        vectors, out = train([r[1] for r in got], [r[2] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([vectors.tobytes()]), pa.array([out.tobytes()])], names=["vectors", "out"])

    model = rows.repartition(1).mapInArrow(learn, "vectors binary, out binary").first()
    if model is None:
        return np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM + 1, 2), np.float32)
    return np.frombuffer(bytes(model["vectors"]), np.float32).reshape(BUCKETS, DIM), np.frombuffer(bytes(model["out"]), np.float32).reshape(DIM + 1, 2)


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, score): ``row`` is a struct of all columns of docs, so no name of theirs meets one of ours."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        vectors, out = held.value
        words = Words(vectors)
        for b in sliced(batches):
            # the text is taken from the row: a column beside it would send it twice
            texts = [t or "" for t in b.column(0).flatten()[at].to_pylist()]
            hidden = np.concatenate([np.zeros((0, DIM))] + [words.means([t.split() for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)])
            logits = hidden @ out[:DIM] + out[DIM]
            p = 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["row", "score"])

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return own.mapInArrow(scored, T.StructType([own.schema["row"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs with ``__score``, the probability of label 1. Null, empty and blank texts get what the output's bias says; other columns pass through
    whatever their names, but for ``__score``, which is replaced."""
    return _scored(docs, model).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "__score"], F.col("score").alias("__score"))


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def model_of(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """Trained on labelled documents whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(table(spark, sf_dir, "documents").where(~_held_out()), table(spark, sf_dir, "labels").where(~_held_out()))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, model_of(spark, sf_dir))
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least the threshold, with all their columns."""
    return _scored(docs, model).where(F.col("score") >= threshold).select("row.*")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
