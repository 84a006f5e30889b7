"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

Words (matches of the split pattern) are bucketed by length and laid into padded matrices of byte ids. In each round every row
merges its leftmost pair of minimum rank, found by a hashed pair table, and the row is compacted. A worker keeps the ids of
words and of space-separated chunks it has met, up to a bound; only new words go through the matrices.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import kept, ship, table

CACHE_WORDS = 200_000
_NONE = np.int32(np.iinfo(np.int32).max)
_LONG = 256
#: A pattern of which no match crosses a single space before other text, nor a single line end.
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Ranks of a tiktoken file with a split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, r in ranks.items():
            self.pieces[r] = piece
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, to = [], []
        for piece, r in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(r)
        self._table(np.array(keys, np.uint64), np.array(to, np.int32))
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.spaced = pattern == _SPACED

    def _table(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds: who finds its slot taken tries the next."""
        size = 1 << (int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), np.int64(size - 1)
        self.slots, self.to = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(size, _NONE, np.int32)
        free = np.uint64(0xFFFFFFFFFFFFFFFF)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            here = at[left]
            empty = self.slots[here] == free
            cand, slot = left[empty], here[empty]
            _, one = np.unique(slot, return_index=True)
            self.slots[slot[one]], self.to[slot[one]] = keys[cand[one]], to[cand[one]]
            left = np.setdiff1d(left, cand[one], assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, _NONE where there is none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.to[at], _NONE)
        left = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            slot = self.slots[at[left]]
            hit = slot == keys[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (slot != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def _merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids of words of about equal length, as little-endian unsigned 32-bit integers."""
        n, wide = len(rows), max(map(len, rows))
        size = np.fromiter(map(len, rows), np.int64, n)
        flat = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        held = np.arange(wide) < size[:, None]
        ids = np.zeros((n, wide), np.int32)
        ids[held] = flat
        rank = np.full((n, max(wide - 1, 1)), _NONE, np.int32)
        pairs = held[:, 1:]
        if wide > 1:
            rank[pairs] = self.ranks_of(ids[:, :-1][pairs], ids[:, 1:][pairs])
        out = [b""] * n
        row = np.arange(n)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == _NONE
            if done.any():
                raw, width = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, (r, m) in enumerate(zip(row[done].tolist(), size[done].tolist(), strict=True)):
                    out[r] = raw[i * width : i * width + 4 * m]
                live = ~done
                if not live.any():
                    return out
                wide = int(size[live].max())
                ids, rank, row, size, at, best = ids[live][:, :wide], rank[live][:, : max(wide - 1, 1)], row[live], size[live], at[live], best[live]
            # compaction: what follows the merged pair moves one place to the left
            k = np.arange(len(row))
            cols = np.arange(wide - 1)
            source = cols + (cols > at[:, None])
            new = np.take_along_axis(ids, source, 1)
            new[k, at] = best
            if wide > 2:
                moved = np.take_along_axis(rank, np.minimum(source[:, :-1], rank.shape[1] - 1), 1)
            else:
                moved = np.full((len(row), 1), _NONE, np.int32)
            size = size - 1
            ids = new
            wide -= 1
            width = moved.shape[1]
            moved[(np.arange(width) >= (size - 1)[:, None])] = _NONE
            left = at > 0
            if left.any():
                moved[k[left], at[left] - 1] = self.ranks_of(ids[k[left], at[left] - 1], ids[k[left], at[left]])
            right = at < size - 1
            if right.any():
                moved[k[right], at[right]] = self.ranks_of(ids[k[right], at[right]], ids[k[right], at[right] + 1])
            rank = moved

    def _merge_long(self, word: bytes) -> np.ndarray:
        """A long word by itself: all places of the minimum rank at once, unless a lower rank arises beside one of them."""
        ids = self.byte[np.frombuffer(word, np.uint8)]
        rank = self.ranks_of(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best)
            # of places next to each other, every second from the first of the run
            first = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at) > 1)), np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            for places in (at, at[:1]):
                keep, joined = np.ones(len(ids), bool), np.zeros(len(ids), bool)
                keep[places + 1], joined[places] = False, True
                new, joined = np.where(joined, best, ids)[keep], joined[keep]
                moved = np.concatenate((rank, [_NONE]))[keep][:-1]
                pair = np.flatnonzero(joined[:-1] | joined[1:])
                moved[pair] = self.ranks_of(new[pair], new[pair + 1])
                if len(places) == 1 or not len(pair) or moved[pair].min() > best:
                    break
            ids, rank = new, moved
        return ids

    def learn(self, new: list[str]) -> None:
        """Put the ids of new words into the cache, bucket by bucket."""
        raws = [w.encode("utf-8", "replace") for w in new]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for i in np.flatnonzero(sizes > _LONG).tolist():
            self.words[new[i]] = self._merge_long(raws[i]).astype("<u4").tobytes()
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] <= _LONG) & (sizes[order] > 0)]
        bucket = (sizes[order] + 3) // 4
        for part in np.split(order, np.flatnonzero(np.diff(bucket)) + 1):
            step = max(1, (1 << 18) // max(4, int(sizes[part[-1]]) if len(part) else 4))
            for at in range(0, len(part), step):
                own = part[at : at + step].tolist()
                self.words.update(zip([new[i] for i in own], self._merge_rows([raws[i] for i in own]), strict=True))

    def _chunks(self, chunks: list[str]) -> None:
        """Put the ids of new chunks into the cache: their matches of the pattern, joined."""
        split = list(map(self.find, chunks))
        words = self.words
        new = list(set().union(*split).difference(words))
        self.learn(new)
        self.cache.update(zip(chunks, [b"".join([words[w] for w in ws]) for ws in split], strict=True))
        if len(words) > CACHE_WORDS:
            for w in new:
                del words[w]

    def _parts(self, text: str) -> list[str]:
        """Pieces that matches of the pattern do not cross. A single space before a word goes with it; a text with other
        white space than single spaces and single line ends between words stays whole, and so does any under another pattern."""
        if not self.spaced or len(text.split()) != text.count(" ") + text.count("\n") + 1 or not text.isprintable() and any(c.isspace() and c not in " \n" for c in set(text)):
            return [text] if text else []
        out: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += ("\n", first) if out else (first,)
            out += map(" ".__add__, rest)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; texts are taken in groups, so that new words share matrices."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < 1 << 21):
                group.append(self._parts(texts[at]))
                size += len(texts[at])
                at += 1
            cache = self.cache
            new = set().union(*group).difference(cache)
            if new:
                self._chunks(list(new))
            out += [b"".join(map(cache.__getitem__, parts)) for parts in group]
            # what comes early comes often: a full cache keeps what it has
            for c in new if len(cache) > CACHE_WORDS else [c for c in new if len(c) > 4 * _LONG]:
                del cache[c]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return kept(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def _files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _coder(path: str, pattern: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kmerloom.llm import byte_bpe

        own = byte_bpe.codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = own.encode([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return code


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text)``; ids are little-endian unsigned 32-bit integers in one binary.

    Null and empty texts have no ids; repeated rows stay; other columns are ignored. The file's path must hold on executors.
    """
    ship(docs.sparkSession)
    p, q = path or _files()[0], pattern or _files()[1]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_coder(p, q), "doc_id long, ids binary")


def _decoder(path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kmerloom.llm import byte_bpe

        own = byte_bpe.codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [own.decode(x) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "text"])

    return decode


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, text) with the decoded bytes of ``coded(doc_id, ids)``."""
    ship(coded.sparkSession)
    p, q = path or _files()[0], pattern or _files()[1]
    return coded.select("doc_id", "ids").mapInArrow(_decoder(p, q), "doc_id long, ids binary, text binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, text): encoded and decoded again, both in one pass of the same worker."""
    ship(docs.sparkSession)
    p, q = path or _files()[0], pattern or _files()[1]
    encoder, decoder = _coder(p, q), _decoder(p, q)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: decoder(encoder(batches)), "doc_id long, ids binary, text binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    both = round_trip(docs)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
