"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Every adjacent pair that has a merge rank is put in
the bucket of that rank; a two-level bitmap over the ranks tells which buckets are not empty, and
find-first-set on it gives the lowest rank. Entries are not removed when a merge changes their
surroundings: they are checked when taken and skipped if stale. Within a rank positions come in
ascending order, as the pair at the left is merged first. A merge costs the same however long the
pre-token is.

Defined results: null or empty text: no ids, empty bytes. Any other text decodes to its own bytes.
Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT, MASK = 6, 63
CACHE_ENTRIES = 100_000  # of each of two generations; an entry takes about half a kilobyte
CACHE_LENGTH = 64


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get = len(piece), self.ranks.get
        ends = [*range(1, n + 1), 0]  # end of the token at a position; 0: no token starts there
        before = list(range(-1, n))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}  # bitmap of non-empty buckets, in words of 2**SHIFT ranks
        top = 0  # bitmap of non-empty words
        for left in range(n - 1):
            rank = get(piece[left : left + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(left)
                else:
                    buckets[rank] = [left]
                    word = rank >> SHIFT
                    words[word] = words.get(word, 0) | 1 << (rank & MASK)
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << SHIFT) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            left = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                del buckets[rank]
                bits &= bits - 1
                words[word] = bits
                if not bits:
                    top &= top - 1
            middle = ends[left]
            if not 0 < middle < n:
                continue  # stale: merged into its left neighbour, or at the end
            right = ends[middle]
            if get(piece[left:right]) != rank:
                continue  # stale: one of its halves has grown
            ends[left], ends[middle] = right, 0
            before[right] = left
            for left, right in ((left, right), (before[left], left)) if left else ((left, right),):
                if right < n:
                    rank = get(piece[left : ends[right]])
                    if rank is not None:
                        if rank in buckets:
                            heappush(buckets[rank], left)
                        else:
                            buckets[rank] = [left]
                            word = rank >> SHIFT
                            words[word] = words.get(word, 0) | 1 << (rank & MASK)
                            top |= 1 << word
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : ends[at]]])
            at = ends[at]
        return out

    def _pack(self, word: str) -> bytes:
        packed = self.older.get(word) or np.asarray(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older = dict(self.cache)  # words used again move back to ``cache``
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        known, pack = self.cache.get, self._pack
        return np.frombuffer(b"".join([known(w) or pack(w) for w in self.find(text)]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file's bytes, built once per worker."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(vocabulary), pattern)
    return _codecs[key]


def encode_decode(
    df: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, ids (little-endian unsigned 32-bit integers), decoded (bytes) of every whole text.

    The vocabulary file (a fixed size, under 1 MB) is read once by the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, n = 0, batch.num_rows
            while at < n:
                ids, decoded, size, start = [], [], 0, at
                while at < n and size < 4 << 20:
                    got = c.encode(texts[at].as_py() or "")
                    ids.append(got.tobytes())
                    decoded.append(c.decode(got))
                    size += len(ids[-1]) + len(decoded[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [keys[start:at], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=[key, "ids", "decoded"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
