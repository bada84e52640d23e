"""Byte-level BPE by two-tier lookup (operator 7).

Tier one: a minimal perfect hash finds pre-tokens that are whole vocabulary entries. Tier two: the others are
merged by a heap of pair ranks over a doubly linked list of bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import CHUNK_SLICE, ChunkCache, byte_level_chunks
from .common import KEPT, byte_slices, ragged, text_of


class PerfectHash:
    """Minimal perfect hash (hash and displace) of byte strings to the places 0..n-1, with a check of the key."""

    _PRIME = (1 << 31) - 1  # displacements of one key pass over all places

    def __init__(self, keys: list[bytes]):
        import xxhash

        self._digest = xxhash.xxh3_128_intdigest
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for k in keys:
            bucket, first, step = self._split(k)
            groups.setdefault(bucket, []).append((first, step, k))
        self.displace = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        free = self.n - 1
        for bucket, group in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(group) == 1:  # any free place will do: it is named directly
                while self.keys[free] is not None:
                    free -= 1
                self.displace[bucket], self.keys[free] = -free - 1, group[0][2]
                continue
            d = 0
            while True:
                places = [(first + d * step) % self._PRIME % self.n for first, step, _ in group]
                if len(set(places)) == len(places) and all(self.keys[p] is None for p in places):
                    break
                d += 1
            self.displace[bucket] = d
            for p, (_, _, k) in zip(places, group, strict=True):
                self.keys[p] = k

    def _split(self, key: bytes) -> tuple[int, int, int]:
        h = self._digest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFF, (h >> 64 & 0xFFFFFFFF) | 1

    def find(self, key: bytes) -> int:
        """The place of a key, or -1 for any other string."""
        if not self.n:
            return -1
        bucket, first, step = self._split(key)
        d = self.displace[bucket]
        place = -d - 1 if d < 0 else (first + d * step) % self._PRIME % self.n
        return place if self.keys[place] == key else -1


class BytePairs:
    """Encoder and decoder for a file of base64 tokens and ranks; the rank is the id."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = PerfectHash(list(self.ranks))
        self.id_at = [self.ranks[k] for k in self.table.keys]
        # the white space of the public tokenizers: Unicode's property, without the control separators that Python adds
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.width = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.begin = np.cumsum(self.width) - self.width
        self.merge = functools.lru_cache(200_000)(self._merge)

    def _merge(self, word: bytes) -> tuple[int, ...]:
        """Merges the pair of lowest rank, the leftmost of equals, until no pair is in the vocabulary."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        place = self.table.find(word)
        return (self.id_at[place],) if place >= 0 else self.merge(word)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.pattern.findall(text) for i in self.encode_word(word.encode())]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        found = list(map(self.encode, texts))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.flat[ragged(self.begin[ids], self.width[ids])]


_LOADED: dict[tuple[str, str], tuple[BytePairs, ChunkCache]] = {}
KEPT.append(_LOADED)


def loaded(path: str, pattern: str) -> tuple[BytePairs, ChunkCache]:
    if (path, pattern) not in _LOADED:
        pairs = BytePairs(path, pattern)
        _LOADED[path, pattern] = pairs, ChunkCache(pairs.encode_all, byte_level_chunks)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes whole texts (null: empty) and decodes the ids again.

    One row for each input row: id_column, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids),
    decoded_sha256 and, with keep_ids, ids array<int> and decoded binary. An empty text has no ids. Null and repeated
    ids stay as they are; other columns are not looked at. `pattern` must be one whose pre-tokens hold a blank only
    in front or within white space, as the byte-level patterns do: texts are cut before blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, encode = loaded(ranks, pattern)
        for batch in batches:
            for part in byte_slices(batch, "text", CHUNK_SLICE):
                ids, counts = encode(part.column("text"))
                decoded = pairs.decode(ids)
                ends = np.concatenate([[0], np.cumsum(counts)])
                byte_ends = np.concatenate([[0], np.cumsum(pairs.width[ids])])[ends].tolist()
                wire, ends = ids.astype("<u4"), ends.tolist()
                spans, texts = list(zip(ends, ends[1:], strict=False)), list(zip(byte_ends, byte_ends[1:], strict=False))
                columns = [
                    part.column("doc_id"),
                    pa.array(counts),
                    pa.array([hashlib.sha256(wire[a:b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in texts], pa.string()),
                ]
                if keep_ids:
                    columns += [pa.array([wire[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())), pa.array([decoded[a:b].tobytes() for a, b in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return chosen.mapInArrow(run, f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids)
