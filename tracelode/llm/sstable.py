"""Token ids in sorted-string-table shards (operator 4).

A shard holds entries in ascending key order: blocks of prefix-compressed entries, then a Bloom filter, a sparse index
(the last key of each block) and a footer. A lookup asks the filter, bisects the index and reads one block.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked import CHUNK_SLICE, largest_id, library_cache
from .common import NO_ID, byte_slices, new_path, ragged, shuffle_partitions, stored, text_of
from .files import attempt_path, create, reader

MAGIC = b"TLSST01\n"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQB7x8s")  # filter's place, index's place, filter's bits, entries, ids, bytes of an id
_ENTRY = struct.Struct("<BBI")  # bytes shared with the key before, bytes of its own, ids


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the ids do, with null after all."""
    return b"\1" + b"\0" * 8 if doc_id is None else b"\0" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    first, step = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(first + i * step) % bits for i in range(PROBES)]


class ShardWriter:
    """Takes keys in ascending order; equal keys may follow each other."""

    def __init__(self, path: str, id_bytes: int):
        self.path, self.out, self.id_bytes = path, create(path), id_bytes
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.block: list[bytes] = []
        self.block_bytes, self.last, self.keys, self.n_ids = 0, b"", [], 0
        self.index: list[tuple[bytes, int, int]] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        if len(ids) and int(ids.max()) >= 1 << 8 * self.id_bytes:
            raise ValueError(f"the id {int(ids.max())} does not fit into {self.id_bytes} bytes")
        data = _ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block.append(data)
        self.block_bytes += len(data)
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            import zstandard

            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        filled = np.zeros(bits, np.uint8)
        for key in self.keys:
            filled[_probes(key, bits)] = 1
        bloom = np.packbits(filled, bitorder="little").tobytes()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        self.out.write(bloom + index + _FOOTER.pack(self.at, self.at + len(bloom), bits, len(self.keys), self.n_ids, self.id_bytes, MAGIC))
        self.bytes = self.at + len(bloom) + len(index) + _FOOTER.size
        self.out.close()


class Shard:
    """Reads a shard: get() by binary search, scan() in key order."""

    def __init__(self, path: str):
        self.file = reader(path)
        size = self.file.size()
        bloom, index, self.bits, self.entries, self.n_ids, self.id_bytes, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.bloom = np.frombuffer(self._read(bloom, index - bloom), np.uint8)
        data, at = self._read(index, size - _FOOTER.size - index), 0
        self.last_keys, self.blocks = [], []
        while at < len(data):
            n = data[at]
            self.last_keys.append(data[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QQ", data, at + 1 + n))
            at += 17 + n

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        at, n = self.blocks[i]
        data = self._read(at, n)
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError(f"block {i} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4], max_output_size=1 << 31), 0, b""
        while at < len(data):
            shared, own, count = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", count, at)
            at += count * self.id_bytes

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this id."""
        key, found = key_of(doc_id), []
        if not self.entries or not self.may_hold(key):
            return found
        i = bisect_left(self.last_keys, key)
        while i < len(self.blocks):
            for k, ids in self._block(i):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
            i += 1
        return found

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, ids in self._block(i):
                yield id_of(key), ids


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes whole texts (null: empty), ends each with end_id and writes shards in ascending doc_id order.

    An id takes two bytes where all ids of the vocabulary and end_id fit, else four.
    Documents are dealt by ranges of doc_id, and each task writes its range as one or more shards. Returns one row a
    shard: path, range (its task), part (its place there), first_id, entries, ids, bytes. Rows with equal ids stand side by side in
    the order of their texts; null ids come last. An empty table gives no shards. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder, parts = new_path(spark, "sst"), max(2, shuffle_partitions(spark))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = chosen.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("range"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, first, number, rows = library_cache(tokenizer, False), None, None, 0, []
        id_bytes = 2 if max(end_id, largest_id(tokenizer)) < 1 << 16 else 4

        def finish() -> None:
            shard.close()
            rows.append((shard.path, of, number, first, len(shard.keys), shard.n_ids, shard.bytes))

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column("range")[0].as_py()
            for part in byte_slices(batch, "text", CHUNK_SLICE):
                ids, counts = encode(part.column("text"))
                ends = np.cumsum(counts).tolist()
                at = 0
                for doc_id, end in zip(part.column("doc_id").to_pylist(), ends, strict=True):
                    if shard is None:
                        shard, first = ShardWriter(attempt_path(folder, ".sst"), id_bytes), doc_id
                    shard.add(key_of(doc_id), np.append(ids[at:end], np.uint32(end_id)))
                    at = end
                    if shard.at >= shard_bytes:
                        finish()
                        shard, number = None, number + 1
        if shard is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["path", "range", "part", "first_id", "entries", "ids", "bytes"]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
    return stored(dealt.mapInArrow(write, "path string, range int, part int, first_id long, entries long, ids long, bytes long"), "sst-list")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents of wanted (doc_id, some of them repeated, null or absent): doc_id, n_tokens, ids, a row for each entry that has the id.

    The list of shards (path and first id, a row for some 64 MB) is broadcast; by it each identifier goes to the shards that can hold it, and there
    through the Bloom filter and the binary search of Shard.get, so blocks that cannot hold it are not read. An identifier that no shard has gives no row.
    """
    spark = shards.sparkSession
    listed = shards.orderBy("range", "part").select("path", F.coalesce("first_id", F.lit(NO_ID)).alias("low")).toArrow()
    spans = spark.sparkContext.broadcast((listed.column("path").to_pylist(), listed.column("low").to_numpy()))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, low = spans.value
        for b in batches:
            keys = b.column("doc_id").fill_null(NO_ID).to_numpy()
            first = np.maximum(np.searchsorted(low, keys, side="left") - 1, 0)  # an id may begin in the shard before the one that begins with it
            stop = np.searchsorted(low, keys, side="right")
            count = np.maximum(stop - first, 0)
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in ragged(first, count).tolist()], pa.string()), b.column("doc_id").take(pa.array(np.repeat(np.arange(len(keys)), count)))], ["path", "doc_id"])

    met = asked.mapInArrow(place, "path string, doc_id long")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = path = None
        for b in batches:
            rows = []
            for p, doc_id in zip(b.column("path").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                if p != path:
                    shard, path = Shard(p), p
                rows += [(doc_id, len(ids), ids.astype(np.int32)) for ids in shard.get(doc_id)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "ids"])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return met.repartition(max(1, shuffle_partitions(spark)), "path").sortWithinPartitions("path", "doc_id").mapInArrow(find, "doc_id long, n_tokens long, ids array<int>")


def read_shards(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The documents of shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

    The list of shards (one row for some 64 MB) is summed in one task; the shards are read by as many tasks as there
    are shuffle partitions.
    """
    before = F.sum("ids").over(Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1))
    listed = shards.select("path", F.coalesce(before, F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in Shard(path).scan():
                    wire = ids.astype("<u4")
                    rows.append((doc_id, start, len(ids), zlib.crc32(wire.tobytes()), *([wire.astype(np.int32)] if keep_ids else [])))
                    start += len(ids)
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_ids
    parts = max(1, shuffle_partitions(shards.sparkSession))
    return listed.repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
