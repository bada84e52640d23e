"""Best-fit packing by exact-complement hashing (operator 1).

Lengths are integers up to the capacity, so what has to be planned is a histogram of at most `capacity` counts:
it reaches the driver whole at any input size. The plan is a list of patterns (lengths that share a sequence) with
multiplicities; rows find their place in it by their rank among the rows of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked import CHUNK_SLICE, library_cache
from .common import byte_slices, frugal, plain_names, stored, text_of

#: Rows of one length that one task ranks, on average.
RANK_ROWS = 20_000


class _Sums:
    """Index of the lengths at hand and of their pair sums, as bit sets; triples are a length plus a pair."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs = 0
        self.renew()

    def renew(self) -> None:
        singles = sum(1 << int(i) for i in np.flatnonzero(self.left > 0))
        self.pairs = 0
        for i in np.flatnonzero(self.left > 0):
            self.pairs |= singles << int(i)

    def pair(self, gap: int, most: int) -> list[int]:
        """Two lengths of that sum, the larger at most `most` and as large as can be."""
        if gap < 2 or not self.pairs >> gap & 1:
            return []
        low, high = (gap + 1) // 2, min(gap - 1, most)
        if high < low:
            return []
        a = np.arange(high, low - 1, -1)
        ok = (self.left[a] > 0) & (self.left[gap - a] > (a == gap - a))
        return [int(a[i := int(ok.argmax())]), gap - int(a[i])] if ok.any() else []

    def exact(self, gap: int) -> list[int]:
        """One, two or three lengths at hand that fill the gap exactly, the largest first; or none."""
        if self.left[gap] > 0:
            return [gap]
        if found := self.pair(gap, gap):
            return found
        for a in np.flatnonzero(self.left[(gap + 2) // 3 : gap - 1] > 0)[::-1] + (gap + 2) // 3:
            a = int(a)
            if self.pairs >> (gap - a) & 1:
                self.left[a] -= 1
                found = self.pair(gap - a, a)
                self.left[a] += 1
                if found:
                    return [a, *found]
        return []


def pack_plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), for counts[length] pieces of each length.

    From the longest piece down: its gap is filled exactly by one, two or three lengths under the counts that are
    left; where none fits, the longest piece that fits goes in and the smaller gap is tried again. A pattern is
    repeated as long as its lengths last, so each one uses up a length.
    """
    left = counts.astype(np.int64).copy()
    sums, plan = _Sums(left), []
    for longest in range(capacity, 0, -1):
        while left[longest] > 0:
            pattern, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap > 0:
                found = sums.exact(gap)
                if not found:
                    fits = np.flatnonzero(left[1 : gap + 1] > 0)
                    if not len(fits):
                        break
                    found = [int(fits[-1]) + 1]
                for x in found:
                    left[x] -= 1
                pattern += found
                gap -= sum(found)
            uses = Counter(pattern)
            for x, n in uses.items():
                left[x] += n
            times = min(int(left[x]) // n for x, n in uses.items())
            for x, n in uses.items():
                left[x] -= n * times
            plan.append((pattern, times))
            if any(left[x] == 0 for x in uses) and len(plan) % 64 == 0:
                sums.renew()
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: from rank `first` of a length on, `uses` pieces go to each of `times` sequences."""
    runs, sequence, ranks = [], 0, Counter()
    for pattern, times in plan:
        offset = 0
        for length, uses in Counter(pattern).items():
            runs.append((length, ranks[length], uses, sequence, offset))
            ranks[length] += uses * times
            offset += length * uses
        sequence += times
    runs.sort()
    return dict(zip(("length", "first", "uses", "sequence", "offset"), np.array(runs, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset (both long) to rows whose `length` is 1 to `capacity`.

    `pieces` should be a stored table: it is read twice. Rows of one length are dealt to hashed buckets by `order`
    (columns that tell rows apart) and ranked there; the ranks of a bucket start after those of the buckets before
    it. Equal rows get different places. An empty table stays empty. Lengths outside 1..capacity raise an error.
    All columns stay as they are, whatever their names, but for some named sequence_id and offset, which give way.
    """
    pieces, back = plain_names(pieces.drop("sequence_id", "offset"))
    length, order = back[length], tuple(back[c] for c in order) or tuple(back.values())
    by_length = pieces.groupBy(F.col(length).cast("long").alias("length")).count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_length:
        if row["length"] is None or not 1 <= row["length"] <= capacity:
            raise ValueError(f"a length of {row['length']} does not fit into {capacity}")
        counts[row["length"]] = row["count"]
    runs = _places(pack_plan(counts, capacity))
    buckets = max(16, int(counts.sum()) // RANK_ROWS)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(F.col(length).alias("_length"), "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_length"), F.col("_bucket").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order))
    ranked = dealt.withColumn("_rank", rank).join(sizes, (F.col(length) == F.col("_length")) & (F.col("_bucket") == F.col("_of")))
    ranked = ranked.withColumn("_rank", (F.col("_rank") - 1 + F.col("_before")).cast("long")).drop("_length", "_of", "_before", "_bucket")
    kept = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (runs["length"] << 44) + runs["first"]
        for b in batches:
            long, rank = (b.column(c).cast(pa.int64()).to_numpy() for c in (length, "_rank"))
            at = np.searchsorted(key, (long << 44) + rank, side="right") - 1
            behind, uses = rank - runs["first"][at], runs["uses"][at]
            sequence, offset = runs["sequence"][at] + behind // uses, runs["offset"][at] + behind % uses * long
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept)
    placed = ranked.mapInArrow(frugal(place, keep=True), f"{fields}, sequence_id long, offset long")
    return placed.select(*[F.col(c).alias(name) for name, c in back.items()], "sequence_id", "offset")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes whole texts (null: empty), adds the end id and cuts what is longer than the capacity.

    A row for each piece: id_column, piece (from 0), start (ids of its document before it), length, ids_crc32. All
    pieces of a cut document are full but the first, which holds the rest. A null id stays null; repeated ids
    give pieces for each of their rows. The input's other columns are not looked at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_cache(tokenizer, True)
        for batch in batches:
            for part in byte_slices(batch, "text", CHUNK_SLICE):
                ids, counts = encode(part.column("text"))
                ends = np.cumsum(counts) + np.arange(1, len(counts) + 1)
                whole = np.full(len(ids) + len(counts), end_id, "<u4")
                mask = np.ones(len(whole), bool)
                mask[ends - 1] = False
                whole[mask] = ids
                total = counts + 1
                first = np.where(total % capacity == 0, capacity, total % capacity)
                number = 1 + (total - first) // capacity
                doc = np.repeat(np.arange(len(total)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                at = (ends - total)[doc] + start
                crc = [zlib.crc32(whole[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    [id_column, "piece", "start", "length", "ids_crc32"],
                )

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return chosen.mapInArrow(frugal(cut, keep=True), f"`{id_column}` long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Texts to packed sequences: token_pieces(), stored once, then pack(). An empty table gives an empty result."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity, order=("doc_id", "piece", "ids_crc32"))


__all__ = ["pack", "pack_documents", "pack_plan", "token_pieces"]
