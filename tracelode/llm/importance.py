"""Target-distribution importance resampling (operator 11).

Hashed counts of word runs are taken of all documents and of all target texts. A document's weight is the floored mean of its features'
gains; with Gumbel noise from its identifier the highest scores are a draw without replacement in proportion to the weights. Scores are whole
numbers in a bounded range, so their exact histogram is small: summed from the top it gives the number of rows before each score
and the score at which the draw ends, and only rows of scores that survive are numbered, each score by itself.

Null and empty texts have no feature, weight 0, and never enter the draw; so do texts of fewer than `least` words. A null identifier draws its noise as
the empty text and follows all others among equal scores; repeated rows are drawn each by itself. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, order_id, plain_names, ragged, ship, stored, text_of
from .words import NOT_ALNUM, Words

#: Ranges longer than this are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)  # the reversed polynomial of crc32, a fixed value
    return t


_TABLE = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of data[start:start + length] for each range: byte by byte for all short ranges at once, longest first."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    short = np.flatnonzero(lengths <= LONG)
    short = short[np.argsort(-lengths[short], kind="stable")]
    at, left = starts[short], -lengths[short]
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k in range(int(-left[0]) if len(short) else 0):
        m = int(np.searchsorted(left, -k))  # the first m have a byte at place k
        crc[:m] = _TABLE[(crc[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (crc[:m] >> np.uint32(8))
    out[short] = ~crc
    return out


def feature_buckets(text: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each feature, and the number of words of each text. Features are all runs of 1 to `longest` words, joined by a blank."""
    words = Words(text, lower=True, separators=NOT_ALNUM)
    lengths, counts = words.ends - words.starts, np.diff(words.firsts)
    at = np.cumsum(lengths + 1) - (lengths + 1)  # the words one after another, a blank behind each
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    joined[ragged(at, lengths)] = words.lowered(words.starts, lengths)
    owner, room = words.text_of(), np.repeat(words.firsts[1:], counts) - np.arange(len(at))
    texts, found = [], []
    for k in range(1, longest + 1):
        first = np.flatnonzero(room >= k)
        last = first + k - 1
        found.append(crc32_of(joined, at[first], at[last] + lengths[last] - at[first]) % np.uint32(buckets))
        texts.append(owner[first])
    return np.concatenate(texts), np.concatenate(found).astype(np.int64), counts


def bucket_counts(texts: DataFrame, column: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends a count for each bucket; the driver gets `buckets` sums at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in byte_slices(batch, "text"):
                total += np.bincount(feature_buckets(b.column("text"), longest, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bucket", "n"])

    ship(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_of(column).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's share of the target over its share of the raw texts, one added to each count."""
    n = len(raw)
    return np.floor(1000 * np.log((target + 1) * (raw.sum() + float(n)) / ((raw + 1) * (target.sum() + float(n))))).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a standard Gumbel number), drawn by the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: int = 2024, column: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                texts, found, words = feature_buckets(b.column("text"), longest, buckets)
                n = np.bincount(texts, minlength=b.num_rows)
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, texts, gains[found])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(column).alias("text"))
    out = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, percent: int = 10, least: int = 20) -> DataFrame:
    """Adds rank (1, 2, ...) to weighed rows: of those with `least` words and more, floor(percent / 100 * their number) are drawn, the others have none.

    The histogram has a row for each whole score, whose range is bounded by the logarithm of 64-bit counts and the noise of 32 bits
    (some 200,000 values): it is summed by one task and broadcast at any size of the input.
    """
    able = F.col("n_words") >= least
    counts = rows.where(able).groupBy("score").agg(F.count("*").alias("_n"))
    down = Window.orderBy(F.col("score").desc())
    counts = counts.withColumn("_before", F.sum("_n").over(down) - F.col("_n"))
    quota = F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(percent) / 100)  # the sum of the counts' few rows
    survive = counts.withColumn("_quota", quota.cast("long")).where(F.col("_before") < F.col("_quota")).drop("_n")
    joined = stored(rows.join(F.broadcast(survive), "score", "left"), "importance-scores")
    drawn = able & F.col("_quota").isNotNull()
    within = Window.partitionBy("score").orderBy(order_id("doc_id"))
    place = F.col("_before") + F.row_number().over(within)
    some = joined.where(drawn).withColumn("rank", F.when(place <= F.col("_quota"), place).cast("long"))
    rest = joined.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (key, text), drawn to resemble the texts of `target` (text)."""
    gains = gains_of(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, "text", longest, buckets))
    return ranked(stored(weighed(docs, gains, longest, seed, key=key), "importance-weights"), percent, least)


def drawn_rows(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, whose identifier is drawn. Rows that share an identifier stay or go together; null ones go."""
    plain, back = plain_names(docs)
    ids = ranks.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return plain.join(ids, F.col(back[key]) == F.col("_drawn"), "left_semi").toDF(*docs.columns)
