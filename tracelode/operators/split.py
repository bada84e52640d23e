"""Sampling and splitting with exact sizes: rows are chosen by a seeded md5 of their key, so a draw can be repeated anywhere.

The n rows of least (md5, key) are found without moving rows: histograms of the md5's first digits, counted where the rows lie, tell in which bucket the
n-th lies; that bucket is looked at by the next digits until few rows are left, of which the driver takes the n-th. What is chosen is then a
filter on the rows as they stand.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits by which a bucket is divided: a histogram has at most 16 ** DIGITS rows a class.
DIGITS = 3
#: Rows of a bucket that the driver sorts.
FEW_ROWS = 4096
#: Classes of rows that are drawn by themselves, at most: the driver keeps a bound for each.
MOST_CLASSES = 10_000


def draw_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def _is(by: str | None, value) -> Column:
    return F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(value))


def bounds(df: DataFrame, key: str, seed: int, wanted: Callable[[object, int], int], by: str | None = None) -> dict:
    """Of each class the (md5, key) of its n-th row, where wanted(class, rows it has) is n; None where n is 0. Of a class that has fewer rows it is their last.

    Three columns of the rows are read for each round; 16 ** 3 buckets make a second round enough for 10 ** 11 rows.
    """
    drawn = df.select(draw_key(key, seed).alias("draw"), F.col(key).alias("key"), (F.lit(None).cast("int") if by is None else F.col(by)).alias("class"))

    def histogram(rows: DataFrame, length: int) -> dict:
        """Rows by class and the digits after the first `length`."""
        few = rows.groupBy("class", F.substring("draw", length + 1, DIGITS).alias("digits")).count().limit(MOST_CLASSES * 16**DIGITS + 1).collect()
        counts: dict = {}
        for r in few:
            counts.setdefault(r["class"], []).append((r["digits"], r["count"]))
        if len(counts) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        return {c: sorted(x) for c, x in counts.items()}

    out: dict = {}
    open_: dict = {}  # class: the prefix of the bucket that the n-th row lies in, and its place there
    ready: dict = {}
    counts, length = histogram(drawn, 0), 0
    for c, x in counts.items():
        n = wanted(c, sum(size for _, size in x))
        out[c] = None
        if n > 0:
            open_[c] = ("", n)
    while open_:
        for c, (prefix, n) in list(open_.items()):
            for digits, size in counts[c]:
                if n <= size or digits == counts[c][-1][0]:
                    chosen = (prefix + digits, min(n, size))
                    if size <= FEW_ROWS or length + DIGITS >= 30:
                        ready[c] = chosen
                        del open_[c]
                    else:
                        open_[c] = chosen
                    break
                n -= size
        length += DIGITS
        if open_:
            counts = histogram(drawn.where(_any(_is("class", c) & F.col("draw").startswith(prefix) for c, (prefix, _) in open_.items())), length)
    if ready:
        rows: dict = {}
        inside = _any(_is("class", c) & F.col("draw").startswith(prefix) for c, (prefix, _) in ready.items())
        # keys that repeat are one row with a count, so a key of very many rows costs no more than another
        for r in drawn.where(inside).groupBy("class", "draw", "key").count().collect():  # some thousand rows a class
            rows.setdefault(r["class"], []).append((r["draw"], r["key"], r["count"]))
        for c, (_, n) in ready.items():
            for draw, k, size in sorted(rows[c]):
                out[c] = (draw, k)
                n -= size
                if n <= 0:
                    break
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def first_rows(df: DataFrame, key: str, seed: int, wanted: Callable[[object, int], int], by: str | None = None) -> Column:
    """A condition that holds for the n rows of least (md5, key) of each class, n as bounds() has it. Rows that share the key of the n-th come along; those without a key are never chosen."""
    draw, out = draw_key(key, seed), F.lit(False)
    for c, bound in bounds(df.where(F.col(key).isNotNull()), key, seed, wanted, by).items():
        if bound is not None:
            out = out | (_is(by, c) & ((draw < bound[0]) | ((draw == bound[0]) & (F.col(key) <= F.lit(bound[1])))))
    return out


def sample_ratio(df: DataFrame, key: str, ratio: float, seed: int = 1234, by: str = "label") -> DataFrame:
    """Of each class the whole part of ratio times its size, without replacement."""
    return df.where(first_rows(df, key, seed, lambda _, n: math.floor(n * float(ratio)), by))


def sample_count(df: DataFrame, key: str, count: int, seed: int = 1234) -> DataFrame:
    """About `count` rows with the classes (label 0 and 1) in their proportion; each class's share is cut to a whole number.

    Raises an error if a class would have to give more rows than it has.
    """
    rows = df.where("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    normal, abnormal = sizes.get(0, 0), sizes.get(1, 0)
    share = abnormal / max(1, normal + abnormal)
    want = {0: int(count * (1 - share)), 1: int(count * share)}
    if want[0] > normal or want[1] > abnormal:
        raise ValueError(f"{count} rows are more than there are")
    return rows.where(first_rows(rows, key, seed, lambda c, _: want[c], "label"))


def train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 1234, shuffle: bool = True) -> DataFrame:
    """Adds split: of the normal rows (label 0) the last ceil(n * test_size) are test, and all abnormal ones (label 1).

    The order is the seeded draw, or that of the key without shuffle. Rows without a label are in neither part and go.
    """
    rows = df.where("label in (0, 1)")
    normal, cut = rows.where("label = 0"), lambda _, n: n - math.ceil(n * float(test_size))
    if shuffle:
        train = first_rows(normal, key, seed, cut)
    else:
        bound = smallest(normal, key, cut(None, normal.count()))
        train = F.lit(False) if bound is None else F.col(key) <= F.lit(bound)
    return rows.withColumn("split", F.when((F.col("label") == 0) & train, "train").otherwise("test"))


def smallest(df: DataFrame, key: str, n: int):
    """The n-th smallest value (from 1) of a whole-number column; None for n of 0. Histograms of ever smaller ranges, counted where the rows lie."""
    if n <= 0:
        return None
    low, high = df.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = -(-(high - low + 1) // 16**DIGITS)
        bucket = F.floor((F.col(key) - F.lit(low)) / F.lit(width)) if width > 1 else F.col(key) - F.lit(low)
        counts = df.where(F.col(key).between(low, high)).groupBy(bucket.cast("long").alias("b")).count().collect()
        for b, size in sorted((r["b"], r["count"]) for r in counts):
            if n <= size:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            n -= size
    return low


def ratio_uniques(lookup: DataFrame, key: str, ratio: float, seed: int = 1234) -> DataFrame:
    """uid of the sentences that a draw of ratio times the log rows hits: frequent ones are likelier to stay."""
    return lookup.where(first_rows(lookup, key, seed, lambda _, n: math.floor(n * float(ratio)))).select("uid").distinct()
