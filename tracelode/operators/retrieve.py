"""Nearest training sentences of each test sentence, exactly, by a metric index.

Training rows are dealt to pivots, rows of their own, each to the nearest one; a part is what a pivot got. A query looks first into the nearest parts
that hold k rows. The k-th distance found there bounds all others: by the triangle inequality a part that lies farther away on the whole cannot
improve it, and of a part that can only the ring of rows at a fitting distance from its pivot is compared, by matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..storage import drop_stored, free_shuffles, ship, stored

#: Rows of either side that one task holds at a time.
BLOCK_ROWS = 20_000
#: Pivots at most: their vectors go to the driver and to all tasks.
MOST_PIVOTS = 2048
#: Distances that are held at a time.
STEP_VALUES = 500_000
#: Bytes of the copies of queries and rows that are on the executors' disks at a time; twice those of all queries and rows, where these are more.
WAVE_BYTES = 256 << 20
#: Distances are compared after rounding to so many places, so that engines agree on ties.
PLACES = 9
#: Bounds are loosened by this, times one and the sizes at hand: more than rounding and matrix products can err.
SLACK = 1e-6


def in_blocks(queries: DataFrame, train: DataFrame, compare, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """compare(queries, train) for every block of training rows and every shard of queries, as tasks of their own.

    A shard meets all blocks, so each query sees every training row once; no task holds more than a block and a shard, of block_rows each. Rows
    are copied for the blocks or shards of the other side: these follow from the rows alone, but where they make fewer tasks than there
    are shuffle partitions the smaller side, which is the cheaper one to copy, meets more parts of the larger. Both need a uid.
    """
    spark = queries.sparkSession
    ship(spark)
    asked, known = queries.count(), train.count()
    shards, blocks = max(1, -(-asked // block_rows)), max(1, -(-known // block_rows))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if asked > known:
        shards = max(shards, min(asked, -(-tasks // blocks)))
    else:
        blocks = max(blocks, min(known, -(-tasks // shards)))
    queries, train = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (queries, train))  # columns of their own
    q = queries.withColumn("_shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    t = train.withColumn("_block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return q.groupBy("_block", "_shard").cogroup(t.groupBy("_block", "_shard")).applyInArrow(compare, schema)


def matrix_of(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without a Python object for each number."""
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by one matrix product; near 0 it errs by some 1e-8 of the vectors' length."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


@dataclass
class Index:
    """rows (uid, cls, part, away: the distance to the part's pivot), the pivots, and of each part its rows, least and largest distance."""

    rows: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Bounds:
    """What tasks need of an index: the pivots, and of each part its rows, least and largest distance."""

    pivots: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_index(train: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    """The index of uid, cls. About as many parts as the root of the rows' number, or as make parts of block_rows, MOST_PIVOTS at most.

    Pivots are rows drawn by a hash, without repeats; which ones they are changes the work, not the result.
    """
    ship(train.sparkSession)
    vectors = train.select("uid", doubles(F.col("cls")).alias("cls"))
    n = vectors.count()
    wanted = min(MOST_PIVOTS, max(math.isqrt(n), -(-n // block_rows)))
    drawn = [r["cls"] for r in vectors.select("cls", F.xxhash64("uid").alias("_h")).orderBy("_h").limit(wanted).collect()]  # MOST_PIVOTS rows at most
    pivots = np.unique(np.array(drawn, np.float64), axis=0) if drawn else np.zeros((0, 0))
    if len(pivots) > 2:  # neighbours in number are near each other, so that blocks of parts are too
        centred = pivots - pivots.mean(axis=0)
        pivots = pivots[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, STEP_VALUES // max(len(pivots), 1))
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                m = matrix_of(b.column("cls"))
                part = distances(m, pivots).argmin(axis=1)
                away = np.sqrt(((m - pivots[part]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("cls"), pa.array(part.astype(np.int32)), pa.array(away)], ["uid", "cls", "part", "away"])

    rows = stored(vectors.mapInArrow(assign, "uid long, cls array<double>, part int, away double"), "index")
    sizes, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row for each pivot
        sizes[r["part"]], low[r["part"]], high[r["part"]] = r["n"], r["low"], r["high"]
    return Index(rows, pivots, sizes, low, high)


def _first_parts(away: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Of each query the nearest parts that hold k rows together, as a mask."""
    order = np.argsort(away, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    first = np.zeros(away.shape, bool)
    np.put_along_axis(first, order, held - sizes[order] < k, axis=1)
    return first & (sizes > 0)


def _visits(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """q_uid, cls, limit, part, away: the nearest parts, which each query looks into first."""
    pivots, sizes = index.pivots, index.sizes

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP_VALUES // (4 * max(len(pivots), 1)))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                away = distances(matrix_of(b.column("cls")), pivots)
                row, part = np.nonzero(_first_parts(away, sizes, k))
                for a in range(0, len(row), BLOCK_ROWS):
                    r, p = row[a : a + BLOCK_ROWS], part[a : a + BLOCK_ROWS]
                    copied = b.select(["q_uid", "cls", "limit"]).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*copied.columns, pa.array(p.astype(np.int32)), pa.array(away[r, p])], ["q_uid", "cls", "limit", "part", "away"])

    return queries.mapInArrow(visit, "q_uid long, cls array<double>, limit double, part int, away double")


def _reach(asked: np.ndarray, limit: np.ndarray, nearest: np.ndarray | None, seen: pa.Array, index: Bounds, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the parts first..last-1 each query has not seen and can improve its limit in, and the distances to their pivots; nearest: that of the nearest pivot of all."""
    away = distances(asked, index.pivots[first:last])
    nearest = away.min(axis=1) if nearest is None else nearest
    low, high = index.low[first:last], index.high[first:last]
    least = np.maximum(np.maximum(away - high, low - away), (away - nearest[:, None]) / 2)  # rows of a part are no nearer to another pivot
    go = (index.sizes[first:last] > 0) & (least <= (limit + SLACK * (1 + limit + np.sqrt((asked**2).sum(axis=1))))[:, None])
    row, part = np.repeat(np.arange(len(asked)), seen.value_lengths().to_numpy(zero_copy_only=False)), seen.flatten().to_numpy(zero_copy_only=False)
    here = (part >= first) & (part < last)
    go[row[here], part[here] - first] = False
    return go, away


_ASKED = ["q_uid", "cls", "limit", "seen"]


def _look_on(queries: DataFrame, index: Index, k: int, block_rows: int) -> DataFrame:
    """q_uid, t_uid, dist, part, looked of the second round, for q_uid, cls, limit, seen (the parts of the first).

    Parts of consecutive numbers, which are near each other, are searched as a group, and a query is sent once to each group that has a part it can improve in: copies
    grow with the groups, not with the parts. Groups have block_rows rows at most and the rest of a part, and as many queries meet them in a task; larger parts and more
    queries are split by hash. Where this makes too few tasks both are smaller by the same factor, which copies the fewest rows. Groups are searched in waves, as
    many at a time as WAVE_BYTES allows: what was copied for a wave leaves the disk before the next.
    """
    spark = queries.sparkSession
    known = Bounds(index.pivots, index.sizes, index.low, index.high)
    queries = stored(queries.select(*_ASKED), "asked")
    of_all, tasks = queries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(block_rows, math.isqrt(int(known.sizes.sum()) * of_all // (2 * tasks)) + 1))  # rows of a group, queries of a task
    group = np.unique((np.cumsum(known.sizes) - known.sizes) // most, return_inverse=True)[1]
    starts = np.searchsorted(group, np.arange(group[-1] + 2))
    held = np.add.reduceat(known.sizes, starts[:-1])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Queries, their distances to the pivots, and which groups each has to look into."""
        step = max(1, STEP_VALUES // (4 * len(known.pivots)))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                limit = b.column("limit").to_numpy(zero_copy_only=False)
                go, away = _reach(matrix_of(b.column("cls")), limit, None, b.column("seen"), known, 0, len(known.pivots))
                yield b, away, np.logical_or.reduceat(go, starts[:-1], axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(held), np.int64)
        for _, _, into in wanted(batches):
            n += into.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["group", "n"])

    def visit(batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
        for b, away, into in wanted(batches):
            row, g = np.nonzero(into[:, first:last])
            for a in range(0, len(row), BLOCK_ROWS):
                r = row[a : a + BLOCK_ROWS]
                copied = b.select(_ASKED).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*copied.columns, pa.array(away.min(axis=1)[r]), pa.array((first + g[a : a + BLOCK_ROWS]).astype(np.int32))], [*_ASKED, "nearest", "group"])

    counted = queries.mapInArrow(count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()  # a row for each group
    asked = {r["group"]: r["n"] for r in counted if r["n"]}
    shape = {g: (max(1, -(-int(held[g]) // (2 * block_rows))), -(-n // most)) for g, n in asked.items()}
    copies = {g: n * shape[g][0] + int(held[g]) * shape[g][1] for g, n in asked.items()}
    row_bytes = 8 * (index.pivots.shape[1] + 6)
    waves = _waves(copies, max(WAVE_BYTES // row_bytes, 2 * (of_all + int(known.sizes.sum()))))
    groups = F.broadcast(spark.createDataFrame([(p, int(g)) for p, g in enumerate(group)], "part int, group int"))  # a row for each pivot
    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[pa.Table] = [_found([], 0, 0)]
        if q.num_rows and t.num_rows:
            g = q.column("group")[0].as_py()
            first, last = int(starts[g]), int(starts[g + 1])
            parts, ring = t.column("part").to_numpy(), t.column("away").to_numpy()
            order = np.lexsort((ring, parts))
            parts, ring, uids, matrix = parts[order], ring[order], t.column("uid").to_numpy()[order], matrix_of(t.column("cls"))[order]
            vectors, limit, q_uids = matrix_of(q.column("cls")), q.column("limit").to_numpy(), q.column("q_uid").to_numpy()
            go, away = _reach(vectors, limit, q.column("nearest").to_numpy(), q.column("seen").combine_chunks(), known, first, last)
            for p in range(first, last):
                a, b = np.searchsorted(parts, [p, p + 1])
                some = np.flatnonzero(go[:, p - first])
                if len(some) and b > a:
                    rows, looked = _ring(q_uids[some], vectors[some], away[some, p - first], limit[some], uids[a:b], matrix[a:b], ring[a:b], k)
                    out.append(_found(rows, p, looked))
        return pa.concat_tables(out)

    keys, out = ["group", "_block", "_shard"], spark.createDataFrame([], _FOUND)
    for first, last in waves:
        shapes = [(g, *x) for g, x in shape.items() if first <= g < last]
        small = lambda: F.broadcast(spark.createDataFrame(shapes, "group int, _blocks int, _shards int"))  # noqa: B023, E731  a row for each group
        visits = queries.mapInArrow(partial(visit, first=first, last=last), "q_uid long, cls array<double>, limit double, seen array<int>, nearest double, group int")
        q = visits.join(small(), "group").withColumn("_shard", F.pmod(F.xxhash64("q_uid"), F.col("_shards")).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        t = index.rows.join(groups, "part").join(small(), "group").withColumn("_block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("_blocks")).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
        out = out.unionByName(stored(q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(compare, _FOUND), "far"))
        del q, t
        free_shuffles(spark)
    drop_stored(queries)
    return out


def _waves(copies: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive groups (first, behind the last) that have `most` copied rows at most together, or are one group."""
    out: list[tuple[int, int]] = []
    total = 0
    for g in sorted(copies):
        if not out or total + copies[g] > most:
            out.append((g, g + 1))
            total = 0
        out[-1] = (out[-1][0], g + 1)
        total += copies[g]
    return out


def _look(visits: DataFrame, index: Index, k: int, block_rows: int, few: bool) -> DataFrame:
    """q_uid, t_uid, dist, part, looked: of each visit the k nearest rows of the part, if not beyond the limit. The last counts distances, once for each group.

    Parts of more than block_rows rows, and the visits of parts that more than block_rows queries look into, are split by hash, so a task holds no more of either.
    """
    spark = visits.sparkSession
    if index.sizes.max() <= block_rows and few:  # nothing to split
        q, t = (x.withColumns({"_block": F.lit(0), "_shard": F.lit(0)}) for x in (visits, index.rows))
    else:
        asked = {r["part"]: r["count"] for r in visits.groupBy("part").count().collect()}  # a row for each pivot
        shape = [(p, max(1, -(-int(n) // block_rows)), max(1, -(-asked[p] // block_rows))) for p, n in enumerate(index.sizes) if p in asked]
        shapes = lambda: F.broadcast(spark.createDataFrame(shape, "part int, _blocks int, _shards int"))  # noqa: E731  a row for each pivot
        q = visits.join(shapes(), "part").withColumn("_shard", F.pmod(F.xxhash64("q_uid"), F.col("_shards")).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        t = index.rows.join(shapes(), "part").withColumn("_block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("_blocks")).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return _found([], 0, 0)
        t = t.take(pa.array(np.argsort(t.column("away").to_numpy(), kind="stable")))
        asked = (q.column("q_uid").to_numpy(), matrix_of(q.column("cls")), q.column("away").to_numpy(), q.column("limit").to_numpy())
        rows, looked = _ring(*asked, t.column("uid").to_numpy(), matrix_of(t.column("cls")), t.column("away").to_numpy(), k)
        return _found(rows, q.column("part")[0].as_py(), looked)

    keys = ["part", "_block", "_shard"]
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(compare, _FOUND)


_FOUND = "q_uid long, t_uid long, dist double, part int, looked long"


def _ring(q_uids: np.ndarray, asked: np.ndarray, away: np.ndarray, limit: np.ndarray, uids: np.ndarray, matrix: np.ndarray, ring: np.ndarray, k: int) -> tuple[list[tuple], int]:
    """(q_uid, t_uid, dist) of the k nearest rows of a part for each query, if not beyond its limit, and how many distances were computed. The part's rows are in the order of ring, their distances to the pivot."""
    out: list[tuple] = []
    looked = 0
    slack = SLACK * (1 + np.sqrt((asked**2).sum(axis=1)) + np.where(np.isinf(limit), 0, limit))
    low, high = np.searchsorted(ring, away - limit - slack), np.searchsorted(ring, away + limit + slack, side="right")
    order = np.argsort(low, kind="stable")
    i = 0
    while i < len(order):
        a = int(low[order[i]])
        some = order[i : i + max(1, min(STEP_VALUES // len(matrix), 512))]
        i += len(some)
        b = int(high[some].max())
        if a >= b:
            continue
        looked += len(some) * (b - a)
        row, column = _close(asked[some], matrix[a:b], k, limit[some])
        d = np.round(np.sqrt(((asked[some[row]] - matrix[a + column]) ** 2).sum(axis=1)), PLACES)
        order_ = np.lexsort((uids[a + column], d, row))
        row, column, d = row[order_], column[order_], d[order_]
        best = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (d <= limit[some[row]])
        out.append((q_uids[some[row[best]]], uids[a + column[best]], d[best]))
    return out, looked


def _found(rows: list[tuple], part: int, looked: int) -> pa.Table:
    """Rows of a part as a table; a last row without q_uid stands for the part and has the count of distances."""
    rows = [*rows, (np.zeros(1, np.int64),) * 2 + (np.zeros(1),)]
    q_uid, t_uid, dist = (np.concatenate([r[i] for r in rows]) for i in range(3))
    last = np.arange(len(dist)) == len(dist) - 1
    return pa.table({"q_uid": pa.array(q_uid, mask=last), "t_uid": pa.array(t_uid, mask=last), "dist": pa.array(dist, mask=last), "part": np.full(len(dist), part, np.int32), "looked": np.where(last, looked, 0)})


def candidates(queries: DataFrame, train: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """q_uid, t_uid, dist, part, looked: rows among which the k nearest of every query are; rows without q_uid count the distances that were computed."""
    index = build_index(train, block_rows)
    if not len(index.pivots):
        return train.sparkSession.createDataFrame([], "q_uid long, t_uid long, dist double, part int, looked long")
    asked = queries.select(F.col("uid").cast("long").alias("q_uid"), doubles(F.col("cls")).alias("cls"))
    few = queries.select("uid").limit(block_rows + 1).count() <= block_rows
    near = stored(_look(_visits(asked.withColumn("limit", F.lit(float("inf"))), index, k), index, k, block_rows, few), "near")
    # the k-th distance; a query that found fewer has looked into all parts
    limits = near.where("q_uid is not null").groupBy("q_uid").agg(F.get(F.sort_array(F.collect_list("dist")), k - 1).alias("limit"), F.collect_set("part").alias("seen"))
    far = _look_on(asked.join(limits.where("limit is not null"), "q_uid"), index, k, block_rows)
    drop_stored(index.rows)
    return near.unionByName(far)


def nearest(queries: DataFrame, train: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """q_uid, rank (from 1), t_uid, dist, part: the k nearest training vectors by Euclidean distance of cls, ties by t_uid, as a written table. Without rows on either side there are none.

    part is the number of the index's part that the training row lies in: rows of one part, or of parts of near numbers, are near each other.
    """
    found = candidates(queries, train, k, block_rows).where("q_uid is not null")
    rank = F.row_number().over(Window.partitionBy("q_uid").orderBy("dist", "t_uid"))
    out = stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("q_uid", "rank", "t_uid", "dist", "part"), "neighbours")
    drop_stored(found)
    free_shuffles(train.sparkSession)
    return out


def _close(queries: np.ndarray, matrix: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that hold the k nearest rows of each query that are not beyond its limit: squared distances by one matrix product, and a margin for its rounding and that of PLACES.

    A limit leaves few rows of most queries; only those with many are looked through for their k-th distance.
    """
    own, other = (queries**2).sum(axis=1), (matrix**2).sum(axis=1)
    squared = own[:, None] + other[None, :] - 2 * (queries @ matrix.T)
    bound = lambda cut, own: cut + 4 * 10.0**-PLACES * (1 + np.sqrt(cut)) + 1e-12 * (own + other.max())
    near = squared <= bound(limit**2, own)[:, None]
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * k)
    if len(many):
        cut = np.maximum(np.partition(squared[many], k - 1, axis=1)[:, k - 1], 0)
        near[many] &= squared[many] <= bound(cut, own[many])[:, None]
    return np.nonzero(near)


def only_in_test(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test sentences whose cls vector no training sentence has."""
    return test.join(train.select(F.col("cls").alias("_cls")).distinct(), F.col("cls") == F.col("_cls"), "left_anti")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Log rows of the sentences that are left."""
    return rows.join(kept.select("uid"), "uid", "left_semi")
