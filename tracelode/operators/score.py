"""Anomaly scores of unique test sentences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit_tokens
from ..storage import ship, stored
from .encode import matrices_of
from .retrieve import in_blocks

#: Scores are rounded before a threshold is looked for, so a last bit does not decide.
PLACES = 9
#: Training sentences of one task in the exhaustive mode.
TOKEN_BLOCK = 2_000
#: Similarities of tokens that are held at a time.
STEP_VALUES = 1_000_000
#: Similarities of one query token and one training token that are held at a time in the exhaustive mode: they stay in a core's cache.
TILE_VALUES = 200_000
#: Bytes of token matrices in one block of training sentences, and in the queries that meet a block in one task.
BLOCK_BYTES = 12 << 20


def with_unit_tokens(df: DataFrame, only_cls: bool = False, metric: str = "cos") -> DataFrame:
    """Tokens at unit length (metric cos) or as they are (dot), reduced to the first row with only_cls."""
    tokens = F.slice("tokens", 1, 1) if only_cls else F.col("tokens")
    return df.withColumn("tokens", unit_tokens(tokens) if metric == "cos" else F.transform(tokens, lambda t: F.transform(t, lambda x: x.cast("double"))))


class Matrices:
    """Token matrices of many sentences, one below the other, from an Arrow column; with metric cos each row at unit length."""

    def __init__(self, tokens: pa.ChunkedArray, metric: str):
        lists = tokens.combine_chunks()
        rows = lists.flatten()
        self.firsts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        if metric == "cos":
            size = np.sqrt((self.values**2).sum(axis=1, keepdims=True))
            self.values /= np.where(size == 0, 1, size)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.firsts[i] : self.firsts[i + 1]]

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some sentences, one below the other, and where each begins."""
        sizes = self.firsts[some + 1] - self.firsts[some]
        begins = np.cumsum(sizes) - sizes
        return self.values[np.repeat(self.firsts[some] - begins, sizes) + np.arange(int(sizes.sum()))], begins


def max_sims(query: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MaxSim of one query with several sentences, by one matrix product. A sentence without tokens, or a query without, has 0."""
    sizes = np.diff(np.append(begins, len(rows)))
    out = np.zeros(len(begins))
    if len(query) and len(rows):
        full = sizes > 0
        out[full] = np.maximum.reduceat(query @ rows.T, begins[full], axis=1).sum(axis=0)
    return out


def _padded(values: np.ndarray, firsts: np.ndarray, repeat: bool) -> np.ndarray:
    """Token i of each sentence at place i, as (tokens, sentences, ...); what a sentence lacks is its first token again, or zeros."""
    sizes = np.diff(firsts)
    at = np.arange(max(1, int(sizes.max(initial=0))))[:, None]
    inside = at < sizes
    out = np.zeros((*inside.shape, *values.shape[1:]))
    there = inside | ((sizes > 0) & repeat)
    out[there] = values[(firsts[:-1] + np.where(inside, at, 0))[there]]
    return out


def sums_of_best(queries: np.ndarray, known: np.ndarray, sizes: np.ndarray | None = None, radii: np.ndarray | None = None) -> np.ndarray:
    """MaxSim of each query with each sentence, from padded tokens (queries by zeros, sentences by repeats): a product of matrices for each pair of places.

    With the lengths of the query's tokens and the radii of balls about the known ones it is a bound instead.
    """
    out = np.zeros((queries.shape[1], known.shape[1]))
    for i, q in enumerate(queries):
        best = None
        for j, t in enumerate(known):
            s = q @ t.T
            if radii is not None:
                s += sizes[i][:, None] * radii[j]
            best = s if best is None else np.maximum(best, s, out=best)
        out += best
    return out


def _source(df: DataFrame, only_cls: bool, make_encoder: Callable | None) -> DataFrame:
    """uid, and tokens; sentences are moved in place of tokens that an encoder makes where they are compared."""
    if make_encoder is not None:
        return df.select(F.col("uid").cast("long").alias("uid"), F.col("sentence").alias("tokens"))
    return df.select(F.col("uid").cast("long").alias("uid"), (F.slice("tokens", 1, 1) if only_cls else F.col("tokens")).alias("tokens"))


def _matrices(tokens: pa.ChunkedArray, metric: str, only_cls: bool, make_encoder: Callable | None) -> Matrices:
    return Matrices(tokens if make_encoder is None else matrices_of(tokens, make_encoder, only_cls), metric)


def pair_similarities(test: DataFrame, train: DataFrame, neighbours: DataFrame, only_cls: bool = False, metric: str = "cos", make_encoder: Callable | None = None) -> DataFrame:
    """q_uid, rank, t_uid, dist, sim: the MaxSim of every pair of neighbours (q_uid, rank, t_uid, dist, part), a table that can be read several times.

    With make_encoder both sides have a sentence in place of tokens.

    Training sentences that are anybody's neighbours are dealt to blocks, near ones together, and sent once; a query is sent once to each block that
    holds neighbours of it. Blocks and the queries that meet in a task are bounded in bytes; a block that very many queries need is sent to several tasks.
    """
    spark = test.sparkSession
    ship(spark)
    reduced = lambda df: _source(df, only_cls, make_encoder)
    first = reduced(train).select("tokens").first()
    schema = "q_uid long, rank int, t_uid long, dist double, sim double"
    if first is None:
        return spark.createDataFrame([], schema)
    matrix = first["tokens"] if make_encoder is None else make_encoder().encode([first["tokens"] or ""])[0][: 1 if only_cls else None]
    length = len(matrix)
    most = max(1, BLOCK_BYTES // (8 * max(1, length * max(len(matrix[0]) if length else 1, 1))))
    needed = neighbours.select("t_uid", "part").distinct()
    parts = sorted(needed.groupBy("part").count().collect())  # as many rows as the index has pivots
    sizes = [r["count"] for r in parts]
    rows = max(1, min(most, -(-sum(sizes) // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    starts = spark.createDataFrame([(r["part"], sum(sizes[:i]), r["count"]) for i, r in enumerate(parts)], "part int, _start long, _n long")
    block = ((F.col("_start") + F.pmod(F.xxhash64("t_uid"), F.col("_n"))) / rows).cast("int").alias("_block")
    t_side = needed.join(F.broadcast(starts), "part").select(F.col("t_uid").alias("uid"), block).join(reduced(train), "uid")

    lists = neighbours.join(F.broadcast(starts), "part").select("q_uid", block, F.struct("rank", "t_uid", "dist").alias("_pair"))
    lists = lists.groupBy("q_uid", "_block").agg(F.collect_list("_pair").alias("pairs"))
    q_side, t_side = (x.withColumn("_shard", F.lit(0)) for x in (lists, t_side))
    if test.select("uid").limit(most + 1).count() > most:  # only then can so many queries need one block
        hot = lists.groupBy("_block").count().where(F.col("count") > most).select("_block", F.ceil(F.col("count") / most).cast("int").alias("_shards"))  # a block for each `most` queries and neighbour
        shards = F.coalesce(F.col("_shards"), F.lit(1))
        q_side = q_side.join(F.broadcast(hot), "_block", "left").withColumn("_shard", F.pmod(F.xxhash64("q_uid"), shards).cast("int")).drop("_shards")
        t_side = t_side.join(F.broadcast(hot), "_block", "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1))).drop("_shards")
    q_side = q_side.join(reduced(test).withColumnRenamed("uid", "q_uid"), "q_uid")

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if q.num_rows and t.num_rows:
            asked, known = (_matrices(x.column("tokens"), metric, only_cls, make_encoder) for x in (q, t))
            uids = t.column("uid").to_numpy()
            by = np.argsort(uids, kind="stable")
            pairs = q.column("pairs").combine_chunks()
            sizes, flat = pairs.value_lengths().to_numpy(zero_copy_only=False), pairs.flatten()
            rank, t_uid, dist = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("rank", "t_uid", "dist"))
            place = by[np.searchsorted(uids, t_uid, sorter=by)]
            ends = np.cumsum(sizes)
            for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                query = asked[i]
                step = max(1, STEP_VALUES // max(1, len(query) * length))
                for j in range(a, b, step):
                    out[4].append(max_sims(query, *known.of(place[j : min(b, j + step)])))
            out[:4] = [[np.repeat(q.column("q_uid").to_numpy(), sizes)], [rank], [t_uid], [dist]]
        kinds = (np.int64, np.int32, np.int64, np.float64, np.float64)
        columns = [np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]
        return pa.table(dict(zip(("q_uid", "rank", "t_uid", "dist", "sim"), columns, strict=True)))

    return q_side.groupBy("_block", "_shard").cogroup(t_side.groupBy("_block", "_shard")).applyInArrow(compare, schema)


def prefix_scores(sims: DataFrame, sizes: list[int]) -> DataFrame:
    """core_set, uid, raw_max, raw_mean for each of some sizes of the core set, from one table of pairs: running values along the rank."""
    along = Window.partitionBy("q_uid").orderBy("rank")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.array(*[F.lit(s) for s in sorted(set(sizes))])
    here = F.filter(wanted, lambda s: (s == F.col("rank")) | ((s > F.col("rank")) & (F.col("rank") == F.col("_last"))))
    running = sims.select("q_uid", "rank", F.max("sim").over(along).alias("raw_max"), F.avg("sim").over(along).alias("raw_mean"), F.max("rank").over(whole).alias("_last"))
    return running.select(F.explode(here).alias("core_set"), F.col("q_uid").alias("uid"), "raw_max", "raw_mean")


def against_core_set(test: DataFrame, train: DataFrame, neighbours: DataFrame, only_cls: bool = False, metric: str = "cos") -> DataFrame:
    """uid, raw_max, raw_mean: MaxSim of each test sentence with its neighbours."""
    sims = pair_similarities(test, train, neighbours, only_cls, metric)
    return sims.groupBy(F.col("q_uid").alias("uid")).agg(F.max("sim").alias("raw_max"), F.avg("sim").alias("raw_mean"))


def against_all(test: DataFrame, train: DataFrame, only_cls: bool = False, metric: str = "cos", block_rows: int = TOKEN_BLOCK, make_encoder: Callable | None = None) -> DataFrame:
    """uid, raw_max, raw_mean over all training sentences, block by block. Sentences may differ in their number of tokens. With make_encoder both sides have a sentence in place of tokens."""

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if q.num_rows and t.num_rows:
            asked, known = (_matrices(x.column("tokens"), metric, only_cls, make_encoder) for x in (q, t))
            queries, sentences = _padded(asked.values, asked.firsts, False), _padded(known.values, known.firsts, True)
            step = max(1, TILE_VALUES // t.num_rows)
            for i in range(0, q.num_rows, step):
                rows += [(s.max(), s.sum(), len(s)) for s in sums_of_best(queries[:, i : i + step], sentences)]
        best, total, count = (np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.float64, np.float64, np.int64)))
        return pa.table({"uid": q.column("uid").combine_chunks() if rows else pa.array([], pa.int64()), "best": best, "total": total, "count": count})

    reduced = lambda df: _source(df, only_cls, make_encoder)
    parts = in_blocks(reduced(test), reduced(train), compare, "uid long, best double, total double, count long", block_rows)
    return parts.groupBy("uid").agg(F.max("best").alias("raw_max"), (F.sum("total") / F.sum("count")).alias("raw_mean"))


def _balls(known: Matrices, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of balls that hold each sentence's tokens, and where each sentence's balls begin. Centres are means of tokens about the ones farthest from each other."""
    centres, radii, firsts = [], [], []
    for i in range(len(known.firsts) - 1):
        firsts.append(len(centres))
        tokens = known[i]
        if not len(tokens):
            continue
        seeds = [0]
        away = ((tokens - tokens[0]) ** 2).sum(axis=1)
        while len(seeds) < groups and away.max() > 0:
            seeds.append(int(away.argmax()))
            away = np.minimum(away, ((tokens - tokens[seeds[-1]]) ** 2).sum(axis=1))
        owner = ((tokens[:, None, :] - tokens[None, seeds, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(seeds)):
            mine = tokens[owner == g]
            if len(mine):
                centres.append(mine.mean(axis=0))
                radii.append(np.sqrt(((mine - centres[-1]) ** 2).sum(axis=1).max()))
    return np.array(centres).reshape(len(centres), known.values.shape[1] if known.values.ndim > 1 else 0), np.array(radii), np.array(firsts, np.int64)


def best_against_all(test: DataFrame, train: DataFrame, only_cls: bool = False, metric: str = "cos", neighbours: DataFrame | None = None, block_rows: int = TOKEN_BLOCK, groups: int = 4) -> DataFrame:
    """uid, raw_max over all training sentences, and looked: of how many of them the MaxSim was computed.

    The tokens of a training sentence lie in a few balls. What a query's token can have with any of them is at most its product with a ball's centre, and its
    length times the radius: the sum over the query's tokens bounds the MaxSim. Sentences are scored from the largest bound down, as long as a bound
    lies above the best so far. Neighbours (of nearest()), where they are given, give each query a best to begin with in every block. Equal to raw_max of against_all().
    """
    reduced = lambda df: df.select(F.col("uid").cast("long").alias("uid"), (F.slice("tokens", 1, 1) if only_cls else F.col("tokens")).alias("tokens"))
    asked_of = reduced(test).withColumn("limit", F.lit(float("-inf")))
    if neighbours is not None:
        start = against_core_set(test, train, neighbours, only_cls, metric).select("uid", F.col("raw_max").alias("_limit"))
        asked_of = reduced(test).join(start, "uid", "left").select("uid", "tokens", F.coalesce("_limit", F.lit(float("-inf"))).alias("limit"))

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        best, looked = np.zeros(0), np.zeros(0, np.int64)
        if q.num_rows and t.num_rows:
            asked, known = Matrices(q.column("tokens"), metric), Matrices(t.column("tokens"), metric)
            centres, radii, firsts = _balls(known, groups)
            best, looked = q.column("limit").to_numpy().copy(), np.zeros(q.num_rows, np.int64)
            ends = np.append(firsts, len(radii))
            queries, middles, around = _padded(asked.values, asked.firsts, False), _padded(centres, ends, True), _padded(radii, ends, True)
            size, tile = np.sqrt((queries**2).sum(axis=2)), max(1, TILE_VALUES // t.num_rows)
            for i in range(q.num_rows):
                if i % tile == 0:
                    all_bounds = sums_of_best(queries[:, i : i + tile], middles, size[:, i : i + tile], around)
                query, bounds = asked[i], all_bounds[i % tile]
                some = np.flatnonzero(bounds >= best[i] - 1e-9 * (1 + abs(best[i])))
                order, step = some[np.argsort(-bounds[some], kind="stable")], 8
                at = 0
                while at < len(order) and bounds[order[at]] >= best[i] - 1e-9 * (1 + abs(best[i])):
                    some = order[at : at + step]
                    best[i] = max(best[i], max_sims(query, *known.of(some)).max())
                    looked[i] += len(some)
                    at, step = at + len(some), min(2 * step, 256)
        uid = q.column("uid").combine_chunks() if len(best) else pa.array([], pa.int64())
        return pa.table({"uid": uid, "best": best, "looked": looked})

    parts = in_blocks(asked_of, reduced(train), compare, "uid long, best double, looked long", block_rows)
    return parts.groupBy("uid").agg(F.max("best").alias("raw_max"), F.sum("looked").alias("looked"))


def inverted(raw: DataFrame, column: str, name: str = "score") -> DataFrame:
    """Adds the largest raw value of all minus this one: 0 is the most normal. Raw values are written, as they are read twice."""
    raw = stored(raw, "raw")
    top = raw.agg(F.max(column).alias("_top"))  # one row
    return raw.crossJoin(F.broadcast(top)).withColumn(name, F.round(F.col("_top") - F.col(column), PLACES)).drop("_top")


def distance_score(neighbours: DataFrame) -> DataFrame:
    """uid, score: the distance of the nearest training sentence."""
    return neighbours.groupBy(F.col("q_uid").alias("uid")).agg(F.min("dist").alias("score"))


def to_rows(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Every log row with the score of its sentence."""
    return rows.join(scores.select("uid", "score"), "uid")
