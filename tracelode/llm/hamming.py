"""Exact top-k search in Hamming space by incremental multi-index hashing (operator 10).

A code is cut into segments, each with an index of its own. At radius r every segment is searched for the values
that differ from the query's in exactly r bits. A code that no segment has found up to radius r differs in more than
r bits in each of m segments, so by m * (r + 1) at least: a query is done once its k-th verified distance is below that.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

BITS = 64


def sign_code(embedding: Column) -> Column:
    """A 64-bit code: bit i is set where element i is above 0. Missing and null elements and a null vector give 0 bits."""
    bits = F.transform(F.coalesce(embedding, F.array().cast("array<double>")), lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.slice(F.concat(bits, F.array_repeat(F.expr("0L"), BITS)), 1, BITS), F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def segment_bounds(rows: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: somewhat narrower than the logarithm of the number of codes, so a value names a few."""
    width = min(24, max(8, round(math.log2(max(2, rows))) - 2))
    count = math.ceil(BITS / width)
    ends = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _value(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND((1 << width) - 1)


def _flips(width: int, radius: int) -> Column:
    """All values of so many bits of which `radius` are set, put together from two halves: the plan names those of a half alone."""
    low = width // 2

    def named(bits: int, some: int) -> Column:
        return F.expr(f"array({', '.join(f'{sum(1 << i for i in c)}L' for c in combinations(range(bits), some))})")

    def both(some: int) -> Column:
        upper = F.transform(named(width - low, radius - some), lambda x: F.shiftleft(x, low))
        return F.flatten(F.transform(named(low, some), lambda a: F.transform(upper, lambda b: a.bitwiseOR(b))))

    return F.concat(*[both(some) for some in range(max(0, radius - (width - low)), min(low, radius) + 1)])


def _probes(segment: int, shift: int, width: int, radius: int) -> Column:
    """The index entries that differ from a query's in exactly so many bits of one segment."""
    own = _value(F.col("query_code"), shift, width)
    return F.transform(_flips(width, radius), lambda x: F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(x).alias("value")))


def top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (1..k), id, distance: the k nearest codes of each query, ties by id.

    Both have id and code (long). A query is compared with every code, also one with its own id; null ids take part
    and come last among ties, a null code is not found and finds nothing. Fewer than k codes give fewer rows. Rows with one code stand
    together: the index holds distinct codes, and of each code's ids only the k smallest can ever be in a result.
    Equal queries' rows are answered once for each distinct (id, code).
    """
    near = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    # a row for each of the first k ids of a code; Spark limits the groups before it shuffles them
    members = stored(codes.where("code is not null").select("id", "code").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k).drop("_n"), "members")
    distinct = stored(members.groupBy("code").agg(F.count("*").alias("held")), "codes")
    asked = stored(queries.where("code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).distinct().withColumn("bound", F.lit(BITS)), "queries")
    partitions = shuffle_partitions(codes.sparkSession)
    segments = segment_bounds(distinct.count())
    index = distinct.select("code", "held", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _value(F.col("code"), *b).alias("value")) for s, b in enumerate(segments)])).alias("s")).select("code", "held", F.col("s.segment").alias("_segment"), F.col("s.value").alias("_value"))
    todo, found, done = asked, None, []
    for radius in range(max(w for _, w in segments) + 1):
        probes = [_probes(s, shift, width, radius) for s, (shift, width) in enumerate(segments) if radius <= width]
        probe = todo.repartition(partitions, "query_id", "query_code").select("query_id", "query_code", "bound", F.explode(F.flatten(F.array(*probes))).alias("p")).select("query_id", "query_code", "bound", "p.*")
        distance = F.bit_count(F.col("query_code").bitwiseXOR(F.col("code")))
        # verified while they meet: a code beyond the k-th distance so far cannot be in the result. The probes are many
        # times their estimate, so the join may not broadcast them
        meet = (F.col("segment") == F.col("_segment")) & (F.col("value") == F.col("_value")) & (distance <= F.col("bound"))
        hits = probe.hint("merge").join(index.hint("merge"), meet).select("query_id", "query_code", "code", "held", distance.alias("distance")).distinct()
        if found is not None:
            before = found.join(todo.select(F.col("query_id").alias("_q"), F.col("query_code").alias("_c")), F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("query_code") == F.col("_c")), "left_semi")
            hits = hits.unionByName(before).distinct()
        # only codes with fewer than k rows before them, counted by distance alone, can be in the result
        closer = F.sum("held").over(Window.partitionBy("query_id", "query_code").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1))
        kept = stored(hits.withColumn("_closer", F.coalesce(closer, F.lit(0))).where(F.col("_closer") < k).drop("_closer"), "found")
        safe = len(segments) * (radius + 1)  # every code nearer than this has been found
        near = F.sum(F.when(F.col("distance") < safe, F.col("held")).otherwise(0))
        kth = F.when(F.sum("held") >= k, F.max("distance")).otherwise(BITS)
        state = stored(kept.groupBy(F.col("query_id").alias("_q"), F.col("query_code").alias("_c")).agg((near >= k).alias("sure"), kth.alias("kth")), "state")
        same = (F.col("query_id").eqNullSafe(F.col("_q"))) & (F.col("query_code") == F.col("_c"))
        done.append(kept.join(state.where("sure"), same, "left_semi"))
        rest = stored(todo.join(state, same, "left").where(~F.coalesce("sure", F.lit(False))).select("query_id", "query_code", F.coalesce("kth", "bound").alias("bound")), "queries")
        found, todo = kept, rest
        if rest.isEmpty():
            break
    else:
        left = todo.select(F.col("query_id").alias("_q"), F.col("query_code").alias("_c"))  # every code has been seen
        done.append(found.join(left, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("query_code") == F.col("_c")), "left_semi"))
    answers = done[0]
    for more in done[1:]:
        answers = answers.unionByName(more)
    order = Window.partitionBy("query_id", "query_code").orderBy("distance", F.col("id").asc_nulls_last())
    ranked = answers.join(members, "code").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")
