"""Order MinHash fingerprints in DataFrame functions (operator 3).

A text's tokens give word k-mers, numbered by occurrence so that repeats count. A hash of (k-mer, occurrence) deals them to
buckets; each bucket keeps its `tuple_size` smallest, puts them back into text order and hashes the tuple. Two texts
agree in a bucket if they hold the same k-mers there in the same order: inserting, deleting, changing or
moving words lowers the share of buckets that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, shuffle_partitions, text_of

#: Words longer than this count as several tokens, so text without blanks is compared too.
TOKEN = r"\S{1,12}"
#: Ranges of doc_id at most: the plan names their bounds. Beyond, ranges hold more rows, which a task sorts on disk.
MOST_RANGES = 20_000


def kmers(text: Column, k: int) -> Column:
    """array<long>: a hash of each run of k tokens; of the whole sequence where there are fewer; empty without tokens."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    # the array is bound once by a one-element transform, so its evaluation is not repeated for every position
    runs = F.transform(
        F.array(hashed),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < k, F.array(F.xxhash64(h)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))),
    )
    return runs[0]


def _numbered(hashes: Column) -> Column:
    """array<struct<rank long, at int, kmer long>>: k-mers with the hash of (k-mer, occurrence), unsorted.

    Sorting by (k-mer, place) brings equal k-mers together; the places where a run of them begins give the occurrence
    numbers in one pass.
    """

    def spread(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["kmer"] != F.get(s, j - 1)["kmer"]))
        by_run = F.transform(
            F.array(begins),
            lambda b: F.flatten(
                F.transform(
                    b,
                    lambda first, r: F.transform(
                        F.sequence(first, F.coalesce(F.get(b, r + 1), F.size(s)) - 1),
                        lambda j: F.struct(F.xxhash64(F.get(s, j)["kmer"], j - first).alias("rank"), F.get(s, j)["at"].alias("at"), F.get(s, j)["kmer"].alias("kmer")),
                    ),
                )
            ),
        )
        return by_run[0]

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("kmer"), i.alias("at"))))
    empty = F.array().cast("array<struct<rank:bigint,at:int,kmer:bigint>>")
    return F.transform(F.array(ordered), lambda s: F.when(F.size(s) == 0, empty).otherwise(spread(s)))[0]


def signature(text: Column, k: int = 2, tuple_size: int = 2, buckets: int = 64) -> Column:
    """array<int> of `buckets` tuple hashes; 0 for a bucket with no k-mer. `buckets` is a power of two up to 256."""
    shift = 64 - (buckets.bit_length() - 1)
    bucket = lambda x: F.shiftrightunsigned(x["rank"], shift)

    def smallest(e: Column) -> Column:
        # sorted by rank: signed order keeps a bucket's ranks together and ascending
        return F.filter(e, lambda x, j: (j < tuple_size) | (bucket(F.get(e, j - tuple_size)) != bucket(x)))

    def tuples(kept: Column) -> Column:
        # a bucket's k-mers stand side by side, so its tuple is a slice between the places where buckets begin
        begins = F.filter(F.sequence(F.lit(0), F.size(kept) - 1), lambda j: (j == 0) | (bucket(F.get(kept, j)) != bucket(F.get(kept, j - 1))))

        def by_run(b: Column) -> Column:
            def one(first: Column, r: Column) -> Column:
                own = F.slice(kept, first + 1, F.coalesce(F.get(b, r + 1), F.size(kept)) - first)
                in_text = F.sort_array(F.transform(own, lambda x: F.struct(x["at"], x["kmer"])))
                return F.xxhash64(F.transform(in_text, lambda x: x["kmer"])).bitwiseAND(0x7FFFFFFF).cast("int").bitwiseOR(1)

            return F.struct(F.transform(b, lambda j: bucket(F.get(kept, j))).alias("filled"), F.transform(b, one).alias("hashes"))

        runs = F.transform(F.array(begins), by_run)
        numbers = F.sequence(F.lit(0), F.lit(buckets - 1))
        spread = F.transform(runs, lambda s: F.transform(numbers, lambda i: F.coalesce(F.get(s["hashes"], (F.array_position(s["filled"], i.cast("long")) - 1).cast("int")), F.lit(0))))[0]
        return F.when(F.size(kept) == 0, F.array_repeat(F.lit(0), buckets)).otherwise(spread)

    ordered = F.sort_array(_numbered(kmers(text, k)))
    kept = F.transform(F.array(ordered), smallest)[0]
    return F.transform(F.array(kept), tuples)[0]


def fingerprint(sig: Column) -> Column:
    """The signature as text: eight hexadecimal digits a bucket."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, tuple_size: int = 2) -> Column:
    """0 to 1: the share of buckets that agree among those that either text fills, to the power 1 / tuple_size.

    Two texts without tokens are alike (1). The root makes the number estimate the share of common k-mers, since a
    tuple agrees only if all its members do.
    """
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    filled = F.size(F.filter(both, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(both, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.pow(same / F.greatest(filled, F.lit(1)), F.lit(1.0 / tuple_size)))


def _bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie at or below a value, by binary search."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds)).bit_length()))]
    array = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.coalesce(F.get(array, n + step - 1) <= value, F.lit(False)), n + step).otherwise(n))


def with_next(docs: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """doc_id, text and the next row's next_text and next_sig-ready text in descending doc_id order, cyclic.

    Ranges of doc_id are cut at quantiles of all ids, so each holds a bounded number of rows; the first row of a range also
    travels to the range before it, so a window inside the ranges, each a task of its own, sees every next row. Two passes read the ids alone. The
    driver holds two numbers for each range. Null ids come last, rows with equal ids stand in the order of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("_id", F.coalesce(-F.col("doc_id"), F.lit(NO_ID)))  # ascending: the order that is asked for
    ids = docs.select(F.coalesce(-F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"))
    count = ids.count()
    ranges = max(shuffle_partitions(spark), min(count // rows_per_range, MOST_RANGES))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.agg(F.percentile_approx("_id", shares, 10_000).alias("b")).first()["b"] or [])) if shares and count else []
    heads = {r["_range"]: r["_id"] for r in ids.groupBy(_bucket_of(F.col("_id"), bounds).alias("_range")).agg(F.min("_id").alias("_id")).collect()}
    filled = sorted(heads)
    before = {heads[r]: filled[i - 1] for i, r in enumerate(filled)}  # the range before a head's own, cyclic
    heads_array = F.array(*[F.lit(heads[r]).cast("long") for r in filled]) if filled else F.array().cast("array<bigint>")
    before_array = F.array(*[F.lit(before[heads[r]]) for r in filled]) if filled else F.array().cast("array<int>")
    own = F.struct(_bucket_of(F.col("_id"), bounds).alias("range"), F.lit(0).alias("guest"))
    place = _bucket_of(F.col("_id"), [heads[r] for r in filled]) - 1  # the last head at or below the id
    is_head = F.get(heads_array, place) == F.col("_id")
    guest = F.struct(F.get(before_array, place).alias("range"), F.lit(1).alias("guest"))
    spread = rows.withColumn("_to", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    spread = spread.select("doc_id", "text", "_id", F.col("_to.range").alias("_range"), F.col("_to.guest").alias("_guest"))
    return spread.repartitionById(ranges, "_range")


def edited_pairs(docs: DataFrame, k: int = 2, tuple_size: int = 2, buckets: int = 64) -> DataFrame:
    """Fingerprints of every text and of its edited text; see the module for the method.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next row's
    text, in descending doc_id order, the last row followed by the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text is the empty one, whose
    fingerprint is all zeros; a table of one row is its own next; an empty table gives no rows; other columns are not looked at.
    """
    sig = lambda c: signature(F.col(c), k, tuple_size, buckets)
    here = with_next(docs).withColumn("sig", sig("text"))
    order = Window.partitionBy("_range").orderBy("_guest", "_id", "text")
    nexts = here.withColumn("_next", F.lead(F.struct("text", "sig")).over(order)).where("_guest = 0")
    cut = nexts.withColumn("n_chars", F.length("text").cast("long")).withColumn("_third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _third)"), F.expr("substring(_next.text, 1, _third)"))
    both = cut.withColumn("_edited", edited).withColumn("esig", sig("_edited"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("esig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("esig"), tuple_size).alias("near_edited"),
        likeness(F.col("sig"), F.col("_next.sig"), tuple_size).alias("near_next"),
    )
