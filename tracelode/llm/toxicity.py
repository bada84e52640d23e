"""Toxicity by two class-conditional Kneser-Ney bigram models (operator 5).

Each class has a model of its own, interpolated with absolute discounts from word pairs down to words and to stems, the first bytes of words.
As Kneser and Ney have it, a lower order does not count how often something is there but in how many different contexts: words by the
different words before them, stems by the pairs of their words. So what one text, or a copy of it, says again counts once: texts count by
the share that is their own, none is left out. What the
discounts leave goes to the next order, from stems to counts that both classes share: these also divide a stem among its words.

A text is compared by its log-likelihoods under the two models, divided by the length: a text is as toxic as its most toxic stretch of a
few words. A logistic regression of this one number, fitted on rows the counts have not seen, makes it a score. It sees a third of all
labelled rows, whatever their number: each step of the fit is one sum over their numbers, made by the executors.

The counts cover all labelled rows and grow with them, but stay with the executors. A count whose shares of the two classes can be chance
is pruned from the models, and its weight goes to the backoff, so that each context still adds up to one; the test's limit rises with
the number of counts tried. Shared counts cancel in the comparison, so only what is left reaches the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, drop_stored, free_shuffles, frugal, plain_names, shuffle_partitions, stored, text_of
from .words import NOT_ALNUM, Words, mix

#: Text bytes whose words a task counts before it sends them.
COMBINE_BYTES = 6 << 20
DISCOUNT = 0.75
#: Bytes of a stem.
STEM = 5
#: The likelihood ratio statistic that a count needs to stay in the models, beside twice the logarithm of the number of counts tried.
EVIDENCE = 4.0
#: Words of a stretch.
STRETCH = 6
#: Stands before the first word of a text.
START = 7
#: Parts that a word's contexts are counted in, for words with very many of them.
SALTS = 8
#: Hashes by whose minima copies are known.
SEEDS = 4
#: The weight of a text that shares nothing. Weights are whole numbers, so that their sums do not depend on an order.
UNIT = 1 << 20
#: Labelled rows that may be broadcast (some 24 bytes each); more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000


@dataclass
class Ratios:
    """Logarithms of toxic over ordinary probability by hash (ascending)."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Ratios:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and the values of these."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), self.values
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes
        return hit, self.values[at[hit]]


@dataclass
class Model:
    """The two models as ratios: of what is left after pruning, and of the weights of each order's backoff."""

    stems: Ratios
    words: Ratios
    contexts: Ratios  # of the weights that the pairs after a word leave to the words
    pairs: Ratios
    stem_rest: float
    word_rest: float
    weights: np.ndarray = None

    def ratios(self, w: Words) -> np.ndarray:
        """The logarithm of toxic over ordinary probability of each word after the one before it."""
        out = np.full(len(w.hashes), self.stem_rest + self.word_rest)
        hit, value = self.stems.find(w.prefixes(STEM))
        out[hit] = value + self.word_rest
        hit, value = self.words.find(w.hashes)
        out[hit] = value
        before = before_of(w)
        hit, value = self.contexts.find(before)
        out[hit] += value
        hit, value = self.pairs.find(_pairs(before, w.hashes))
        out[hit] = value
        return out

    def _signal(self, w: Words) -> np.ndarray:
        n, length = len(w.hashes), np.diff(w.firsts)
        out = np.full(len(length), self.stem_rest + self.word_rest)
        some = length > 0
        if n:
            total = np.concatenate([[0.0], np.cumsum(self.ratios(w))])
            ends = np.minimum(np.arange(n) + STRETCH, np.repeat(w.firsts[1:], length))
            out[some] = np.maximum.reduceat((total[ends] - total[:-1]) / STRETCH, w.firsts[:-1][some])
        return out

    def signal(self, text: pa.Array) -> np.ndarray:
        """Of each text the length-normalised log-likelihood ratio of its most toxic stretch; of a text without words that of a word nobody knows."""
        found = [self._signal(Words(t, lower=True, separators=NOT_ALNUM)) for t in _slices(text)]
        return np.concatenate([np.zeros(0), *found])

    def score(self, text: pa.Array) -> np.ndarray:
        x = np.clip(self.signal(text) * self.weights[0] + self.weights[1], -30, 30)
        return 1 / (1 + np.exp(-x))


def _slices(text: pa.Array) -> Iterator[pa.Array]:
    for part in byte_slices(pa.RecordBatch.from_arrays([text], ["t"]), "t"):
        yield part.column("t")


def before_of(w: Words) -> np.ndarray:
    """The hash of the word before each word; START for the first of a text."""
    out = np.concatenate([np.zeros(1, np.uint64), w.hashes[:-1]])[: len(w.hashes)]
    out[w.firsts[:-1][np.diff(w.firsts) > 0]] = START
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b))


def _begins(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else np.zeros(0, values.dtype)


_COUNTED = ["word", "before", "stem", "n0", "n1"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows _toxic, _weight, text: in texts of what weight in each class a word is after another (stem null); and of each word in texts of what weight, by pairs, another is after it (before null)."""
    held: list[list[np.ndarray]] = []
    size = texts = 0

    def send() -> Iterator[pa.RecordBatch]:
        word, before, stem, doc, of = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, before, word))
        order = order[_begins(word[order], before[order], doc[order])]  # what one text says again counts once
        w, v, toxic, all_of = word[order], before[order], np.maximum(of[order], 0), np.abs(of[order])
        begins = _begins(w, v)
        ones, all_ = _sums(toxic, begins), _sums(all_of, begins)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w[begins].view(np.int64), v[begins].view(np.int64))] + [pa.nulls(len(begins), pa.int64()), pa.array(all_ - ones), pa.array(ones)], _COUNTED)
        names, first = np.unique(word, return_index=True)
        after = np.argsort(v, kind="stable")
        begins = _begins(v[after])
        left, ones, all_ = v[after][begins], _sums(toxic[after], begins), _sums(all_of[after], begins)
        rows = [(names, stem[first], np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)), (left, None, all_ - ones, ones)]
        for key, stems, zeros, ones in rows:
            stems = pa.nulls(len(key), pa.int64()) if stems is None else pa.array(stems.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.int64()), stems, pa.array(zeros), pa.array(ones)], _COUNTED)

    for batch in batches:
        for part in byte_slices(batch, "text"):
            w = Words(part.column("text"), lower=True, separators=NOT_ALNUM)
            doc = w.text_of()
            if not len(doc):
                continue
            toxic, weight = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_toxic", "_weight"))
            of = np.where(toxic > 0, weight, -weight)[doc]  # the sign is the class
            held.append([w.hashes, before_of(w), w.prefixes(STEM), doc + texts, of])
            texts += part.num_rows
            size += len(w.data)
            if size >= COMBINE_BYTES:
                yield from send()
                held, size = [], 0
    if held:
        yield from send()


_MET = ["word", "before", "stem", "n0", "n1", "k0", "k1", "kinds"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _count sorted by (word, before), all of a pair in one task: its sums where there are two; and of each word (before null) the
    contexts it has in each class and in all, beside what follows it. Held back are the rows of the open pair.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column("word").to_numpy()
        lone = batch.column("before").is_null().to_numpy(zero_copy_only=False)
        before = batch.column("before").fill_null(0).to_numpy()
        known = batch.column("stem").is_valid().to_numpy(zero_copy_only=False)
        now = [word, before, lone, batch.column("stem").fill_null(0).to_numpy(), known, batch.column("n0").to_numpy(), batch.column("n1").to_numpy()]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        begins = _begins(now[0], now[1], now[2])
        held = [x[begins[-1] :] for x in now]
        if begins[-1]:
            yield from _met([x[: begins[-1]] for x in now])
    if held is not None:
        yield from _met(held)


def _met(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    word, before, lone, stem, known, n0, n1 = rows
    begins = _begins(word, before, lone)
    zeros, ones = _sums(n0, begins), _sums(n1, begins)
    word_of, single = word[begins], lone[begins]
    often = np.flatnonzero(~single & (zeros + ones > UNIT))
    none = pa.nulls(len(often), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(word_of[often]), pa.array(before[begins][often]), none, pa.array(zeros[often]), pa.array(ones[often]), none, none, none], _MET)
    by = _begins(word_of)
    sums = [_sums(np.where(single, x, 0), by) for x in (zeros, ones)] + [_sums((~single & x).astype(np.int64), by) for x in (zeros > 0, ones > 0, zeros + ones > 0)]
    first = _begins(word)
    has = np.logical_or.reduceat(known, first)
    stems = pa.array(stem[first + _first_true(known, first)], mask=~has)
    yield pa.RecordBatch.from_arrays([pa.array(word_of[by]), pa.nulls(len(by), pa.int64()), stems, *map(pa.array, sums)], _MET)


def _first_true(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each run how far from its beginning the first flag is set; 0 where none is."""
    length = np.diff(np.append(begins, len(flags)))
    at = np.where(flags, np.arange(len(flags)), len(flags))
    least = np.minimum.reduceat(at, begins)
    return np.where(least < begins + length, least - begins, 0)


def likelihood_ratio(n0: Column, n1: Column, share: float) -> Column:
    """The statistic G2 of counts in two classes against the toxic share of all of them."""
    total = n0 + n1
    part = lambda n, p: F.when(n > 0, n * F.ln(n / (total * F.lit(max(p, 1e-300))))).otherwise(0.0)
    return 2 * (part(n0, 1 - share) + part(n1, share))


def _columns(rows: DataFrame, *names: str) -> list[np.ndarray]:
    t = rows.select(*names).toArrow()
    return [t.column(c).to_numpy() for c in names]


def fit_models(text: DataFrame, evidence: float = EVIDENCE) -> Model:
    """The two models of all rows _toxic, text, counted by the executors; class 1 is toxic. Either class may be empty. Where there is a _weight, texts count by it.

    evidence: minus infinity prunes nothing that two texts have, and gives the plain Kneser-Ney probabilities of stems and words.
    """
    spark = text.sparkSession
    weight = F.col("_weight") if "_weight" in text.columns else F.lit(UNIT).alias("_weight")
    counted = text.select("_toxic", weight, "text").mapInArrow(frugal(_count), "word long, before long, stem long, n0 long, n1 long")
    salt = F.pmod(F.coalesce("before", F.lit(0)), F.lit(SALTS))
    met = counted.repartition(shuffle_partitions(spark), "word", salt).sortWithinPartitions("word", "before")
    counts = stored(met.mapInArrow(frugal(_meet), "word long, before long, stem long, n0 long, n1 long, k0 long, k1 long, kinds long"), "counts")
    by_word = counts.where("before is null").groupBy("word").agg(F.max("stem").alias("stem"), *[F.sum(c).alias(c) for c in ("n0", "n1", "k0", "k1", "kinds")])
    words = stored(by_word, "words")
    free_shuffles(spark)
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "k0", "k1", "kinds")], F.count("*").alias("words"), F.count_distinct("stem").alias("stems")).first()
    k, n = np.array([total.k0, total.k1], float), np.array([total.n0, total.n1], float)
    kept = lambda c0, c1, sums, tried, unit=1: likelihood_ratio(F.col(c0) / unit, F.col(c1) / unit, sums[1] / max(1.0, sums.sum())) > evidence + 2 * np.log(max(1, tried))
    by_stem = words.where("stem is not null and k0 + k1 > 0").groupBy("stem").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    stem, s0, s1 = _columns(by_stem.where(kept("k0", "k1", k, total.stems)), "stem", "k0", "k1")
    word, before, n0, n1 = _columns(counts.where("before is not null").where(kept("n0", "n1", n, total.kinds, UNIT)), "word", "before", "n0", "n1")
    marked = words.where("k0 + k1 > 0").where(kept("k0", "k1", k, total.words))
    # the words that pairs need too, whether they are marked or not
    needed = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([word, before])).tolist()], "word long")
    columns = ["word", "stem", "n0", "n1", "k0", "k1"]
    rows = marked.select(*columns, F.lit(True).alias("marked")).unionByName(words.join(F.broadcast(needed), "word", "left_semi").select(*columns, F.lit(False).alias("marked")))
    found = rows.groupBy(*columns).agg(F.max("marked").alias("marked")).toArrow().sort_by("word")
    names, w0, w1, a0, a1 = (found.column(c).to_numpy() for c in ("word", "k0", "k1", "n0", "n1"))
    is_marked, its_stem = found.column("marked").to_numpy().astype(bool), found.column("stem").fill_null(0).to_numpy()
    drop_stored(counts)
    drop_stored(words)
    k, both = np.maximum(k, 1.0), max(1.0, k.sum())
    # stems: what is not marked has the backoff's weight times the shared probability
    order = np.argsort(stem)
    stem, s = stem[order], np.stack([s0, s1], axis=1).astype(float)[order]
    direct = np.maximum(s - DISCOUNT, 0) / k
    stem_rest = 1 - direct.sum(axis=0)
    stem_p = direct + stem_rest * (s.sum(axis=1) / both)[:, None]
    # words
    c = np.stack([w0, w1], axis=1).astype(float)
    direct = np.where(is_marked[:, None], np.maximum(c - DISCOUNT, 0) / k, 0.0)
    word_rest = 1 - direct.sum(axis=0)
    at = np.minimum(np.searchsorted(stem, its_stem), max(0, len(stem) - 1))
    of_stem = (stem[at] == its_stem) if len(stem) else np.zeros(len(names), bool)
    lower = stem_rest * (c.sum(axis=1) / both)[:, None]
    if len(stem):
        lower[of_stem] = stem_p[at[of_stem]] * (c.sum(axis=1)[of_stem] / s.sum(axis=1)[at[of_stem]])[:, None]
    word_p = direct + word_rest * lower
    # pairs, after the words that they follow
    m = np.stack([n0, n1], axis=1) / UNIT
    left, right = np.searchsorted(names, before), np.searchsorted(names, word)
    after = np.stack([a0, a1], axis=1) / UNIT
    direct = np.maximum(m - DISCOUNT, 0) / np.maximum(after[left], 1.0)
    rest = np.ones((len(names), 2))
    np.subtract.at(rest, left, direct)
    rest = np.maximum(rest, 1e-9)
    pair_p = direct + rest[left] * word_p[right]
    log = lambda p: np.log(p[:, 1]) - np.log(p[:, 0])
    known = np.unique(left)
    return Model(
        Ratios.of(stem.view(np.uint64), log(stem_p)),
        Ratios.of(names[is_marked].view(np.uint64), log(word_p[is_marked])),
        Ratios.of(names[known].view(np.uint64), log(rest[known])),
        Ratios.of(_pairs(before.view(np.uint64), word.view(np.uint64)), log(pair_p)),
        float(np.log(stem_rest[1] / stem_rest[0])),
        float(np.log(word_rest[1] / word_rest[0])),
    )


def fit_logistic(rows: DataFrame, sizes: dict[int, int], ridge: float = 0.3, steps: int = 100) -> np.ndarray | None:
    """Weighted logistic regression of _toxic on x, standardised, by Newton's method with step halving; the slope and the constant are for x as it is.

    sizes are the classes' sizes, to which the rows are weighed back; where there is a _weight, rows count by it. Rows are read once for each step and only sums leave the
    executors. None where a class has no rows.
    """
    own = F.col("_weight") if "_weight" in rows.columns else F.lit(1.0)
    of = {r["_toxic"]: r for r in rows.groupBy("_toxic").agg(F.sum(own).alias("n"), F.sum(own * F.col("x")).alias("x")).collect()}  # a row for each class
    if set(of) != {0, 1}:
        return None
    found = {c: r["n"] for c, r in of.items()}
    middle = sum(r["x"] for r in of.values()) / sum(found.values())
    spread = (rows.agg(F.sum(own * (F.col("x") - middle) ** 2)).first()[0] / sum(found.values())) ** 0.5 + 1e-9
    share = sum(found.values()) / sum(sizes[c] for c in found)
    y, z = F.col("_toxic"), (F.col("x") - F.lit(middle)) / F.lit(spread)
    weight = own * F.when(y == 1, sizes[1] / found[1] * share).otherwise(sizes[0] / found[0] * share)

    def sums(beta: np.ndarray) -> np.ndarray:
        """The penalised loss, its gradient (2) and its second derivatives (3)."""
        t = F.lit(float(beta[0])) * z + F.lit(float(beta[1]))
        p = 1 / (1 + F.exp(-F.greatest(F.least(t, F.lit(30.0)), F.lit(-30.0))))
        parts = rows.select(z.alias("z"), (weight * (F.log1p(F.exp(-F.abs(t))) + F.greatest(t, F.lit(0.0)) - y * t)).alias("loss"), (weight * (y - p)).alias("g"), (weight * p * (1 - p)).alias("h"))
        of = parts.agg(F.sum("loss"), F.sum(F.col("g") * F.col("z")), F.sum("g"), F.sum(F.col("h") * F.col("z") * F.col("z")), F.sum(F.col("h") * F.col("z")), F.sum("h"))
        out = np.array(of.first(), float)
        return out + [0.5 * ridge * beta[0] ** 2, -ridge * beta[0], 0, ridge + 1e-6, 0, 1e-6]

    beta = np.zeros(2)
    now = sums(beta)
    for _ in range(steps):
        step = np.linalg.solve(np.array([[now[3], now[4]], [now[4], now[5]]]), now[1:3])
        size, there = 1.0, sums(beta + step)
        while size > 1e-6 and there[0] > now[0]:
            size /= 2
            there = sums(beta + size * step)
        beta, now = beta + size * step, there
        if np.abs(size * step).max() < 1e-6:
            break
    return np.array([beta[0] / spread, beta[1] - beta[0] * middle / spread])


def _least(batches: Iterator[pa.RecordBatch], seeds: int = SEEDS, words: int = 3) -> Iterator[pa.RecordBatch]:
    """The least of `seeds` hashes of the word triples of each text; none for a text without one."""
    for batch in batches:
        for part in byte_slices(batch, "text"):
            w = Words(part.column("text"), lower=True, separators=NOT_ALNUM)
            starts, hashes = w.windows(words)
            first = np.searchsorted(starts, w.firsts)
            mixed = [mix(hashes + np.uint64(1000003 * (s + 1))) for s in range(seeds)]
            least = [[int(m[a:b].min().view(np.int64)) for m in mixed] if b > a else [] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            kept = ["_id", "_version", "_toxic", "_chars"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(least, pa.list_(pa.int64()))], [*kept, "least"])


def weighed(text: DataFrame) -> DataFrame:
    """_id, _version, _toxic, _chars, _mark, _weight (UNIT is a whole text) of all texts, by _id and _version. _mark is the first minimum that no large share of the rows has, or null.

    Copies and near copies of a text would make its chance words look like expressions of its class. So a text has the weight of what is its own: of
    each of its minima of hashed word triples the share of one among the rows that have it. Equal texts have one weight together, one that shares
    nothing keeps all of its, and one that is alike in part the rest. None is left out.
    """
    own = text.select("_id", "_version", "_toxic", F.length("text").cast("long").alias("_chars"), "text")
    signed = stored(own.mapInArrow(frugal(_least), "_id long, _version long, _toxic int, _chars long, least array<long>").groupBy("_id", "_version").agg(F.count("*").alias("_copies"), *[F.any_value(c).alias(c) for c in ("_toxic", "_chars", "least")]), "signed")
    each = signed.select("_id", "_version", "_copies", F.posexplode("least").alias("seed", "hash"))
    shared = each.groupBy("seed", "hash").agg(F.sum("_copies").alias("_rows")).where("_rows > 1")
    large = max(10, (signed.agg(F.sum("_copies")).first()[0] or 0) // 20)
    counted = each.join(shared, ["seed", "hash"], "left").withColumn("_rows", F.coalesce("_rows", F.lit(1)))
    mark = F.min(F.when(F.col("_rows") <= large, F.struct("seed", "hash")))["hash"].alias("_mark")
    own = counted.groupBy("_id", "_version").agg(F.sum(F.expr(f"{UNIT // SEEDS} div _rows")).alias("_own"), mark)
    weight = F.coalesce("_own", F.expr(f"{UNIT} div _copies"))  # a text without a triple is alike to equal rows alone
    return signed.join(own, ["_id", "_version"], "left").select("_id", "_version", "_toxic", "_chars", "_mark", F.greatest(weight, F.lit(1)).cast("long").alias("_weight"))


def within(rows: list, chars: int) -> list:
    """Those of rows (their characters last) that fit, in order: one that would pass the bound is stepped over. The shortest, if none fits."""
    out, total = [], 0
    for r in rows:
        if total + r[-1] <= chars:
            out.append(r)
            total += r[-1]
    return out or sorted(rows, key=lambda r: r[-1])[:1]


def is_held_out(doc_id: Column, part: int = 2, parts: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def _sent(rows: DataFrame) -> DataFrame:
    """Rows to be joined with texts: sent to them where they are few, so that the texts stay where they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def train(docs: DataFrame, labels: DataFrame, held_out: bool = True, rows: int | None = None, chars: int | None = None) -> Model:
    """Fits on labelled documents; those that are held out give nothing.

    The counts are of all of them but the regression's rows, copies by their share (weighed()). The regression's are a third, by a hash of a minimum of the text's word
    triples, so that copies are on one side, and near copies mostly, unless they are a large share of all; they are weighed back to the sizes of the classes. Whoever wants fewer of them gives a bound: `rows` rows of each class, and as many of these as `chars` characters
    hold. Null ids and labels give nothing; of differing labels of a document the toxic one counts. With one class alone,
    or none, every text gets the same score, the share of the toxic class.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    if held_out:
        marks = marks.where(~is_held_out(F.col("_id")))
    sizes = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    ordinary, toxic = sizes.get(0, 0), sizes.get(1, 0)
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_version"), text_of().alias("text")).join(_sent(marks), "_id")
    weighted = stored(weighed(text), "weighed")
    is_third = F.crc32(F.concat(F.lit("part "), F.coalesce("_mark", "_id").cast("string")).cast("binary")) % 3 == 0
    third = weighted.where(is_third)
    keys = ["_id", "_version"]
    if rows is not None or chars is not None:
        picked = []
        for c in (0, 1):
            first = third.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), *keys)
            first = first if rows is None else first.limit(rows)
            few = [(r["_id"], r["_version"], r["_chars"]) for r in first.select("_id", "_version", "_chars").collect()]
            picked += within(few, chars) if chars is not None else few
        third = third.join(F.broadcast(docs.sparkSession.createDataFrame([r[:2] for r in picked], "_id long, _version long")), keys, "left_semi")
        counted = weighted.join(third.select(*keys), keys, "left_anti")
    else:
        counted = weighted.where(~is_third)
    text_of_some = lambda some: text.join(_sent(some.select(*keys, "_weight")), keys)
    model = fit_models(text_of_some(counted))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what is left after pruning

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("_toxic"), part.column("_weight"), pa.array(shared.value.signal(part.column("text")))], ["_toxic", "_weight", "x"])

    share = toxic / max(1, toxic + ordinary)
    model.weights = np.array([0.0, np.log((share + 1e-6) / (1 - share + 1e-6))])
    if counted.select("_toxic").distinct().count() == 2:
        seen = stored(text_of_some(third).select("_toxic", "_weight", "text").mapInArrow(frugal(signals), "_toxic int, _weight long, x double"), "signals")
        fitted = fit_logistic(seen.withColumn("_weight", F.col("_weight") / UNIT), sizes)
        model.weights = model.weights if fitted is None else fitted
        drop_stored(seen)
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of docs and a score from 0 to 1; a column that has its name already gives way to it.

    A null text counts as empty; an empty one scores as one word that nobody knows. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what is left after pruning
    inner, back = plain_names(docs.drop(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in back.values()), pa.array(shared.value.score(part.column("_text")))], [*back.values(), "s"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    scored = inner.withColumn("_text", text_of(back["text"])).mapInArrow(frugal(run), f"{types}, s double")
    return scored.select(*[F.col(c).alias(name) for name, c in back.items()], F.col("s").alias(column))
