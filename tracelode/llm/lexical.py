"""Ranked lexical search by variable block maxima (operator 13).

One pass over the texts counts, for each document, the terms that queries name; document frequencies and lengths follow from this table. Its rows
are then gathered into shards. A shard has a posting list for each term, cut into blocks where dynamic programming finds the least sum of
bound errors (how far a block's largest score lies above what its documents have) and costs per block. A query adds up the block bounds over every range of
documents; only ranges whose sum can still reach the k-th score so far are scored, exactly, range by range from the largest bound down, and
the k-th score is carried from shard to shard of a task. The best k of each task are ranked once more.

Null and empty texts have no term: they are in no count and no result, and a query without terms finds nothing. Equal scores go by doc_id, null ones last;
repeated documents and repeated queries have results of their own. Without documents, or queries, the result is empty. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, byte_slices, order_id, ragged, ship, stored, text_of
from .words import NOT_ALNUM, Words

#: Queries, and terms of queries, that the driver and each task hold at a time; one longer query is a block of its own.
BLOCK_QUERIES, BLOCK_TERMS = 1000, 1 << 20
#: Postings and documents of one shard in a task's memory.
SHARD_POSTINGS, SHARD_DOCUMENTS = 1 << 21, 1 << 15
#: A list is cut at multiples of so many parts at most, and a block holds at most so many of them.
CELLS, WIDEST = 512, 64
#: What another block costs, in average scores of a posting.
BLOCK_COST = 8.0
#: Documents that are scored before the bounds are looked at again; so many times more each time.
FIRST_DOCUMENTS, MORE = 128, 128
#: Postings that can be read in the time of one look-up.
LOOKUP = 6


def _term_counts(text: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) sorted by text and term, and the number of terms of each text. A term is its hash, or its place in a sorted vocabulary."""
    words = Words(text, lower=True, separators=NOT_ALNUM)
    owner, terms = words.text_of(), words.hashes
    if vocabulary is not None:
        place = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
        known = vocabulary[place] == terms if len(vocabulary) else np.zeros(len(terms), bool)
        owner, terms = owner[known], place[known]
    order = np.lexsort((terms, owner))
    owner, terms = owner[order], terms[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], terms[first], np.diff(np.append(first, len(owner))), np.diff(words.firsts)


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), values)


def query_terms(queries: DataFrame, key: str = "item_id", column: str = "text") -> DataFrame:
    """item_id, terms array<long>: the hashes of a query's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                owner, terms, _, _ = _term_counts(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("item_id"), _lists(owner, b.num_rows, pa.array(terms.view(np.int64)))], ["item_id", "terms"])

    ship(queries.sparkSession)
    return queries.select(F.col(key).cast("long").alias("item_id"), text_of(column).alias("text")).mapInArrow(run, "item_id long, terms array<long>")


def counted(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n (its terms with repeats), terms, times (of the terms in the vocabulary) of all documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                owner, terms, times, n = _term_counts(b.column("text"), vocabulary)
                out = pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n.astype(np.int64)), _lists(owner, b.num_rows, pa.array(terms.astype(np.int32))), _lists(owner, b.num_rows, pa.array(times.astype(np.int64)))], ["doc_id", "n", "terms", "times"]
                )
                yield out.filter(pa.array(n > 0))

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(column).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


@dataclass
class Model:
    """What scores depend on: documents, terms of all documents, whole weights of the vocabulary, and the two settings of the formula."""

    documents: int
    length: int
    weights: np.ndarray
    saturation: int = 20
    slope: int = 50

    def parts(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term's weight is multiplied by, for its times in documents of n terms."""
        if len(n) and int(n.max()) * self.documents * self.slope >= 1 << 63:
            ratio = np.array([self.slope * int(x) * self.documents // self.length for x in n], np.int64)
        else:
            ratio = self.slope * n * self.documents // max(self.length, 1)
        return 1_000_000_000 * times // (1000 * times + self.saturation * (100 - self.slope + ratio))


def fitted(counts: DataFrame, terms: int) -> Model:
    """Totals and document frequencies of a counted() table; the driver gets one number for each term of a block of queries."""
    documents, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(terms, np.int64)
    for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    return Model(documents, length, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64))


def block_ends(values: np.ndarray, docs: np.ndarray, starts: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of all lists end, and the list of each block: the cuts of least (bound error + cost for each block).

    List i is values[starts[i]:starts[i + 1]], of ascending docs. A block bounds every document from its first to its last by its largest value; its error
    is the sum of these bounds less that of its values, so gaps between documents count too. All lists take a step of the dynamic program
    together; lists of more than CELLS values are cut at multiples of equal parts only, the others anywhere.
    """
    sizes = np.diff(starts)
    width = np.maximum(-(-sizes // CELLS), 1)
    cells = -(-sizes // width)
    order = np.argsort(-cells, kind="stable")
    rows, most = len(sizes), int(cells.max(initial=0))
    if not most:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cells, width, sizes, first = cells[order], width[order], sizes[order], starts[:-1][order]
    owner = np.repeat(np.arange(rows), cells)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = first[owner] + place * width[owner]
    high = first[owner] + np.minimum((place + 1) * width[owner], sizes[owner])
    ascending = np.argsort(low)  # as reduceat asks for
    top, begin = np.zeros((rows, most)), np.zeros((rows, most))
    top[owner[ascending], place[ascending]] = np.maximum.reduceat(values, low[ascending])
    begin[owner, place] = docs[low]
    running = np.concatenate([[0], np.cumsum(values)])
    total, end = np.zeros((rows, most + 1)), np.zeros((rows, most + 1))
    total[owner, place + 1] = running[high] - running[first[owner]]
    end[owner, place + 1] = docs[high - 1] + 1
    best, back = np.zeros((rows, most + 1)), np.zeros((rows, most + 1), np.int32)
    for i in range(1, most + 1):
        m, a = int(np.searchsorted(-cells, -i, side="right")), max(0, i - WIDEST)
        bound = np.maximum.accumulate(top[:m, a:i][:, ::-1], axis=1)
        error = bound * (end[:m, i : i + 1] - begin[:m, a:i][:, ::-1]) - (total[:m, i : i + 1] - total[:m, a:i][:, ::-1])
        sums = best[:m, a:i][:, ::-1] + error
        choice = sums.argmin(axis=1)
        back[:m, i] = i - 1 - choice
        best[:m, i] = sums[np.arange(m), choice] + cost
    ends, owners, at, row = [], [], cells.copy(), np.arange(rows)
    while len(row):
        ends.append(first[row] + np.minimum(at * width[row], sizes[row]))
        owners.append(order[row])
        at = back[row, at]
        row, at = row[at > 0], at[at > 0]
    ends, owners = np.concatenate(ends), np.concatenate(owners)
    by = np.argsort(ends)
    return ends[by], owners[by]


class Shard:
    """Posting lists of some documents, in blocks with their largest scores. `scored` counts the postings that searches have looked at."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, times: np.ndarray, model: Model):
        self.ids, self.scored = ids, 0
        order = np.lexsort((owner, terms))
        self.docs, terms = owner[order], terms[order]
        self.scores = model.weights[terms] * model.parts(times[order], n[self.docs])
        self.terms, starts = np.unique(terms, return_index=True)
        starts = np.append(starts, len(terms))
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(starts)) * len(ids) + self.docs
        if not len(terms):
            self.starts = self.ends = self.owners = np.zeros(0, np.int64)
            return
        self.ends, self.owners = block_ends(self.scores, self.docs, starts, BLOCK_COST * float(self.scores.mean()))
        self.starts = np.append(0, self.ends[:-1])
        self.tops = np.maximum.reduceat(self.scores, self.starts)
        self.lows, self.highs = self.docs[self.starts], self.docs[self.ends - 1] + 1
        self.blocks = np.searchsorted(self.owners, np.arange(len(self.terms) + 1))

    def search(self, query: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids), of those given and the documents here, for a query's sorted terms."""
        lists = np.searchsorted(self.terms, query)
        lists = lists[(lists < len(self.terms)) & (self.terms[np.minimum(lists, len(self.terms) - 1)] == query)] if len(self.terms) else lists[:0]
        if not len(lists):
            return scores, ids
        some = ragged(self.blocks[lists], self.blocks[lists + 1] - self.blocks[lists])
        lows, highs, tops = self.lows[some], self.highs[some], self.tops[some]
        edges = np.unique(np.concatenate([lows, highs]))
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, np.searchsorted(edges, lows), tops)
        np.subtract.at(change, np.searchsorted(edges, highs), tops)
        bounds, left, sizes = np.cumsum(change)[:-1], edges[:-1], np.diff(edges)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        wanted = FIRST_DOCUMENTS
        while len(order):
            limit = scores[k - 1] if len(scores) >= k else 1
            order = order[: int(np.searchsorted(-bounds[order], -limit, side="right"))]  # a range below the k-th score holds none of the k best
            take = order[: int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1]
            if len(take):
                scores, ids = self._score(lists, some, lows, highs, left[take], sizes[take], k, scores, ids)
            order, wanted = order[len(take) :], MORE * wanted
        return scores, ids

    def _score(self, lists, some, lows, highs, left, sizes, k, scores, ids):
        """Exact scores of the documents in some ranges: few of them are looked up in the lists, of many the blocks that hold them are read."""
        documents = ragged(left, sizes)
        chosen = np.zeros(len(self.ids) + 1, bool)
        chosen[documents] = True
        before = np.concatenate([[0], np.cumsum(chosen)])
        blocks = some[before[highs] > before[lows]]  # all other blocks are skipped
        size = self.ends[blocks] - self.starts[blocks]
        if LOOKUP * len(documents) * len(lists) < int(size.sum()):
            keys = (lists[:, None] * len(self.ids) + documents[None, :]).reshape(-1)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            at = at[self.keys[at] == keys]
            self.scored += len(at)
        else:
            at = ragged(self.starts[blocks], size)
            self.scored += len(at)
            at = at[chosen[self.docs[at]]]
        total = np.zeros(len(self.ids), np.int64)
        np.add.at(total, self.docs[at], self.scores[at])
        found = np.flatnonzero(total)
        return best_of(np.concatenate([scores, total[found]]), np.concatenate([ids, self.ids[found]]), k)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, highest first, equal ones by ascending id."""
    if len(scores) > k:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[enough], ids[enough]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of counted() by shards."""
    held, postings, rows = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = int(sizes[start - 1]) if start else 0
            stop = min(int(np.searchsorted(sizes, base + SHARD_POSTINGS - postings, side="right")), start + SHARD_DOCUMENTS - rows, batch.num_rows)
            if stop <= start and not held:
                stop = start + 1  # a document of more postings is a shard by itself
            if stop > start:
                held.append(batch.slice(start, stop - start))
                postings, rows, start = postings + int(sizes[stop - 1]) - base, rows + stop - start, stop
            if start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, postings, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def searched(counts: DataFrame, model: Model, queries: list[np.ndarray], k: int) -> DataFrame:
    """query (its place in the list), doc_id, score: the best k rows of each task of a counted() table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for table in _gathered(batches):
            lists = table.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            times = table.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids = table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
            shard = Shard(ids, table.column("n").combine_chunks().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False), times, model)
            best = [shard.search(q, k, *b) for q, b in zip(queries, best, strict=True)]
        for i, (scores, ids) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i, np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["query", "doc_id", "score"])

    return counts.mapInArrow(run, "query int, doc_id long, score long")


def _query_blocks(terms: DataFrame) -> Iterator[list]:
    """Rows of query_terms() in blocks; the driver holds one block and one partition of the table."""
    block, size = [], 0
    for r in terms.toLocalIterator():
        if block and (len(block) >= BLOCK_QUERIES or size + len(r["terms"]) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r["terms"])
    if block:
        yield block


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: of every query (item_id, text) the k documents (doc_id, text) of highest score above 0; all, if fewer."""
    spark: SparkSession = docs.sparkSession
    found = []
    for block in _query_blocks(stored(query_terms(queries), "query-terms")):
        hashes = [np.array(r["terms"], np.int64).view(np.uint64) for r in block]
        vocabulary = np.unique(np.concatenate(hashes))
        counts = stored(counted(docs, vocabulary), "term-counts")
        hits = searched(counts, fitted(counts, len(vocabulary)), [np.searchsorted(vocabulary, np.sort(h)) for h in hashes], k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), order_id("doc_id")))
        items = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "query int, item_id long")
        best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
        found.append(best.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score"))  # a block of queries
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
