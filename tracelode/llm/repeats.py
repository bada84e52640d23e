"""Substring dedup by level-wise doubling (operator 9).

The lengths of the levels double up to the window, which is the last one. At a level each full window still in question has one shorter window that stands
for it: at first, of those inside it, the one of least hash, so that equal full windows choose the same and few positions stand for
all; then the one of about twice the length that begins or ends where that one does and still lies inside. Only full windows whose shorter window is in two
documents go on to the next level. It ends where no candidates survive, or with the window itself: longer windows would remove no other words.

Windows of twice the length that are equal have equal halves. So rows dealt by the hash of the shorter window also hold that of the longer one: rows that
share the first lie together, those of them that share the second too survive, and one exchange serves two levels. No text is read between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, byte_slices, drop_stored, free_shuffles, frugal, order_id, plain_names, ragged, shuffle_partitions, stored, text_of
from .words import Words

#: Text bytes within which a task compares windows before anything is shuffled.
COMBINE_BYTES = 16 << 20
#: Lengths that are looked at; the last is the window. Two of those before it cost one pass over the texts that still have candidates.
LEVELS = 3


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """For each i, where the least of values[i : i + size] stands, the leftmost of equals; for len(values) - size + 1 places."""
    best = np.arange(len(values))
    width = 1
    while width < size:  # the least of 2 * width values is that of two runs of `width`, which may overlap
        step = min(width, size - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        width += step
    return best


def lengths_of(window: int, levels: int = LEVELS) -> list[int]:
    """The ascending lengths of the levels: each at most twice the one before, the last the window."""
    if window < 1 or levels < 1:
        raise ValueError("a window has one word, and a search one level, at least")
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _by_word(w: Words, length: int) -> np.ndarray:
    """The hashes of all windows of `length` words, by their first word."""
    starts, hashes = w.windows(length)
    out = np.zeros(len(w.hashes), np.uint64)
    out[starts] = hashes
    return out


def _stages(lengths: list[int]) -> list[tuple[int, int | None]]:
    """The lengths before the last in pairs that one exchange serves: (length, the next one, or None)."""
    short = lengths[:-1]
    return [(a, short[i + 1] if i + 1 < len(short) else None) for i, a in enumerate(short) if i % 2 == 0]


def _chosen(w: Words, window: int, length: int, longer: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The full windows' first words; for each the code of what stands for it; and the hashes of windows of `length` words by word.

    A code is twice the first word of the window of `length` words, plus one where the one of `longer` words ends with it instead of beginning with it.
    """
    by_word = _by_word(w, length)
    room = np.repeat(w.firsts[1:], np.diff(w.firsts)) - np.arange(len(w.hashes))
    full = np.flatnonzero(room >= window)
    if not len(full):
        return full, full, by_word
    place = sliding_argmin(by_word, window - length + 1)[full]
    ends = place + longer > full + window if longer else np.zeros(len(full), bool)
    return full, 2 * place + ends, by_word


def _spans(flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as runs of neighbours: first and last of each."""
    if not len(flagged):
        return flagged, flagged
    cut = np.flatnonzero(np.diff(flagged) != 1)
    return flagged[np.concatenate([[0], cut + 1])], flagged[np.concatenate([cut, [len(flagged) - 1]])]


_ROW = "key int, more long, id long, version long, first int, last int, also array<int>"
_NAMES = ["key", "more", "id", "version", "first", "last", "also"]


def _rows(keys: tuple[np.ndarray, np.ndarray] | None, rows: pa.RecordBatch, text: np.ndarray, first: np.ndarray, last: np.ndarray, also: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of _ROW. keys: 32 bits of the shorter window's hash, by which they are dealt, and the hash that has to be shared; None marks what is already known.

    first and last are words, or codes of _chosen(), counted from the start of the text; also: more of them, of the same keys.
    """
    at = pa.array(text)
    key, more = (pa.nulls(len(text), pa.int32()), pa.nulls(len(text), pa.int64())) if keys is None else (pa.array(keys[0]), pa.array(keys[1].view(np.int64)))
    also = pa.nulls(len(text), pa.list_(pa.int32())) if also is None else also
    return pa.RecordBatch.from_arrays([key, more, rows.column("_id").take(at), rows.column("_version").take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), also], _NAMES)


def _once(key: np.ndarray, more: np.ndarray, rows: pa.RecordBatch, text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row for each pair of keys and text, its other places in `also`: a line that a text repeats very often is one row. Sorted by keys and text."""
    begins = _begins(key, more, text)
    count = np.diff(np.append(begins, len(key)))
    rest = np.ones(len(key), bool)
    rest[begins] = False
    offsets = pa.array(np.concatenate([[0], np.cumsum(count - 1)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(place[rest].astype(np.int32)), mask=pa.array(count == 1))
    return _rows((key[begins], more[begins]), rows, text[begins], place[begins], place[begins], lists)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _level(window: int, before: tuple[int, int | None] | None, stage: tuple[int, int | None]):
    length, longer = stage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands for full windows in this stage, of those for which what stood in the stage before is in `places`.

        What the documents of a slice show is known here: keys that two of them share, before the last level, are repeated in all of them
        and one stands for all; at the last level, full windows that a smaller document of the slice has are repeated.
        """
        for batch in batches:
            for part in byte_slices(batch, "text", COMBINE_BYTES):
                places, keys, hashes, texts = [], [], [], []
                done = 0
                for small in byte_slices(part, "text"):
                    w = Words(small.column("text"))
                    full, codes, by_word = _chosen(w, window, length, longer)
                    if before is not None and len(full):
                        lists = small.column("places")
                        wanted = np.zeros(2 * len(w.hashes), bool)
                        wanted[np.asarray(lists.flatten()) + 2 * np.repeat(w.firsts[:-1], np.asarray(lists.value_lengths().fill_null(0)))] = True
                        left = wanted[_chosen(w, window, *before)[1]]
                        full, codes = full[left], codes[left]
                    codes = np.unique(codes)
                    place, ends = codes >> 1, codes & 1
                    of = w.text_of()[place]
                    key = by_word[place]
                    places.append((codes - 2 * w.firsts[of] if length < window else place - w.firsts[of]).astype(np.int32))
                    # the last level is dealt by the whole hash, and one number for all takes no room
                    keys.append((key >> np.uint64(32)).astype(np.uint32).view(np.int32) if length < window else np.zeros(len(key), np.int32))
                    hashes.append(_by_word(w, longer)[place + ends * (length - longer)] if longer else key)
                    texts.append((of + done).astype(np.int32))
                    done += small.num_rows
                place, key, more, text = (np.concatenate(x) for x in (places, keys, hashes, texts))
                if not len(key):
                    continue
                owner = part.column("_id").to_numpy()[text]
                order = np.lexsort((place, text, owner, more, key))
                place, key, more, text, owner = place[order], key[order], more[order], text[order], owner[order]
                begins = _begins(key, more)
                number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
                if length < window:
                    shared = owner[begins] != owner[np.append(begins[1:], len(key)) - 1]
                    known = shared[number]
                    yield _rows(None, part, text[known], place[known], place[known])
                    lead = begins[shared]
                    yield _rows((key[lead], more[lead]), part, text[lead], place[lead], place[lead])
                else:
                    known = owner > owner[begins][number]
                    yield from _known_spans(part, text[known], place[known])
                if not known.all():
                    yield _once(key[~known], more[~known], part, text[~known], place[~known])

    return run


def _known_spans(part: pa.RecordBatch, text: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(text):
        wide = text.astype(np.int64) * (1 << 32) + place
        first, last = _spans(np.sort(wide))
        yield _rows(None, part, first >> 32, first & 0xFFFFFFFF, last & 0xFFFFFFFF)


def _runs_of_key(keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, more, id), whole keys in one task, read as a stream: passes on those of keys that two ids have.

        Rows of one `key` share the shorter window and lie together; those of one `more` share the longer one too, and only they count.

        keep_first: all of them; else those whose id is not the smallest. Rows without a key pass. What is held back
        is the rows of the open key for its smallest id, so of one document.
        """
        key = owner = None
        open_shared, held = False, []
        for b in batches:
            free = pc.is_null(b.column("key"))
            if pc.any(free).as_py():
                yield b.filter(free)
                b = b.filter(pc.invert(free))
            if not b.num_rows:
                continue
            keys, mores, ids = (b.column(c).to_numpy() for c in ("key", "more", "id"))
            begins = _begins(keys, mores)
            number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
            goes_on = key == (keys[0], mores[0])
            owners = ids[begins]
            if goes_on:
                owners[0] = owner
            later = ids > owners[number]
            shared = np.logical_or.reduceat(later, begins)
            if goes_on:
                shared[0] |= open_shared
                if shared[0]:
                    yield from held
            if not goes_on or shared[0]:
                held = []
            yield b.filter(pa.array(shared[number] if keep_first else later))
            if keep_first and not shared[-1]:
                held = held if goes_on and len(begins) == 1 else []
                held.append(b.slice(int(begins[-1])))
            elif len(begins) > 1:
                held = []
            key, owner, open_shared = (keys[-1], mores[-1]), owners[-1], bool(shared[-1])

    return run


def _meet(rows: DataFrame, partitions: int, keep_first: bool) -> DataFrame:
    """Rows of _ROW that are repeated: known ones, and those that share their key with another (or a smaller) id.

    Within a slice a key that many documents have has been cut down to one of them, so a key's rows here are at most as many
    as there are slices, times the places it has in one document.
    """
    spread = F.coalesce(F.col("key").cast("long") if keep_first else F.col("more"), F.xxhash64("id", "version", "first"))
    dealt = rows.repartition(partitions, spread).sortWithinPartitions("key", "more", "id")
    return dealt.mapInArrow(frugal(_runs_of_key(keep_first)), _ROW)


def _identified(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(order_id("doc_id").alias("_id"), F.xxhash64(text).alias("_version"), text.alias("text"))


def repeated_spans(rows: DataFrame, window: int = 50, levels: int = LEVELS) -> DataFrame:
    """Where windows begin that a smaller document has too: _sid, _sversion, spans array<struct<first, last>> of word numbers.

    `rows` has _id, _version (a hash of the text, to tell rows with one id apart) and text. lengths_of() says which levels there are. Texts
    with fewer words than the window have no windows. All counts are exact but for equal 64-bit hashes of different windows.
    """
    spark, lengths = rows.sparkSession, lengths_of(window, levels)
    partitions = shuffle_partitions(spark)
    around, before, places = rows, None, None
    more = F.flatten(F.collect_list("also"))
    for stage in [*_stages(lengths), (window, None)]:
        last = stage[0] == window
        met = _meet(around.mapInArrow(frugal(_level(window, before, stage)), _ROW), partitions, keep_first=not last)
        by_text = met.groupBy(F.col("id").alias("_sid"), F.col("version").alias("_sversion"))
        if last:  # left to the query that reads it, which then shuffles the texts once for both joins with them
            each = F.transform(more, lambda p: F.struct(p.alias("first"), p.alias("last")))
            return by_text.agg(F.concat(F.collect_set(F.struct("first", "last")), each).alias("spans"))
        found = stored(by_text.agg(F.array_union(F.collect_set("first"), more).alias("places")), "places")
        if places is not None:
            drop_stored(places)
        free_shuffles(spark)
        if found.isEmpty():  # no candidates survive
            break
        # always a merge: a broadcast would serve small tables alone
        around = rows.join(found.hint("merge"), (F.col("_id") == F.col("_sid")) & (F.col("_version") == F.col("_sversion"))).select("_id", "_version", "text", "places")
        before, places = stage, found
    return found.select("_sid", "_sversion", F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans"))


def _kept(w: Words, spans: pa.Array, window: int) -> np.ndarray:
    """For each word whether no window covers it."""
    change = np.zeros(len(w.hashes) + 1, np.int64)
    counts = np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
    flat = spans.flatten()
    if len(flat):
        base = np.repeat(w.firsts[:-1], counts)
        first, last = (np.asarray(flat.field(i)) + base for i in (0, 1))
        np.add.at(change, first, 1)
        np.add.at(change, last + window, -1)
    return np.cumsum(change)[:-1] == 0


def _joined(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of all texts, each followed by a blank, and the byte offsets of the texts in them."""
    lengths = (w.ends - w.starts)[kept] + 1
    at = ragged(w.starts[kept], lengths)
    out = w.data[np.minimum(at, max(0, len(w.data) - 1))]
    ends = np.cumsum(lengths)
    out[ends - 1] = 32
    before = np.concatenate([[0], np.cumsum(kept)])[w.firsts]
    return out, np.concatenate([[0], ends])[before]


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    rows = _identified(docs)
    spans = repeated_spans(rows, window).hint("merge")
    return rows.join(spans, (F.col("_id") == F.col("_sid")) & (F.col("_version") == F.col("_sversion")), "left").select("_id", "_version", "text", "spans")


def kept_words(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a blank.

    A word goes if a window of `window` words that covers it also begins in a document with a smaller doc_id; what counts is
    the input, not what is left of it. Null text has no words; a null id is larger than every other; rows with equal ids are not smaller than
    each other; repeated rows each get a row. An empty table gives none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                w = Words(part.column("text"))
                kept = _kept(w, part.column("spans"), window)
                out, ends = _joined(w, kept)
                ends = ends.tolist()
                digests = [hashlib.sha256(out[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                gone = np.concatenate([[0], np.cumsum(~kept)])
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(w.firsts)), pa.array(np.diff(gone[w.firsts])), pa.array(digests, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    out = _with_spans(docs, window).mapInArrow(frugal(run), "id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated words cut out of the texts, and n_chars as it then is; all other columns as they are.

    A removed word goes with the white space after it; texts without removed words stay as they are, null too. All other columns stay as they
    are, whatever their names; without a column n_chars there is none after it either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                w = Words(part.column("text"))
                kept = _kept(w, part.column("spans"), window)
                texts = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    raw, a, b = text.encode(), int(w.firsts[i]), int(w.firsts[i + 1])
                    base = int(w.starts[a]) - (len(raw) - len(raw.lstrip(b" \t\n\x0b\x0c\r"))) if b > a else 0
                    first, last = _spans(np.flatnonzero(~kept[a:b]))
                    at, out = 0, []
                    for f, g in zip(first.tolist(), last.tolist(), strict=True):
                        out.append(raw[at : int(w.starts[a + f]) - base])
                        at = int(w.starts[a + g + 1]) - base if a + g + 1 < b else len(raw)
                    texts.append(b"".join([*out, raw[at:]]).decode())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_version"), pa.array(texts, pa.string())], ["_nid", "_nversion", "_new"])

    changed = _with_spans(docs, window).where("spans is not null").mapInArrow(frugal(run), "_nid long, _nversion long, _new string").dropDuplicates(["_nid", "_nversion"])
    inner, back = plain_names(docs)
    plain = inner.withColumn("_id", order_id(back["doc_id"])).withColumn("_version", F.xxhash64(text_of(back["text"])))
    both = plain.join(changed, (F.col("_id") == F.col("_nid")) & (F.col("_version") == F.col("_nversion")), "left")
    new = {"text": F.coalesce("_new", back["text"])}
    if "n_chars" in back:
        new["n_chars"] = F.when(F.col("_new").isNull(), F.col(back["n_chars"])).otherwise(F.length("_new")).cast("long")
    return both.select(*[new.get(name, F.col(c)).alias(name) for name, c in back.items()])
