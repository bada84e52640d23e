"""Exact Jaccard join of shingle sets by universe partition and the pigeonhole principle (operator 8).

Sets of similar size share a band. The universe of token hashes is cut into segments; two sets that differ in at
most H tokens agree in one of H + 1 segments, or, where a segment also has its one-deletion neighbourhood
indexed (it then counts twice), differ by one token there. How many segments get that is chosen by cost from the sizes of all
sets. Sets that share a key are candidates if their parity sketches, as wide as the sets are large, leave a link possible; that
never loses one. Each set is first looked at with the sets it shares most keys with; a key inside one of the clusters this gives says
nothing new, and only keys across clusters are looked at whole. Then the tokens of each cluster meet once, and all its sets are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, byte_slices, drop_stored, free_shuffles, frugal, order_id, plain_names, ragged, shuffle_partitions, stored, text_of
from .components import components
from .words import Words, mix

#: A band's largest size over its smallest.
BAND_RATIO = 1.6
#: 64-bit words of the smallest sketch; larger sets have as many bits as tokens, up to the next power of two.
SKETCH_WORDS = 8
#: Places whose parities are counted at a time.
SKETCH_STEP = 1 << 20
#: Distinct sets that a task has sent and will not send again.
REMEMBERED = 200_000
#: What looking at two sketches costs, against sending one key.
PAIR_COST = 0.01
#: Sets of which a task remembers what it has connected.
CONNECTED = 200_000
#: Sets of a key up to which they are looked at together with those of other keys.
PAIRED = 48
#: Sets, and tokens, that one task compares with each other.
BLOCK_SETS, BLOCK_TOKENS = 2048, 2_000_000
#: Sets whose tokens are looked up at a time.
STEP_SETS = 256


class Bands:
    """Bands of set sizes for a threshold in percent, and the differences that a link allows."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.first = [1]
        while self.first[-1] <= max(1, largest) * 100 // percent + 1:
            self.first.append(max(self.first[-1] + 1, math.ceil(self.first[-1] * BAND_RATIO)))
        self.first_array = np.array(self.first, np.int64)
        # a pair is looked for in the band of its larger set
        self.differences = [self.most_different(2 * (b - 1)) for b in self.first[1:]] + [0]

    def most_different(self, sizes: int) -> int:
        """Tokens in one set of a linked pair alone, at most, when the sizes add up to so many."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_array, size, side="right") - 1

    def allocate(self, counts: dict[int, int]) -> list[tuple[int, int]]:
        """(segments, how many of them are indexed with their neighbourhoods) for each band; counts: sets by band.

        The cost of an allocation is what it sends, and the pairs that would meet by chance in segments without a
        token or with one. Both follow from the band's sizes and the number of its sets.
        """
        out = []
        for band, most in enumerate(self.differences):
            sets, size = counts.get(band, 0) + counts.get(band - 1, 0), self.first[band]
            best = None
            for double in range(0, (most + 1) // 2 + 1, max(1, (most + 1) // 16)):
                segments = most + 1 - double
                per = size / segments
                sent = segments + double * per
                chance = sets * math.exp(-per) / segments
                cost = sets * sent + PAIR_COST * segments * chance * sets / 2
                if best is None or cost < best[0]:
                    best = cost, (segments, double)
            out.append(best[1])
        return out


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct shingle hashes of each text, one text after the other, and the offsets (one more than texts)."""
    w = Words(text, lower=True)
    starts, hashes = w.windows(words)
    of = w.text_of()[starts]
    counts = np.diff(w.firsts)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = np.array([_sequence(w.hashes[w.firsts[i] : w.firsts[i + 1]]) for i in short.tolist()], np.uint64)
        hashes, of = np.concatenate([hashes, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    ends = np.searchsorted(of, np.arange(len(counts) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else hashes), np.cumsum([0, *map(len, sets)])


def _sequence(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole short sequence; no shingle of full length has it but by chance."""
    out = np.uint64(len(hashes))
    for h in hashes:
        out = mix(np.array([out ^ h], np.uint64))[0]
    return out


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens), out=total[1:])
    size = np.diff(offsets).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ (size << np.uint64(40))).view(np.int64)


def sketches(tokens: np.ndarray, offsets: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of the numbers of tokens by 64 * words places: two sketches differ in no more bits than the sets in tokens."""
    bits, texts = words * 64, len(offsets) - 1
    step = max(1, SKETCH_STEP // bits)
    if texts > step:
        parts = [sketches(tokens[offsets[i] : offsets[min(i + step, texts)]], offsets[i : i + step + 1] - offsets[i], words) for i in range(0, texts, step)]
        return np.concatenate(parts)
    of = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
    parity = np.bincount(of * bits + (mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=texts * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(texts, -1), axis=1, bitorder="little").view(np.uint64).reshape(texts, words)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """The width of the sketches of sets of such sizes, in 64-bit words: a power of two with a bit for each token at least."""
    need = np.maximum(np.asarray(sizes, np.int64), 64 * SKETCH_WORDS)
    return (1 << np.ceil(np.log2(need)).astype(np.int64)) // 64


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as sketches of fewer places: places of equal remainder are one."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, words), axis=1)


def own_sketches(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The sketch of each set in its own width."""
    out: list[bytes] = [b""] * (len(offsets) - 1)
    size = np.diff(offsets)
    width = sketch_words(size)
    for words in np.unique(width).tolist():
        which = np.flatnonzero(width == words)
        length = size[which]
        found = sketches(tokens[ragged(offsets[which], length)], np.concatenate([[0], np.cumsum(length)]), words)
        for i, row in zip(which.tolist(), found, strict=True):
            out[i] = row.tobytes()
    return out


def signatures(tokens: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bands: Bands, plan: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of sets, and whose they are.

    A set is indexed in its own band and in any larger one that a partner can have. A plain segment with at most one token says
    little: there, both sets that have it look at the next plain segment too, with its one-deletion neighbourhood. If a linked
    pair agrees in z such segments alone, the plain segments after them, z different ones, cannot all differ by two as well: that
    and the two of each wide segment would be more than the pair differs by. So one of the looks meets. A single plain segment has no
    other after it and gives its key as it is.
    """
    size = np.diff(offsets)
    keys, owners = [], []
    lowest, highest = bands.of(np.maximum(size, 1)), bands.of(np.maximum(size, 1) * 100 // bands.percent)
    for step in range(int((highest - lowest).max(initial=-1)) + 1):
        band = lowest + step
        which = np.flatnonzero((band <= highest) & (size > 0))
        which = which[np.array(bands.differences)[band[which]] > 0]  # else only equal sets link
        if not len(which):
            continue
        segments, double = (np.array(x, np.int64)[band[which]] for x in zip(*plan, strict=True))
        base = np.cumsum(segments) - segments
        total = int(segments.sum())
        length = size[which]
        at = np.repeat(offsets[which] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        token, row = tokens[at], np.repeat(np.arange(len(which)), length)
        segment = ((token >> np.uint64(32)) * segments[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = base[row] + segment  # ascending: tokens are in order
        mixed = mix(token)
        count = np.bincount(place, minlength=total)
        begin = np.cumsum(count) - count
        running = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed, out=running[1:])
        content = running[begin + count] - running[begin]
        owner = np.repeat(np.arange(len(which)), segments)
        number = np.arange(total) - base[owner]
        name = mix((number.astype(np.uint64) << np.uint64(8)) ^ band[which][owner].astype(np.uint64))
        wide = number < double[owner]
        after = np.where(number + 1 < segments[owner], np.arange(total) + 1, (base + double)[owner])  # plain segments follow the wide ones
        light = ~wide & (count <= 1) & ((segments - double)[owner] > 1)
        plain = np.flatnonzero(~light & ~wide)
        keys.append(mix(name[plain] ^ mix(content[plain])))
        owners.append(ids[which[owner[plain]]])
        for source, target, tag in ((np.flatnonzero(wide), None, 1), (np.flatnonzero(light), after, 2)):
            if not len(source):
                continue
            looked = source if target is None else target[source]
            lead = mix(name[source] + np.uint64(tag))
            if target is not None:
                lead = mix(lead ^ content[source])
            keys.append(mix(lead ^ mix(content[looked])))
            owners.append(ids[which[owner[source]]])
            many = count[looked]
            inner = np.repeat(begin[looked] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            lead, looked_content = np.repeat(lead, many), np.repeat(content[looked], many)
            keys.append(mix(lead ^ mix(looked_content - mixed[inner])))
            owners.append(np.repeat(ids[which[owner[source]]], many))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _thin(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                tokens, offsets = shingle_sets(part.column("text"), words)
                size = np.diff(offsets)
                ids = pa.array(set_ids(tokens, offsets), mask=size == 0)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_version"), pa.array(size), ids, pa.array(own_sketches(tokens, offsets), pa.binary())], ["_id", "_version", "n", "set_id", "sketch"])

    return run


def _index(words: int, bands: Bands, plan: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                tokens, offsets = shingle_sets(part.column("text"), words)
                ids = set_ids(tokens, offsets)
                _, first = np.unique(ids, return_index=True)
                new = np.array(sorted(i for i in first.tolist() if offsets[i + 1] > offsets[i] and int(ids[i]) not in sent), np.int64)
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent.update(ids[new].tolist())
                if not len(new):
                    continue
                length = np.diff(offsets)[new]
                ends = np.cumsum(length)
                at = np.repeat(offsets[new] - (ends - length), length) + np.arange(int(length.sum()))
                keys, owners = signatures(tokens[at], np.concatenate([[0], ends]), ids[new], bands, plan)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "set_id"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, set_id): the distinct rows of keys that two sets have, their place in the key, the key's first set and the one before.

    Held back is one row: the open key's last so far, of which a second set is not seen yet or which has been passed on.
    """
    open_key = open_set = open_first = None
    seen = 0  # distinct sets of the open key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key").to_numpy(), batch.column("set_id").to_numpy()
        if open_key is not None:  # its last set again, in front
            keys, ids = np.append(open_key, keys), np.append(open_set, ids)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[fresh], ids[fresh]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(begins, len(keys)))
        group = np.repeat(np.arange(len(begins)), counts)
        place = np.arange(len(keys)) - begins[group]
        first, total = ids[begins], counts.copy()
        if open_key is not None:
            place[group == 0] += seen - 1
            total[0] += seen - 1
            first[0] = open_first
        before = np.concatenate([ids[:1], ids[:-1]])
        out = total[group] > 1
        if open_key is not None and seen > 1:
            out[0] = False  # it has been passed on already
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (keys, ids, place, first[group], before)], _SHARED)
        open_key, open_set, open_first, seen = keys[-1], ids[-1], first[-1], int(total[-1])


_SHARED = ["key", "set_id", "place", "first", "before"]


def fresh_links(a: list[int], b: list[int], parent: dict[int, int]) -> tuple[list[int], list[int]]:
    """The links that connect what parent (a union-find forest, kept by the task) does not connect yet."""

    def root(x: int) -> int:
        up = parent.setdefault(x, x)
        while up != x:
            parent[x] = parent[up]
            x, up = up, parent[up]
        return x

    out_a, out_b = [], []
    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def _rows_of(sketch: pa.Array, width: np.ndarray, words: int) -> np.ndarray:
    """The sketches of an Arrow column, each `width` words (`words` at least), folded to `words` words."""
    out = np.empty((len(sketch), words), np.uint64)
    for own in np.unique(width).tolist():
        which = np.flatnonzero(width == own)
        flat = sketch.take(pa.array(which))
        begin = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset] if len(flat) else 0
        bits = np.frombuffer(flat.buffers()[2], np.uint8)[begin : begin + own * 8 * len(which)].view(np.uint64)
        out[which] = fold(bits.reshape(len(which), own), words)
    return out


def _widths(sketch: pa.Array) -> np.ndarray:
    return pc.binary_length(sketch).to_numpy(zero_copy_only=False).astype(np.int64) // 8


def possible(percent: int, n: np.ndarray, m: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sets of n and m tokens whose sketches differ in so many bits can link: never false for those that do."""
    sizes = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
    return sizes & (bits <= (100 - percent) * (n + m) // (100 + percent))


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs with their sizes and sketches those that can link."""
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            width, other = _widths(batch.column("sketch")), _widths(batch.column("sketch_b"))
            least, keep = np.minimum(width, other), np.zeros(len(n), bool)
            for words in np.unique(least).tolist():
                which = np.flatnonzero(least == words)
                some = batch.take(pa.array(which))
                x, y = _rows_of(some.column("sketch"), width[which], words), _rows_of(some.column("sketch_b"), other[which], words)
                keep[which] = possible(percent, n[which], m[which], np.bitwise_count(x ^ y).sum(axis=1))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _near(percent: int):
    def edges(group: np.ndarray, ids: np.ndarray, n: np.ndarray, side: np.ndarray, sketch: np.ndarray, halves: np.ndarray, parent: dict[int, int]) -> pa.RecordBatch:
        """Pairs of different ids (clusters) with sets that can link, enough to connect them."""

        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return possible(percent, n[i], n[j], np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1))

        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        counts = np.diff(np.append(begins, len(group)))
        small = ((counts <= PAIRED) & ~halves[begins])[np.repeat(np.arange(len(begins)), counts)]
        found = []
        for step in range(1, PAIRED):
            i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            if not len(i):
                break
            i = i[ids[i] != ids[i + step]]
            i = i[close(i, i + step)]
            found.append((ids[i], ids[i + step]))
        for first, count in zip(begins.tolist(), counts.tolist(), strict=True):
            if small[first]:
                continue
            root = np.unique(ids[first : first + count], return_inverse=True)[1].reshape(-1)
            for k in range(count - 1):
                rest = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
                if halves[first]:
                    rest = rest[side[first + rest] != side[first + k]]
                rest = rest[close(np.full(len(rest), first + k), first + rest)]
                if len(rest):
                    found.append((np.full(len(rest), ids[first + k]), ids[first + rest]))
                    root[np.isin(root, root[rest])] = root[k]
        a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = fresh_links(a[new].tolist(), b[new].tolist(), parent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def look(rows: pa.Table, parent: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """Whole groups; groups whose narrowest sketches are equally wide are looked at together."""
        if rows.num_rows < 2:
            return
        rows = rows.combine_chunks()
        key, i, j, ids, n, side = (rows.column(c).to_numpy() for c in ("key", "i", "j", "comp", "n", "side"))
        sketch = rows.column("sketch").chunk(0)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        width = _widths(sketch)
        least = np.minimum.reduceat(width, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))[group]
        for words in np.unique(least).tolist():
            which = np.flatnonzero(least == words)
            narrow = _rows_of(sketch.take(pa.array(which)), width[which], words)
            yield edges(group[which], ids[which], n[which], side[which], narrow, (i != j)[which], parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, i, j), whole groups in one task, a group at most two blocks: edges between clusters whose sets may link."""
        held, parent = [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(parent) > CONNECTED:
                parent.clear()
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if held and (held[-1].column("key")[0].as_py(), held[-1].column("i")[0].as_py(), held[-1].column("j")[0].as_py()) != (key[0], i[0], j[0]):
                new = np.concatenate([[0], new])
            if len(new):
                yield from look(pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))]), parent)
                held = []
            held.append(batch.slice(int(new[-1]) if len(new) else 0))
        if held:
            yield from look(pa.Table.from_batches(held), parent)

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of the sets that rows stand for; repeated rows of a task give them once."""
        sent: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                if len(sent) > REMEMBERED:
                    sent.clear()
                ids = part.column("set_id").to_pylist()
                at = []
                for i, s in enumerate(ids):
                    if s not in sent:
                        sent.add(s)
                        at.append(i)
                some = part.take(pa.array(at, pa.int64()))
                tokens, offsets = shingle_sets(some.column("text"), words)
                rows = [tokens[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                kept = ["set_id", "cluster", "copies", "blocks"]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(rows, pa.binary())], [*kept, "tokens"])

    return run


def _places(names: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Where those tokens stand that names (ascending) has."""
    at = np.searchsorted(names, tokens)
    at[at == len(names)] = 0
    return at[names[at] == tokens].astype(np.int32) if len(names) else np.zeros(0, np.int32)


def _common(mine: np.ndarray, token: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many of the tokens marked in mine each of some sets has."""
    length = offsets[which + 1] - offsets[which]
    before = np.concatenate([[0], np.cumsum(mine[token[ragged(offsets[which], length)]])])
    ends = np.cumsum(length)
    return before[ends] - before[ends - length]


def link_counts(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, percent: int) -> tuple[np.ndarray, list[int], list[int]]:
    """How many rows each set links with here, by exact comparison of all pairs; and pairs of places, enough to connect what is linked.

    side: 0 and 1 for two blocks to be compared; all 0 for one by itself. copies: the rows that have a set.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    sets, size, side, copies = [sets[i] for i in order.tolist()], size[order], side[order], copies[order]
    tokens, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    sketch = sketches(tokens, offsets, int(sketch_words(size[-1:])[0]))
    tokens.sort()  # the sets hold them in their order
    names = np.unique(tokens[1:][tokens[1:] == tokens[:-1]])  # what one set alone has is in no intersection
    del tokens
    token = [_places(names, x) for x in sets]
    offsets, token = np.concatenate([[0], np.cumsum([len(x) for x in token])]), np.concatenate(token)
    mine, two = np.zeros(len(names), bool), bool(side.any())
    root, links, out_a, out_b = np.arange(n), np.zeros(n, np.int64), [], []
    for i in range(n - 1):
        stop = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        rest = np.arange(i + 1, stop)
        if two:
            rest = rest[side[rest] != side[i]]
        allowed = (100 - percent) * (size[i] + size[rest]) // (100 + percent)
        rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1) <= allowed]
        if not len(rest):
            continue
        own = token[offsets[i] : offsets[i + 1]]
        mine[own] = True
        common = np.concatenate([_common(mine, token, offsets, rest[k : k + STEP_SETS]) for k in range(0, len(rest), STEP_SETS)])
        mine[own] = False
        rest = rest[100 * common >= percent * (size[i] + size[rest] - common)]
        links[i] += copies[rest].sum()
        links[rest] += copies[i]
        other, first = np.unique(root[rest], return_index=True)
        first = first[other != root[i]]
        out_a += [int(order[i])] * len(first)
        out_b += order[rest[first]].tolist()
        root[np.isin(root, other)] = root[i]
    back = np.empty(n, np.int64)
    back[order] = links
    return back, out_a, out_b


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (cluster, i, j, set_id), whole groups in one task; a group is at most two blocks. Repeated sets count once.

        Gives a, b, links: with b, links that connect all that is linked in the group; without b, the number of rows that a links with there.
        """
        group, held = None, []

        def close() -> pa.RecordBatch:
            ids, side, copies = (np.array([h[k] for h in held], np.int64) for k in (0, 2, 3))
            links, x, y = link_counts([h[1] for h in held], side, copies, percent)
            a, b = ids[x].tolist() if x else [], ids[y].tolist() if y else []
            some = np.flatnonzero(links)
            columns = [pa.array([*a, *ids[some].tolist()], pa.int64()), pa.array([*b, *[None] * len(some)], pa.int64()), pa.array([*[None] * len(a), *links[some].tolist()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("cluster", "i", "j", "set_id", "tokens", "side", "copies")]
            for cluster, i, j, set_id, tokens, side, copies in zip(*columns, strict=True):
                if (cluster, i, j) != group:
                    if len(held) > 1:
                        yield close()
                    group, held = (cluster, i, j), []
                if held and held[-1][0] == set_id:
                    continue
                held.append((set_id, np.frombuffer(tokens, np.uint64), side, copies))
        if len(held) > 1:
            yield close()

    return run


def _with_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b with n and sketch of a, and m and sketch_b of b."""
    b = sets.select(F.col("set_id").alias("_b"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"))
    return pairs.join(sets.select(F.col("set_id").alias("_a"), "n", "sketch"), F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select("a", "b", "n", "m", "sketch", "sketch_b")


def _clusters(rows: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """set_id, cluster of all sets that share a key with a set they can link with: linked sets are in one cluster."""
    spark = rows.sparkSession
    partitions = shuffle_partitions(spark)
    largest = sets.agg(F.max("n")).first()[0] or 0
    bands = Bands(percent, largest)
    bounds = F.array(*[F.lit(b).cast("long") for b in bands.first])  # some thirty numbers
    band = (F.size(F.filter(bounds, lambda b: b <= F.col("n"))) - 1).alias("band")
    plan = bands.allocate({r["band"]: r["count"] for r in sets.groupBy(band).count().collect()})
    index = rows.select("text").mapInArrow(frugal(_index(words, bands, plan)), "key long, set_id long")
    met = index.repartition(partitions, "key").sortWithinPartitions("key", "set_id")
    shared = stored(met.mapInArrow(frugal(_shared), "key long, set_id long, place long, first long, before long"), "shared")
    free_shuffles(spark)
    # first the two sets that each shares most keys with, as the first of the key and as the one before it
    others = shared.where("place > 0").select("set_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("first").alias("other")), F.struct(F.lit(1).alias("kind"), F.col("before").alias("other")))).alias("o"))
    often = others.groupBy("set_id", "o").agg(F.count("*").alias("times")).groupBy("set_id", "o.kind").agg(F.max(F.struct("times", "o.other")).alias("best"))
    pairs = often.select(F.least("set_id", "best.other").alias("a"), F.greatest("set_id", "best.other").alias("b")).distinct()
    likely = stored(_with_sketches(pairs, sets).mapInArrow(frugal(_close(percent)), "a long, b long"), "likely")
    known = components(likely)
    # a key across clusters is looked at whole, and one of those keys that have the same sets
    comp = F.coalesce("component", "set_id").alias("comp")
    placed = stored(shared.select("key", "set_id", "place").join(known, F.col("set_id") == F.col("id"), "left").select("key", "set_id", "place", comp), "placed")
    drop_stored(shared)
    by_key = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("held"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("content"), F.max("place").alias("last"))
    open_keys = by_key.where("low <> high").groupBy("held", "content").agg(F.min(F.struct("key", "last")).alias("k")).select(F.col("k.key").alias("_key"), (F.floor(F.col("k.last") / BLOCK_SETS) + 1).cast("int").alias("blocks"))
    own = F.floor(F.col("place") / BLOCK_SETS).cast("int")
    spread = placed.join(open_keys, F.col("key") == F.col("_key")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "set_id", "comp")
    drawn = asked.join(sets.select("set_id", "n", "sketch"), "set_id").repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = stored(drawn.mapInArrow(frugal(_near(percent)), "a long, b long").distinct(), "near")
    drop_stored(placed)
    free_shuffles(spark)
    joined = components(edges).select(F.col("id").alias("_known"), F.col("component").alias("wider"))
    every = known.select("id", "component").unionByName(edges.select(F.explode(F.array("a", "b")).alias("id")).select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    out = every.join(joined, F.col("component") == F.col("_known"), "left").select(F.col("id").alias("set_id"), F.coalesce("wider", "component").alias("cluster"))
    return stored(out, "clusters")


def linked_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _version, n, set_id of every row; set_id, component, links of every set that has a link).

    links: the rows of other sets that it links with; all sets of a cluster are compared.
    percent: two sets link when 100 * common >= percent * union. Rows without words have n = 0 and no set_id.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    rows = docs.select(order_id("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_version"), text_of().alias("text"))
    thin = stored(rows.mapInArrow(frugal(_thin(words)), "_id long, _version long, n long, set_id long, sketch binary"), "thin")
    known = thin.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("_id", "_version")).alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    sets = stored(known, "sets")
    clusters = _clusters(rows, sets, words, percent)
    members = stored(clusters.join(sets.select(F.col("set_id").alias("_set"), "rep", "copies", "n"), F.col("set_id") == F.col("_set")).drop("_set"), "members")
    drop_stored(clusters)
    # a cluster of more sets or tokens than a block has is compared block by block
    size = members.groupBy(F.col("cluster").alias("_cluster")).agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    asked = members.join(size, F.col("cluster") == F.col("_cluster")).select(F.col("rep._id").alias("_rid"), F.col("rep._version").alias("_rversion"), "set_id", "cluster", "copies", "blocks")
    # always a merge: a broadcast would serve small tables alone, and figures of these would say nothing of large ones
    wanted = rows.join(asked.hint("merge"), (F.col("_id") == F.col("_rid")) & (F.col("_version") == F.col("_rversion"))).select("text", "set_id", "cluster", "copies", "blocks")
    found = wanted.mapInArrow(frugal(_sets_of(words)), "set_id long, cluster long, copies long, blocks int, tokens binary")
    dealt = found.withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_id", "tokens", "copies", (F.col("own") > F.col("other")).cast("int").alias("side"))
    met = pairs.repartition(partitions, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "set_id")
    compared = stored(met.mapInArrow(frugal(_compare(percent)), "a long, b long, links long"), "compared")
    free_shuffles(spark)
    connected = components(compared.where("b is not null").select("a", "b"))
    links = compared.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    whole = connected.join(links, F.col("id") == F.col("a")).select(F.col("id").alias("set_id"), "component", "links")
    return thin.select("_id", "_version", "n", "set_id"), stored(whole, "linked")


def join_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, its own included; and n_links: the other rows it links with.

    Sets are distinct hashes of `words` consecutive words (A-Z lower-cased, split at the blank and the codes 9 to 13); fewer words make one
    shingle; no word or null text makes none, and such rows are linked with nothing. Equal sets always link. Rows with equal ids are rows of
    their own; a null id counts as larger than all and stays null where a component has no other. An empty table gives none; columns
    other than doc_id and text are not looked at.
    """
    thin, linked = linked_sets(docs, words, percent)
    own = thin.where("set_id is not null").groupBy("set_id").agg(F.min("_id").alias("copy"), F.count("*").alias("copies"))
    both = stored(own.join(linked, "set_id", "left"), "sets")
    group = F.coalesce("component", "set_id").alias("group")
    least = both.groupBy(group).agg(F.min("copy").alias("place"))
    places = both.select("set_id", group, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).join(least, "group").select(F.col("set_id").alias("_set"), "place", "n_links")
    out = thin.join(places, F.col("set_id") == F.col("_set"), "left")
    no_id = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(no_id(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), no_id(F.coalesce("place", "_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs with one row of each component: the one of smallest doc_id (null last), and of rows with that id the first by a hash of its text.

    Rows without words stay, each of them. All columns stay as they are, whatever their names.
    """
    thin, linked = linked_sets(docs, words, percent)
    group = F.coalesce("component", "set_id")
    linked = linked.select(F.col("set_id").alias("_set"), "component")
    kept = thin.where("set_id is not null").join(linked, F.col("set_id") == F.col("_set"), "left").groupBy(group.alias("group")).agg(F.min(F.struct("_id", "_version")).alias("k"))
    kept = stored(kept.select(F.col("k._id").alias("_kid"), F.col("k._version").alias("_kversion")), "kept")
    inner, back = plain_names(docs)
    text = text_of(back["text"])
    plain = inner.withColumn("_id", order_id(back["doc_id"])).withColumn("_version", F.xxhash64(text)).withColumn("_words", text.rlike(r"[^\x20\x09-\x0D]"))
    wordless = plain.where("not _words").select(*inner.columns)
    both = plain.where("_words").join(kept, (F.col("_id") == F.col("_kid")) & (F.col("_version") == F.col("_kversion")), "left_semi")
    # only rows with equal ids and texts can be left over; one of them stays
    one = both.dropDuplicates(["_id", "_version"]).select(*inner.columns)
    return one.unionByName(wordless).select(*[F.col(c).alias(name) for name, c in back.items()])
