import hashlib
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tracelode.llm import bpe, packing, sstable
from tracelode.llm.chunked import library_cache
from tracelode.llm.common import ship, stored

ODD = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "1", "12", "!!", "\x1c", "\x85", " ", "İ", "Σ", "é", "日本", "<|endoftext|>", "\r", "\0", "🙂", " "]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n"] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def documents(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, _rank string, length string")


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_library_s_ids(name, byte_level, special):
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = not special
    marks = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = odd_texts(1500) + [f"a {m}  b\n{m}" for m in marks] + [m.upper() for m in marks]
    ids, counts = library_cache(P.path(name), byte_level, special)(pa.array(texts))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_case_and_marks_make_no_chunks():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    words = ["Word", "wOrd", "élan", "ÉLAN", "h\u0331", "H\u0331", "don't", "DON'T", "x's.", "'s,", "it'", "\xdf", "\xb5m", "\xd7", "\xff", "\u0130", "a1b", "7", "q\1", "\1", "\xbfno?", "a.b", "A\u030a", "=\u0338", "z=\u0338", "<|endoftext|>", "x<|ENDOFTEXT|>,"]
    texts = [rng.choice(" \n").join(rng.choice(words) + rng.choice(["", "", ",", "!!", ".'", "'.", "''", "\u0301", "\xab", "%&", " ", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for special in (True, False):
        library.encode_special_tokens = not special
        ids, counts = library_cache(P.path("word_bpe_49k.json"), False, special)(pa.array(texts))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    cache = library_cache(P.path("word_bpe_49k.json"), False)
    cache._clear()
    cache(pa.array([f"{a}{m} x" for a in ("one", "One", "ONE", "été", "Été") for m in (",", ".", "!!", "%%%")]))
    assert cache.known_n == 2 + 4 + 1  # words, marks, x


def test_perfect_hash():
    keys = [b"%d" % i for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(5000)) and table.find(b"x") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1


def test_byte_pairs_against_tiktoken(spark):
    pairs, _ = bpe.loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    texts = [*odd_texts(400, 2), "x" * 3000, "ab" * 500]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(None, None, None, None), (5, texts[5], "", "")]
    got = bpe.encode_decode(documents(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and bytes(r.decoded) == text.encode() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(documents(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_plan_fills_exactly():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 50, 30, 20, 10]] = [2, 1, 3, 1, 1, 1]
    plan = packing.pack_plan(counts, 100)
    used = np.zeros(101, np.int64)
    for lengths, times in plan:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert (used == counts).all()
    assert sum(t for _, t in plan) == 4  # 60+40, 60+30+10, 50+50, 50+20
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    total = int((counts * np.arange(101)).sum())
    assert sum(t for _, t in packing.pack_plan(counts, 100)) <= 1.005 * total / 100 + 1


def fewest(lengths, capacity):
    """The least number of sequences, by trying every way."""

    @cache
    def best(rest, room):
        if not rest:
            return 0
        return min(best(rest[:i] + rest[i + 1 :], room - x) if x <= room else 1 + best(rest[:i] + rest[i + 1 :], capacity - x) for i, x in enumerate(rest) if i == 0 or x != rest[i - 1])

    return best(tuple(sorted(lengths, reverse=True)), 0)


def test_plan_against_the_optimum():
    rng = random.Random(8)
    over = 0
    for _ in range(150):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        made = sum(t for _, t in packing.pack_plan(np.bincount(lengths, minlength=13).astype(np.int64), 12))
        assert made <= fewest(lengths, 12) + 1
        over += made - fewest(lengths, 12)
    assert over <= 8


def test_pack_places_every_row(spark):
    ship(spark)
    rng = random.Random(4)
    rows = [(i % 50, rng.choice([1, 3, 7, 20, 20, 64])) for i in range(3000)] + [(None, 64)] * 200
    df = stored(spark.createDataFrame(rows, "doc_id long, length long"), "t")
    got = packing.pack(df, 64).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == sorted((a or -1, b) for a, b in rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 64
    assert packing.pack(stored(spark.createDataFrame([], "doc_id long, length long"), "t"), 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(stored(spark.createDataFrame([(1, 65)], "doc_id long, length long"), "t"), 64)


def test_pieces(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["", "some words here", "abc def " * 60]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(3, None, "", "")]
    got = {}
    for r in packing.pack_documents(documents(spark, rows), P.path("byte_bpe_50k.json"), capacity=32).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate([*texts, ""]):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 32 for r in parts[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)


def test_shards(spark, tmp_path):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {7: "seven words", -3: "", 12: "a b c " * 50, 9: None, 40: "The END"}
    rows = [(i, t, "", "") for i, t in texts.items()] + [(7, "seven words", "", ""), (None, "lost", "", "")]
    shards = sstable.write_shards(documents(spark, rows), P.path("word_bpe_49k.json"), end_id=2)
    got = sorted(sstable.read_shards(shards, keep_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [-3, 7, 7, 9, 12, 40, None]
    at = 0
    for r in got:
        ids = [*library.encode({**texts, None: "lost"}[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert sstable.read_shards(sstable.write_shards(documents(spark, []), P.path("word_bpe_49k.json"), end_id=2)).count() == 0


def test_lookup_across_shards(spark):
    rows = [(i * 3 - 50, f"text {i}", "", "") for i in range(300)] + [(4, "again", "", "")] * 3 + [(None, "lost", "", "")]
    shards = stored(sstable.write_shards(documents(spark, rows), P.path("word_bpe_49k.json"), end_id=2, shard_bytes=100), "list")
    assert shards.count() > 2
    asked = [-50, 4, 5, 847, 848, -51, None, 10**12, 4]
    got = Counter((r.doc_id, tuple(r.ids)) for r in sstable.lookup(shards, spark.createDataFrame([(i, "clash") for i in asked], "doc_id long, ids string")).collect())
    every = sstable.read_shards(shards, keep_ids=True).collect()
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in every if r.doc_id in set(asked)) and sum(got.values()) == 7
    empty = sstable.write_shards(documents(spark, []), P.path("word_bpe_49k.json"), end_id=2)
    assert sstable.lookup(empty, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_ids_that_do_not_fit(tmp_path):
    with pytest.raises(ValueError):
        sstable.ShardWriter(str(tmp_path / "x.sst"), 2).add(sstable.key_of(1), np.array([1 << 16], np.uint32))


def test_lookup_in_a_shard(tmp_path):
    path = str(tmp_path / "x.sst")
    writer = sstable.ShardWriter(path, 4)
    keys = sorted(random.Random(5).sample(range(-(10**9), 10**9), 3000))
    for k in keys:
        writer.add(sstable.key_of(k), np.arange(k % 37 + 20, dtype=np.uint32))
    writer.add(sstable.key_of(None), np.zeros(1, np.uint32))
    writer.close()
    shard = sstable.Shard(path)
    assert len(shard.blocks) > 3
    assert all(len(shard.get(k)[0]) == k % 37 + 20 for k in keys[::97]) and len(shard.get(None)) == 1
    missing = [k for k in range(5000) if k not in set(keys)]
    assert not any(shard.get(k) for k in missing[:300])
    assert sum(shard.may_hold(sstable.key_of(k)) for k in missing) < 0.05 * len(missing)
    assert [k for k, _ in shard.scan()] == [*keys, None]
    data = bytearray((tmp_path / "x.sst").read_bytes())
    data[100] ^= 1
    (tmp_path / "x.sst").write_bytes(data)
    with pytest.raises(Exception):
        sstable.Shard(path).get(keys[0])


def test_cache_bounds_python_strings(monkeypatch):
    """Unseen chunks are Python objects a bounded number at a time, with the same ids."""
    from tracelode.llm import chunked

    sizes = []

    def encode(chunks):
        sizes.append(len(chunks))
        return np.array([len(c) for c in chunks for _ in c], np.uint32), np.array([len(c) for c in chunks], np.int64)

    monkeypatch.setattr(chunked, "ENCODE_CHUNKS", 3, raising=False)
    text = pa.array([" ".join("x" * n for n in range(1, 12)), "", "xx yyy"])
    ids, counts = chunked.ChunkCache(encode, chunked.blank_chunks)(text)
    assert max(sizes) <= 3
    words = [w for t in text.to_pylist() for w in t.split()]
    assert ids.tolist() == [len(w) for w in words for _ in w] and counts.tolist() == [66, 0, 5]


def test_workers_keep_no_tables_of_other_steps(spark):
    """A step that has no use for what an earlier one left in its Python worker begins without it."""
    from tracelode.llm import chunked, common

    common.ship(spark)

    def leave(batches):
        chunked._CACHES["left"] = None
        yield from batches

    def look(batches):
        n = len(chunked._CACHES)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, n))], ["id"])

    rows = spark.range(64).repartition(8)
    kept = lambda step: {r.id for r in rows.mapInArrow(step, "id long").collect()}
    kept(leave)
    assert kept(common.frugal(look)) == {0}
    kept(leave)
    assert 1 in kept(common.frugal(look, keep=True))
