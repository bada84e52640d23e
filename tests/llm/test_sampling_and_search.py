import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelode.llm import importance, lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n", "É ÀB_c1 2d!", "one", "ONE One oNe", "\x00a\x7fb", "日本語 と 日本語", "x" * 300 + " " + "y" * 70]


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def texts(n, seed, vocabulary=60):
    rng = random.Random(seed)
    return ODD + [" ".join(f"W{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(rng.choice([1, 5, 25, 60]))) for _ in range(n)]


def test_crc32_of_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, lengths = rng.integers(0, 4000, 300), rng.choice([0, 1, 3, 63, 64, 65, 900], 300)
    assert importance.crc32_of(data, starts, lengths).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]


def features(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (3, 35, 2), (2, 100, 0)])
def test_resampling_against_plain_python(spark, longest, percent, least):
    raw = texts(120, 3)
    raw += raw[20:60]  # copies
    ids = [*range(len(raw) - 3), None, 7, 7]  # no identifier, and repeated ones
    target = [None, "W1 w2 W3 w2", "w5 é1 one"]
    docs = spark.createDataFrame([(i, t, 1.5, "x") for i, t in zip(ids, raw, strict=True)], "doc_id long, text string, score double, rank string")
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    ranks = importance.resample(docs, aim, longest=longest, buckets=97, percent=percent, least=least, seed=5)
    got = sorted((r.doc_id is None, r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in ranks.collect())

    bucket = lambda f: zlib.crc32(f.encode()) % 97
    s, t = Counter(bucket(f) for x in raw for f in features(x, longest)), Counter(bucket(f) for x in target for f in features(x, longest))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 97) / ((s[b] + 1) * (big_t + 97)))) for b in range(97)]
    rows = []
    for i, x in zip(ids, raw, strict=True):
        f = features(x, longest)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"5:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i is None, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), 0, len(words_of(x))])
    able = sorted((r for r in rows if r[6] >= least), key=lambda r: (-r[4], r[0], r[1] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    assert got == sorted(tuple(r[:6]) for r in rows)
    kept = {r[1] for r in rows if r[5] and not r[0]}
    drawn = importance.drawn_rows(docs, ranks)
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(i for i in ids if i in kept)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(one, none, percent=100, least=1).first()["rank"] == 1
    assert importance.resample(one, none, least=3).first()["rank"] is None


def error_of(values, docs):
    return max(values) * (docs[-1] + 1 - docs[0]) - sum(values)


def least_cost(values, docs, cost):
    best = [0.0]
    for i in range(1, len(values) + 1):
        best.append(min(best[j] + error_of(values[j:i], docs[j:i]) + cost for j in range(max(0, i - lexical.WIDEST), i)))
    return best[-1]


def test_blocks_have_the_least_cost():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 150, rng.integers(1, 9))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values, cost = rng.integers(0, 60, starts[-1]), float(rng.integers(1, 80))
        docs = np.concatenate([np.sort(rng.choice(int(n) * int(rng.integers(1, 9)), n, replace=False)) for n in sizes])
        ends, owners = lexical.block_ends(values, docs, starts, cost)
        begins, total = np.append(0, ends[:-1]), np.zeros(len(sizes))
        for a, b, o in zip(begins, ends, owners, strict=True):
            assert starts[o] <= a < b <= starts[o + 1]
            total[o] += error_of(values[a:b].tolist(), docs[a:b].tolist()) + cost
        assert np.allclose(total, [least_cost(values[a:b].tolist(), docs[a:b].tolist(), cost) for a, b in zip(starts, starts[1:], strict=False)])
    ends, _ = lexical.block_ends(rng.integers(0, 9, 5000), np.arange(5000), np.array([0, 5000]), 10.0)  # a list of more values than parts
    assert ends[-1] == 5000 and (np.diff(ends) > 0).all()


def ranking(docs, items, k):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(c[2] for c in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, size in counts:
            m = 50 + 50 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words_of(text)) if c[w])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, place + 1, None if none else i, -s) for place, (s, none, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "k", "seed"), [(300, 7, 1), (40, 50, 2), (0, 3, 3)])
def test_search_against_scores_of_all(spark, n, k, seed):
    raw = texts(n, seed)
    docs = [*enumerate(raw), (None, raw[-1]), (3, raw[3]), (9000, raw[-1])]
    items = [(0, "w1 W2 w40 w41 nowhere"), (1, None), (2, "!?"), (3, raw[-1]), (3, raw[-1]), (4, "é àb w9"), (None, "one w3")]
    d = spark.createDataFrame([(i, t, 3, 4) for i, t in docs], "doc_id long, text string, score int, query int").repartition(5)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted([tuple(r) for r in lexical.top_documents(d, q, k).select("item_id", "rank", "doc_id", "score").collect()], key=repr)
    assert got == ranking(docs, items, k)


def test_search_of_nothing(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.top_documents(some, q).count() == 0
    assert lexical.top_documents(d, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_queries_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    docs, items = list(enumerate(texts(60, 6))), [(i, f"w{i} w{i + 1}") for i in range(5)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted([tuple(r) for r in lexical.top_documents(d, q, 4).collect()], key=repr) == ranking(docs, items, 4)


def rows_of(docs, vocabulary):
    owner, terms, times, n = lexical._term_counts(pa.array([t or "" for t in docs]), vocabulary)
    lists = lambda v: lexical._lists(owner, len(docs), pa.array(v))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(docs))), pa.array(n.astype(np.int64)), lists(terms.astype(np.int32)), lists(times.astype(np.int64))], ["doc_id", "n", "terms", "times"])


def test_shards_cover_all_rows_and_blocks_are_skipped(monkeypatch):
    """A bound on what a task holds, and fewer postings looked at than there are, with the same result."""
    rng = random.Random(8)
    docs = [" ".join(rng.choices([f"t{i}" for i in range(40)], k=rng.randrange(5, 40))) + (" rare" * rng.randrange(3) if rng.random() < 0.02 else "") for _ in range(3000)]
    query = np.unique(np.concatenate([lexical._term_counts(pa.array(["rare t1 t2"]))[1]]))
    batch = rows_of(docs, query)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 500)
    parts = list(lexical._gathered(iter([batch.slice(0, 1234), batch.slice(1234)])))
    assert np.concatenate([p.column("doc_id").to_numpy() for p in parts]).tolist() == list(range(3000)) and len(parts) > 3
    n = batch.column("n").to_numpy()
    sizes, terms, times = batch.column("terms").value_lengths().to_numpy(), batch.column("terms").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
    model = lexical.Model(len(docs), int(n.sum()), np.array([math.floor(1000 * math.log(6002 / (2 * (terms == i).sum() + 1))) for i in range(3)], np.int64))
    shard = lexical.Shard(np.arange(3000), n, np.repeat(np.arange(3000), sizes), terms, times, model)
    scores, ids = shard.search(np.arange(3), 10, np.zeros(0, np.int64), np.zeros(0, np.int64))
    plain = np.zeros(3000, np.int64)
    np.add.at(plain, shard.docs, shard.scores)
    assert list(zip(scores.tolist(), ids.tolist(), strict=True)) == sorted(((int(s), i) for i, s in enumerate(plain)), key=lambda x: (-x[0], x[1]))[:10]
    assert shard.scored < len(shard.docs) / 2


def test_whole_arithmetic_beyond_64_bits():
    model = lexical.Model(10**12, 10**15, np.zeros(1, np.int64))
    n = 10**9
    assert model.parts(np.array([3]), np.array([n])).tolist() == [3_000_000_000 // (3000 + 20 * (50 + 50 * n * 10**12 // 10**15))]
