import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelode.llm import chat, hamming, order_minhash, repeats, setjoin, toxicity
from tracelode.llm.common import ship
from tracelode.llm.components import components
from tracelode.llm.words import Words


def documents(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")


def words_of(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]


def corpus(n, seed, vocabulary=400):
    """Texts with copies, near copies, shared passages, short and odd ones."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % vocabulary}"
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.1:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word().upper()
            texts.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 8, 30, 90, 150]))]
            if kind > 0.8:
                w[len(w) // 2 : len(w) // 2] = passage[rng.randrange(15) :]
            texts.append(" ".join(w))
    return texts


def edges_of(sets, percent):
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                out.append((j, i))
    return out


def roots(n, edges):
    root = list(range(n))
    for a, b in edges:
        x, y = root[a], root[b]
        if x != y:
            root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def sets_of(texts, k):
    out = []
    for t in texts:
        w = words_of(t, True)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 60, 3), (2, 100, 4)])
def test_jaccard_join_against_all_pairs(spark, k, percent, seed):
    texts = [*corpus(260, seed), "", None, " \n ", "a b c\x0bd", "A b C d", "a B c D"]
    got = {r.doc_id: r for r in setjoin.join_components(documents(spark, enumerate(texts)), k, percent).collect()}
    sets = sets_of(texts, k)
    want = roots(len(texts), edges_of(sets, percent))
    assert {i: (len(s), want[i]) for i, s in enumerate(sets)} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}
    kept = sorted(r.doc_id for r in setjoin.keep_one(documents(spark, enumerate(texts)), k, percent).collect())
    assert kept == [i for i, s in enumerate(sets) if not s or want[i] == i]


def test_join_in_blocks_with_hot_group_and_neighbourhoods(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 8)
    monkeypatch.setattr(setjoin.Bands, "allocate", lambda self, counts: [(d + 1 - (d + 1) // 2, (d + 1) // 2) for d in self.differences])
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 40 + corpus(60, 7)
    sets = sets_of(texts, 2)
    got = {r.doc_id: r.component_id for r in setjoin.join_components(documents(spark, enumerate(texts)), 2, 85).collect()}
    assert got == dict(enumerate(roots(len(texts), edges_of(sets, 85))))


@pytest.mark.parametrize("percent", [60, 80, 85, 90])
@pytest.mark.parametrize("sets_of_a_band", [100, 10_000, 100_000, 10**7])
def test_linked_sets_share_a_key(percent, sets_of_a_band):
    """Pairs that just link, of all small sizes and some larger ones: light and wide segments alike."""
    rng = np.random.default_rng(percent)
    bands = setjoin.Bands(percent, 400)
    plan = bands.allocate({b: sets_of_a_band for b in range(len(bands.first))})
    tokens, sizes = [], []
    for n in [*range(2, 45), 70, 100, 150, 250]:
        for m in range(n * percent // 100, n + 1):
            common = -(-percent * (n + m) // (100 + percent))
            if not 0 < common <= m or (n == m == common):
                continue
            for _ in range(4 if n < 45 else 1):
                t = rng.integers(0, 1 << 63, n + m - common, np.int64).view(np.uint64) * np.uint64(2)
                a, b = np.sort(t[:n]), np.sort(np.concatenate([t[:common], t[n:]]))
                assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
                tokens += [a, b]
                sizes += [n, m]
    keys, owners = setjoin.signatures(np.concatenate(tokens), np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(sizes)), bands, plan)
    of: list[set] = [set() for _ in sizes]
    for key, owner in zip(keys.tolist(), owners.tolist(), strict=True):
        of[owner].add(key)
    assert not [(sizes[i], sizes[i + 1]) for i in range(0, len(sizes), 2) if not of[i] & of[i + 1]]


def test_sketches_fold_and_never_pass_the_difference():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 62, 3000)).astype(np.uint64)
    b = np.unique(np.concatenate([a[200:], rng.integers(0, 1 << 62, 150).astype(np.uint64)]))
    assert setjoin.sketch_words(np.array([1, 512, 513, 3000])).tolist() == [8, 8, 16, 64]
    offsets = np.array([0, len(a), len(a) + len(b)])
    wide = np.stack([np.frombuffer(x, np.uint64) for x in setjoin.own_sketches(np.concatenate([a, b]), offsets)])
    apart = len(np.setxor1d(a, b))
    for words in (64, 16, 8):
        narrow = setjoin.fold(wide, words)
        assert (narrow == setjoin.sketches(np.concatenate([a, b]), offsets, words)).all()
        assert np.bitwise_count(narrow[0] ^ narrow[1]).sum() <= apart


def test_number_of_links_in_groups(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 8)
    rng = random.Random(16)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["", None, "a b c", "a b c"] + corpus(60, 7)
    sets = sets_of(texts, 2)
    want = Counter(i for e in edges_of(sets, 85) for i in e)
    got = {r.doc_id: r.n_links for r in setjoin.join_components(documents(spark, enumerate(texts)), 2, 85).collect()}
    assert got == {i: want[i] for i in range(len(texts))} and max(want.values()) > 3


def test_join_edges(spark):
    assert setjoin.join_components(documents(spark, []), 4, 85).count() == 0
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "other words are here"), (1, "zz")]
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in setjoin.join_components(documents(spark, rows), 4, 85).collect() if r.component_id is not None)
    assert got == [(0, 2, 3), (1, 1, 1), (3, 2, 3), (3, 2, 3)]
    clash = documents(spark, rows).select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("_id", "_version", "_kid", "set_id", "c0", "n"))])
    kept = setjoin.keep_one(clash, 4, 85)
    assert kept.columns == clash.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert all(tuple(r)[2:] == tuple(range(6)) for r in kept.collect())
    same = setjoin.join_components(documents(spark, [(None, f"t{i % 3} of many rows without an id") for i in range(30)]), 4, 85).collect()
    assert len(same) == 30 and all(r.component_id is None and r.n_links >= 9 for r in same)


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(8).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def without(texts, window):
    words = [words_of(t) for t in texts]
    first = {}
    for i, w in enumerate(words):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    gone = []
    for i, w in enumerate(words):
        mark = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                mark[j : j + window] = [True] * window
        gone.append(mark)
    return words, gone


@pytest.mark.parametrize(("window", "slice_bytes", "levels"), [(50, 24 << 20, 3), (7, 3000, 4), (2, 700, 2), (1, 700, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, window, slice_bytes, levels):
    monkeypatch.setattr(repeats, "COMBINE_BYTES", slice_bytes)
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (window, levels))
    texts = [*corpus(150, window), "", None, "spam " * 300, "spam " * 200, " \n lead  " + "spam " * 100]
    words, gone = without(texts, window)
    got = {r.doc_id: r for r in repeats.kept_words(documents(spark, enumerate(texts)), window).collect()}
    for i, (w, mark) in enumerate(zip(words, gone, strict=True)):
        kept = b" ".join(x for x, g in zip(w, mark, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(mark), hashlib.sha256(kept).hexdigest())
    docs = documents(spark, enumerate(texts)).withColumn("n_chars", F.length("text").cast("long"))
    for r in repeats.without_repeats(docs, window).collect():
        kept = [x for x, g in zip(words[r.doc_id], gone[r.doc_id], strict=True) if not g]
        assert words_of(r.text) == kept and (r.text == texts[r.doc_id] or any(gone[r.doc_id]))
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.key == "clash"


def test_repeats_of_equal_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (0, "short")]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in repeats.kept_words(documents(spark, rows), 50).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (1, 0), (99, 60)]
    assert repeats.kept_words(documents(spark, []), 50).count() == 0


def test_levels():
    assert repeats.lengths_of(50) == [13, 25, 50] and repeats.lengths_of(50, 2) == [25, 50] and repeats.lengths_of(7, 9) == [1, 2, 4, 7] and repeats.lengths_of(1) == [1]
    with pytest.raises(ValueError):
        repeats.lengths_of(0)


def test_search_ends_without_candidates(spark):
    docs = documents(spark, [(i, " ".join(f"w{i}x{j}" for j in range(80))) for i in range(5)])
    assert all(r.n_removed == 0 and r.n_words == 80 for r in repeats.kept_words(docs, 50).collect())


def test_sliding_argmin():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 26, 40):
        v = rng.integers(0, 9, 40)
        assert repeats.sliding_argmin(v, size).tolist() == [i + int(np.argmin(v[i : i + size])) for i in range(40 - size + 1)]


def test_words():
    texts = ["", "a bb  a", "\tA\x0bbb\r\n", "é日 é日", "a"]
    w = Words(pa.array(texts), lower=True)
    assert np.diff(w.firsts).tolist() == [0, 3, 2, 2, 1]
    assert w.hashes[0] == w.hashes[2] == w.hashes[3] == w.hashes[7] and w.hashes[1] == w.hashes[4] and w.hashes[5] == w.hashes[6]
    assert len(set(w.hashes.tolist())) == 3
    starts, hashes = Words(pa.array(["x y x y", "y x"])).windows(2)
    assert starts.tolist() == [0, 1, 2, 4] and hashes[0] == hashes[2] and hashes[1] == hashes[3]


def test_order_minhash(spark):
    rng = random.Random(10)
    texts = {i: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 5, 200, 400]))) for i in range(40)}
    texts |= {50: "", 51: None, 52: texts[0], 53: "日本語" * 40, 54: texts[5] + " " + texts[5]}
    rows = {r.doc_id: r for r in order_minhash.edited_pairs(documents(spark, texts.items())).collect()}
    order = sorted(texts, reverse=True)
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[here] or "", texts[after] or ""
        third = len(t) // 3
        r = rows[here]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[0].fingerprint == rows[52].fingerprint and rows[50].fingerprint == rows[51].fingerprint == "0" * 512
    long = [i for i in range(40) if len(texts[i]) > 500]
    assert np.mean([rows[i].near_edited for i in long]) > 0.3 > 0.1 > np.mean([rows[i].near_next for i in long])
    assert order_minhash.edited_pairs(documents(spark, [])).count() == 0
    alone = order_minhash.edited_pairs(documents(spark, [(1, "a b c d e f")])).first()
    assert alone.near_next == 1.0


def test_order_minhash_of_repeated_and_null_ids(spark):
    rows = [(2, "b two"), (2, "a two"), (None, "last of all"), (5, "five words are in here"), (5, "five words are in here"), (None, None), (1, "long " * 30_000)]
    got = order_minhash.edited_pairs(documents(spark, rows)).collect()
    order = ["five words are in here"] * 2 + ["a two", "b two", "long " * 30_000, "", "last of all"]  # descending ids, null last, equal ids by text
    edited = Counter()
    for i, t in enumerate(order):
        third, other = len(t) // 3, order[(i + 1) % len(order)]
        edited[hashlib.sha256((t[: len(t) - third] + other[:third]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in got) == edited and len({r.fingerprint for r in got if r.n_chars == 22}) == 1


def test_order_minhash_by_hand(spark):
    """Occurrence numbers, selection and text order against the definition, and that order counts."""
    a, b = "x y z x y z q", "q x y z x y z"
    df = spark.createDataFrame([(a,), (b,), (a,)], "t string")
    got = df.select(order_minhash.kmers(F.col("t"), 1).alias("k"), order_minhash._numbered(order_minhash.kmers(F.col("t"), 1)).alias("n"), order_minhash.signature(F.col("t"), 1, 2, 4).alias("s")).collect()
    for row in got:
        seen, want = Counter(), []
        for at, k in enumerate(row.k):
            want.append((at, k, seen[k]))
            seen[k] += 1
        numbers = {x["at"]: (x["kmer"], x["rank"]) for x in row.n}
        assert {at: k for at, (k, _) in numbers.items()} == {at: k for at, k, _ in want}
        ranks = {(k, o): spark.sql(f"select xxhash64({k}L, {o})").first()[0] for _, k, o in want}
        assert all(numbers[at][1] == ranks[k, o] for at, k, o in want)
        for bucket in range(4):
            own = sorted((r, at, k) for at, (k, r) in numbers.items() if (r & (2**64 - 1)) >> 62 == bucket)[:2]
            tuple_ = [k for _, _, k in sorted(own, key=lambda x: x[1])]
            assert (row.s[bucket] == 0) == (not tuple_)
            if tuple_:
                assert row.s[bucket] == (spark.sql(f"select xxhash64(array({','.join(f'{k}L' for k in tuple_)}))").first()[0] & 0x7FFFFFFF) | 1
    assert got[0].s == got[2].s


def test_chat_events_fold(spark):
    e = [
        (1, 1, 1, "delta", "user", "he"), (1, 2, 1, "delta", "user", "llo"), (1, 2, 1, "delta", "user", "llo"), (1, 3, 2, "delta", "assistant", "bad"),
        (1, 4, 2, "regenerate", "assistant", None), (1, 5, 2, "delta", "assistant", "go"), (1, 6, 2, "delta", "assistant", "od"), (1, 7, 1, "edit", "user", "hi"),
        (1, 8, 1, None, "user", "!"), (None, 1, 1, "delta", None, None),
    ]
    log = spark.createDataFrame(e, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(log).collect()}
    assert got == {(1, 1): ("user", "hi!"), (1, 2): ("assistant", "good"), (None, 1): ("", "")}
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 1, 1, "what", "u", "t")], log.schema)).collect()


def test_chats_come_back(spark):
    rng = random.Random(11)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\", "<\\|", "\n", "assistant", "ä", "🙂", "%0A", "$1", ">"]
    chats = {c: [(rng.choice(["user", "assistant", "sys\n<|tem%25"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for _ in range(rng.randrange(1, 6))] for c in range(40)}
    chats[40] = [("assistant", "x" * 5000), ("user", "")]
    rows = [(c, i, r, t) for c, turns in chats.items() for i, (r, t) in enumerate(turns)] + [(41, 0, None, None), (41, None, "assistant", "first"), (None, 1, "user", "u")]
    chats |= {41: [("assistant", "first"), ("", "")], None: [("user", "u")]}
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.kind for r in chat.turn_events(turns, chunk=7).select("kind").distinct().collect()} == set(chat.KINDS)
    rendered = chat.render(chat.fold(chat.turn_events(turns, chunk=7))).cache()
    got = {r.conv_id: r for r in chat.digests(rendered).collect()}
    assert set(got) == set(chats)
    for c, said in chats.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[c].n_turns == len(said) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in rendered.collect():
        assert r.formatted.count("<|im_end|>") == len(chats[r.conv_id]) == r.formatted.count("<|im_start|>") and got[r.conv_id].formatted_chars == len(r.formatted)
    assert chat.digests(chat.render(chat.fold(chat.turn_events(turns.where("false"))))).count() == 0


def test_hamming_top_k(spark):
    rng = random.Random(12)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(300)]
    codes += [codes[0]] * 30 + [codes[1] ^ (1 << i) for i in range(40)] + [None]
    rows = [(i, c) for i, c in enumerate(codes)] + [(None, codes[0])]
    df = spark.createDataFrame(rows, "id long, code long")
    asked = [0, 1, 50, 350]
    got = {}
    for r in hamming.top_k(df, df.where(F.col("id").isin(*asked)), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    for q in asked:
        best = sorted((bin((c ^ codes[q]) & (2**64 - 1)).count("1"), i is None, i or 0) for i, c in rows if c is not None)[:10]
        assert [(i, d) for _, i, d in sorted(got[q])] == [(None if none else i, d) for d, none, i in best]
    assert hamming.top_k(df, df.where("false"), 3).count() == 0 and hamming.top_k(df.limit(0), df.limit(2), 3).count() == 0
    few = hamming.top_k(df.limit(2), df.limit(1), 10).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    bits = spark.createDataFrame([([1.0, -1.0, None],), (None,), ([0.5] * 64,)], "v array<double>").select(hamming.sign_code(F.col("v"))).collect()
    assert [r[0] for r in bits] == [-(2**63), 0, -1]


def test_flips(spark):
    for width, radius in ((8, 0), (8, 3), (9, 9), (11, 5), (1, 1), (1, 0)):
        got = spark.range(1).select(hamming._flips(width, radius)).first()[0]
        assert sorted(got) == [x for x in range(1 << width) if bin(x).count("1") == radius]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 300))]
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "trash", "scum"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus(1200, 13)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "idiot")])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("held", toxicity.is_held_out(F.col("doc_id"))).collect()
    assert len(scored) == len(rows) + 3 and all(0 <= r.score <= 1 for r in scored) and scored[0].key == "clash"
    truth = {i: y for i, _, y in rows}
    held = [r for r in scored if r.held and r.doc_id in truth]
    right = sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    # the labels of held-out rows have no influence
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, flipped)).collect()}
    assert all(again[r.doc_id] == r.score for r in scored)


def test_texts_alike_in_part_count_too(spark):
    """Equal texts weigh as one together, also under several ids; one that shares a passage keeps what is its own; the models have the words of all."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    alike = [(i, " ".join([passage, *(f"w{rng.randrange(3000)}" for _ in range(40))])) for i in range(30)]
    rows = [*alike, *((100 + i, "a text that stands here five times") for i in range(5)), (200, "short one"), (300, "of its own and of nobody else"), (400, "twice with the same id"), (400, "twice with the same id")]
    table = spark.createDataFrame([(i, hash(t), 0, t) for i, t in rows], "_id long, _version long, _toxic int, text string")
    got = {r._id: r for r in toxicity.weighed(table).collect()}
    share = {i: r._weight / toxicity.UNIT for i, r in got.items()}
    assert set(got) == {i for i, _ in rows}
    assert all(abs(share[100 + i] - 0.2) < 1e-5 for i in range(5)) and share[200] == share[300] == 1 and share[400] == 0.5
    assert 8 < sum(share[i] for i in range(30)) < 29 and len({got[100 + i]._mark for i in range(5)} - {None}) == 1
    # what a toxic text says beside a passage that it shares with an earlier one is counted
    docs = [(i, f"{passage} x{i} {'vile' if i % 2 else 'kind'} y{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, held_out=False)
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "vile"), (2, "kind")], "doc_id long, text string"), model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_a_giant_text_displaces_none(spark):
    rows = toxic_corpus(600, 17)
    giant = " ".join(f"g{i}" for i in range(30_000))
    ids = range(9000, 9060)  # one of them comes first
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(i, f"{i} {giant[i:]}") for i in ids])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 0) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, chars=100_000)
    assert model.weights[0] > 0
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= 0.3) == bool(y) for i, _, y in rows) >= 0.9 * len(rows)
    assert toxicity.within([(1, 3), (2, 50), (3, 4)], 10) == [(1, 3), (3, 4)] and toxicity.within([(1, 60), (2, 50)], 10) == [(2, 50)]
    # the counts are of all rows, whatever the sample holds
    words = toxicity.train(docs, labels, rows=20).words
    assert words.find(Words(pa.array(["idiot moron trash scum"])).hashes)[0].all()


def kneser_ney(texts, discount=0.75, stem=5):
    """log p(toxic) - log p(ordinary) of a word after another, by dictionaries: pairs, contexts of words, contexts of stems, shared counts."""
    pairs = [Counter(), Counter()]
    for toxic, text in texts:
        w = text.split()
        pairs[toxic].update(set(zip(["<s>", *w], w, strict=False)))
    words, stems, ratio = [Counter(w for _, w in p) for p in pairs], [], []
    for c in words:
        stems.append(Counter())
        for w, n in c.items():
            stems[-1][w[:stem]] += n
    shared, shared_stems = words[0] + words[1], stems[0] + stems[1]

    def p(c, before, w):
        total = sum(words[c].values())
        ps = max(stems[c][w[:stem]] - discount, 0) / total + sum(min(n, discount) for n in stems[c].values()) / total * shared_stems[w[:stem]] / sum(shared.values())
        pw = max(words[c][w] - discount, 0) / total + sum(min(n, discount) for n in words[c].values()) / total * ps * shared[w] / shared_stems[w[:stem]]
        after = {x: n for (v, x), n in pairs[c].items() if v == before}
        if not after:
            return pw
        return max(pairs[c][before, w] - discount, 0) / sum(after.values()) + sum(min(n, discount) for n in after.values()) / sum(after.values()) * pw

    return lambda before, w: math.log(p(1, before, w)) - math.log(p(0, before, w))


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COMBINE_BYTES", 100)
    rng = random.Random(3)
    texts = [(rng.randrange(2), " ".join(rng.choice(["abcdefg", "abcdexy", "abcde", "u", "v", "wx", "stems", "stemsy"]) for _ in range(rng.randrange(1, 9)))) for _ in range(40)]
    texts = texts * 2  # the operator leaves pairs that one text alone has to the words
    table = spark.createDataFrame([(t, x) for t, x in texts], "_toxic int, text string").repartition(3)
    model, want = toxicity.fit_models(table, evidence=-math.inf), kneser_ney(texts)
    for _, text in texts[:40]:
        w = text.split()
        got = model.ratios(Words(pa.array([text]), lower=True))
        assert np.allclose(got, [want(v, x) for v, x in zip(["<s>", *w], w, strict=False)])
    # pruned models still add up: what is left out has one ratio, that of the backoffs' weights
    pruned = toxicity.fit_models(table, evidence=math.inf)
    assert not len(pruned.words.keys) and np.allclose(pruned.ratios(Words(pa.array(["u v nobody"]))), 0)


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all(r.score < 0.6 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_regression_of_all_rows(spark):
    """The fit by sums of the executors is the weighted fit over every row; none is left out."""
    rng = random.Random(5)
    rows = [(y, rng.gauss(1.5 * y, 1)) for y in (int(rng.random() < 0.3) for _ in range(9000))]
    n = [sum(y == c for y, _ in rows) for c in (0, 1)]
    sizes = {0: 4 * n[0], 1: 2 * n[1]}
    a, b = toxicity.fit_logistic(spark.createDataFrame(rows, "_toxic int, x double").repartition(3), sizes)
    y, x = (np.array([r[i] for r in rows], float) for i in (0, 1))
    weight = np.where(y == 1, 2.0, 4.0) * len(y) / sum(sizes.values())
    p = 1 / (1 + np.exp(-(a * x + b)))
    # at the minimum the gradient is that of the ridge on the standardised slope
    assert abs((weight * (y - p)).sum()) < 1e-3 and abs((weight * (y - p) * (x - x.mean()) / x.std()).sum() - 0.3 * a * x.std()) < 1e-3
    assert toxicity.fit_logistic(spark.createDataFrame([(1, 0.5)], "_toxic int, x double"), {1: 1}) is None
