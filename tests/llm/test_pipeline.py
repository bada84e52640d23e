import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words_of(text):
    return (text or "").split()


def near_duplicates(texts):
    """The places that stay: of linked sets of five-word shingles the first, and all texts without words."""
    sets = []
    for t in texts:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [i for i, s in enumerate(sets) if not s or root[i] == i]


def cut(texts, window=50):
    """The words that stay of each text."""
    words, first = [words_of(t) for t in texts], {}
    for i, w in enumerate(words):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = {p for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for p in range(j, j + window)}
        out.append([x for p, x in enumerate(w) if p not in gone])
    return out


def made_corpus(seed=5, n=240):
    """Texts with toxic words, near copies, a shared passage, empty and null ones; and the labels."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [f"p{i}" for i in range(70)]
    texts, toxic = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 200))]
        bad = i % 5 == 0
        if i % 7 == 1 and i > 20:
            w = texts[i - 14].split()
            bad = toxic[i - 14]
            w[rng.randrange(len(w))] = word()
        elif i % 6 == 2:
            w[5:5] = passage[rng.randrange(15) :]
        elif bad:
            for _ in range(8):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "scum"])
        texts.append(" ".join(w))
        toxic.append(bad)
    return texts, toxic


def test_stages_against_brute_force(spark, tmp_path):
    texts, toxic = made_corpus()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", None, "s", 0), (902, " \n", "en", "s", 2)]
    clash = {"_id": 1, "_version": 2, "_text": 3, "c0": 4, "_score": 5, "_new": 6}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(v).alias(k) for k, v in clash.items()])
    spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    every = stages["toxicity"](spark, docs, str(tmp_path)).sort("doc_id").collect()
    kept = {r.doc_id: r.text for r in every}
    assert every[0].asDict().keys() == {*COLUMNS, *clash} and all({k: r[k] for k in clash} == clash for r in every)
    assert sum((i in kept) != (not x) for i, x in enumerate(toxic)) <= 0.03 * len(toxic) and {900, 901, 902} <= set(kept)
    ids = sorted(kept)
    docs = corpus_pipeline.stored(docs.where(F.col("doc_id").isin(ids)), "kept")
    one = stages["near_duplicates"](spark, docs, str(tmp_path)).sort("doc_id").collect()
    assert [r.doc_id for r in one] == [ids[i] for i in near_duplicates([kept[i] for i in ids])] and len(one) < len(ids)
    assert all({k: r[k] for k in clash} == clash and r.text == kept[r.doc_id] for r in one)
    ids = [r.doc_id for r in one]
    docs = corpus_pipeline.stored(docs.where(F.col("doc_id").isin(ids)), "one")
    less = stages["substring_dedup"](spark, docs, str(tmp_path)).sort("doc_id").collect()
    want = cut([kept[i] for i in ids])
    assert [words_of(r.text) for r in less] == want and [r.doc_id for r in less] == ids
    assert sum(len(w) for w in want) < sum(len(words_of(kept[i])) for i in ids) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in less)
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(library.encode(kept[i] or "", add_special_tokens=False).ids) + 1 for i in ids}
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048


def test_repeated_rows_and_ids(spark, tmp_path):
    long = " ".join(f"a{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        left.append(docs.count())
    assert left == [6, 3, 3, 3]


def test_stages_on_a_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS
        rows[name] = docs.count()
    assert 0.5 * 200 < rows["near_duplicates"] <= rows["toxicity"] <= 200 and rows["substring_dedup"] == rows["near_duplicates"]
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_take_an_empty_table(spark, sf):
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
        assert stage(spark, empty, sf).count() == 0
