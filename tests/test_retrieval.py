import random
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.config import RunConfig
from tracelode.operators import metrics, retrieve, score, split, threshold
from tracelode.plans import pipeline
from tracelode.sources import logs


def clustered(n, d, clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return np.round(centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, d)), 4)


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), "x") for i, v in enumerate(vectors)], "uid long, cls array<double>, part string")


def plain(q, t, k):
    d = np.round(np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(axis=2)), 9)
    return [[(int(j), d[i, j]) for j in np.lexsort((np.arange(len(t)), d[i]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize(("n", "d", "clusters", "k", "block_rows"), [(900, 8, 30, 5, 20_000), (300, 3, 4, 40, 50), (5, 2, 2, 9, 20_000), (200, 1, 1, 1, 7)])
def test_index_finds_the_nearest(spark, n, d, clusters, k, block_rows):
    t = clustered(n, d, clusters, 1)
    t[n // 2 : n // 2 + n // 3] = t[0]  # a third of all rows in one place
    q = np.concatenate([clustered(60, d, clusters, 1), t[:3], np.full((1, d), 50.0)])
    rows = retrieve.nearest(frame(spark, q, 5000), frame(spark, t), k, block_rows).sort("q_uid", "rank").collect()
    got = [[(r.t_uid, r.dist) for r in rows if r.q_uid == 5000 + i] for i in range(len(q))]
    for mine, wanted in zip(got, plain(q, t, k), strict=True):
        assert [x for x, _ in mine] == [x for x, _ in wanted] and np.allclose([x for _, x in mine], [x for _, x in wanted])


def test_groups_searched_in_waves_find_the_same(spark, monkeypatch):
    assert retrieve._waves({0: 3, 2: 4, 5: 9, 6: 1}, 7) == [(0, 3), (5, 6), (6, 7)] and retrieve._waves({}, 7) == []
    made, true = [], retrieve._waves
    monkeypatch.setattr(retrieve, "_waves", lambda copies, _: made.append(true(copies, sum(copies.values()) // 2)) or made[-1])
    q, t = clustered(60, 8, 30, 1, 0.5), clustered(900, 8, 30, 1, 0.5)
    rows = retrieve.nearest(frame(spark, q, 5000), frame(spark, t), 5).sort("q_uid", "rank").collect()
    assert len(made[0]) > 1
    assert [[r.t_uid for r in rows if r.q_uid == 5000 + i] for i in range(len(q))] == [[x for x, _ in w] for w in plain(q, t, 5)]


def test_index_computes_few_distances(spark):
    q, t = clustered(400, 16, 40, 7), clustered(4000, 16, 40, 7)
    looked = retrieve.candidates(frame(spark, q, 10**6), frame(spark, t), 5).where("q_uid is null").agg(F.sum("looked")).first()[0]
    assert looked < 0.2 * len(q) * len(t)


def test_nothing_to_find(spark):
    some, none = frame(spark, np.ones((2, 3))), frame(spark, np.ones((0, 3)))
    assert retrieve.nearest(some, none, 3).count() == 0 and retrieve.nearest(none, some, 3).count() == 0


def tokens_frame(spark, matrices, vectors):
    return spark.createDataFrame([(i, v.tolist(), m.tolist()) for i, (m, v) in enumerate(zip(matrices, vectors, strict=True))], "uid long, cls array<double>, tokens array<array<float>>")


def sim(q, t, metric):
    if not len(q) or not len(t):
        return 0.0
    if metric == "cos":
        q, t = (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n) for x in (q, t))
    return (q @ t.T).max(axis=1).sum()


@pytest.mark.parametrize(("metric", "only_cls"), [("cos", False), ("dot", False), ("cos", True)])
def test_max_sim_of_sentences_of_any_length(spark, monkeypatch, metric, only_cls):
    monkeypatch.setattr(score, "BLOCK_BYTES", 2000)  # many blocks, and blocks that many queries need
    rng = np.random.default_rng(3)
    made = lambda n: [np.round(rng.normal(size=(int(rng.integers(1, 7)), 4)), 3).astype(np.float32) for _ in range(n)]
    q, t = made(50), made(60)
    q[3][0] = 0  # a token without direction
    t[5] = np.zeros((1, 4), np.float32)
    test, train = tokens_frame(spark, q, rng.normal(size=(50, 3))), tokens_frame(spark, t, rng.normal(size=(60, 3)))
    near = retrieve.nearest(test, train, 8)
    cut = (lambda m: m[:1]) if only_cls else (lambda m: m)
    for r in score.pair_similarities(test, train, near, only_cls, metric).collect():
        assert np.isclose(r.sim, sim(cut(q[r.q_uid].astype(float)), cut(t[r.t_uid].astype(float)), metric))
    sims = score.pair_similarities(test, train, near, only_cls, metric)
    whole = {r.q_uid: r.s for r in sims.groupBy("q_uid").agg(F.collect_list(F.struct("rank", "sim")).alias("s")).collect()}
    for r in score.prefix_scores(sims, [1, 3, 8, 20]).collect():
        values = [x.sim for x in sorted(whole[r.uid]) if x["rank"] <= r.core_set]
        assert np.allclose([r.raw_max, r.raw_mean], [max(values), np.mean(values)])
    assert score.prefix_scores(sims, [1, 3, 8, 20]).count() == 4 * len(q)
    every = {r.uid: (r.raw_max, r.raw_mean) for r in score.against_all(test, train, only_cls, metric, block_rows=9).collect()}
    for i in range(len(q)):
        values = [sim(cut(q[i].astype(float)), cut(x.astype(float)), metric) for x in t]
        assert np.allclose(every[i], [max(values), np.mean(values)])


@pytest.mark.parametrize(("metric", "start"), [("cos", True), ("dot", False)])
def test_bounds_pass_over_sentences(spark, metric, start):
    """Equal to the exhaustive mode, and few sentences are scored where they lie in groups."""
    rng = np.random.default_rng(9)
    topics = rng.normal(size=(25, 6, 5))
    made = lambda n: [(topics[k] + 0.05 * rng.normal(size=(6, 5)))[: rng.integers(3, 7)].astype(np.float32) for k in rng.integers(0, 25, n)]
    q, t = made(40), [*made(500), np.zeros((0, 5), np.float32)]
    cls = lambda m: np.array([x.mean(axis=0) if len(x) else np.zeros(5) for x in m])
    test, train = tokens_frame(spark, q, cls(q)), tokens_frame(spark, t, cls(t))
    near = retrieve.nearest(test, train, 2) if start else None
    got = score.best_against_all(test, train, metric=metric, neighbours=near, block_rows=300).collect()
    want = {r.uid: r.raw_max for r in score.against_all(test, train, metric=metric, block_rows=300).collect()}
    assert len(got) == 40 and all(np.isclose(r.raw_max, want[r.uid]) for r in got)
    assert sum(r.looked for r in got) < 0.5 * 40 * len(t)


def detection_table(spark, n=90):
    """Vectors of normal and odd sentences, their tokens, and log rows of which some repeat."""
    rng = np.random.default_rng(11)
    v = clustered(n, 6, 5, 4, 0.2)
    v[::9] += rng.normal(size=v[::9].shape)
    m = [np.stack([x[:3], x[3:], x[:3] + x[3:]]) for x in v]
    rows = [(j, int(i % 9 == 0), "train" if i % 2 and i % 9 else "test", i) for j, i in enumerate([*range(n), *range(0, n, 4)])]
    return tokens_frame(spark, m, v), spark.createDataFrame(rows, "line_no long, label int, split string, uid long"), v, m, rows


def by_numpy(v, m, rows, size, metric="cos"):
    train = sorted({r[3] for r in rows if r[2] == "train"})
    test = [r for r in rows if r[2] == "test"]
    best, mean, one = {}, {}, {}
    for u in {r[3] for r in test}:
        d = np.round(np.sqrt(((v[train] - v[u]) ** 2).sum(axis=1)), 9)
        order = np.lexsort((train, d))[: size or len(train)]
        s = [sim(m[u].astype(np.float32).astype(float), m[train[i]].astype(np.float32).astype(float), metric) for i in order]
        one[u], best[u], mean[u] = d.min(), max(s), np.mean(s)
    out = []
    for scores in (one, {u: round(max(best.values()) - x, 9) for u, x in best.items()}, {u: round(max(mean.values()) - x, 9) for u, x in mean.items()}):
        points = []
        for t in sorted(set(scores.values())):
            called = [(scores[r[3]] >= t, r[1]) for r in test]
            tp, fp, fn = (sum(1 for c, y in called if c == a and y == b) for a, b in ((True, 1), (True, 0), (False, 1)))
            p, r = tp / (tp + fp), tp / (tp + fn)
            points.append((-round(2 * p * r / (p + r + 1e-10), 12), t, 2 * tp / (2 * tp + fp + fn)))
        out.append(min(points)[2])
    return out


def test_a_run_by_numpy(spark):
    representation, rows, v, m, plain_rows = detection_table(spark)
    for size in (3, 0):
        report = pipeline.detect(representation, rows, RunConfig(core_set=size)).collect()
        got = {r.exp_name: r.f1_score for r in report}
        assert np.allclose([got[f"{n}(all_each)"] for n in ("K=1", "ColBERT", "mean ColBERT")], by_numpy(v, m, plain_rows, size))


def test_each_run_of_a_grid_is_its_own(spark, tmp_path):
    representation, rows, *_ = detection_table(spark)
    configs = [RunConfig(core_set=c, threshold=h, only_cls=o, metric=x) for c, h, o, x in ((1, "prc", False, "cos"), (4, "roc", False, "cos"), (0, "prc", False, "cos"), (2, "prc", True, "cos"), (4, "prc", False, "dot"))]
    whole = pipeline.run_grid(spark, lambda _: (representation, rows), configs, str(tmp_path)).collect()
    both = pipeline.sides(representation, rows, configs[0])
    names = ["f1_score", "roc_auc_score", "precision_score", "recall_score", "accuracy_score"]
    for c in configs:
        alone = {r.exp_name: [r[n] for n in names] for r in pipeline.detect(representation, rows, c).collect()}
        mine = {r.exp_name: [r[n] for n in names] for r in whole if r.experiment == c.experiment_name(both.uniques)}
        assert len(mine) == 3 and mine == alone
    # the same by predictions for each log row
    near = retrieve.nearest(both.test, both.train, 4)
    scores = score.inverted(score.against_core_set(both.test, both.train, near), "raw_max")
    r = metrics.report(threshold.predictions(score.to_rows(both.rows, scores), "roc"), "x").first()
    assert [r[n] for n in names] == [x[n] for x in whole if x.exp_name == "ColBERT(all_each)" and x.experiment == configs[1].experiment_name(both.uniques) for n in names]


def test_a_threshold_from_a_validation_part(spark):
    representation, rows, *_ = detection_table(spark)
    config = RunConfig(core_set=3, validation=0.4)
    report = {r.exp_name: r for r in pipeline.detect(representation, rows, config).collect()}
    both = pipeline.sides(representation, rows, config)
    scored = score.to_rows(both.rows, score.distance_score(retrieve.nearest(both.test, both.train, 1)))
    n = both.rows.count()
    part = split.first_rows(both.rows, "line_no", config.seed, lambda _, n: int(0.4 * n))
    called = threshold.predictions(scored.where(~part), "prc", validation=scored.where(part))
    r = metrics.report(called, "x").first()
    assert called.count() == n - int(0.4 * n)
    assert [r[c] for c in logs.METRICS] == [report["K=1(all_each)"][c] for c in logs.METRICS]


def test_a_run_leaves_its_report(spark, tmp_path):
    from pathlib import Path

    from tracelode.storage import shared_dir

    representation, rows, *_ = detection_table(spark)
    before = set(Path(shared_dir(spark).removeprefix("file://")).iterdir())
    report = pipeline.detect(representation, rows, RunConfig(core_set=2))
    left = set(Path(shared_dir(spark).removeprefix("file://")).iterdir()) - before
    assert len(left) == 1 and report.count() == 3


@pytest.mark.parametrize("few", [split.FEW_ROWS, 3])
def test_draws_by_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(split, "FEW_ROWS", few)
    monkeypatch.setattr(split, "DIGITS", 1)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 0, 1, None]), f"v{i}") for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k long, label int, value string")
    order = lambda label: sorted((md5(f"{k}9".encode()).hexdigest(), k) for k, x, _ in rows if x == label)
    part = split.sample_ratio(df, "k", 0.3, 9)
    assert sorted(r.k for r in part.collect()) == sorted(k for x in (0, 1, None) for _, k in order(x)[: int(len(order(x)) * 0.3)])
    parts = split.train_test(df, "k", 0.2, 9)
    assert sorted(r.k for r in parts.where("split = 'train'").collect()) == sorted(k for _, k in order(0)[: len(order(0)) - -(-len(order(0)) // 5)])
    assert "Exchange" not in parts._jdf.queryExecution().toString() and "Exchange" not in part._jdf.queryExecution().toString()
    in_order = split.train_test(df, "k", 0.2, 9, shuffle=False)
    normal = sorted(k for k, x, _ in rows if x == 0)
    assert sorted(r.k for r in in_order.where("split = 'train'").collect()) == normal[: len(normal) - -(-len(normal) // 5)]
    counts = Counter(r.label for r in split.sample_count(df, "k", 100, 9).collect())
    assert sum(counts.values()) in (98, 99, 100)


def test_draws_at_the_edges(spark):
    same = spark.createDataFrame([(1, 0)] * 50 + [(2, 0), (None, 0)], "k long, label int")
    assert split.sample_ratio(same, "k", 1.0).count() == 51  # a row without a key is never drawn
    assert split.sample_ratio(same.limit(0), "k", 0.5).count() == 0
    assert split.train_test(same.limit(0), "k").count() == 0
    assert split.train_test(same, "k", 1.0).where("split = 'train'").count() == 0


def test_padded_tokens_say_the_same():
    """Sentences of any number of tokens, none included, in products of whole places."""
    rng = np.random.default_rng(3)
    make = lambda n: [rng.normal(size=(int(k), 5)) for k in rng.integers(0, 5, n)]
    stacked = lambda x: (np.concatenate(x), np.concatenate([[0], np.cumsum([len(m) for m in x])]))
    queries, known = make(20), make(30)
    got = score.sums_of_best(score._padded(*stacked(queries), False), score._padded(*stacked(known), True))
    want = [[(q @ t.T).max(axis=1).sum() if len(q) and len(t) else 0 for t in known] for q in queries]
    assert np.allclose(got, want)


def test_what_a_task_holds_is_bounded():
    """A step's products, and a block's matrices with the copies made of them, stay far below a worker's share of 1,000 MB."""
    assert 8 * 8 * max(score.STEP_VALUES, score.TILE_VALUES, retrieve.STEP_VALUES) + 16 * score.BLOCK_BYTES <= 300e6


def test_limit_leaves_few_rows_to_look_through():
    import numpy as np

    rng = np.random.default_rng(3)
    q, t = rng.standard_normal((20, 4)), rng.standard_normal((300, 4))
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2))
    limit = np.sort(d, axis=1)[:, 1]
    row, column = retrieve._close(q, t, 2, limit)
    assert set(zip(row.tolist(), column.tolist())) == {(i, int(j)) for i in range(20) for j in np.argsort(d[i])[:2]}
    row, _ = retrieve._close(q, t, 2, np.full(20, np.inf))
    assert np.bincount(row).tolist() == [2] * 20
