from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.__main__ import main
from tracelode.config import RunConfig
from tracelode.functions import vectors
from tracelode.operators import dedup, encode, metrics, retrieve, score, sessions, split, threshold
from tracelode.plans import inputs, pipeline
from tracelode.sources import logs
from tracelode.storage import dense_index, running_sums
from tracelode.streaming.score import known_sentences


def scored(spark, scores, labels):
    return spark.createDataFrame([(float(s), y) for s, y in zip(scores, labels, strict=True)], "score double, label int")


def test_thresholds_and_report(spark):
    rows = scored(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    assert threshold.threshold_prc(rows).first()[0] == 0.35
    assert threshold.threshold_roc(rows).first()[0] == 0.8
    called = threshold.predictions(rows, "prc")
    assert tuple(metrics.confusion(called).first()) == (2, 1, 0, 1)
    r = metrics.report(called, "x").first()
    assert np.allclose([r.precision_score, r.recall_score, r.f1_score, r.accuracy_score, r.roc_auc_score], [2 / 3, 1, 0.8, 0.75, 0.75])


def test_thresholds_by_brute_force(spark):
    rng = np.random.default_rng(5)
    s, y = np.round(rng.random(200), 1), rng.integers(0, 2, 200)
    best = {}
    for t in np.unique(s):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        p, r = tp / (tp + fp), tp / y.sum()
        best[t] = round(2 * p * r / (p + r + 1e-10), 12), round(r - fp / (len(y) - y.sum()), 12)
    rows = scored(spark, s.tolist(), y.tolist())
    assert threshold.threshold_prc(rows).first()[0] == min(best, key=lambda t: (-best[t][0], t))
    j = {**{t: b[1] for t, b in best.items()}, s.max() + 1: 0.0}
    assert threshold.threshold_roc(rows).first()[0] == max(j, key=lambda t: (j[t], t))


@pytest.mark.parametrize("labels", [[0, 0], [1, 1], []])
def test_one_class_or_nothing(spark, labels):
    rows = scored(spark, [0.5] * len(labels), labels)
    r = metrics.report(threshold.predictions(rows, "prc"), "x").first()
    assert r.roc_auc_score is None and r.f1_score == (1.0 if labels == [1, 1] else 0.0)


def test_max_sim(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 0.0]], [[0.0, 1.0], [1.0, 0.0]])], "q array<array<double>>, d1 array<array<double>>, d2 array<array<double>>")
    assert df.select(vectors.max_sim(F.col("q"), F.col("d1")), vectors.max_sim(F.col("q"), F.col("d2"))).first()[:] == (1.0, 2.0)
    assert df.select(vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]
    raw = spark.createDataFrame([(1, 2.0), (2, 1.5), (3, 0.5)], "uid long, raw double")
    assert [r.score for r in score.inverted(raw, "raw").sort("uid").collect()] == [0.0, 0.5, 1.5]


def test_core_set_of_all_is_exhaustive_and_grows(spark, sf):
    v = inputs.vectors(spark, sf)
    train, test = v.where("split = 'train'").limit(40).cache(), v.where("split = 'test' and uid % 9 = 0").cache()
    near = retrieve.nearest(test, train, 40, block_rows=7)
    every = {r.uid: (round(r.raw_max, 9), round(r.raw_mean, 9)) for r in score.against_all(test, train, block_rows=9).collect()}
    last = None
    for k in (1, 5, 40):
        raw = {r.uid: (round(r.raw_max, 9), round(r.raw_mean, 9)) for r in score.against_core_set(test, train, near.where(F.col("rank") <= k)).collect()}
        assert last is None or all(raw[u][0] >= last[u][0] for u in raw)
        last = raw
    assert last == every
    rows = near.sort("q_uid", "rank").collect()
    assert all(a.q_uid != b.q_uid or a.dist <= b.dist for a, b in zip(rows, rows[1:], strict=False))


def test_splits_are_exact(spark):
    df = spark.range(11).select(F.col("id").alias("k"), F.lit(0).alias("label")).unionByName(spark.range(100, 104).select(F.col("id").alias("k"), F.lit(1).alias("label")))
    for shuffle in (True, False):
        parts = split.train_test(df, "k", 0.2, 1, shuffle)
        assert tuple(logs.split_sizes(parts).first()) == (8, 3, 4)
        assert parts.count() == 15
    assert split.sample_ratio(df, "k", 0.5).groupBy("label").count().sort("label").collect()[0]["count"] == 5
    with pytest.raises(ValueError):
        split.sample_count(df, "k", 100)
    unlabelled = df.unionByName(spark.createDataFrame([(999, None)], "k long, label int"))
    assert split.train_test(unlabelled, "k").count() == 15


def test_index_and_running_sums(spark):
    df = spark.createDataFrame([(w,) for w in "pear fig apple fig kiwi date".split()], "sentence string")
    uniques = dedup.unique_sentences(df).sort("uid").collect()
    assert [(r.uid, r.sentence) for r in uniques] == list(enumerate(["apple", "date", "fig", "kiwi", "pear"]))
    assert dense_index(spark.range(0), [F.col("id")], "n").count() == 0
    sums = running_sums(spark.range(1, 50), [F.col("id").desc()], {"s": "id"}).collect()
    assert all(r.s == sum(range(r.id, 50)) for r in sums)


def test_sessions(spark):
    lines = spark.createDataFrame([(2, "a b c INFO to blk_-77 and blk_12 blk_12"), (1, "a b c WARN from blk_12"), (3, "nothing")], "line_no long, value string")
    labels = logs.block_labels(spark.createDataFrame([(1, "blk_12", "Normal"), (2, "blk_12", "Anomaly")], "line_no long, BlockId string, Label string"))
    got = {r.block_id: r for r in sessions.sessions(lines, labels).collect()}
    assert got["blk_12"].raw == ["a b c WARN from blk_12", "a b c INFO to blk_-77 and blk_12 blk_12"]
    assert got["blk_12"].label == 1 and got["blk_-77"].label is None
    assert got["blk_12"].events == ["blk_12", "info to blk and blk blk", "warn from blk"]


def test_files(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"- one\r\nKERN two\xff\n\n")
    routed, blank = logs.route_labels(logs.read_lines(spark, str(tmp_path / "log")))
    assert [(r.value, r.label) for r in routed.sort("line_no").collect()] == [("- one", 0), ("KERN two", 1)]
    assert blank.count() == 1
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_1,Anomaly\nblk_2,Normal\n")
    assert {r.block_id: r.label for r in logs.read_block_labels(spark, str(tmp_path / "l.csv")).collect()} == {"blk_1": 1, "blk_2": 0}
    parts = routed.withColumn("split", F.when(F.col("label") == 0, "train").otherwise("test"))
    logs.write_split(parts, str(tmp_path / "s"))
    assert [r.value for r in logs.read_split(spark, str(tmp_path / "s"), "test").collect()] == ["KERN two"]
    logs.write_sizes(parts, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).first().test_abnormal == 1
    calls = []
    for _ in range(2):
        logs.load_or_make(spark, str(tmp_path / "a"), lambda: calls.append(1) or spark.range(3))
    assert calls == [1]


def test_whole_run(spark, sf):
    lines = inputs.log_lines(spark, sf, "bgl").limit(300)
    kept, bad = pipeline.parse(lines.unionByName(spark.createDataFrame([(10**6, "- no time here", 0)], lines.schema)), RunConfig())
    assert bad.count() == 1 and kept.count() == 300
    report = pipeline.run(lines, RunConfig(core_set=2, shuffle=True)).collect()
    assert [r.exp_name for r in report] == ["K=1(all_each)", "ColBERT(all_each)", "mean ColBERT(all_each)"]
    assert all(0 <= r.f1_score <= 1 for r in report)


def block_log(n=40):
    """Lines of n blocks; every fifth block has a step of its own and is abnormal."""
    lines, labels = [], []
    for i in range(n):
        steps = ["Receiving block", "PacketResponder for block", "Deleting block"] + ["Unexpected error serving block"] * (i % 5 == 0)
        block = f"blk_{'-' * (i % 2)}{100 + i}"
        lines += [f"081109 2035{j:02d} 143 INFO dfs.DataNode: {s} {block} src /10.0.0.{i}" for j, s in enumerate(steps)]
        labels.append((i, block, "Anomaly" if i % 5 == 0 else "Normal"))
    return lines, labels


def test_block_logs_from_lines_to_report(spark):
    lines, labels = block_log()
    log = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, "no block here", "- blk_999 without a label"])], "line_no long, value string")
    known = logs.block_labels(spark.createDataFrame(labels, "line_no long, BlockId string, Label string"))
    config = RunConfig(dataset="hdfs", core_set=1, shuffle=True, max_tokens=32)
    records, bad = pipeline.records_of(log, config, known)
    assert records.count() == 40 and records.where("label = 1").count() == 8 and bad.count() == 1
    report = {r.exp_name: r for r in pipeline.run(log, config, known).collect()}
    assert set(report) == {"K=1(session)", "ColBERT(session)", "mean ColBERT(session)"} and report["K=1(session)"].f1_score == 1.0
    with pytest.raises(ValueError):
        pipeline.labelled(log, config)


def test_runs_write_sentences_in_place_of_cheap_matrices(spark, monkeypatch):
    """The same report as over written matrices, without any on disk; an encoder that doesn't call its matrices cheap has them written."""
    words = [f"w{i * 7 % 23} w{i % 11} w{i % 5}" for i in range(40)]
    log = spark.createDataFrame([(i, f"{'APP' if i % 9 == 0 else '-'} 1 2005.06.03 R02 2005-06-03-15.42.50.675872 R02 RAS APP INFO {w}") for i, w in enumerate(words)], "line_no long, value string")
    written, reports = [], []
    for module in (pipeline, retrieve, score):
        monkeypatch.setattr(module, "stored", lambda df, *a, true=module.stored, **k: written.append(df.columns) or true(df, *a, **k))
    for cheap in (True, False):
        monkeypatch.setattr(encode.HashEncoder, "cheap", cheap)
        written.clear()
        report = pipeline.run(log, RunConfig(core_set=2, max_tokens=8, shuffle=True))
        reports.append(report.select("exp_name", "experiment", "f1_score", "roc_auc_score", "accuracy_score").collect())
        assert written and any("tokens" in columns for columns in written) != cheap
    assert len(reports[0]) == 3 and reports[0] == reports[1]


def test_matrices_made_where_they_are_compared(spark):
    make = partial(encode.HashEncoder, 4, 6)
    sentences = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} w{i}") for i in range(12)], "uid long, sentence string")
    whole = encode.encode(sentences, make)
    near = spark.createDataFrame([(q, 1, t, 0.5, t % 2) for q in range(5) for t in (q + 5, q + 6)], "q_uid long, rank int, t_uid long, dist double, part int")
    for only_cls in (False, True):
        found = [score.pair_similarities(x, x, near, only_cls, make_encoder=m).sort("q_uid", "t_uid").collect() for x, m in ((sentences, make), (whole, None))]
        assert len(found[0]) == 10 and found[0] == found[1]
    found = [score.against_all(x, x, make_encoder=m).sort("uid").collect() for x, m in ((sentences, make), (whole, None))]
    assert len(found[0]) == 12 and np.allclose(found[0], found[1])


def test_records_and_what_is_apart_are_parsed_once(spark, sf):
    lines = inputs.log_lines(spark, sf, "bgl").select("line_no", "value").unionByName(spark.createDataFrame([(10**6, "- no time here"), (10**6 + 1, " ")], "line_no long, value string"))
    records, bad = pipeline.records_of(lines, RunConfig(dataset="bgl"))
    assert sorted((r.line_no, r.value, r.label) for r in bad.collect()) == [(10**6, "- no time here", 0), (10**6 + 1, " ", None)]
    assert records.count() == lines.count() - 2 and records.columns == ["line_no", "ts", "session_id", "sentence", "label", "split"]
    assert set(records.inputFiles()) <= set(bad.inputFiles())  # both from what was written


def test_settings_count(spark, sf):
    lines = inputs.log_lines(spark, sf, "bgl")
    n = {r.label: r["count"] for r in lines.groupBy("label").count().collect()}
    half = pipeline.sampled(lines, RunConfig(sample=0.5)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in half} == {k: v // 2 for k, v in n.items()}
    assert 98 <= pipeline.sampled(lines, RunConfig(sample=100)).count() <= 100
    with pytest.raises(ValueError):
        encode.named("nobody", 8)
    seen = []

    class Sizes(encode.HashEncoder):
        def encode(self, sentences):
            seen.append(len(sentences))
            return super().encode(sentences)

    encode.ENCODERS["sizes"] = Sizes
    try:
        records = spark.createDataFrame([(i, f"s{i}", 0, "train") for i in range(50)], "line_no long, sentence string, label int, split string")
        config = RunConfig(encoder="sizes", batch_size=7, max_tokens=4)
        assert pipeline.represent(records, config)[0].select(F.size("tokens")).distinct().collect()[0][0] == 4
    finally:
        del encode.ENCODERS["sizes"]
    names = {RunConfig(**x).experiment_name(9) for x in ({}, {"seed": 2}, {"shuffle": True}, {"pooling": "mean"}, {"max_tokens": 5}, {"batch_size": 3}, {"test_size": 0.3})}
    assert len(names) == 7


def test_grid_looks_for_neighbours_once(spark, sf, tmp_path, monkeypatch):
    v = inputs.vectors(spark, sf).where("uid % 3 = 0").cache()
    rows = v.select(F.col("uid").alias("line_no"), "label", "split", "uid")
    calls, asked = [], []
    true = pipeline.retrieve.nearest
    monkeypatch.setattr(pipeline.retrieve, "nearest", lambda q, t, k, *a: calls.append(k) or true(q, t, k, *a))
    configs = [RunConfig(core_set=k, only_cls=o) for k, o in ((1, False), (4, False), (0.01, True))] + [RunConfig(core_set=2, seed=5)]
    represented = lambda c: asked.append(c) or (v.select("uid", "cls", "tokens"), rows)
    report = pipeline.run_grid(spark, represented, configs, str(tmp_path)).collect()
    assert len(report) == 12 and calls == [4, 2] and len(asked) == 2
    alone = pipeline.detect(v.select("uid", "cls", "tokens"), rows, configs[0]).collect()
    same = [r for r in report if r.experiment == alone[0].experiment]
    assert [(r.exp_name, r.f1_score) for r in sorted(same, key=lambda r: r.exp_name)] == [(r.exp_name, r.f1_score) for r in sorted(alone, key=lambda r: r.exp_name)]
    again = pipeline.run_grid(spark, represented, configs, str(tmp_path))
    assert again.count() == 12 and calls == [4, 2, 1]  # the one is of detect alone


def test_stages_from_the_command_line(spark, tmp_path):
    lines, labels = block_log()
    (tmp_path / "log").write_text("\n".join([*lines, "", "blk_999 nobody labels"]) + "\n")
    (tmp_path / "labels.csv").write_text("BlockId,Label\n" + "".join(f"{b},{x}\n" for _, b, x in labels))
    common = ["--root", str(tmp_path / "out"), "--dataset", "hdfs", "--max_tokens", "32", "--core_set", "1"]
    main(["split", *common, "--input", str(tmp_path / "log"), "--labels", str(tmp_path / "labels.csv")], spark)
    main(["represent", *common], spark)
    main(["detect", *common], spark)
    results = tmp_path / "out/processed_data/hdfs/0.2/hash/results"
    rows = spark.read.csv(f"{results}/*/csv", header=True).collect()
    nested = logs.read_report(spark, f"{results}/*").where("metric = 'f1_score'").collect()
    assert len(rows) == 3 and {r.exp_name for r in nested} == {r.exp_name for r in rows} and all(float(r.representation_time) > 0 for r in rows)
    assert {r.exp_name: r.value for r in nested}["K=1(session)"] == 1.0 and len({r.experiment for r in nested}) == 1
    assert "f1_score           1.0000" in "\n".join(r.value for r in spark.read.text(f"{results}/*/text").collect())
    scores = spark.read.parquet(f"{results}/*/scores")
    assert scores.groupBy("key").count().count() == 3 and scores.where("key = 'K=1|'").count() == scores.where("key <> 'K=1|'").count() / 2
    sizes = spark.read.json(f"{tmp_path}/out/stages/*/data_size").first()
    assert (sizes.train_normal, sizes.test_normal, sizes.test_abnormal) == (25, 7, 8)
    assert spark.read.json(f"{tmp_path}/out/stages/*/quarantine_split").count() == 1
    main(["grid", *common, "--grids", "rq1"], spark)  # over the split and the representation that are there
    assert len(logs.read_report(spark, f"{results}/grid_rq1").where("metric = 'f1_score'").collect()) == 6
    with pytest.raises(SystemExit, match="1 lines"):
        main(["split", "--root", str(tmp_path / "strict"), *common[2:], "--strict", "yes", "--input", str(tmp_path / "log"), "--labels", str(tmp_path / "labels.csv")], spark)


def test_encoders(spark):
    a, b = encode.HashEncoder(8, 4), encode.HashEncoder(8, 4)
    x, y = a.encode(["one two"])[0], b.encode(["one two"])[0]
    assert x.shape == (4, 8) and (x == y).all() and a.encode([""])[0].shape == (4, 8)
    m = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "t array<array<double>>")
    assert m.select(vectors.pooled(F.col("t"), "mean"), vectors.pooled(F.col("t"), "cls")).first()[:] == ([[2.0, 3.0]], [[1.0, 2.0]])


def test_words_after_the_eighth_count(spark):
    same = " ".join(f"w{i}" for i in range(20))
    rows = [(i, None, None, f"{same} {last}", 0, "train") for i, last in enumerate(("left", "right"))]
    records = spark.createDataFrame(rows, "line_no long, ts timestamp, session_id string, sentence string, label int, split string")
    for config, tokens in ((RunConfig(), 128), (RunConfig(dataset="hdfs"), 512), (RunConfig(max_tokens=30), 30)):
        a, b = pipeline.represent(records, config)[0].collect()
        assert len(a.tokens) == len(b.tokens) == tokens and a.cls != b.cls and a.tokens[21] != b.tokens[21]
    a, b = encode.HashEncoder().encode([r[3] for r in rows])
    assert a.shape[0] == 128 and (a[0] != b[0]).any()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("- 1 2005.06.03 a seen before\n- 1 2005.06.03 a never seen\n")
    train = spark.createDataFrame([("seen before", 0.1)], "sentence string, score double")
    stream = spark.readStream.text(str(tmp_path / "in"))
    q = known_sentences(stream, train, "bgl", 0.5).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.sentence, r.pred) for r in spark.table("scored").collect()) == [("never seen", 1), ("seen before", 0)]
