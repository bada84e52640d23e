from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelode.operators import sessions
from tracelode.sources import logs
from tracelode.storage import exists, load, save, stored, temporaries


def test_an_artefact_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "a")
    assert load(spark, path) is None
    save(spark.range(5), path, "seed 1")
    assert load(spark, path, "seed 1").count() == 5
    with pytest.raises(ValueError, match="other settings"):
        load(spark, path, "seed 2")
    (tmp_path / "a" / "data-lost").mkdir()  # of a writer that was lost
    save(spark.range(7).withColumn("x", F.lit("é")), path, "seed 1")
    assert load(spark, path, "seed 1").columns == ["id", "x"] and load(spark, path, "seed 1").count() == 7
    assert len([x for x in Path(path).iterdir() if x.name.startswith("data-")]) == 1
    part = next(x for x in Path(path).glob("data-*/part-*.parquet"))
    part.unlink()
    with pytest.raises(ValueError, match="rows"):
        load(spark, path, "seed 1")


def test_artefacts_are_made_once(spark, tmp_path):
    calls = []
    for _ in range(2):
        assert logs.load_or_make(spark, str(tmp_path / "b"), lambda: calls.append(1) or spark.range(3), "x").count() == 3
    assert calls == [1]

    def broken():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        logs.load_or_make(spark, str(tmp_path / "c"), broken)
    assert load(spark, str(tmp_path / "c")) is None


def test_temporaries_go_and_kept_tables_stay(spark):
    with temporaries(spark):
        outer = stored(spark.range(2), "outer")
        with temporaries(spark):
            inner, kept = stored(spark.range(3), "inner"), stored(spark.range(4), "kept", keep=True)
            paths = [x.inputFiles()[0].rpartition("/")[0] for x in (outer, inner, kept)]
        assert [exists(spark, p) for p in paths] == [True, False, True]
    assert [exists(spark, p) for p in paths] == [False, False, True] and kept.count() == 4


def test_documents_of_long_sessions(spark):
    """As sessions() has them, also where a block has very many lines, and a line several blocks or an odd one."""
    lines = [(i, f"a b c INFO part {i % 5} of blk_77 to 10.0.0.1") for i in range(3000)]
    lines += [(4000, "a b c WARN blk_12 and blk_-77 blk_12"), (3999, "a b c one blk_5"), (4001, "nothing"), (4002, None), (4003, "blk_77"), (4004, "a b c one blk_5")]
    log = spark.createDataFrame(lines, "line_no long, value string").repartition(3)
    labels = spark.createDataFrame([("blk_12", 1), ("blk_77", 0)], "block_id string, label int")
    whole = {r.block_id: (r.events, r.doc, r.label) for r in sessions.sessions(log, labels).collect()}
    mine = sessions.documents(log, labels).collect()
    assert {r.block_id: (r.events, r.doc, r.label) for r in mine} == whole
    assert {r.block_id: r.first_line for r in mine} == {"blk_77": 0, "blk_12": 4000, "blk_-77": 4000, "blk_5": 3999}
    plan = sessions.documents(log, labels)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
