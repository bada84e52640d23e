import pytest
from pyspark.sql import functions as F

from tracelode.operators import split
from tracelode.sources import logs


@pytest.fixture
def split_sizes(spark):
    """Sets how large splits are, for a while."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, size)

    yield use
    for n, v in old.items():
        spark.conf.set(n, v)


def log_of_files(folder):
    """Three files, the last one the largest, with all kinds of line ends; and their lines in order."""
    folder.mkdir()
    parts = [["- one"], [], [f"- line {i} é" if i % 7 else "" for i in range(900)], ["KERN a", "- b"]]
    for i, (lines, end) in enumerate(zip(parts, ("\n", "\n", "\r\n", "\n"), strict=True)):
        (folder / f"part-{i}.log").write_text("".join(x + end for x in lines), newline="")
    return [x for p in parts for x in p]


def test_lines_keep_their_order_and_numbers(spark, tmp_path, split_sizes):
    wanted = log_of_files(tmp_path / "log")
    drawn = []
    for size in ("64m", "700", "97"):
        split_sizes(size)
        lines = logs.read_lines(spark, str(tmp_path / "log"))
        assert [(r.line_no, r.value) for r in lines.sort("line_no").collect()] == list(enumerate(wanted))
        routed = lines.withColumn("label", F.lit(0))
        drawn.append(sorted(r.line_no for r in split.train_test(routed, "line_no", 0.3, 5).where("split = 'test'").collect()))
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == -(-3 * len(wanted) // 10)


def test_a_written_split_is_read_in_order(spark, tmp_path, split_sizes):
    lines = spark.createDataFrame([(i, f"- {i}", "train") for i in range(500)], "line_no long, value string, split string").repartition(4)
    logs.write_split(lines, str(tmp_path / "s"))
    split_sizes("300")
    assert [r.value for r in logs.read_split(spark, str(tmp_path / "s"), "train").sort("line_no").collect()] == [f"- {i}" for i in range(500)]
    assert logs.read_split(spark, str(tmp_path / "s"), "test").count() == 0


def test_the_last_label_of_several_files(spark, tmp_path, split_sizes):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.csv").write_text("BlockId,Label\n" + "blk_1,Anomaly\n" * 200 + "blk_2,Normal\n")
    (tmp_path / "l" / "b.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\n")
    for size in ("64m", "200"):
        split_sizes(size)
        assert {r.block_id: r.label for r in logs.read_block_labels(spark, str(tmp_path / "l")).collect()} == {"blk_1": 0, "blk_2": 1}
