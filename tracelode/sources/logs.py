"""Reading logs, labels and artefacts, and writing results."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_word, without_invalid_utf8
from ..storage import exists, load, save, stored  # noqa: F401  the stages take exists from here

LABELS = "BlockId string, Label string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), value of the lines of a text file, or of all files of a folder by name: bytes that are no UTF-8 go, any line end ends a line.

    Lines are written once with the split they come from and their place in it. Counts by split, in the order of files and places in them, give each split the
    number it starts from, so the numbers are the same for any size of splits, any cluster and any order in which Spark reads.
    """
    text = spark.read.text(path)
    at = F.monotonically_increasing_id()  # ascends within a split
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at.alias("place"))
    lines = stored(lines.select(without_invalid_utf8(F.col("value")).alias("value"), "file", "start", F.xxhash64("file", "start").alias("split"), "place"), "lines")
    splits = lines.groupBy("split").agg(F.min("file").alias("file"), F.min("start").alias("start"), F.max("start").alias("last"), F.max("file").alias("other"), F.min("place").alias("first"), F.count("*").alias("n"))
    # two splits with one hash would have one number: never silently
    sure = F.when((F.col("start") == F.col("last")) & (F.col("file") == F.col("other")), F.col("n")).otherwise(F.raise_error(F.lit("two splits have one hash")).cast("long"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("split", (F.coalesce(F.sum(sure).over(before), F.lit(0)) - F.col("first")).alias("_from"))
    # a row of two numbers for each split of the input: some 800,000 for 100 TB
    return lines.join(F.broadcast(starts), "split").select((F.col("_from") + F.col("place")).alias("line_no"), "value")


def route_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of a line-labelled log with label (0 where the first word is a dash, else 1), and the blank lines, set apart."""
    word = F.coalesce(first_word(F.col("value")), F.lit(""))
    return lines.where(word != "").withColumn("label", (word != "-").cast("int")), lines.where(word == "")


def read_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """block_id, label of a CSV of BlockId, Label, or of several by name; of repeated blocks the last line counts."""
    rows = spark.read.csv(path, header=True, schema=LABELS)
    # block labels need an order alone: the file, the split's place in it, and the row's place in the split
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return block_labels(rows.select("BlockId", "Label", place.alias("line_no")))


def block_labels(rows: DataFrame) -> DataFrame:
    label = (F.coalesce("Label", F.lit("")) == "Anomaly").cast("int")
    return rows.groupBy(F.col("BlockId").alias("block_id")).agg(F.max_by(label, F.col("line_no")).alias("label"))


def load_or_make(spark: SparkSession, path: str, make, settings: str = "") -> DataFrame:
    """The artefact at a path, made and saved first where it is missing. A half-written one has no manifest and is made anew."""
    found = load(spark, path, settings)
    if found is None:
        save(make(), path, settings)
        found = load(spark, path, settings)
    return found


def write_split(df: DataFrame, root: str) -> None:
    """The lines of train and test as text files beside each other, in the order of line_no."""
    for name in ("train", "test"):
        df.where(F.col("split") == name).sort("line_no").select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value")).write.mode("overwrite").text(str(PurePosixPath(root) / name))


def read_split(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_lines(spark, f"{root}/{name}")


def split_sizes(df: DataFrame) -> DataFrame:
    """train_normal, test_normal, test_abnormal."""
    of = lambda s, x: F.count_if((F.col("split") == s) & (F.col("label") == x)).cast("long")
    return df.agg(of("train", 0).alias("train_normal"), of("test", 0).alias("test_normal"), of("test", 1).alias("test_abnormal"))


def write_quarantine(bad: DataFrame, path: str) -> None:
    """What no time, block or word was found in, as JSON lines."""
    bad.write.mode("overwrite").json(path)


def write_sizes(df: DataFrame, path: str) -> None:
    split_sizes(df).coalesce(1).write.mode("overwrite").json(path)


def _text_report() -> Column:
    """A row of a report as lines of text."""
    numbers = [F.format_string(f"  {c:<18} %.4f", F.col(c)) for c in METRICS]
    return F.concat_ws("\n", "exp_name", *numbers)


METRICS = ["f1_score", "roc_auc_score", "precision_score", "recall_score", "accuracy_score"]


def write_report(report: DataFrame, path: str) -> None:
    """The three rows of a run as CSV; as JSON, nested as {experiment: {metric: {row: value}}}; and as text."""
    report.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    rows = F.map_from_entries(F.collect_list(F.struct(F.col("exp_name"), F.col("value"))))
    long = report.select("experiment", "exp_name", F.explode(F.create_map(*[x for c in METRICS for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    by_metric = long.groupBy("experiment", "metric").agg(rows.alias("rows"))
    nested = by_metric.groupBy("experiment").agg(F.map_from_entries(F.collect_list(F.struct("metric", "rows"))).alias("metrics"))
    nested.select(F.to_json(F.create_map("experiment", "metrics"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/json")
    report.select(_text_report().alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/text")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """experiment, metric, exp_name, value of a written JSON report."""
    whole = spark.read.text(f"{path}/json").select(F.from_json("value", "map<string,map<string,map<string,double>>>").alias("m"))
    return whole.select(F.explode("m").alias("experiment", "x")).select("experiment", F.explode("x").alias("metric", "y")).select("experiment", "metric", F.explode("y").alias("exp_name", "value"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores (key, uid, score) that a run's report comes from, a folder for each key."""
    scores.write.partitionBy("key").mode("overwrite").parquet(path)
