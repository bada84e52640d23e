"""The three stages from the command line, and the published grids: python -m tracelode split | represent | detect | grid."""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig, published_grids, to_bool, to_number
from .functions import text
from .operators import split
from .plans import pipeline
from .sources import logs
from .storage import ship, stored, temporaries


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracelode", description=__doc__)
    parser.add_argument("stage", choices=["split", "represent", "detect", "grid"])
    parser.add_argument("--root", required=True, help="folder of all artefacts")
    parser.add_argument("--input", help="the log (split)")
    parser.add_argument("--labels", help="CSV of BlockId, Label (split, block logs)")
    parser.add_argument("--dataset", default="tbird")
    parser.add_argument("--shuffle", type=to_bool, default=True)
    parser.add_argument("--sample", type=to_number, default=1)
    parser.add_argument("--test_size", type=float, default=0.2)
    parser.add_argument("--seed", type=int, default=1234)
    parser.add_argument("--encoder", default="hash")
    parser.add_argument("--max_tokens", type=int)
    parser.add_argument("--batch_size", type=int, default=8192)
    parser.add_argument("--pooling", default="all", choices=["all", "cls", "mean"])
    parser.add_argument("--train_ratio", type=float, default=1.0)
    parser.add_argument("--core_set", type=to_number, default=0)
    parser.add_argument("--only_cls", type=to_bool, default=False)
    parser.add_argument("--only_in_test", type=to_bool, default=False)
    parser.add_argument("--threshold", default="prc", choices=["prc", "roc"])
    parser.add_argument("--metric", default="cos", choices=["cos", "dot"])
    parser.add_argument("--validation", type=float, default=0.0, help="share of the test lines that the threshold is chosen on")
    parser.add_argument("--strict", type=to_bool, default=False, help="stop where lines have no time, block, word or label, instead of setting them apart")
    parser.add_argument("--grids", default="", help="names of published grids with commas between (grid); all of them by default")
    return parser.parse_args(args)


def set_apart(bad: DataFrame, path: str, strict: bool) -> None:
    """Writes what no time, block, word or label was found in; an error in strict mode if there is any."""
    if strict and (n := bad.count()):
        raise SystemExit(f"{n} lines cannot be used; without --strict they are set apart in {path}")
    logs.write_quarantine(bad, path)


def split_stage(spark: SparkSession, config: RunConfig, folder: str, path: str, labels: str | None, strict: bool = False) -> None:
    """The lines of train and test, their numbers, and what was set apart. A split that is there is kept.

    Labelled lines, or the documents of sessions, are written once and read for all of these; a later run of the stage finds them.
    """
    if logs.exists(spark, f"{folder}/data_size/_SUCCESS"):
        return

    def lines() -> DataFrame:
        known, blank = pipeline.labelled(logs.read_lines(spark, path), config, logs.read_block_labels(spark, labels) if labels else None)
        return known.withColumn("apart", F.lit(False)).unionByName(blank.withColumn("apart", F.lit(True)))

    with temporaries(spark):
        both = logs.load_or_make(spark, f"{folder}/labelled", lines)
        set_apart(both.where("apart").drop("apart"), f"{folder}/quarantine_split", strict)
        parts = split.train_test(pipeline.sampled(both.where("not apart").drop("apart"), config), "line_no", config.test_size, config.seed, config.shuffle)
        logs.write_split(parts, folder)
        logs.write_sizes(parts, f"{folder}/data_size")


def split_lines(spark: SparkSession, config: RunConfig, folder: str) -> DataFrame:
    """The written split as lines with labels: training lines are normal, test lines say what they are by their first word."""
    train = logs.read_split(spark, folder, "train").withColumn("label", F.lit(0)).withColumn("split", F.lit("train"))
    label = text.inline_label(text.mask(F.col("value"), config.dataset))
    test = logs.read_split(spark, folder, "test").withColumn("label", label).withColumn("split", F.lit("test"))
    return train.unionByName(test)


def represent_stage(spark: SparkSession, config: RunConfig, folder: str, encoded: str, strict: bool = False) -> None:
    """The representation of a split, beside those of other encoders, and the seconds it took. Lines are parsed once."""
    if logs.exists(spark, f"{encoded}/lookup/_SUCCESS"):
        return
    began = time.time()
    with temporaries(spark):
        parsed = stored(pipeline.parsed(split_lines(spark, config, folder), config), "parsed")
        records, bad = pipeline.apart(parsed)
        set_apart(bad, f"{encoded}/quarantine", strict)
        representation, rows = pipeline.represent(records, config)
        representation.write.mode("overwrite").parquet(f"{encoded}/representation")
        spark.createDataFrame([(time.time() - began,)], "representation_time double").write.mode("overwrite").json(f"{encoded}/time")
        rows.write.mode("overwrite").parquet(f"{encoded}/lookup")


def read_represented(spark: SparkSession, encoded: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{encoded}/representation"), spark.read.parquet(f"{encoded}/lookup")


def detect_stage(spark: SparkSession, config: RunConfig, folder: str, results: str) -> DataFrame:
    """The report of a run as CSV, JSON and text, and the scores it comes from."""
    with temporaries(spark):
        report, scores = pipeline.detect_all([config], pipeline.sides(*read_represented(spark, folder), config))
        taken = spark.read.json(f"{folder}/time").first()["representation_time"] if logs.exists(spark, f"{folder}/time/_SUCCESS") else None
        report = report.withColumn("representation_time", F.lit(taken).cast("double"))
        path = f"{results}/{report.first()['experiment']}"
        logs.write_report(report, path)
        logs.write_scores(scores, f"{path}/scores")
    return report


def folders(config: RunConfig, root: str) -> tuple[str, str]:
    """Where the split and the representation of a run lie."""
    folder = f"{root}/stages/{config.dataset}_{config.digest('dataset', 'shuffle', 'sample', 'test_size', 'seed')}"
    name = config.encoder.rpartition("/")[2]
    return folder, f"{folder}/{name}_{config.digest(*pipeline.REPRESENTED)}"


def grid_stage(spark: SparkSession, config: RunConfig, root: str, names: list[str], path: str | None, labels: str | None, strict: bool) -> DataFrame:
    """The runs of published grids over one dataset; what they vary is taken from them, all else from config. Splits and representations that are there are used."""
    known = published_grids()
    kind = text.kind_of(config.dataset)
    chosen = {replace(config, encoder=config.encoder if c.encoder == "hash" else c.encoder, train_ratio=c.train_ratio, core_set=c.core_set, only_cls=c.only_cls): None for n in names or known for c in known[n] if text.kind_of(c.dataset) == kind}

    def represented(c: RunConfig) -> tuple[DataFrame, DataFrame]:
        folder, encoded = folders(c, root)
        if path:
            split_stage(spark, c, folder, path, labels, strict)
        represent_stage(spark, c, folder, encoded, strict)
        return read_represented(spark, encoded)

    report = pipeline.run_grid(spark, represented, list(chosen), root)
    logs.write_report(report, f"{config.layout(root)}/grid_{'_'.join(names) or 'all'}")
    return report


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(args)
    own = ("stage", "root", "input", "labels", "strict", "grids")
    config = RunConfig(**{k: v for k, v in vars(a).items() if k not in own})
    spark = spark or SparkSession.builder.appName("tracelode").getOrCreate()
    ship(spark)
    folder, encoded = folders(config, a.root)
    if a.stage == "split":
        if not a.input:
            raise SystemExit("split needs --input")
        split_stage(spark, config, folder, a.input, a.labels, a.strict)
    elif a.stage == "represent":
        represent_stage(spark, config, folder, encoded, a.strict)
    elif a.stage == "detect":
        detect_stage(spark, config, encoded, config.layout(a.root)).show(truncate=False)
    else:
        grid_stage(spark, config, a.root, [n for n in a.grids.split(",") if n], a.input, a.labels, a.strict).show(truncate=False)


if __name__ == "__main__":
    main()
