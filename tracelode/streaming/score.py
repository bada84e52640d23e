"""Scoring of a stream of lines against a fixed training set with a frozen threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def known_sentences(stream: DataFrame, train: DataFrame, dataset: str, limit: float) -> DataFrame:
    """line columns, sentence, score, pred: a sentence's score comes from a table (sentence, score); one it lacks counts as abnormal.

    A stream-static join: no state is kept, so lines are never late. The table is read anew by each micro-batch.
    """
    parsed = stream.withColumn("sentence", text.sentence(F.col("value"), dataset, False))
    scored = parsed.join(train.select("sentence", "score"), "sentence", "left")
    return scored.withColumn("pred", F.when(F.col("score").isNull(), 1).otherwise((F.col("score") >= F.lit(limit)).cast("int")))
