"""Logs, sessions and vectors rendered from the test tables; each as a DataFrame here and as SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import pass_through
from ..operators.split import train_test
from ..storage import spread

SLICES = 4
SEED = 1234


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """line_no, value, label: events as log lines; errors are the abnormal ones. The last word holds a digit and a letter."""
    e = spread(table(spark, sf_dir, "events"), 4)  # small rows, so that no task runs much longer than the rest
    bad, user, no = F.col("event_type") == "error", F.col("user_id").cast("string"), F.col("event_id").cast("string")
    epoch = (F.lit(1117838570) + F.col("event_id")).cast("string")
    if kind == "bgl":
        when = F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS")
        parts = [F.when(bad, "KERNDTLB").otherwise("-"), " ", epoch, " ", F.date_format("ts", "yyyy.MM.dd"), " R02-M1-U", user, " ", when, " R02-M1-U", user, " RAS KERNEL ", "event_type", " parity error at 0x00", no, "ab from 10.1.2.", user, ":40 /bgl/apps/", "event_type", " core.", no, " z9"]
    elif kind == "tbird":
        parts = [F.when(bad, "R_HDA_NR").otherwise("-"), " ", epoch, " ", F.date_format("ts", "yyyy.MM.dd"), " dn", user, " ", F.date_format("ts", "MMM d HH:mm:ss"), " dn", user, "/dn", user, " crond(pam_unix)[", no, "]: ", "event_type", " session closed for user root from 10.1.2.", user, " in /var/log/m", user, " by bob@host-", user, " z9"]
    else:
        parts = ["081109 203518 ", user, " INFO dfs.DataNode: ", "event_type", " block blk_-", epoch, " src: /10.250.19.", user, ":54106 size ", no, " z9"]
    value = F.concat(*[p if not isinstance(p, str) else F.col(p) if p == "event_type" else F.lit(p) for p in parts])
    return e.select(F.col("event_id").alias("line_no"), value.alias("value"), bad.cast("int").alias("label"))


_BGL = "(CASE WHEN event_type = 'error' THEN 'KERNDTLB' ELSE '-' END) || ' ' || (1117838570 + event_id)::VARCHAR || ' ' || strftime(ts, '%Y.%m.%d') || ' R02-M1-U' || user_id || ' ' || strftime(ts, '%Y-%m-%d-%H.%M.%S.%f') || ' R02-M1-U' || user_id || ' RAS KERNEL ' || event_type || ' parity error at 0x00' || event_id || 'ab from 10.1.2.' || user_id || ':40 /bgl/apps/' || event_type || ' core.' || event_id || ' z9'"
_TBIRD = "(CASE WHEN event_type = 'error' THEN 'R_HDA_NR' ELSE '-' END) || ' ' || (1117838570 + event_id)::VARCHAR || ' ' || strftime(ts, '%Y.%m.%d') || ' dn' || user_id || ' ' || strftime(ts, '%b %-d %H:%M:%S') || ' dn' || user_id || '/dn' || user_id || ' crond(pam_unix)[' || event_id || ']: ' || event_type || ' session closed for user root from 10.1.2.' || user_id || ' in /var/log/m' || user_id || ' by bob@host-' || user_id || ' z9'"
_HDFS = "'081109 203518 ' || user_id || ' INFO dfs.DataNode: ' || event_type || ' block blk_-' || (1117838570 + event_id)::VARCHAR || ' src: /10.250.19.' || user_id || ':54106 size ' || event_id || ' z9'"
LINES_SQL = {k: f"lines AS (SELECT event_id AS line_no, {v} AS value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)" for k, v in (("bgl", _BGL), ("tbird", _TBIRD), ("hdfs", _HDFS))}


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, value, label: every line of the documents as the message of a log line; those of toxic documents are the abnormal ones."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    toxic = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "message")).join(toxic, F.col("doc_id") == F.col("_id"), "left")
    label = F.coalesce(F.col("toxic"), F.lit(0)).cast("int")
    value = F.concat(F.when(label == 1, "APPTOX").otherwise("-"), F.lit(" 1117838570 2005.06.03 R02-M1-N0 2005-06-03-15.42.50.675872 R02-M1-N0 RAS APP INFO "), "message")
    return lines.select((F.col("doc_id") * 100_000 + F.col("line")).alias("line_no"), value.alias("value"), label.alias("label"))


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, value: a line for each turn; every third names a second block, and the first one twice."""
    c = table(spark, sf_dir, "conversations")
    own, other = F.concat(F.lit("blk_"), (F.col("conv_id") + 1000).cast("string")), F.concat(F.lit("blk_-"), (F.col("conv_id") % 7 + 20).cast("string"))
    tail = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" mirrors "), other, F.lit(" and "), own)).otherwise("")
    value = F.concat(F.lit("081109 203518 143 INFO dfs.DataNode: "), "role", F.lit(" block "), own, F.lit(" src /10.250.19."), F.col("turn").cast("string"), F.lit(":50010 size "), F.length("text").cast("string"), tail)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), value.alias("value"))


BLOCKS_SQL = """blines AS (SELECT conv_id * 1000 + turn AS line_no, '081109 203518 143 INFO dfs.DataNode: ' || role || ' block blk_' || (conv_id + 1000) || ' src /10.250.19.' || turn || ':50010 size ' || length(text)
  || (CASE WHEN turn % 3 = 0 THEN ' mirrors blk_-' || (conv_id % 7 + 20) || ' and blk_' || (conv_id + 1000) ELSE '' END) AS value FROM conversations),
bx AS (SELECT line_no, value, unnest(list_distinct(regexp_extract_all(value, '(blk_-?[0-9]+)'))) AS block_id FROM blines),
bs AS (SELECT block_id, list(value ORDER BY line_no) AS raw FROM bx GROUP BY block_id),
bl AS (SELECT 'blk_' || (doc_id + 1000) AS block_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS label FROM labels GROUP BY 1)"""


def block_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, BlockId, Label as a label file has them; not every block is there."""
    m = table(spark, sf_dir, "labels")
    return m.select(F.col("doc_id").alias("line_no"), F.concat(F.lit("blk_"), (F.col("doc_id") + 1000).cast("string")).alias("BlockId"), F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal").alias("Label"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, value: documents line by line."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))


TEXT_SQL = "tl AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, cls, tokens (four slices), label (class 9 is abnormal), split."""
    v = pass_through(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SLICES)
    v = v.select("uid", "cls", "tokens", (F.col("label") == 9).cast("int").alias("label"))
    return train_test(v, "uid", 0.2, SEED)


VECTORS_SQL = f"""v AS (SELECT vec_id AS uid, list_transform(embedding, lambda x: x::DOUBLE) AS e, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(uid::VARCHAR || '{SEED}'), uid) AS rk, count(*) OVER (PARTITION BY label) AS n FROM v),
parts AS (SELECT uid, e, [e[1:16], e[17:32], e[33:48], e[49:64]] AS tok, label, rk, n, CASE WHEN label = 0 AND rk <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ranked),
tr AS (SELECT * FROM parts WHERE split = 'train'), te AS (SELECT * FROM parts WHERE split = 'test')"""


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, label of log rows: every third sentence stands in two rows."""
    te = vectors(spark, sf_dir).where("split = 'test'").select("uid", "label")
    return te.unionByName(te.where("uid % 3 = 0"))


ROWS_SQL = "lr AS (SELECT uid, label FROM te UNION ALL SELECT uid, label FROM te WHERE uid % 3 = 0)"
