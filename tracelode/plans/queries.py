"""A query for each operator, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, core_set_size, published_grids
from ..functions import text
from ..functions.vectors import pooled
from ..operators import dedup, encode, metrics, retrieve, score, sessions, split, threshold
from ..sources import logs
from ..storage import new_path, stored
from . import inputs, pipeline
from .inputs import BLOCKS_SQL, LINES_SQL, ROWS_SQL, SEED, TEXT_SQL, VECTORS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- text

_NORMAL = "trim(regexp_replace(strip_accents(lower({0})), '[^a-zA-Z<>]+', ' ', 'g'))"
#: The masks in the order in which they apply, written out (fixed values). RE2 has no lookahead: for lines that end in a word with a digit and a letter, as all here do,
#: rules without it say the same; tests/test_text.py compares the others with the plain rules.
_RE2 = {
    "bgl": [
        (r"\d{1,4}-\d{1,2}-\d{1,2}-\d{1,2}.\d{1,2}.\d{1,2}.\d{1,6}", " TIME "),
        (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?", " IP "),
        (r"\d{1,4}\.\d{1,2}\.\d{1,2}", " TIME "),
        (r".\S+/[0-9a-zA-Z]\S*", " PATH "),
        (r"\S+:\S*", " SERVER "),
        (r"\S+-\S*", " SERVER "),
        ("[A-Z0-9]{28}", " ECID "),
        ("[a-zA-Z0-9]{48}", " SERIAL "),
        (r"0[xX][0-9a-fA-F]\S+", " MEMORY "),
        ("[0-9a-fA-F]{8}", " IAR "),
        (r"\d+", " NUM "),
    ],
    "tbird": [
        (r"\d{2,4}\.\d{1,2}\.\d{1,2}\s", "DATE "),
        (r"(January|Jan|February|Feb|March|Mar|April|Apr|May|June|Jun|July|Jul|August|Aug|September|Sep|October|Oct|November|Nov|December|Dec)\s+\d{1,2}\s+", "DATE "),
        (r"DATE\s.*\sDATE", "DATE ID DATE"),
        (r"\d{1,2}:\d{1,2}:\d{1,2}", "TIME"),
        (r"TIME\s\S+", "TIME ACCOUNT"),
        (r"\w+[\w.]*@\w+[\w.]*-\w+[\w.]*", "ACCOUNT"),
        (r"\w+[\w.]*@\w+[\w.]*", "ACCOUNT"),
        ("[a-zA-Z0-9_./-]+/[a-zA-Z0-9_./-]+/[a-zA-Z0-9_./-]*", " DIR "),
        ("/[a-zA-Z0-9_./-]+/[a-zA-Z0-9_./-]*", " DIR "),
        (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?", "IP"),
        ("[0-9a-fA-F]{10}", "IAR"),
        (r"\[\d+\]", " NUM "),
    ],
    "hdfs": [(r"blk_.\d+", "BLK"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?", "IP"), (r"\d*\d", "NUM")],
}


def _mask_sql(kind: str, column: str) -> str:
    for pattern, name in _RE2[kind]:
        column = f"regexp_replace({column}, '{pattern}', '{name}', 'g')"
    return column


def _masked(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = inputs.log_lines(spark, sf_dir, kind)
        masked = lines.select("line_no", text.mask(F.col("value"), kind).alias("masked"))  # Catalyst keeps what is costly and used twice apart
        return masked.select("line_no", "masked", text.normalize(F.col("masked")).alias("normal"))

    run.__name__ = f"mask_{kind}"
    return run


for _kind in ("bgl", "tbird", "hdfs"):
    query(f"WITH {LINES_SQL[_kind]}, m AS (SELECT line_no, {_mask_sql(_kind, 'value')} AS masked FROM lines) SELECT line_no, masked, {_NORMAL.format('masked')} AS normal FROM m")(_masked(_kind))


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS normal FROM documents")
def text_normalize(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query(f"WITH {LINES_SQL['bgl']} SELECT line_no, strftime(strptime(regexp_extract(value, '[0-9]+-[0-9]+-[0-9]+-[0-9.]+'), '%Y-%m-%d-%H.%M.%S.%f'), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM lines")
def parse_bgl_timestamp(spark, sf_dir):
    ts = text.bgl_timestamp(F.col("value"))
    return inputs.log_lines(spark, sf_dir, "bgl").select("line_no", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query(f"WITH {LINES_SQL['tbird']} SELECT line_no, strftime(strptime(regexp_extract(value, '[0-9]{{4}}\\.[0-9]+\\.[0-9]+') || ' ' || regexp_extract(value, '[0-9]+:[0-9]+:[0-9]+'), '%Y.%m.%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts FROM lines")
def parse_tbird_timestamp(spark, sf_dir):
    ts = text.tbird_timestamp(F.col("value"))
    return inputs.log_lines(spark, sf_dir, "tbird").select("line_no", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"WITH {LINES_SQL['hdfs']} SELECT line_no, regexp_extract(value, 'blk_.[0-9]+') AS block_id FROM lines")
def parse_hdfs_block(spark, sf_dir):
    return inputs.log_lines(spark, sf_dir, "hdfs").select("line_no", text.first_block(F.col("value")).alias("block_id"))


@query(f"WITH {TEXT_SQL} SELECT doc_id, CAST(line AS BIGINT) AS line, array_to_string(string_split({_NORMAL.format('value')}, ' ')[4:], ' ') AS rest FROM tl")
def field_drop(spark, sf_dir):
    lines = inputs.text_lines(spark, sf_dir)
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), text.drop_fields(text.normalize(F.col("value")), 3).alias("rest"))


@query(f"WITH {LINES_SQL['bgl']} SELECT line_no, CASE WHEN {_mask_sql('bgl', 'value')} LIKE '- %' THEN 0 ELSE 1 END AS test_label FROM lines")
def inline_label(spark, sf_dir):
    return inputs.log_lines(spark, sf_dir, "bgl").select("line_no", text.inline_label(text.mask(F.col("value"), "bgl")).alias("test_label"))


def _sentence_sql(kind: str) -> str:
    masked = _mask_sql(kind, "value")
    return f"""m AS (SELECT line_no, label, {masked} AS x FROM lines),
w AS (SELECT line_no, label, string_split({_NORMAL.format("CASE WHEN x LIKE '- %' THEN x ELSE regexp_replace(x, '^[^ ]+', '') END")}, ' ') AS p FROM m),
sentences AS (SELECT line_no, label, array_to_string(p[4:], ' ') AS sentence FROM w)"""


@query(f"WITH {LINES_SQL['bgl']}, {_sentence_sql('bgl')} SELECT line_no, sentence FROM sentences")
def test_sentences(spark, sf_dir):
    return inputs.log_lines(spark, sf_dir, "bgl").select("line_no", text.sentence(F.col("value"), "bgl", True).alias("sentence"))


@query(f"WITH {LINES_SQL['bgl']} SELECT CASE WHEN value LIKE '- %' THEN 0 ELSE 1 END AS label, count(*) AS n, min(line_no) AS first_line FROM lines GROUP BY 1")
def label_route(spark, sf_dir):
    routed, _ = logs.route_labels(inputs.log_lines(spark, sf_dir, "bgl").drop("label"))
    return routed.groupBy("label").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


# ---- sessions


@query(f"WITH {BLOCKS_SQL} SELECT block_id, line_no FROM bx")
def block_extract(spark, sf_dir):
    return sessions.explode_blocks(inputs.block_lines(spark, sf_dir)).select("block_id", "line_no")


@query(f"WITH {BLOCKS_SQL} SELECT block_id, CAST(len(raw) AS BIGINT) AS n_lines, md5(array_to_string(raw, chr(10))) AS raw_md5 FROM bs")
def session_group(spark, sf_dir):
    s = sessions.group_sessions(sessions.explode_blocks(inputs.block_lines(spark, sf_dir)))
    return s.select("block_id", F.size("raw").cast("long").alias("n_lines"), F.md5(F.array_join("raw", "\n").cast("binary")).alias("raw_md5"))


_EVENTS = f"""pl AS (SELECT block_id, raw, list_prepend(regexp_extract(raw[1], 'blk_.[0-9]+'), list_transform(raw, lambda x: {_NORMAL.format(_mask_sql('hdfs', "regexp_replace(x, '^([^ ]+ ){{0,3}}', '')").replace('{{', '{').replace('}}', '}'))})) AS parsed FROM bs),
ev AS (SELECT block_id, list_sort(list_distinct(parsed)) AS events FROM pl),
doc AS (SELECT e.block_id, e.events, l.label, CASE WHEN l.label = 0 THEN '- ' ELSE '' END || array_to_string(e.events, ' ') AS doc FROM ev e LEFT JOIN bl l USING (block_id))"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(inputs.block_lines(spark, sf_dir), logs.block_labels(inputs.block_label_rows(spark, sf_dir)))


@query(f"WITH {BLOCKS_SQL}, {_EVENTS} SELECT block_id, CAST(len(events) AS BIGINT) AS n_events, array_to_string(events, '|') AS events FROM ev")
def session_unique_events(spark, sf_dir):
    return _sessions(spark, sf_dir).select("block_id", F.size("events").cast("long").alias("n_events"), F.array_join("events", "|").alias("events"))


@query(f"WITH {BLOCKS_SQL}, {_EVENTS} SELECT block_id, doc FROM doc")
def session_concat_labeled(spark, sf_dir):
    return _sessions(spark, sf_dir).select("block_id", "doc")


@query(f"WITH {BLOCKS_SQL}, {_EVENTS} SELECT block_id, (SELECT min(line_no) FROM bx WHERE bx.block_id = doc.block_id) AS first_line, CAST(len(events) AS BIGINT) AS n_events, doc FROM doc")
def session_documents(spark, sf_dir):
    """The same documents without gathering the lines of a block."""
    found = sessions.documents(inputs.block_lines(spark, sf_dir), logs.block_labels(inputs.block_label_rows(spark, sf_dir)))
    return found.select("block_id", "first_line", F.size("events").cast("long").alias("n_events"), "doc")


@query(f"WITH {BLOCKS_SQL} SELECT s.block_id, CAST(l.label AS INTEGER) AS label FROM bs s LEFT JOIN bl l USING (block_id)")
def session_label_join(spark, sf_dir):
    grouped = sessions.group_sessions(sessions.explode_blocks(inputs.block_lines(spark, sf_dir)))
    return sessions.label_sessions(grouped, logs.block_labels(inputs.block_label_rows(spark, sf_dir))).select("block_id", "label")


@query("SELECT conv_id, '- ' || string_agg(replace(text, chr(10), ''), ' ' ORDER BY turn) AS doc FROM conversations GROUP BY conv_id")
def concat_dash_prefixed(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block_id"), F.col("turn").alias("line_no"), F.col("text").alias("value"))
    return sessions.group_sessions(c).select(F.col("block_id").alias("conv_id"), sessions.dash_prefixed(F.col("raw")).alias("doc"))


# ---- samples and splits


@query(f"WITH {VECTORS_SQL} SELECT uid, label, split FROM parts")
def split_normal(spark, sf_dir):
    return inputs.vectors(spark, sf_dir).select("uid", "label", "split")


@query("""WITH e AS (SELECT event_id, event_type = 'error' AS bad, count(*) FILTER (event_type <> 'error') OVER () AS n, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY event_id) AS rk FROM events)
SELECT event_id, CASE WHEN NOT bad AND rk <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM e""")
def split_in_order(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("label"))
    return split.train_test(e, "event_id", 0.2, SEED, shuffle=False).select("event_id", "split")


@query(f"WITH {VECTORS_SQL} SELECT count(*) FILTER (split = 'train' AND label = 0) AS train_normal, count(*) FILTER (split = 'test' AND label = 0) AS test_normal, count(*) FILTER (split = 'test' AND label = 1) AS test_abnormal FROM parts")
def split_sizes(spark, sf_dir):
    return logs.split_sizes(inputs.vectors(spark, sf_dir))


@query(f"WITH {VECTORS_SQL} SELECT uid, label FROM parts WHERE split = 'test'")
def test_union(spark, sf_dir):
    v = inputs.vectors(spark, sf_dir).where("split = 'test'").select("uid", "label")
    return v.where("label = 0").unionByName(v.where("label = 1"))


_RANKED_EVENTS = f"""e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(event_id::VARCHAR || '{SEED}'), event_id) AS rk, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total, sum(label) OVER () AS bad FROM e)"""


def _labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("label"))


@query(f"WITH {_RANKED_EVENTS} SELECT event_id, label FROM r WHERE rk <= floor(n * 0.1::DOUBLE)")
def sample_float(spark, sf_dir):
    return split.sample_ratio(_labelled_events(spark, sf_dir), "event_id", 0.1, SEED)


@query(f"WITH {_RANKED_EVENTS} SELECT event_id, label FROM r WHERE rk <= CASE WHEN label = 1 THEN floor(500 * (bad::DOUBLE / total)) ELSE floor(500 * (1 - bad::DOUBLE / total)) END")
def sample_int_stratified(spark, sf_dir):
    return split.sample_count(_labelled_events(spark, sf_dir), "event_id", 500, SEED)


# ---- unique sentences

_UNIQUE = f"{TEXT_SQL}, sn AS (SELECT doc_id, line, {_NORMAL.format('value')} AS sentence FROM tl), un AS (SELECT row_number() OVER (ORDER BY sentence) - 1 AS uid, sentence FROM (SELECT DISTINCT sentence FROM sn))"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.text_lines(spark, sf_dir).select("doc_id", "line", text.normalize(F.col("value")).alias("sentence"))


@query(f"WITH {_UNIQUE} SELECT uid, sentence, (SELECT count(*) FROM sn WHERE sn.sentence = un.sentence) AS n FROM un")
def unique_sentences(spark, sf_dir):
    return dedup.unique_sentences(_sentences(spark, sf_dir))


@query(f"WITH {_UNIQUE} SELECT doc_id, CAST(line AS BIGINT) AS line, uid FROM sn JOIN un USING (sentence)")
def unique_lookup(spark, sf_dir):
    rows = stored(_sentences(spark, sf_dir), "sentences")
    return dedup.lookup(rows, dedup.unique_sentences(rows)).select("doc_id", F.col("line").cast("long").alias("line"), "uid")


@query(f"""WITH {_UNIQUE}, lk AS (SELECT doc_id * 100000 + line AS row_id, uid FROM sn JOIN un USING (sentence)),
r AS (SELECT uid, row_number() OVER (ORDER BY md5(row_id::VARCHAR || '{SEED}'), row_id) AS rk, count(*) OVER () AS n FROM lk)
SELECT DISTINCT uid FROM r WHERE rk <= floor(n * 0.05::DOUBLE)""")
def train_ratio_uniques(spark, sf_dir):
    rows = stored(_sentences(spark, sf_dir), "sentences").withColumn("row_id", F.col("doc_id") * 100000 + F.col("line"))
    return split.ratio_uniques(dedup.lookup(rows, dedup.unique_sentences(rows)), "row_id", 0.05, SEED)


# ---- retrieval


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = inputs.vectors(spark, sf_dir)
    return v.where("split = 'train'"), v.where("split = 'test'")


_DISTANCE = "round(list_distance(q.e, t.e), 9)"
_NEAR = f"nn AS (SELECT q.uid AS q_uid, t.uid AS t_uid, {_DISTANCE} AS dist, row_number() OVER (PARTITION BY q.uid ORDER BY {_DISTANCE}, t.uid) AS rank FROM te q JOIN tr t ON true QUALIFY rank <= {K})"


#: The abnormal sentences of the test part are copied into the training part, so that some vectors are in both.
_BOTH = "SELECT e FROM tr UNION ALL SELECT e FROM te WHERE label = 1"


def _only_in_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _halves(spark, sf_dir)
    return retrieve.only_in_test(test, train.unionByName(test.where("label = 1")))


@query(f"WITH {VECTORS_SQL} SELECT uid FROM te WHERE e NOT IN ({_BOTH})")
def only_in_test(spark, sf_dir):
    return _only_in_test(spark, sf_dir).select("uid")


@query(f"WITH {VECTORS_SQL}, {ROWS_SQL} SELECT lr.uid, lr.label FROM lr WHERE lr.uid IN (SELECT uid FROM te WHERE e NOT IN ({_BOTH}))")
def only_in_test_rows(spark, sf_dir):
    return retrieve.keep_rows(inputs.test_rows(spark, sf_dir), _only_in_test(spark, sf_dir))


_ARGUMENTS = [0, 0.001, 0.01, 0.1, 0.5, 1, 2, 10, 999]
_SIZE = "CAST(CASE WHEN {a} = 0 THEN 0 WHEN {a} < 1 THEN greatest(floor({n} * {a}), 1) ELSE least(floor({a}), {n}) END AS BIGINT)"


@query(f"SELECT label, a AS argument, n AS uniques, {_SIZE.format(a='a', n='n')} AS size FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) JOIN (SELECT unnest({_ARGUMENTS}::DOUBLE[]) AS a) ON true")
def coreset_size_grid(spark, sf_dir):
    """The core sets that arguments mean for the sentences of each class."""
    uniques = inputs.table(spark, sf_dir, "embeddings").groupBy("label").count().collect()  # a row for each class
    rows = [(r["label"], float(a), r["count"], core_set_size(a, r["count"])) for r in uniques for a in _ARGUMENTS]
    return spark.createDataFrame(rows, "label int, argument double, uniques long, size long")


@query(f"WITH {VECTORS_SQL}, {_NEAR} SELECT q_uid, CAST(rank AS INTEGER) AS rank, t_uid, round(dist, 6) AS dist FROM nn")
def knn_topk(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return retrieve.nearest(test, train, K).select("q_uid", "rank", "t_uid", F.round("dist", 6).alias("dist"))


@query(f"WITH {VECTORS_SQL}, {_NEAR} SELECT q_uid, t_uid FROM nn WHERE rank = 1")
def knn_1(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return retrieve.nearest(test, train, 1).select("q_uid", "t_uid")


@query(f"WITH {VECTORS_SQL}, {_NEAR} SELECT q_uid AS uid, round(min(dist), 6) AS score FROM nn GROUP BY 1")
def knn_score(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return score.distance_score(retrieve.nearest(test, train, K)).select("uid", F.round("score", 6).alias("score"))


# ---- scores

_SIM = "list_sum(list_transform(q.tok, lambda x: list_max(list_transform(t.tok, lambda y: list_cosine_similarity(x, y)))))"
_CORE = f"raw AS (SELECT q.uid AS uid, max({_SIM}) AS raw_max, avg({_SIM}) AS raw_mean FROM nn JOIN te q ON q.uid = nn.q_uid JOIN tr t ON t.uid = nn.t_uid GROUP BY q.uid)"
_ALL = f"raw AS (SELECT q.uid AS uid, max({_SIM}) AS raw_max, avg({_SIM}) AS raw_mean FROM te q JOIN tr t ON true GROUP BY q.uid)"
_SCORED = "sc AS (SELECT uid, round((SELECT max(raw_max) FROM raw) - raw_max, 9) AS score FROM raw)"


def _raw(spark: SparkSession, sf_dir: str, k: int, only_cls: bool = False, metric: str = "cos") -> DataFrame:
    train, test = _halves(spark, sf_dir)
    if only_cls:  # the first row stands for the sentence: here the whole vector
        train, test = (x.withColumn("tokens", F.array("cls")) for x in (train, test))
    return score.against_core_set(test, train, retrieve.nearest(test, train, k), only_cls, metric) if k else score.against_all(test, train, only_cls, metric)


@query(f"WITH {VECTORS_SQL}, {_NEAR}, {_CORE} SELECT uid, round(raw_max, 6) AS raw_max FROM raw")
def maxsim_coreset(spark, sf_dir):
    return _raw(spark, sf_dir, K).select("uid", F.round("raw_max", 6).alias("raw_max"))


@query(f"WITH {VECTORS_SQL}, {_NEAR}, {_CORE} SELECT uid, round(raw_mean, 6) AS raw_mean FROM raw")
def mean_maxsim(spark, sf_dir):
    return _raw(spark, sf_dir, K).select("uid", F.round("raw_mean", 6).alias("raw_mean"))


@query(f"WITH {VECTORS_SQL}, {_ALL} SELECT uid, round(raw_max, 6) AS raw_max, round(raw_mean, 6) AS raw_mean FROM raw")
def maxsim_all(spark, sf_dir):
    return _raw(spark, sf_dir, 0).select("uid", F.round("raw_max", 6).alias("raw_max"), F.round("raw_mean", 6).alias("raw_mean"))


@query(f"WITH {VECTORS_SQL}, {_ALL} SELECT uid, round(raw_max, 6) AS raw_max FROM raw")
def maxsim_best(spark, sf_dir):
    """The best MaxSim over all training sentences, of which bounds pass over those that cannot have it."""
    train, test = _halves(spark, sf_dir)
    return score.best_against_all(test, train, neighbours=retrieve.nearest(test, train, 1)).select("uid", F.round("raw_max", 6).alias("raw_max"))


@query(f"WITH {VECTORS_SQL}, {_NEAR} SELECT q.uid AS uid, round(max(list_cosine_similarity(q.e, t.e)), 6) AS raw_max FROM nn JOIN te q ON q.uid = nn.q_uid JOIN tr t ON t.uid = nn.t_uid GROUP BY q.uid")
def maxsim_only_cls(spark, sf_dir):
    return _raw(spark, sf_dir, K, only_cls=True).select("uid", F.round("raw_max", 6).alias("raw_max"))


@query(f"WITH {VECTORS_SQL}, {_NEAR}, " + _CORE.replace("list_cosine_similarity", "list_inner_product") + " SELECT uid, round(raw_max, 6) AS raw_max FROM raw")
def maxsim_dot(spark, sf_dir):
    return _raw(spark, sf_dir, K, metric="dot").select("uid", F.round("raw_max", 6).alias("raw_max"))


@query(f"WITH {VECTORS_SQL}, {_NEAR}, {_CORE}, {_SCORED} SELECT uid, round(score, 6) AS score FROM sc")
def score_inversion(spark, sf_dir):
    return score.inverted(_raw(spark, sf_dir, K), "raw_max").select("uid", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS uid, round(list_sum(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE + embedding[i + 48]::DOUBLE) / 4)), 6) AS total FROM embeddings")
def pooling_mean(spark, sf_dir):
    v = encode.pass_through(inputs.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", inputs.SLICES)
    mean = pooled(F.col("tokens"), "mean")[0]
    return v.select("uid", F.round(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# ---- thresholds and metrics: on the scores of the core set


def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.inverted(_raw(spark, sf_dir, K), "raw_max").withColumn("score", F.round("score", 6))
    return stored(score.to_rows(inputs.test_rows(spark, sf_dir), scores).select("uid", "label", "score"), "scored")


_ROWS = f"{VECTORS_SQL}, {ROWS_SQL}, {_NEAR}, {_CORE}, {_SCORED}, sr AS (SELECT lr.uid, lr.label, round(sc.score, 6) AS score FROM lr JOIN sc USING (uid))"
_CURVE = """ct AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sr GROUP BY score),
cv AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM ct),
pr AS (SELECT score, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / ap AS recall FROM cv),
pf AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10::DOUBLE) AS f1 FROM pr),
rc AS (SELECT score, tp::DOUBLE / ap AS tpr, fp::DOUBLE / an AS fpr, tp::DOUBLE / ap - fp::DOUBLE / an AS j FROM cv)"""
_PRC = "(SELECT score FROM pf ORDER BY round(f1, 12) DESC, score LIMIT 1)"
_ROC = "(SELECT score FROM (SELECT score, j FROM rc UNION ALL SELECT max(score) + 1, 0 FROM sr) ORDER BY round(j, 12) DESC, score DESC LIMIT 1)"
_CONF = "cf AS (SELECT count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn FROM (SELECT label, score >= " + _PRC + " AS p FROM sr))"


@query(f"WITH {_ROWS} SELECT uid, label, score FROM sr")
def score_lookup(spark, sf_dir):
    return _scored_rows(spark, sf_dir)


@query(f"WITH {_ROWS}, {_CURVE} SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf")
def pr_curve(spark, sf_dir):
    return threshold.pr_curve(_scored_rows(spark, sf_dir)).select("score", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_ROWS}, {_CURVE} SELECT score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(j, 6) AS j FROM rc")
def roc_curve(spark, sf_dir):
    return threshold.roc_curve(_scored_rows(spark, sf_dir)).select("score", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "j")])


@query(f"WITH {_ROWS}, {_CURVE} SELECT {_PRC} AS threshold")
def threshold_prc(spark, sf_dir):
    return threshold.threshold_prc(_scored_rows(spark, sf_dir))


@query(f"WITH {_ROWS}, {_CURVE} SELECT {_ROC} AS threshold")
def threshold_roc(spark, sf_dir):
    return threshold.threshold_roc(_scored_rows(spark, sf_dir))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.predictions(_scored_rows(spark, sf_dir), "prc")


@query(f"WITH {_ROWS}, {_CURVE}, {_CONF} SELECT tp, fp, fn, tn FROM cf")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_called(spark, sf_dir))


@query(f"""WITH {_ROWS}, {_CURVE}, {_CONF}, m AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r, tn::DOUBLE / (tn + fp) AS s FROM cf)
SELECT 'ColBERT(all_each)' AS exp_name, round(2 * p * r / (p + r), 6) AS f1_score, round((r + s) / 2, 6) AS roc_auc_score, round(p, 6) AS precision_score, round(r, 6) AS recall_score, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy_score FROM m""")
def detection_report(spark, sf_dir):
    r = metrics.report(_called(spark, sf_dir), "ColBERT(all_each)")
    return r.select("exp_name", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


@query(f"""WITH {_ROWS}, {_CURVE}, {_CONF}, two AS (
SELECT '0' AS class, tn::DOUBLE / greatest(tn + fn, 1) AS precision, tn::DOUBLE / greatest(tn + fp, 1) AS recall, tn + fp AS support FROM cf
UNION ALL SELECT '1', tp::DOUBLE / greatest(tp + fp, 1), tp::DOUBLE / greatest(tp + fn, 1), tp + fn FROM cf),
c AS (SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM two)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
SELECT * FROM c UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM c
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM c)""")
def classification_report(spark, sf_dir):
    r = metrics.classification_report(_called(spark, sf_dir))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


_GRIDS = "(VALUES ('rq1', 3, [0.01, 0]), ('rq2_4', 15, [0, 1, 2, 5, 10, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5]), ('rq3', 6, [0.01]), ('rq5', 30, [0, 0.01]), ('rq6', 30, [0.01, 0.1, 1, 0])) AS g(grid, others, cores)"


@query(f"""WITH {VECTORS_SQL}, n AS (SELECT count(*) AS n FROM tr), x AS (SELECT grid, others, unnest(cores)::DOUBLE AS a FROM {_GRIDS})
SELECT grid, CAST(sum(others) AS BIGINT) AS runs, count(DISTINCT {_SIZE.format(a='a', n='n')}) AS core_sets, max({_SIZE.format(a='a', n='n')}) AS largest FROM x, n GROUP BY grid""")
def experiment_grid(spark, sf_dir):
    """The published grids over the training part: their runs, and the core sets that these look for."""
    n = _halves(spark, sf_dir)[0].count()
    sizes = {name: {core_set_size(c.core_set, n) for c in runs} for name, runs in published_grids().items()}
    rows = [(name, len(runs), len(sizes[name]), max(sizes[name])) for name, runs in published_grids().items()]
    return spark.createDataFrame(rows, "grid string, runs long, core_sets long, largest long")


_GRID = (1, 2, 3, 4, 5, 7, 10, 15, 25, 40)
_GRID_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (WITH nn AS (SELECT * FROM near WHERE rank <= {k}), {_CORE}, {_SCORED}, sr AS (SELECT lr.uid, lr.label, sc.score FROM lr JOIN sc USING (uid)), {_CURVE}, {_CONF}
SELECT {k}::BIGINT AS core_set, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1_score, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy_score FROM cf)"""
    for k in _GRID
)


@query(f"WITH {VECTORS_SQL}, {ROWS_SQL}, {_NEAR.replace('nn AS', 'near AS', 1).replace(f'rank <= {K}', f'rank <= {max(_GRID)}')} {_GRID_SQL}")
def grid_reports(spark, sf_dir):
    """Runs of ten core sets over one representation as one plan: one search for neighbours, one MaxSim for each pair."""
    v = inputs.vectors(spark, sf_dir)
    train = v.where("split = 'train'").select("uid", "label")
    rows = train.withColumn("split", F.lit("train")).unionByName(inputs.test_rows(spark, sf_dir).withColumn("split", F.lit("test")))
    configs = [RunConfig(core_set=k) for k in _GRID]
    whole = pipeline.run_grid(spark, lambda _: (v.select("uid", "cls", "tokens"), rows.withColumn("line_no", F.col("uid"))), configs, new_path(spark, "grid"))
    best = whole.where(F.col("exp_name") == "ColBERT(all_each)")
    core = F.regexp_extract("experiment", "_core_([0-9]+)_", 1).cast("long")
    return best.select(core.alias("core_set"), F.round("f1_score", 6).alias("f1_score"), F.round("accuracy_score", 6).alias("accuracy_score"))


@query()
def hash_encode(spark, sf_dir):
    sentences = dedup.unique_sentences(inputs.document_log(spark, sf_dir).select(text.sentence(F.col("value"), "bgl", False).alias("sentence")))
    return encode.encode(sentences).select("uid", F.size("tokens").alias("rows"), F.round(F.col("tokens")[0][0].cast("double"), 5).alias("first"))


@query()
def end_to_end_logs(spark, sf_dir):
    report = pipeline.run(inputs.log_lines(spark, sf_dir, "bgl"), RunConfig(dataset="bgl", shuffle=True, core_set=2))
    return report.select("exp_name", "f1_score", "roc_auc_score", "precision_score", "recall_score", "accuracy_score", "experiment")


@query()
def end_to_end_documents(spark, sf_dir):
    """The same over lines of which few are alike."""
    report = pipeline.run(inputs.document_log(spark, sf_dir), RunConfig(dataset="bgl", shuffle=True, core_set=2))
    return report.select("exp_name", "f1_score", "roc_auc_score", "precision_score", "recall_score", "accuracy_score", "experiment")


@query(f"WITH {BLOCKS_SQL}, {_EVENTS} SELECT CASE WHEN label IS NULL THEN 'apart' WHEN label = 0 THEN 'normal' ELSE 'abnormal' END AS kind, count(*) AS sessions, count(DISTINCT doc) AS documents FROM doc GROUP BY 1")
def block_log_documents(spark, sf_dir):
    """What a run over a block log starts from: a document for each block, and those without a label set apart."""
    known, apart = pipeline.labelled(inputs.block_lines(spark, sf_dir), RunConfig(dataset="hdfs"), logs.block_labels(inputs.block_label_rows(spark, sf_dir)))
    kind = F.when(F.col("label").isNull(), "apart").when(F.col("label") == 0, "normal").otherwise("abnormal").alias("kind")
    return known.unionByName(apart).groupBy(kind).agg(F.count("*").alias("sessions"), F.count_distinct("value").alias("documents"))


# ---- sources and sinks: written, and read back


def _log_files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The lines of a log in order, in several files of a folder."""
    path = new_path(spark, "log")
    inputs.log_lines(spark, sf_dir, kind).repartitionByRange(7, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return path


@query(f"WITH {LINES_SQL['hdfs']} SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, value FROM lines")
def read_log_files(spark, sf_dir):
    return logs.read_lines(spark, _log_files(spark, sf_dir, "hdfs"))


@query("SELECT 'blk_' || (doc_id + 1000) AS block_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS label FROM labels GROUP BY 1")
def read_label_csv(spark, sf_dir):
    path = new_path(spark, "labels")
    inputs.block_label_rows(spark, sf_dir).select("BlockId", "Label").write.csv(path, header=True)
    return logs.read_block_labels(spark, path)


@query(f"WITH {BLOCKS_SQL}, {_EVENTS} SELECT block_id, CAST(len(bs.raw) AS BIGINT) AS n_lines, doc.doc, doc.label FROM bs JOIN doc USING (block_id)")
def session_cache(spark, sf_dir):
    """Sessions are grouped once and read by whoever asks again."""
    path = new_path(spark, "sessions")
    logs.load_or_make(spark, path, lambda: _sessions(spark, sf_dir))
    again = logs.load_or_make(spark, path, lambda: 1 / 0)
    return again.select("block_id", F.size("raw").cast("long").alias("n_lines"), "doc", "label")


_IN_ORDER = f"""{LINES_SQL['bgl']}, o AS (SELECT *, count(*) FILTER (label = 0) OVER () AS n, row_number() OVER (PARTITION BY label ORDER BY line_no) AS rk FROM lines),
sp AS (SELECT line_no, value, label, CASE WHEN label = 0 AND rk <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o)"""


@query(f"WITH {_IN_ORDER} SELECT split, row_number() OVER (PARTITION BY split ORDER BY line_no) - 1 AS line_no, value FROM sp")
def split_files(spark, sf_dir):
    """Train and test as text files, read again: their lines, in order, numbered anew."""
    root = new_path(spark, "split")
    logs.write_split(split.train_test(inputs.log_lines(spark, sf_dir, "bgl"), "line_no", 0.2, SEED, shuffle=False), root)
    parts = [logs.read_split(spark, root, name).withColumn("split", F.lit(name)) for name in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("split", "line_no", "value")


@query(f"WITH {BLOCKS_SQL}, {_EVENTS} SELECT doc AS value FROM doc WHERE label IS NULL")
def quarantine_sink(spark, sf_dir):
    """Documents of blocks without a label are set apart as JSON and read again."""
    _, apart = pipeline.labelled(inputs.block_lines(spark, sf_dir), RunConfig(dataset="hdfs"), logs.block_labels(inputs.block_label_rows(spark, sf_dir)))
    path = new_path(spark, "quarantine")
    logs.write_quarantine(apart, path)
    return spark.read.schema("line_no long, value string").json(path).select("value")


@query(f"WITH {_IN_ORDER}, {_sentence_sql('bgl')} SELECT sp.line_no, strftime(strptime(regexp_extract(sp.value, '[0-9]+-[0-9]+-[0-9]+-[0-9.]+'), '%Y-%m-%d-%H.%M.%S.%f'), '%Y-%m-%d %H:%M:%S.%f') AS ts, sentence, sp.label, split FROM sp JOIN sentences USING (line_no)")
def time_data(spark, sf_dir):
    """Time, sentence and label of the lines of both parts."""
    rows = pipeline.parse(inputs.log_lines(spark, sf_dir, "bgl"), RunConfig(dataset="bgl"))[0]
    return rows.select("line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "sentence", "label", "split")


@query(f"WITH {_IN_ORDER}, {_sentence_sql('bgl')}, u AS (SELECT row_number() OVER (ORDER BY sentence) - 1 AS uid, sentence FROM (SELECT DISTINCT sentence FROM sentences)) SELECT sp.line_no, sp.label, split, uid, 8 AS tokens FROM sp JOIN sentences USING (line_no) JOIN u USING (sentence)")
def process_log(spark, sf_dir):
    """From lines to the representation of unique sentences and the way back to it."""
    config = RunConfig(dataset="bgl", max_tokens=8)
    representation, rows = pipeline.represent(pipeline.records_of(inputs.log_lines(spark, sf_dir, "bgl"), config)[0], config)
    return rows.join(representation.select("uid", F.size("tokens").alias("tokens")), "uid").select("line_no", "label", "split", "uid", "tokens")


def _run_sql(name: str, scored: str) -> str:
    return f"""SELECT * FROM (WITH sc AS ({scored}), sr AS (SELECT lr.uid, lr.label, sc.score FROM lr JOIN sc USING (uid)), {_CURVE}, {_CONF}, m AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r, tn::DOUBLE / (tn + fp) AS s FROM cf)
SELECT '{name}(all_each)' AS exp_name, unnest(['f1_score', 'roc_auc_score', 'precision_score', 'recall_score', 'accuracy_score']) AS metric,
unnest([round(2 * p * r / (p + r), 6), round((r + s) / 2, 6), round(p, 6), round(r, 6), round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6)]) AS value FROM m)"""


_THREE = {
    "K=1": "SELECT q_uid AS uid, dist AS score FROM nn WHERE rank = 1",
    "ColBERT": "SELECT uid, round((SELECT max(raw_max) FROM raw) - raw_max, 9) AS score FROM raw",
    "mean ColBERT": "SELECT uid, round((SELECT max(raw_mean) FROM raw) - raw_mean, 9) AS score FROM raw",
}


def _run_of_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The report of a run with a core set of K, and its scores."""
    v = inputs.vectors(spark, sf_dir)
    train = v.where("split = 'train'").select("uid", "label").withColumn("split", F.lit("train"))
    rows = train.unionByName(inputs.test_rows(spark, sf_dir).withColumn("split", F.lit("test"))).withColumn("line_no", F.col("uid"))
    config = RunConfig(core_set=K)
    return pipeline.detect_all([config], pipeline.sides(v.select("uid", "cls", "tokens"), rows, config))


@query(f"WITH {VECTORS_SQL}, {ROWS_SQL}, {_NEAR}, {_CORE} " + " UNION ALL ".join(_run_sql(n, x) for n, x in _THREE.items()))
def result_sinks(spark, sf_dir):
    """A run's report, written and read back as nested JSON."""
    path = new_path(spark, "results")
    logs.write_report(_run_of_vectors(spark, sf_dir)[0], path)
    return logs.read_report(spark, path).select("exp_name", "metric", F.round("value", 6).alias("value"))


@query(f"WITH {VECTORS_SQL}, {_NEAR}, {_CORE} " + " UNION ALL ".join(f"SELECT '{n}' AS name, uid, round(score, 6) AS score FROM ({x})" for n, x in _THREE.items()))
def score_artefacts(spark, sf_dir):
    """The scores of a run's sentences, written and read back."""
    path = new_path(spark, "scores")
    logs.write_scores(_run_of_vectors(spark, sf_dir)[1], path)
    return spark.read.parquet(path).select(F.split_part("key", F.lit("|"), F.lit(1)).alias("name"), "uid", F.round("score", 6).alias("score"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nearest neighbour, threshold by F1, metrics: the smallest run from end to end."""
    train, test = _halves(spark, sf_dir)
    scored = score.to_rows(test.select("uid", "label"), score.distance_score(retrieve.nearest(test, train, 1)))
    return metrics.report(threshold.predictions(scored, "prc"), "K=1(all_each)")
