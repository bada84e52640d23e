"""Chats rebuilt from event logs and rendered with a reversible template, in DataFrame functions (operator 6).

Events: conv_id, seq (order in the log), message (its place in the conversation), kind, role, text, where kind is
`delta` (text is added), `edit` (text replaces the message) or `regenerate` (the message begins anew with the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Fixed marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("delta", "edit", "regenerate")
#: Code points of a draft.
DRAFT = 64


def escape(text: Column) -> Column:
    r"""No control string is left: `<\` becomes `<\\`, then `<|` becomes `<\|`."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\([|\\])", "<$1")


def escape_role(role: Column) -> Column:
    """As escape(), and on one line."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def turn_events(turns: DataFrame, chunk: int = 1024) -> DataFrame:
    """An event log that ends in given turns (conv_id, turn, role, text), as a chat service would have written it.

    Every first message of three streams in as deltas of `chunk` code points. Every second is a draft that is generated anew, every third a
    draft that is edited: the draft is one delta, the first code points of the text in reverse; the regeneration or the edit holds the
    first `chunk` code points, and deltas follow. Rows of one conversation and turn are messages of their own, in the order of role and
    text. Null text is empty, null role is the empty role; rows without conv_id form one conversation of their own; null turns come first.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_of().alias("text"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("message", rank.cast("long"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chunk))
    begins = F.element_at(F.array(*[F.lit(k) for k in ("delta", "regenerate", "edit")]), (F.pmod(F.col("message") - 1, F.lit(3)) + 1).cast("int"))
    draft = F.struct(F.lit("delta").alias("kind"), F.reverse(F.substring("text", 1, DRAFT)).alias("text"))
    final = F.transform(
        starts, lambda at, n: F.struct(F.when(n == 0, begins).otherwise(F.lit("delta")).alias("kind"), F.substr(F.col("text"), at + 1, F.lit(chunk)).alias("text"))
    )
    log = F.when(begins == "delta", final).otherwise(F.concat(F.array(draft), final))
    pieces = rows.select("conv_id", "message", "role", F.posexplode(log).alias("n", "e"))
    return pieces.select("conv_id", (F.col("message") * (1 << 32) + F.col("n")).alias("seq"), "message", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text.

    What counts is the last edit or regeneration of a message and the deltas after it, in the order of seq. An event that was
    delivered twice (equal seq in a conversation) counts once; of differing events with one seq that with the least kind, message,
    role and text. The role is that of the last event that counts. Null text is empty, null kind is a delta; any other kind raises an
    error. A message is folded by itself, before the messages of a conversation come together.
    """
    e = events.select(
        "conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_of().alias("text")
    )
    e = e.withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.col("kind")))))
    once = e.groupBy("conv_id", "seq").agg(F.min(F.struct("kind", "message", "role", "text")).alias("e")).select("conv_id", "seq", "e.*")
    last = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    messages = once.groupBy("conv_id", "message").agg(last.alias("log"))
    reset = F.array_max(F.transform(F.col("log"), lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(0))))
    counted = messages.withColumn("_from", reset).withColumn("log", F.expr("slice(log, _from + 1, size(log))"))
    return counted.select("conv_id", "message", F.element_at("log", -1)["role"].alias("role"), F.array_join(F.transform("log", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans: where the texts of loss_role stand, as array<struct<start, length>> in code points.

    A conversation is one string and so one row, whatever its length; the places are running sums over its messages.
    """
    piece = messages.select(
        "conv_id", "message", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss")
    )
    piece = piece.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    placed = piece.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    span = F.when(F.col("loss"), F.struct("start", F.length("body").cast("long").alias("length")))
    whole = F.concat("head", "body", F.lit(END + "\n"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", whole.alias("piece")))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def _pieces(formatted: Column) -> Column:
    """The rendered messages without their end marks; no text holds one, as texts are escaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))


def _role(piece: Column) -> Column:
    return unescape_role(F.substr(F.substring_index(piece, "\n", 1), F.lit(len(START) + 1)))


def _text(piece: Column) -> Column:
    return unescape(F.substr(piece, F.length(F.substring_index(piece, "\n", 1)) + 2))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    return F.transform(_pieces(formatted), lambda p: F.struct(_role(p).alias("role"), _text(p).alias("text")))


def digests(chats: DataFrame) -> DataFrame:
    """What the rendered strings and their loss spans say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Messages and spans become rows of their own, and each span is cut from the message it lies in, so the work follows the length of a
    conversation and not its square. The rows of a conversation stay where it is.
    """
    none = lambda kind: F.lit(None).cast(kind)
    messages = F.transform(_pieces(F.col("formatted")), lambda p, i: F.struct(i.alias("message"), none("long").alias("start"), none("long").alias("length"), p.alias("piece")))
    spans = F.transform("loss_spans", lambda s: F.struct(none("int").alias("message"), s["start"].cast("long").alias("start"), s["length"].cast("long").alias("length"), none("string").alias("piece")))
    rows = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.explode_outer(F.concat(messages, spans)).alias("e")).select("conv_id", "formatted_chars", "e.*")
    size = F.when(F.col("piece").isNull(), 0).otherwise(F.length("piece") + len(END) + 1)
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_from", F.coalesce(before, F.lit(0))).withColumn("_at", F.coalesce("start", "_from"))
    by_place = Window.partitionBy("conv_id").orderBy("_at", F.col("start").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_in", F.last(F.when(F.col("piece").isNotNull(), F.struct("_from", "piece")), ignorenulls=True).over(by_place))
    cut = unescape(F.substr(F.col("_in.piece"), (F.col("start") - F.col("_in._from") + 1).cast("int"), F.col("length").cast("int")))
    turn = F.when(F.col("piece").isNotNull(), F.struct("message", _role(F.col("piece")).alias("role"), _text(F.col("piece")).alias("text")))
    read = placed.groupBy("conv_id").agg(
        F.max("formatted_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", cut.alias("text"))))).alias("spans"),
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumn("loss", F.array_join(F.transform("spans", lambda s: s["text"]), ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
