r"""Chat formatting from an event log: messages are folded from streamed deltas, edits and
regenerations, and rendered with a mask of the texts a model learns from.

An event has a conversation, a sequence number, the message it is about, a kind, and for some kinds
a role or a text:

* ``open`` begins the message (again): its role counts, its text is empty;
* ``delta`` appends its text;
* ``edit`` replaces the text by its own;
* ``regenerate`` empties the text for new deltas, and discards all that came before of later messages.

A message counts if it was opened after the last thing that discards it. An event that arrives twice
counts once. Different events of a message under one number apply in order of kind and text.

A turn is rendered as ``### role: text</turn>`` and a newline. In texts and roles a backslash is
doubled, ``</`` becomes ``<\/`` and ``##`` becomes ``#\#``, so neither mark occurs inside; a
backslash and the character behind it stand for that character. In a role a backslash follows each
colon too. The mask has the byte offsets of the escaped text of every assistant turn.

Nulls: a null role or text is empty, a null conversation is one of its own, a null turn comes first.
A conversation is one value of the result, which bounds it to 2 GB; its messages are folded apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
LEARNT = "assistant"


# ---- the log ---------------------------------------------------------------------------------------

def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, kind, role, text).

    Events are gathered per message, not per conversation; what earlier messages discard is a running
    maximum over the messages of a conversation."""
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("seq"))
    said = F.when(
        F.col("kind").isin(DELTA, EDIT), F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    )
    messages = events.groupBy("conv_id", "message").agg(
        F.max(at(OPEN)).alias("opened"),
        F.max(at(OPEN, EDIT, REGENERATE)).alias("reset"),
        F.max(at(REGENERATE)).alias("again"),
        F.max_by(F.coalesce("role", F.lit("")), at(OPEN)).alias("role"),
        F.collect_set(said).alias("said"),
    )
    earlier = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    cut = F.max("again").over(earlier)
    live = F.filter(F.array_sort("said"), lambda e: e["seq"] >= F.col("reset"))
    return (
        messages.withColumn("cut", cut)
        .filter("opened > coalesce(cut, opened - 1)")
        .select("conv_id", "message", "role", F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))
    )


def turns_as_log(turns: DataFrame) -> DataFrame:
    """A log that ends in the given turns (conv_id, turn, role, text), as a chat server would keep it.

    Rows are messages in order of turn, role and text. By a hash of conversation and message the text
    comes in plain deltas; after a draft that is regenerated, when the next message was already begun;
    as an edit of its first words; or in deltas that arrive twice."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("message", F.row_number().over(order).cast("long"))
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("message").cast("string"))
    rows = rows.withColumn("style", F.crc32(name.cast("binary")) % 4)
    rows = rows.withColumn("part", F.ceil((F.length("text") + 1) / 4).cast("int"))

    def event(step: int, kind: str, text: Column, ahead: int = 0) -> Column:
        role = F.col("role") if kind == OPEN else F.lit(None).cast("string")
        return F.struct(
            (F.col("message") * 16 + step).alias("seq"), (F.col("message") + ahead).alias("message"),
            F.lit(kind).alias("kind"), role.alias("role"), text.cast("string").alias("text"),
        )

    none, part = F.lit(None), F.col("part")
    deltas = [event(8 + i, DELTA, F.col("text").substr(part * i + 1, part)) for i in range(4)]
    first = event(1, DELTA, F.col("text").substr(F.lit(1), F.lit(12)))
    start = event(0, OPEN, none)
    plain = F.array(start, *deltas)
    drafted = F.array(
        start, first, event(2, OPEN, none, 1), event(3, DELTA, F.lit("too early"), 1), event(4, REGENERATE, none), *deltas
    )
    edited = F.array(start, first, event(5, EDIT, F.col("text")))
    style = F.col("style")
    steps = F.when(style == 1, drafted).when(style == 2, edited).when(style == 3, F.concat(plain, F.array(*deltas)))
    return rows.select("conv_id", F.inline(steps.otherwise(plain)))


# ---- the template ----------------------------------------------------------------------------------

def escaped(text: Column) -> Column:
    for mark, safe in (("\\", "\\\\"), ("</", "<\\/"), ("##", "#\\#")):
        text = F.replace(text, F.lit(mark), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted, and loss, the (from, size) of each learnt text in bytes."""
    head = F.concat(F.lit(HEAD), F.replace(escaped(F.col("role")), F.lit(":"), F.lit(":\\")), F.lit(COLON))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = parts.withColumn("turn", F.concat("head", "body", F.lit(TAIL)))
    earlier = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("turn").cast("long")).over(earlier), F.lit(0))
    span = F.struct((before + F.octet_length("head")).alias("from"), F.octet_length("body").cast("long").alias("size"))
    spans = turns.withColumn("span", F.when(F.col("role") == LEARNT, span))
    whole = spans.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message", "turn", "span"))).alias("turns")
    )
    return whole.select(
        "conv_id",
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.split(formatted, TAIL, -1)

    def turn(piece: Column) -> Column:
        colon = F.locate(COLON, piece, len(HEAD) + 1)
        role = piece.substr(F.lit(len(HEAD) + 1), colon - (len(HEAD) + 1))
        return F.struct(
            unescaped(role).alias("role"), unescaped(piece.substr(colon + len(COLON), F.length(piece))).alias("text")
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learnt(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped. The text is turned into bytes once, in an array of one."""

    def cut(whole: Column) -> Column:
        spans = F.transform(
            loss, lambda s: unescaped(F.substring(whole, (s["from"] + 1).cast("int"), s["size"].cast("int")).cast("string"))
        )
        return F.array_join(spans, "")

    return F.element_at(F.transform(F.array(formatted.cast("binary")), cut), 1)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")
