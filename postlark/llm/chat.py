r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation is formatted once: every turn becomes ``### role: text</turn>\n``.
Every assistant turn is then its own example: all preceding turns are its context,
and only its reply is trainable. Because the format of a prefix is a prefix of the
format, an example is kept as a span of its conversation's text; storing the context
of every example would grow with the square of the turns. ``expand`` gives the
examples with context and target as text.

Inside roles and texts, ``\``, ``#``, ``<`` (and ``:`` in roles) are written as
``\b``, ``\h``, ``\l`` (``\c``), so no text can contain a mark, and it can be undone.

Defined cases: a NULL or empty text is an empty turn, a NULL role an empty role.
Rows are ordered by turn (NULL first), then role, then text; repeated rows are turns
of their own. A NULL ``conv_id`` is one conversation. A conversation without assistant
turns has no examples. An empty table gives no rows. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
TRAINABLE = "assistant"

_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def escape(text: Column, escapes=_ESCAPES) -> Column:
    for plain, written in escapes:  # the backslash comes first
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes=_ROLE_ESCAPES) -> Column:
    for plain, written in reversed(escapes):  # and here last
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, replies``.

    ``replies`` lists ``(start, chars)`` of each assistant text in ``formatted``, in
    code points from 0. One shuffle, by conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(
        F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), _ROLE_ESCAPES), F.lit(BETWEEN))
    turns = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = (
        turns.withColumn("position", F.row_number().over(order))
        .withColumn("head", head)
        .withColumn("body", escape(F.col("text")))
        .withColumn("chars", F.length("head") + F.length("body") + len(CLOSE))
        .withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0).cast("long")))
    )
    pieces = placed.select(
        "conv_id",
        F.struct(
            "position",
            F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
            (F.col("role") == TRAINABLE).alias("trains"),
            (F.col("start") + F.length("head")).alias("start"),
            F.length("body").cast("long").alias("chars"),
        ).alias("turn"),
    )
    gathered = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    replies = F.transform(
        F.filter("turns", lambda turn: turn["trains"]),
        lambda turn: F.struct(turn["start"].alias("start"), turn["chars"].alias("chars")),
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        replies.alias("replies"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, context, target, loss_start, loss_chars``.

    ``context`` holds all turns before it and the opening of its own; ``target`` is
    the reply. The loss mask covers ``loss_chars`` code points from ``loss_start`` of
    ``context || target``. Columns that are not used are not built.
    """
    rows = formatted.select("conv_id", "formatted", F.posexplode("replies").alias("example", "reply"))
    start, chars = F.col("reply.start"), F.col("reply.chars")
    text = F.col("formatted")
    return rows.select(
        "conv_id",
        "example",
        text.substr(F.lit(1), start.cast("int")).alias("context"),
        text.substr((start + 1).cast("int"), chars.cast("int")).alias("target"),
        start.alias("loss_start"),
        chars.alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``(role, text)``."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing follows the last mark
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(
                F.regexp_extract(piece, f"(?s)^{OPEN}([^:]*){BETWEEN}(.*)$", 1)
            ).alias("role"),
            unescape(
                F.regexp_extract(piece, f"(?s)^{OPEN}([^:]*){BETWEEN}(.*)$", 2), _ESCAPES
            ).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its stored format and its examples say."""
    lines = F.transform(
        read_turns(F.col("formatted")),
        lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")),
    )
    none = F.lit(None)
    whole = formatted.withColumn("lines", lines).select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        none.cast("struct<example:int,target:string>").alias("loss"),
    )
    targets = expand(formatted).select(
        "conv_id",
        none.cast("long").alias("n_turns"),
        none.cast("string").alias("turns_sha256"),
        none.cast("long").alias("formatted_chars"),
        F.struct("example", unescape(F.col("target"), _ESCAPES).alias("target")).alias("loss"),
    )
    loss = F.array_join(F.sort_array(F.collect_list("loss"))["target"], "")
    return (
        whole.unionByName(targets)
        .groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            loss.alias("loss"),
            F.max("formatted_chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
