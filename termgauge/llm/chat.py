"""Conversations as one text each, with a loss mask, in a grammar that is read back to check it.

    text  = turn*
    turn  = "<|im_start|>" role "\\n" content "<|im_end|>" "\\n"

The parser splits at start marks, ends a content at the first end mark, and unescapes, so neither
mark can stand in a content. Each turn is first rendered as it is, parsed and compared with its
source; turns that come back different are escaped, rendered and parsed again.
Escaping puts one more backslash into every ``<\\*|`` (and spells backslashes and line feeds of a
role), unescaping takes one out, so one round of escaping always suffices; the last comparison is
still made and stops the job if a turn differs. All of it is column expressions.

Turns are escaped and checked row by row, before anything is grouped. A conversation is one row of
the result by definition; only its rendered turns meet in one place.

Defined results: rows are ordered by turn, then role, then text, NULLs first, so ties and repeated
rows have one order; NULL role or text is empty; a NULL conversation id is a conversation of its
own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
END = STOP + "\n"
START_PATTERN = r"<\|im_start\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    spelled = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(spelled)


def unescape_role(role: Column) -> Column:
    # The two spellings are read from the left, so that "\\\\n" stays a backslash and an n.
    mark = F.lit("\u0000")
    plain = F.replace(unescape(role), mark, F.lit("\u0000z"))
    plain = F.replace(plain, F.lit("\\\\"), F.lit("\u0000b"))
    plain = F.replace(plain, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(plain, F.lit("\u0000b"), F.lit("\\")), F.lit("\u0000z"), mark)


def render(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    pieces = F.split(formatted, START_PATTERN, -1)
    turns = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        content = F.substring_index(F.substr(piece, F.length(head) + 2), STOP, 1)
        name = F.substring_index(head, STOP, 1)
        return F.struct(unescape_role(name).alias("role"), unescape(content).alias("text"))

    return F.transform(turns, turn)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    return parse(rendered) == F.array(F.struct(role.alias("role"), text.alias("text")))


def format_conversations(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """conv_id, formatted, segments: the formatted text cut into (text, loss) runs.

    The segments put together are the formatted text; those with ``loss`` are the contents of the
    turns of ``loss_role``, as they stand in it.
    """
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    r, t = F.col("role"), F.col("text")
    # Without the mark's first sign and a backslash or line feed in the role nothing can conflict.
    plain = ~t.contains("<") & ~r.contains("<") & ~r.contains("\\") & ~r.contains("\n")
    level = rows.withColumn("escaped", ~(plain | _same(render(r, t), r, t)))
    name = F.when(F.col("escaped"), escape_role(r)).otherwise(r)
    content = F.when(F.col("escaped"), escape(t)).otherwise(t)
    written = level.withColumn("name", name).withColumn("content", content)
    n, c = F.col("name"), F.col("content")
    agrees = ~F.col("escaped") | _same(render(n, c), r, t)
    checked = F.when(agrees, c).otherwise(F.raise_error(F.lit("a turn is not recovered from its escaped form")))
    turns = written.select(
        "conv_id", F.struct("turn", "role", "text", "name", checked.alias("content")).alias("turn")
    )
    ordered = F.array_sort(F.collect_list("turn"))
    head = lambda x: F.concat(F.lit(START), x["name"], F.lit("\n"))
    segments = F.flatten(
        F.transform(
            ordered,
            lambda x: F.array(
                F.struct(head(x).alias("text"), F.lit(False).alias("loss")),
                F.struct(x["content"].alias("text"), (x["role"] == F.lit(loss_role)).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    grouped = turns.groupBy("conv_id").agg(segments.alias("segments"))
    return grouped.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns and loss_texts recovered from formatted text and mask alone."""
    masked = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        F.transform(masked, lambda s: unescape(s["text"])).alias("loss_texts"),
    )
