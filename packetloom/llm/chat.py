"""Chat formatting: turns to one marked text per conversation, and back.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

The parser cuts at the control strings and removes one level of escapes. A turn is
rendered, parsed again and compared with its source; content that does not come
back is escaped and tried again. So ordinary turns stay as they are, and any text,
control strings and escapes included, survives the way there and back.

Native functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.columns import whole

# fixed strings of the template
START, END = "<|im_start|>", "<|im_end|>"
_HEAD, _TAIL = len(START), len(END) + 1

# The opening of a control string with any number of backslashes in it. One more backslash escapes it, one less
# unescapes it; without a backslash in between no escaped text holds a control string.
_OPENING = r"<(\\*+)\|"
_ESCAPED = r"<\\(\\*+)\|"
TURN = "struct<role: string, text: string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPENING, r"<\\$1|")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given; also leaves text alone that has no escapes."""
    return F.regexp_replace(text, _ESCAPED, "<$1|")


def escape_role(role: Column) -> Column:
    """As for texts; a line break, which ends a role, is spelled out."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


# what is escaped, in the order in which it is tried
LEVELS = (
    lambda role, text: (role, text),
    lambda role, text: (role, escape(text)),
    lambda role, text: (escape_role(role), text),
    lambda role, text: (escape_role(role), escape(text)),
)


def _marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of ``role`` and ``text``.

    Null where the text is not of the grammar. One cut at each control string, so
    the work is linear in the text.
    """
    pieces = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        sound = F.contains(piece, F.lit("\n")) & F.endswith(piece, F.lit(END + "\n"))
        # the first end mark must be the one at the end
        sound = sound & (F.char_length(F.substring_index(piece, END, 1)) == F.char_length(piece) - _TAIL)
        # a role may not reach into the end mark
        sound = sound & (F.char_length(role) <= F.char_length(piece) - _TAIL - 1)
        start = F.char_length(role) + 2
        body = F.substring(piece, start, F.char_length(piece) - F.char_length(role) - 1 - _TAIL)
        return F.when(sound, F.struct(unescape_role(role).alias("role"), unescape(body).alias("text")))

    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    good = (F.get(pieces, F.lit(0)) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(good, turns)


def _survives(role: Column, text: Column, level: int) -> Column:
    """Whether a turn, rendered at a level and parsed again, is what it was."""
    back = parse(_marked(*LEVELS[level](role, text)))
    first = F.get(back, F.lit(0))
    return F.coalesce((F.size(back) == 1) & (first["role"] == role) & (first["text"] == text), F.lit(False))


def _by_level(level: Column, make) -> Column:
    """``make(n)`` of the row's level."""
    out = F.when(level == 0, make(0))
    for n in range(1, len(LEVELS)):
        out = out.when(level == n, make(n))
    return out


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the stretches of ``formatted`` (``start`` and ``end`` in code
    points, end exclusive) that hold the texts of ``loss_roles``, in order.

    Rows go by turn; null turns come first, and equal ones by role and text. A
    repeated row is a turn of its own. Null roles and texts count as empty; rows
    without an id are one conversation without an id. No rows, no conversations;
    further columns are ignored.

    The round trip is tested turn by turn before anything is shuffled, and once
    more over whole conversations; a difference there stops the job. Each text is
    shuffled once. A conversation becomes one string, so it has to fit in a row.
    """
    role, text = whole(role_col), whole(text_col)
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"))
    level = F.lit(None).cast("int")
    for n in reversed(range(len(LEVELS))):
        level = F.when(_survives(F.col("_role"), F.col("_text"), n), F.lit(n)).otherwise(level)
    rows = rows.withColumn("_level", level)

    rendered = _by_level(F.col("_level"), lambda n: F.struct(*[c.alias(k) for k, c in zip("rt", LEVELS[n](F.col("_role"), F.col("_text")))]))
    sized = rows.withColumn("_sizes", F.transform(F.array(rendered), lambda x: F.struct(F.char_length(x["r"]).alias("role"), F.char_length(x["t"]).alias("text")))[0])
    size = F.col("_sizes.role").cast("long") + F.col("_sizes.text") + _HEAD + 1 + _TAIL
    in_order = Window.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "_role", "_text", F.col("_level"))
    placed = sized.withColumn("_at", F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))

    one = F.struct(F.coalesce("_at", F.lit(0)).alias("at"), "_role", "_text", "_level", "_sizes")
    whole_ones = placed.groupBy("_conv").agg(F.array_sort(F.collect_list(one)).alias("_turns"))

    def string(t: Column) -> Column:
        return _by_level(t["_level"], lambda n: _marked(*LEVELS[n](t["_role"], t["_text"])))

    def span(t: Column) -> Column:
        start = t["at"] + _HEAD + t["_sizes"]["role"] + 1
        return F.struct(start.alias("start"), (start + t["_sizes"]["text"]).alias("end"))

    learned = F.filter("_turns", lambda t: t["_role"].isin(*loss_roles))
    made = whole_ones.withColumn("_formatted", F.array_join(F.transform("_turns", string), ""))
    source = F.transform("_turns", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text")))
    checked = F.when(F.coalesce(parse(F.col("_formatted")) == source, F.lit(False)), F.col("_formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not come back from its formatted text"))
    )
    return made.select(
        F.col("_conv").alias(conv_col),
        F.size("_turns").cast("long").alias("n_turns"),
        checked.alias("formatted"),
        F.transform(learned, span).alias("loss_spans"),
    )


def text_under(formatted: Column, spans: Column) -> Column:
    """The unescaped texts that ``spans`` cut out of ``formatted``, as an array."""
    return F.transform(
        spans,
        lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
