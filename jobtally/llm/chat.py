"""Chat formatting that is read back: turns rendered, parsed again, escaped until they agree.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Nothing but DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
OPENER, ESCAPED, LINE = "<|", "<||>", "<|nl|>"  # every opener in a text becomes <||>; a line feed in a role <|nl|>
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Leaves no control string: each ``<|`` that is left begins a ``<||>``, so :func:`unescape` is exact."""
    return F.replace(text, F.lit(OPENER), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(OPENER))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BREAK), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit(BREAK)))


def render(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(BREAK), turn["text"], F.lit(END + BREAK))


def parse(formatted: Column) -> Column:
    """The raw ``(role, text)`` of each turn, as the template delimits them.

    A turn begins after each ``<|im_start|>``; its role ends at the first line
    feed and its text at the first ``<|im_end|>``. So no text or role that holds
    either string comes back whole unless it is escaped.
    """
    chunks = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(chunks, F.lit(2), F.size(chunks) - 1)

    def turn(chunk: Column) -> Column:
        body = F.substring_index(chunk, END, 1)
        role = F.substring_index(body, BREAK, 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(turns, turn)


def recovered(formatted: Column) -> Column:
    """The turns with their texts as they were before escaping."""
    return F.transform(
        parse(formatted),
        lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``(conv_id, n_turns, formatted, loss_spans)``.

    ``rows`` are ``(conv_id, turn, role, text)``; turns are ordered by ``turn``
    (null first), ties by role and text. Every turn is rendered as it is, parsed again by the
    template's grammar, and compared with its source; a turn that comes
    back changed, or as another number of turns, is rendered with its control
    strings escaped instead. The whole conversation then goes through
    the same parser, and a difference would end the job. ``loss_spans`` are
    ``(start, length)`` in characters of the assistant texts in ``formatted``.

    Null text or role: empty. Repeated rows: each is a turn. Null ``conv_id``: one
    conversation, its id null. No rows: no rows. Other columns are not
    read. A conversation is one output row, so its turns meet in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    source = rows.select("conv_id", "turn", F.struct(role.alias("role"), text.alias("text")).alias("source"))
    plain = source.withColumn("alone", recovered(render(F.col("source"))))
    same = (F.size("alone") == 1) & (F.col("alone")[0] == F.col("source"))
    safe = F.struct(escape_role(F.col("source.role")).alias("role"), escape(F.col("source.text")).alias("text"))
    turns = plain.withColumn("shown", F.when(same, F.col("source")).otherwise(safe))
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "source", "shown"))).alias("turns")
    )
    joined = grouped.withColumn("formatted", F.array_join(F.transform("turns", lambda t: render(t["shown"])), ""))
    origin = F.transform("turns", lambda t: t["source"])
    sizes = F.transform("turns", lambda t: F.length(render(t["shown"])))
    # running places of the assistant texts; null where a turn bears no loss
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        shown = turn["shown"]
        start = state["at"] + F.lit(len(START) + 1) + F.length(shown["role"])
        span = F.struct(start.alias("start"), F.length(shown["text"]).alias("length"))
        spans = F.when(turn["source"]["role"] == "assistant", F.concat(state["spans"], F.array(span)))
        return F.struct(
            (state["at"] + F.length(render(shown))).alias("at"), spans.otherwise(state["spans"]).alias("spans")
        )

    checked = joined.withColumn(
        "formatted",
        F.when(recovered(F.col("formatted")) == origin, F.col("formatted")).otherwise(
            F.raise_error(F.concat(F.lit("not recovered: conversation "), F.col("conv_id").cast("string"))).cast("string")
        ),
    )
    return checked.select(
        "conv_id",
        F.size(sizes).cast("long").alias("n_turns"),
        "formatted",
        F.aggregate("turns", begin, step)["spans"].alias("loss_spans"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted_chars)`` from formatted rows alone.

    ``loss_text`` is all text under ``loss_spans``, unescaped, in order.
    """
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return formatted.select(
        "conv_id",
        recovered(F.col("formatted")).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
