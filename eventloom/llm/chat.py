"""Chat formatting by grammar round trip.

The grammar is deterministic: ``chat := turn*``, ``turn := <|im_start|> role \\n text <|im_end|> \\n``, where neither
role nor text holds a control string. Each turn is rendered, reparsed and compared with its source; content that does
not come back is escaped (one backslash into every ``<|``, ``<\\|``, ``<\\\\|`` ...) and compared again. Unescaping takes
one backslash out, so a single escape suffices for any content; a turn that still differed would raise an error. At last
the whole rendered conversation is reparsed and compared with all its source turns; a difference raises an error, too.

A conversation is one output string, so its turns meet in one task; nothing else is gathered. Ties in ``turn`` are
ordered by role, then text. Null role or text counts as empty, a null conversation id is one conversation. Only the
four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.sqltext import let

START, END = "<|im_start|>", "<|im_end|>"
NEWLINE_IN_ROLE = "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE_IN_ROLE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE_IN_ROLE), F.lit("\n")))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse_chat(chat: Column) -> Column:
    """Turns (role, text) of a rendered chat, unescaped; null where the grammar is broken."""
    opening = "\n" + START

    def turn(part: Column) -> Column:
        body = F.substring(part, len(opening) + 1, 2**31 - 1)
        at = F.locate("\n", body)
        good = F.startswith(part, F.lit(opening)) & (F.locate(START, body) == 0) & (at > 0)
        both = F.struct(unescape_role(F.left(body, at - 1)).alias("role"), unescape(F.substr(body, at + 1)).alias("text"))
        return F.when(good, both)

    def turns(parts: Column) -> Column:
        inner = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
        good = (F.element_at(parts, -1) == "\n") & ~F.exists(inner, lambda x: x.isNull())
        return F.when(good, inner)

    return let(F.split(F.concat(F.lit("\n"), chat), r"<\|im_end\|>", -1), turns)


def _rendered(role: Column, text: Column) -> Column:
    """The first rendering that reparses to the source: as it is, else escaped."""
    comes_back = lambda s: parse_chat(s).eqNullSafe(F.array(F.struct(role.alias("role"), text.alias("text"))))
    raw, escaped = render_turn(role, text), render_turn(escape_role(role), escape(text))
    lost = F.raise_error(F.lit("a turn does not come back from its rendering")).cast("string")
    return F.when(~F.contains(role, F.lit("\n")) & comes_back(raw), raw).when(comes_back(escaped), escaped).otherwise(lost)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_from=("assistant",)) -> DataFrame:
    """One row for each conversation: its id, the formatted text, and the loss mask, once as code-point and once as
    byte spans (UTF-8) of that text."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("out", _rendered(F.col("role"), F.col("text")))
    # the window and the grouping use one shuffle on the conversation
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"end": F.sum(F.length("out")).over(before), "octets": F.sum(F.octet_length("out")).over(before)})
    line = F.substring_index("out", "\n", 1)  # the mark and the role
    span = lambda end, size: F.struct((F.col(end) - size("out") + size(line) + 1).alias("start"), (F.col(end) - len(END) - 1).alias("end"))
    learned = F.col("role").isin(*learn_from)
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("end", "out", "role", "text"))).alias("parts"),
        F.sort_array(F.collect_list(F.when(learned, span("end", F.length)))).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(learned, span("octets", F.octet_length)))).alias("loss_octets"),
    )
    made = grouped.withColumn("formatted", F.array_join(F.col("parts.out"), ""))
    source = F.transform("parts", lambda p: F.struct(p.role.alias("role"), p.text.alias("text")))
    lost = F.raise_error(F.lit("a conversation does not come back from its rendering")).cast("string")
    exact = F.when(parse_chat(F.col("formatted")).eqNullSafe(source), F.col("formatted")).otherwise(lost)
    return made.select("conv_id", exact.alias("formatted"), "loss_spans", "loss_octets")


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the formatted text gives when it is read back: turns by the parser, learned text by the mask. Parts of the
    text are cut by byte, which needs no count from its start."""
    octets = F.encode("formatted", "UTF-8")
    learned = let(octets, lambda b: F.array_join(F.transform("loss_octets", lambda s: unescape(F.decode(F.substr(b, (s.start + 1).cast("int"), (s.end - s.start).cast("int")), "UTF-8"))), ""))
    read = chats.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), learned.alias("learned"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
