"""Chat formatting from event logs, in DataFrame functions only.

A log holds events of conversations in a sequence. Folding them gives the final messages: message begins one, delta
appends to the turn's current message, edit replaces its text, regenerate empties it and drops all that came before
it in later turns. Messages are rendered by a template whose control strings are escaped reversibly inside texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick

OPEN, SEP, CLOSE = "### ", ":\n", "</turn>\n"
#: What texts may not hold as it is, and what stands for it. Backslashes come first when escaping and last when reading.
ESCAPES = (("</turn>", "\\e"), ("### ", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: The role whose texts are under the loss mask.
TRAINED_ROLE = "assistant"
#: Turns that are rendered in one piece before a conversation's pieces are joined.
PIECE = 256


def escape(text: Column, table: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, code in table:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column, table: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Escaped backslashes are pairs, and pairs are found from the left; between them a backslash begins a code."""

    def part(x: Column) -> Column:
        for raw, code in table:
            x = F.replace(x, F.lit(code), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def as_events(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log of whole messages: one event for each row, in the order of turns. Rows of one turn are messages of their own."""
    d = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return d.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def as_streamed(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log as a chat server would have written it: each row's text comes after a draft, in three deltas.

    A row of the trained role is begun with a draft, regenerated and streamed; another one is begun with a draft that is
    edited into its first third, and the rest follows. Rows of one turn follow each other by role and text; rows of a
    null turn come first.
    """
    d = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    d = d.withColumn("row", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))))
    text = F.coalesce(F.col("text"), F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    a, b, c = (F.substring(text, F.lit(i) * third + 1, third) for i in range(3))
    draft = F.reverse(F.substring(text, 1, 24))
    say = lambda i, kind, x: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), x.alias("text"))
    none = F.lit(None).cast("string")
    again = F.array(say(0, "message", draft), say(1, "delta", F.lit(" draft")), say(2, "regenerate", none), say(3, "delta", a), say(4, "delta", b), say(5, "delta", c))
    edited = F.array(say(0, "message", draft), say(1, "edit", a), say(2, "delta", b), say(3, "delta", c))
    e = d.select("conv_id", "turn", "row", "role", F.explode(F.when(F.col("role") == TRAINED_ROLE, again).otherwise(edited)).alias("e"))
    seq = F.struct(F.col("turn").alias("turn"), F.col("row").alias("row"), F.col("e.i").alias("i"))
    return e.select("conv_id", "turn", seq.alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text: the messages that the log of events (conv_id, turn, seq, kind, role, text) ends in.

    Events with a null kind are messages. A turn with several message events has as many messages (part counts them from 1);
    the other kinds apply to the turn's latest one, or begin one if there is none. Null texts are empty, null roles are
    empty. Null conversations are one conversation, null turns come first, ties of seq go by kind (messages first), role and text;
    seq may be of any type that has an order. An empty log gives no messages; very long texts are texts like others.
    Only a message's own events meet in one group: what a conversation's turns have to know of each other, which
    is when they were regenerated, is looked up without their texts.
    """
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    e = pick(events, conv_id="conv_id", turn="turn", seq="seq", kind="kind", role="role", text="text")
    e = e.select("conv_id", "turn", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rank", rank)
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "rank", "role", "text")
    own = order.rowsBetween(Window.unboundedPreceding, 0)
    begun = (F.first("kind").over(own) != "message").cast("int")  # by another event than a message
    e = e.withColumn("part", F.sum((F.col("kind") == "message").cast("int")).over(own) + begun).withColumn("pos", F.row_number().over(order))
    at = F.struct("seq", "rank", "pos")
    reset = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "rank", "pos")))
    turns = e.groupBy("conv_id", "turn", "part").agg(
        reset.alias("from"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.min_by("role", F.when(F.col("role") != "", at)).alias("role"),
        F.collect_list(F.struct("seq", "rank", "pos", "kind", "text")).alias("log"),
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("part").alias("p"), F.max("again").over(earlier.partitionBy("conv_id")).alias("dropped")).where("dropped IS NOT NULL")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    turns = turns.join(before, same, "left")
    live = F.filter(
        F.array_sort("log"),
        lambda x: (F.col("from").isNull() | (F.struct(x["seq"], x["rank"], x["pos"]) >= F.col("from"))) & (x["kind"] != "regenerate") & (F.col("dropped").isNull() | x["seq"].isNull() | (x["seq"] > F.col("dropped"))),
    )
    kept = turns.withColumn("live", live).where((F.size("live") > 0) | F.col("dropped").isNull() | (F.col("again") > F.col("dropped")))
    return kept.select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"))


def render_pieces(messages: DataFrame) -> DataFrame:
    """conv_id, piece, s, spans: the messages of PIECE turns each, rendered; spans has null for turns of other roles."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(SEP))
    body = escape(F.col("text"))
    known = F.col("turn").isNotNull()
    at = F.struct(known.alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("part").alias("part"))
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end")))
    m = messages.select("conv_id", F.struct(known.alias("known"), F.expr(f"coalesce(turn, 0) div {PIECE}").alias("n")).alias("piece"), at.alias("at"), F.concat(head, body, F.lit(CLOSE)).alias("s"), span.alias("span"))
    rows = F.array_sort(F.collect_list(F.struct("at", "s", "span")))
    pieces = m.groupBy("conv_id", "piece").agg(rows.alias("rows"))
    return pieces.select("conv_id", "piece", F.array_join(F.transform("rows", lambda x: x["s"]), "").alias("s"), F.transform("rows", lambda x: x["span"]).alias("spans"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for messages (conv_id, turn, part, role, text), turn a whole number.

    loss_spans names, for each turn of the trained role, the turn's number from 0 and the code points of its escaped text
    from the turn's beginning in the formatted text (end exclusive). Pieces of a bounded number of turns are rendered
    apart, in tasks of their own, and joined; a conversation is one string in the end, and may be as long as a string can be.
    Null turns come first, messages of one turn by part; no message, no row.
    """
    pieces = render_pieces(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "s", "spans"))).alias("pieces"))
    spans = F.flatten(F.transform("pieces", lambda x: x["spans"]))
    numbered = F.transform(spans, lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("turn"), x["start"].alias("start"), x["end"].alias("end"))))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["s"]), "").alias("formatted"), F.filter(numbered, lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_texts, formatted: what a rendered conversation says.

    A null formatted text gives nulls, an empty one no turns; a null conv_id stays null; other columns are left behind.
    """
    pieces = F.split("formatted", CLOSE, -1)
    r = rendered.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        end = F.instr(p, SEP)
        role = F.substring(p, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(p, end + len(SEP), F.length(p))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get(F.col("pieces"), s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return r.select("conv_id", F.transform("pieces", turn).alias("turns"), loss.alias("loss_texts"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rows of read_back, one for each; conversations without a loss text have the digest of the empty one."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
