"""Chat formatting of event-sourced conversations, with DataFrame functions only.

A log row is an event of a message (``msg``) of a conversation: ``message``, ``edit`` and ``regenerate`` set its whole
text, ``delta`` adds to it. Sorted by sequence number, the last setting event and the deltas after it make the final
text. The fold is associative, so a hot conversation or message is folded block by block before its blocks meet.

Rendering: ``<s>[role]``, line feed, text, ``</s>``, line feed for each turn. In roles and texts the characters
``\\ < [ ]`` are written ``\\b \\l \\o \\c``, so no control string occurs inside them and the output can be read back.

Null text and null role count as empty; a null conversation id is a conversation of its own; null sequence numbers sort
first. Events of equal sequence number are ordered by kind, role and text; every repeated row is an event of its own.
An unknown or null kind counts as ``message``. Other columns of the log are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character and its code, in the order of escaping; unescaping goes backwards.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))
#: Sequence numbers of one block, which one task folds or joins at a time.
BLOCK = 512


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_events(log: DataFrame, conv: str = "conv_id", msg: str = "msg", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The final messages: conv_id, msg, part, role, text.

    ``part`` counts the ``message`` events of one msg, which are messages of their own. An ``edit`` or ``regenerate``
    replaces role and text of the one before it, a ``delta`` adds text; with none before it, either makes one.
    """
    rows = log.select(
        F.col(conv).alias("conv_id"), F.col(msg).alias("msg"), F.floor(F.col(seq) / block).alias("b"),
        F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"), _text(role).alias("role"), _text(text).alias("text")).alias("e"),
    )
    made = lambda fresh, whole, role, parts: F.struct(fresh.alias("fresh"), whole.alias("whole"), role.alias("role"), parts.alias("parts"))
    none = F.array().cast("array<struct<fresh:boolean,whole:boolean,role:string,parts:array<string>>>")

    def continued(done: Column, x: Column) -> Column:
        """``x`` edits or extends the last message of ``done``."""
        last = F.element_at(done, -1)
        new = F.when(x.whole, made(last.fresh, F.lit(True), x.role, x.parts)).otherwise(made(last.fresh, last.whole, last.role, F.concat(last.parts, x.parts)))
        return F.when(F.size(done) == 0, F.array(x)).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(new)))

    def event(done: Column, e: Column) -> Column:
        change = made(F.lit(False), e.kind.isin("edit", "regenerate"), e.role, F.array(e.text))
        return F.when(e.kind.isin("edit", "regenerate", "delta"), continued(done, change)).otherwise(F.concat(done, F.array(made(F.lit(True), F.lit(True), e.role, F.array(e.text)))))

    def meet(done: Column, x: Column) -> Column:
        first = F.element_at(x.s, 1)
        return F.when(first.fresh, F.concat(done, x.s)).otherwise(F.concat(continued(done, first), F.slice(x.s, F.lit(2), F.size(x.s))))

    joined = lambda done: F.transform(done, lambda x: made(x.fresh, x.whole, x.role, F.array(F.array_join(x.parts, ""))))
    blocks = rows.groupBy("conv_id", "msg", "b").agg(F.aggregate(F.sort_array(F.collect_list("e")), none, event, joined).alias("s"))
    final = blocks.groupBy("conv_id", "msg").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("b", "s"))), none, meet, joined).alias("s"))
    return final.select("conv_id", "msg", F.posexplode("s").alias("part", "m")).select("conv_id", "msg", "part", F.col("m.role").alias("role"), F.element_at("m.parts", 1).alias("text"))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant", block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans. Turns of equal number are ordered by role and text.

    ``loss_spans`` has for each turn (start, length, learn): where its escaped text stands in ``formatted``, in code
    points from 0, and whether the role is ``learn``. Each turn is rendered by itself and joined to blocks of turns
    first, so only the finished blocks of a conversation meet in one task.
    """
    head = F.concat(F.lit("<s>["), escape(_text(role)), F.lit("]\n"))
    body = escape(_text(text))
    each = turns.select(
        F.col(conv).alias("conv_id"), F.floor(F.col(turn) / block).alias("b"),
        F.struct(F.col(turn).alias("turn"), _text(role).alias("role"), F.concat(head, body, F.lit("</s>\n")).alias("t"), F.length(head).alias("head"), F.length(body).alias("body")).alias("e"),
    )
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = lambda sizes: F.aggregate(sizes, empty, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s.starts, F.array(s["at"])).alias("starts")), lambda s: s.starts)
    blocks = each.groupBy("conv_id", "b").agg(F.sort_array(F.collect_list("e")).alias("es")).select(
        "conv_id", "b",
        F.array_join(F.transform("es", lambda e: e.t), "").alias("t"),
        F.zip_with("es", starts(F.transform("es", lambda e: F.length(e.t).cast("long"))), lambda e, at: F.struct((at + e.head).alias("start"), e.body.cast("long").alias("length"), (e.role == learn).alias("learn"))).alias("spans"),
    )
    return blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("b", "t", "spans"))).alias("bs")).select(
        "conv_id",
        F.array_join(F.transform("bs", lambda b: b.t), "").alias("formatted"),
        F.flatten(F.zip_with("bs", starts(F.transform("bs", lambda b: F.length(b.t).cast("long"))), lambda b, at: F.transform(b.spans, lambda s: F.struct((at + s.start).alias("start"), s.length.alias("length"), s.learn.alias("learn"))))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: ARRAY<STRUCT<role, body, text>>, ``body`` as it stands there, the others unescaped."""
    # "<" and "[" stand only in control strings, "]" only after a role
    parts = F.slice(F.split(formatted, "<s>\\["), 2, 2147483646)

    def one(part: Column) -> Column:
        role = F.substring_index(part, "]\n", 1)
        body = F.substring(part, F.length(role) + 3, F.length(part) - F.length(role) - F.lit(7))
        return F.struct(unescape(role).alias("role"), body.alias("body"), unescape(body).alias("text"))

    return F.transform(parts, one)


def masked(formatted: Column, loss_spans: Column, cut: int = 32_768) -> Column:
    """The texts under the loss mask, cut out of the formatted text by start and length, unescaped and joined.

    The text is first cut to parts of ``cut`` characters, so that a span costs no more than the parts that it touches.
    """
    parts = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{cut}}}"), F.lit(0))

    def under(part: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s.start / cut).cast("int")
            touched = F.floor((s.start + s.length - 1) / cut).cast("int") - first + 1
            return unescape(F.substring(F.array_join(F.slice(part, first + 1, touched), ""), (s.start - first * F.lit(cut)).cast("int") + 1, s.length.cast("int")))

        return F.array_join(F.transform(F.filter(loss_spans, lambda s: s.learn & (s.length > 0)), one), "")

    return F.element_at(F.transform(F.array(parts), under), 1)
