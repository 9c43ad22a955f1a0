"""Chat formatting with typed content parts, in DataFrame functions only.

Input rows are turns ``(conv_id, turn, role, parts)``; a part is a struct of
``kind`` (text, image, audio, document), ``text``, ``uri`` and ``amount`` (image
tiles, audio seconds or document pages).  Each kind is visited by its own rule:
text is escaped and kept, every other kind becomes one placeholder that the
model later expands, and its uri, turn, place among the turn's parts and expanded
token count are recorded in ``attachments``, in order.

Escaping: every ``<`` + n backslashes + ``|`` gets one backslash more, so no
text or role can hold a control string and one backslash less restores it.
Adjacent text parts are escaped as one text, so no control string can arise where
they meet.  In roles, backslashes and line feeds are escaped first.  Reading back tells a
placeholder from text that looks like one: texts stand between placeholders.

Defined results: null text is empty; a null part list has no parts; a null or
unknown kind counts as text; adjacent texts read back as one; null roles are empty; null amounts are one unit;
turns are ordered by (turn, role, content), nulls first; repeated rows are
repeated turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image_pad|>", "audio": "<|audio_pad|>", "document": "<|document_pad|>"}
#: Tokens that one unit (tile, second, page) of a kind expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def text_part(text: Column) -> Column:
    """The content of a plain text turn: an array of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("uri"),
            F.lit(None).cast("int").alias("amount"),
        )
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # A doubled backslash is parked as \x01 (\x01 itself as \x01\x01 never occurs: it is doubled first).
    raw = unescape(role)
    pieces = F.split(raw, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _is(kind: Column, name: str) -> Column:
    return F.coalesce(kind == name, F.lit(False))


def _typed(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*PLACEHOLDER), F.lit(False))


def visit(part: Column) -> Column:
    """One part that is no text as its placeholder."""
    out = F.lit("")
    for kind, mark in PLACEHOLDER.items():
        out = F.when(_is(part["kind"], kind), F.lit(mark)).otherwise(out)
    return out


def content_of(parts: Column) -> Column:
    """The parts of a turn as text of the template: runs of text escaped whole, placeholders between them."""
    n = F.size(parts)
    at = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | _typed(F.get(parts, i - 1)))  # 1-based places of placeholders, and 0

    def run(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(at, k + 1), n + 1)
        texts = F.transform(F.slice(parts, i + 1, end - i - 1), lambda p: F.coalesce(p["text"], F.lit("")))
        return F.concat(F.when(i > 0, visit(F.get(parts, i - 1))).otherwise(""), escape(F.array_join(texts, "")))

    return F.when(n == 0, "").otherwise(F.array_join(F.transform(at, run), ""))


def expanded(part: Column) -> Column:
    """Tokens that a placeholder expands to; 0 for text."""
    out = F.lit(0).cast("long")
    for kind, each in TOKENS_PER_UNIT.items():
        out = F.when(_is(part["kind"], kind), F.coalesce(part["amount"], F.lit(1)).cast("long") * each).otherwise(out)
    return out


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments, expanded_tokens, n_turns.

    loss_mask is run-length coded over the code points of ``formatted``: three
    runs per turn (head, content, tail), each a length and whether it is learned.
    attachments: (kind, uri, turn, place, tokens); turn counts the turns of the conversation
    from 0, place the parts of the turn from 0.
    One shuffle: turns are gathered by conversation with partial lists per task.
    """
    parts = F.coalesce(F.col("parts"), F.array())
    content = content_of(parts)
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    attachments = F.transform(
        F.filter(placed, lambda x: _typed(x["p"])),
        lambda x: F.struct(x["p"]["kind"].alias("kind"), x["p"]["uri"].alias("uri"), x["i"].alias("place"), expanded(x["p"]).alias("tokens")),
    )
    seen = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            content.alias("content"),
            attachments.alias("attachments"),
        ).alias("t"),
    )
    held = seen.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def head(t):
        return F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))

    tail = END + "\n"
    run = lambda n, learned: F.struct(n.cast("long").alias("n"), learned.alias("learned"))
    return held.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["content"], F.lit(tail))), "").alias("formatted"),
        F.flatten(
            F.transform(
                "ts",
                lambda t: F.array(
                    run(F.length(head(t)), F.lit(False)),
                    run(F.length(t["content"]), t["role"].isin(*loss_roles)),
                    run(F.lit(len(tail)), F.lit(False)),
                ),
            )
        ).alias("loss_mask"),
        F.flatten(
            F.transform(
                "ts",
                lambda t, i: F.transform(t["attachments"], lambda a: F.struct(a["kind"].alias("kind"), a["uri"].alias("uri"), i.alias("turn"), a["place"].alias("place"), a["tokens"].alias("tokens"))),
            )
        ).alias("attachments"),
        F.aggregate(
            F.flatten(F.transform("ts", lambda t: F.transform(t["attachments"], lambda a: a["tokens"]))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ).alias("expanded_tokens"),
        F.size("ts").cast("long").alias("n_turns"),
    )


_MARKS = "|".join(m.replace("|", r"\|") for m in PLACEHOLDER.values())


def _texts(raw: Column) -> Column:
    """The texts before, between and after the placeholders of a content, unescaped."""
    return F.transform(F.split(raw, _MARKS, -1), unescape)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text, parts, piece).

    parts: (kind, text) in order, a text before and after every placeholder (maybe empty); text joins the texts.
    The i-th placeholder of a conversation is the i-th of its attachments.
    """
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p):
        at = F.instr(p, "\n")
        raw = F.substr(p, at + 1, F.length(p) - at - len(END) - 1)
        marks = F.regexp_extract_all(raw, F.lit(f"({_MARKS})"), F.lit(1))
        kind = F.lit(None).cast("string")
        named = lambda m: F.coalesce(*(F.when(m == v, F.lit(k)) for k, v in PLACEHOLDER.items()), kind)
        part = lambda k, t: F.struct(k.alias("kind"), t.alias("text"))
        both = lambda t, i: F.when(i == 0, F.array(part(F.lit("text"), t))).otherwise(F.array(part(named(F.get(marks, i - 1)), F.lit("")), part(F.lit("text"), t)))
        texts = _texts(raw)
        return F.struct(
            unescape_role(F.substr(p, F.lit(1), at - 1)).alias("role"),
            F.array_join(texts, "").alias("text"),
            F.flatten(F.transform(texts, both)).alias("parts"),
            p.alias("piece"),
        )

    return F.transform(pieces, turn)


def learned_text(turns_read: Column, loss_mask: Column) -> Column:
    """Text under the loss mask, unescaped and without placeholders, run by run in order."""

    def under(t, i):
        head = F.element_at(loss_mask, 3 * i + 1)["n"] - len(START)
        body = F.element_at(loss_mask, 3 * i + 2)
        return F.when(body["learned"], F.array_join(_texts(F.substr(t["piece"], (head + 1).cast("int"), body["n"].cast("int"))), "")).otherwise("")

    return F.array_join(F.transform(turns_read, under), "")
