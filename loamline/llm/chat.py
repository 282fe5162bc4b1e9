"""Chat formatting with Spark expressions only: collected turns, merged blocks, one string a conversation.

Template.  A block of adjacent turns of one role becomes one message::

    [SYS]text[/SYS]   [INST]text[/INST]   <s>text</s>   [ROLE:name]text[/ROLE]

for system, user, assistant and any other role.  Turns merged into a block stay apart by the
joint ``\\+``.  Inside texts the escape character and every opening bracket are written as a
code (``\\`` as ``\\b``, ``[`` as ``\\o``, ``<`` as ``\\l``), so that no control string of the
template, nor the joint, can arise from a text, and reading back is exact.

A conversation is one output row, so its turns meet in one task; that bound is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import quoted

JOINT = "\\+"
# (character, code), in the order of escaping; undone in the reverse order.
TEXT_CODES = (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"))
# Role names also lose the bracket that ends their marker.
NAME_CODES = (*TEXT_CODES, ("]", "\\c"))
KNOWN = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE:", "[/ROLE]")
LOSS_ROLE = "assistant"
# Array elements handled together where a running state is built, so that work stays in proportion.
CHUNK = 256


def _coded(text: Column, codes) -> Column:
    for char, code in codes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _decoded(text: Column, codes) -> Column:
    for char, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def escape(text: Column) -> Column:
    return _coded(text, TEXT_CODES)


def unescape(text: Column) -> Column:
    return _decoded(text, TEXT_CODES)


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), _coded(role, NAME_CODES), F.lit("]"))
    for name, (start, _) in KNOWN.items():
        out = F.when(role == name, F.lit(start)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, end) in KNOWN.items():
        out = F.when(role == name, F.lit(end)).otherwise(out)
    return out


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one struct (role, body).

    Block starts meet their ends side by side, so each turn is looked at a fixed number of times.
    """
    last = F.size(turns) - 1
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    stops = F.concat(F.slice(starts, F.lit(2), last + 1), F.array(last + 1))

    def block(start: Column, stop: Column) -> Column:
        texts = F.transform(F.slice(turns, start + 1, stop - start), lambda t: escape(t["text"]))
        return F.struct(F.get(turns, start)["role"].alias("role"), F.array_join(texts, JOINT).alias("body"))

    return F.zip_with(starts, stops, block)


def _chunked(items: Column) -> Column:
    """The array cut into arrays of CHUNK elements; an empty one gives one empty array."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))


def _mask(blocks: Column) -> Column:
    """Spans of the loss blocks' bodies in the formatted string: code points from 0, and how many.

    Spans are placed inside chunks of blocks, which are then moved by the sizes of those before them.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, b: Column) -> Column:
        start = state["at"] + F.length(_opening(b["role"]))
        size = F.length(b["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + F.length(_closing(b["role"]))).alias("at"),
            F.when(b["role"] == LOSS_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    parts = F.transform(_chunked(blocks), lambda c: F.aggregate(c, empty, step))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("shifts"))
    shifts = F.aggregate(
        parts,
        begin,
        lambda state, p: F.struct(
            (state["at"] + p["at"]).alias("at"), F.concat(state["shifts"], F.array(state["at"])).alias("shifts")
        ),
        lambda state: state["shifts"],
    )

    def moved(part: Column, shift: Column) -> Column:
        return F.transform(
            part["spans"], lambda m: F.struct((m["start"] + shift).alias("start"), m["length"].alias("length"))
        )

    return F.flatten(F.zip_with(parts, shifts, moved))


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_mask``.

    ``loss_mask`` holds one span (start, length, in code points) per block of assistant turns.
    NULL role and text count as empty; a NULL conversation id is a conversation of its own;
    NULL turn numbers come first; ties are ordered by role, then text, and repeated rows are
    repeated turns.  Other columns are ignored.  No rows give no rows.  Work grows in proportion to the
    turns of a conversation.
    """
    row = F.struct(
        quoted(turn).alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
    )
    gathered = (
        turns.select(quoted(conv_id).alias(conv_id), row.alias("row"))
        .groupBy(quoted(conv_id))
        .agg(F.sort_array(F.collect_list("row")).alias("turns"))
    )
    blocks = gathered.select(quoted(conv_id), _blocks(F.col("turns")).alias("blocks"))
    messages = F.transform(
        F.col("blocks"), lambda b: F.concat(_opening(b["role"]), b["body"], _closing(b["role"]))
    )
    return blocks.select(
        quoted(conv_id), F.array_join(messages, "").alias("formatted"), _mask(F.col("blocks")).alias("loss_mask")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text), the inverse of the template."""
    pieces = F.filter(
        F.regexp_extract_all(formatted, F.lit(r"[\[<][^\[<]*"), F.lit(0)),
        lambda p: ~(p.startswith("[/") | p.startswith("</")),
    )

    def opened(p: Column) -> Column:
        square = p.startswith("[")
        head = F.when(square, F.instr(p, "]")).otherwise(F.instr(p, ">"))
        role = _decoded(p.substr(F.lit(len(OTHER[0]) + 1), head - len(OTHER[0]) - 1), NAME_CODES)
        for name, (start, _) in KNOWN.items():
            role = F.when(p.startswith(start), F.lit(name)).otherwise(role)
        parts = F.split(p.substr(head + 1, F.length(p)), r"\\\+")
        return F.transform(parts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(pieces, opened))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, one array element per assistant turn.

    The spans ascend. Those of a chunk are cut from the stretch that holds them all, so that the
    string is not counted through from its start for each of them.
    """

    def stretch(spans: Column) -> Column:
        first, last = F.get(spans, F.lit(0)), F.get(spans, F.size(spans) - 1)
        held = formatted.substr(first["start"] + 1, last["start"] + last["length"] - first["start"])
        return F.struct(held.alias("held"), first["start"].alias("first"), spans.alias("spans"))

    def texts(c: Column) -> Column:
        cut = F.transform(c["spans"], lambda m: c["held"].substr(m["start"] - c["first"] + 1, m["length"]))
        return F.flatten(F.transform(cut, lambda s: F.transform(F.split(s, r"\\\+"), unescape)))

    return F.flatten(F.transform(F.transform(_chunked(mask), stretch), texts))
