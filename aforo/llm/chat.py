"""Chat formatting: layouts found by a fingerprint of nested field paths, one reversible template.

A record's shape is its nested field names in order, without types. Its SHA-256
selects a declarative mapping to canonical turns ``(role, text)``. Typed tables
have one shape; JSON records are fingerprinted row by row, so a table may mix
layouts. Records of an unknown shape are kept apart (``unknown_layouts``) and
never dropped silently.

Turns are written as ``<|turn|>role<|text|>text<|end|>``. Control strings inside
roles and texts, of this and of other common templates, get a backslash after
their first character and backslashes are doubled, so the text comes back as it
was and a text cannot end a turn. The loss mask holds character spans of the
assistant texts.

A conversation is kept in segments of ``SEGMENT`` turns: windows and arrays stay
small however long it is, and whatever number of turns shares a place. Only a
digest over a whole conversation has to bring its text together.

Turns are ordered by number (null first), then role and text. Null role or text:
empty. Null id: a conversation of its own. Repeated rows are turns each. Empty
table: no rows. Everything is DataFrame functions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from aforo.llm.common import pick, stored

SEGMENT = 64
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string, of this template and of others.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>|/?start_of_turn>|/?end_of_turn>|bos>|eos>)"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Shapes and the mapping of each, as SQL over the variant ``v``.
LAYOUTS = {
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>": (
        "transform(variant_get(v, '$.messages', 'array<struct<role string, content string>>'), m -> struct(m.role AS role, m.content AS text))"
    ),
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": (
        "transform(variant_get(v, '$.conversations', 'array<struct<`from` string, value string>>'), m -> struct(m.`from` AS role, m.value AS text))"
    ),
    "OBJECT<instruction, output>": (
        "array(struct('user' AS role, variant_get(v, '$.instruction', 'string') AS text),"
        " struct('assistant' AS role, variant_get(v, '$.output', 'string') AS text))"
    ),
    "OBJECT<input, instruction, output>": (
        "array(struct('user' AS role, concat_ws('\n\n', variant_get(v, '$.instruction', 'string'),"
        " nullif(variant_get(v, '$.input', 'string'), '')) AS text),"
        " struct('assistant' AS role, variant_get(v, '$.output', 'string') AS text))"
    ),
    "OBJECT<completion, prompt>": (
        "array(struct('user' AS role, variant_get(v, '$.prompt', 'string') AS text),"
        " struct('assistant' AS role, variant_get(v, '$.completion', 'string') AS text))"
    ),
    "OBJECT<prompt, response>": (
        "array(struct('user' AS role, variant_get(v, '$.prompt', 'string') AS text),"
        " struct('assistant' AS role, variant_get(v, '$.response', 'string') AS text))"
    ),
    # a row per turn
    "OBJECT<role, text>": "array(struct(variant_get(v, '$.role', 'string') AS role, variant_get(v, '$.text', 'string') AS text))",
}


def shape_of(kind: DataType) -> str:
    """The nested field names of a type, sorted, in the notation of :func:`shape_column`."""
    if isinstance(kind, StructType):
        inner = [(f.name, shape_of(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return f"OBJECT<{', '.join(n + (f': {s}' if s else '') for n, s in inner)}>"
    if isinstance(kind, ArrayType):
        return f"ARRAY<{shape_of(kind.elementType)}>"
    return ""


def shape_column(variant: Column) -> Column:
    """The same of each row's variant: its schema without the scalar types."""
    scalar = r":? ?\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(variant), scalar, "")


def fingerprint(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def _canonical(role: Column) -> Column:
    named = role
    for theirs, ours in ROLES.items():
        named = F.when(role == theirs, ours).otherwise(named)
    return named


def turns_of_variants(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, role_read)`` of ``(conv_id, first, v)``, each variant mapped by its own fingerprint.

    ``first`` is the number of the record's first turn. ``role`` is canonical,
    ``role_read`` as it stands in the record.
    """
    rows = rows.withColumn("_print", F.sha2(shape_column(F.col("v")), 256))
    turns = F.expr("CAST(NULL AS array<struct<role string, text string>>)")
    for shape, mapping in LAYOUTS.items():
        turns = F.when(F.col("_print") == fingerprint(shape), F.expr(mapping)).otherwise(turns)
    found = rows.select("conv_id", "first", F.posexplode(turns).alias("_n", "_t"))
    role, turn = F.col("_t.role"), (F.col("first") + F.col("_n")).cast("long")
    return found.select("conv_id", turn.alias("turn"), _canonical(role).alias("role"), F.col("_t.text").alias("text"), role.alias("role_read"))


def turns_of_json(records: DataFrame, conv_id: str, json: str) -> DataFrame:
    """:func:`turns_of_variants` of JSON records."""
    return turns_of_variants(pick(records, conv_id=conv_id, _json=json).select("conv_id", F.lit(0).alias("first"), F.try_parse_json("_json").alias("v")))


def variants_of_table(records: DataFrame, conv_id: str, turn: str | None, fields: list[str]) -> DataFrame:
    """``(conv_id, first, v)`` of typed records; ``turn`` names their number, if a record is one turn."""
    record = F.struct(*[F.col(f"`{c}`").alias(c) for c in fields])
    first = F.lit(0) if turn is None else F.col(f"`{turn}`")
    return records.select(F.col(f"`{conv_id}`").alias("conv_id"), first.cast("long").alias("first"), F.to_variant_object(record).alias("v"))


def unknown_layouts(records: DataFrame, conv_id: str, json: str) -> DataFrame:
    """Ids and fingerprints of the records that no mapping fits, or that are no JSON."""
    rows = pick(records, conv_id=conv_id, _json=json)
    shape = shape_column(F.try_parse_json("_json"))
    known = [fingerprint(s) for s in LAYOUTS]
    return rows.withColumn("fingerprint", F.sha2(shape, 256)).filter(
        F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known)
    ).select("conv_id", "fingerprint")


def turns_of_table(records: DataFrame, conv_id: str, turn: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """:func:`turns_of_variants` of typed records in any known layout.

    ``fields`` names the columns of the record (default: all but id and turn).
    With ``turn`` the table has a row per turn.
    """
    fields = fields or [c for c in records.columns if c not in (conv_id, turn)]
    shape = shape_of(records.select(*[F.col(f"`{c}`") for c in fields]).schema)
    if fingerprint(shape) not in {fingerprint(s) for s in LAYOUTS}:
        raise ValueError(f"no mapping for records of shape {shape}")
    return turns_of_variants(variants_of_table(records, conv_id, turn, fields))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, trained: str = "assistant", segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, segment, part, formatted, loss)``; ``loss`` has spans ``(start, end)`` in ``formatted``."""
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    # null numbers come first
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 62))))
    place = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumns({"_n": F.row_number().over(place), "_head": head, "_body": escape(F.col("text"))})
    rows = rows.withColumn("part", F.floor((F.col("_n") - 1) / segment))
    inside = Window.partitionBy("conv_id", "segment", "part").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("_head") + F.length("_body") + len(END)
    start = F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.length("_head")
    span = F.when(F.col("role") == trained, F.struct(start.alias("start"), (start + F.length("_body")).alias("end")))
    rows = rows.withColumns({"_span": span, "_piece": F.concat("_head", "_body", F.lit(END))})
    joined = rows.groupBy("conv_id", "segment", "part").agg(F.sort_array(F.collect_list(F.struct("_n", "_piece", "_span"))).alias("_all"))
    return joined.select(
        "conv_id",
        "segment",
        "part",
        F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"),
        F.filter(F.transform("_all", lambda x: x["_span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def parse_segments(segments: DataFrame) -> DataFrame:
    """Read the output: ``(conv_id, segment, part, turns, loss_texts)`` with texts as they were."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    pair = F.transform(blocks, lambda b: F.split(b, r"<\|text\|>"))
    role = lambda p: unescape(F.substring(p[0], len(TURN) + 1, 1 << 30))
    turns = F.transform(pair, lambda p: F.struct(role(p).alias("role"), unescape(p[1]).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return segments.select("conv_id", "segment", "part", turns.alias("turns"), masked.alias("loss_texts"), F.length("formatted").alias("chars"))


def conversation_digests(segments: DataFrame) -> DataFrame:
    """A row per conversation from its stored segments: counts and digests of turns and loss texts."""
    parsed = parse_segments(segments)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = parsed.select("conv_id", "segment", "part", "chars", F.size("turns").alias("n"), turns.alias("t"), F.array_join("loss_texts", "").alias("l"))
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum(F.length("l")).cast("long").alias("loss_chars"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("segment", "part", "t", "l"))).alias("_all"),
    )
    digest = lambda name: F.sha2(F.array_join(F.transform("_all", lambda x: x[name]), ""), 256)
    return whole.select(
        "conv_id", "n_turns", digest("t").alias("turns_sha256"), "loss_chars", digest("l").alias("loss_sha256"), "formatted_chars"
    )


def stored_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """The formatted segments as a table in the scratch folder."""
    return stored(format_turns(turns, trained), "chat-segments")
