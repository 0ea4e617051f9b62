"""Chat formatting: records of any known layout become canonical turns, then one marked text.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common templates, fixed values: first character, then the rest.
_HEAD = r"(<|\[)"
_REST = (
    r"(/?s>|/?INST\]|/?<?/?SYS>>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>"
    r"|\|system\|>|\|user\|>|\|assistant\|>|/?bos>|/?eos>|start_of_turn>|end_of_turn>)"
)


def escape(text: Column) -> Column:
    """One more backslash behind the first character of every control string.

    Backslashes that are already there count as part of it, so ``unescape`` gets back any text.
    """
    return F.regexp_replace(text, _HEAD + r"(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"\\(\\*)" + _REST, "$1$2$3")


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``paths`` are the field paths that tell the layout; each turn is
    (role, path of its text), or for a list of messages (path of role, path of text)."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(
        "system_prompt_response",
        ("system", "prompt", "response"),
        (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Layout("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(
        "instruction_input",
        ("instruction", "input", "output"),
        (("user", "instruction+input"), ("assistant", "output")),
    ),
    Layout(
        "system_instruction",
        ("system", "instruction", "output"),
        (("system", "system"), ("user", "instruction"), ("assistant", "output")),
    ),
    Layout("messages", ("messages.role", "messages.content"), messages=("messages", "role", "content")),
    Layout("turns", ("turns.role", "turns.text"), messages=("turns", "role", "text")),
    Layout("conversations", ("conversations.from", "conversations.value"), messages=("conversations", "from", "value")),
)
#: Other names of the canonical roles.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def schema_paths(schema: T.DataType, head: str = "") -> set[str]:
    """Nested field paths of a type; lists do not show in a path."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, head)
    if isinstance(schema, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{head}.{f.name}" if head else f.name) for f in schema.fields))
    return {head}


def _column(record: str, path: str) -> Column:
    column = F.col(record)
    for name in path.split("."):
        column = column.getField(name)
    return column


def fingerprint(record: str, schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the known field paths that a record holds; unknown fields do not change it."""
    there = schema_paths(schema)
    held = [
        F.when(_column(record, p.split(".")[0]).isNotNull(), F.lit(p)) for p in known_paths(layouts) if p in there
    ]
    return _path_hash(F.array_compact(F.array(*held)) if held else F.array().cast("array<string>"))


def _path_hash(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _turns(record: str, layout: Layout) -> Column:
    if layout.messages:
        name, role, text = layout.messages
        return F.transform(
            _column(record, name),
            lambda m: F.struct(m.getField(role).cast("string").alias("role"), m.getField(text).cast("string").alias("text")),
        )

    def content(path: str) -> Column:
        parts = [F.coalesce(_column(record, p).cast("string"), F.lit("")) for p in path.split("+")]
        if len(parts) == 1:
            return parts[0]
        return F.concat(parts[0], *[x for p in parts[1:] for x in (F.when(p != "", F.lit("\n\n")).otherwise(F.lit("")), p)])

    return F.array(*[F.struct(F.lit(role).alias("role"), content(path).alias("text")) for role, path in layout.turns])


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (null if no mapping has the record's fingerprint) and its ``turns``.

    A field counts as present if it is not null. Null texts and roles become empty, known
    other role names become the canonical ones. A null record has no layout and no turns.
    """
    schema = df.schema[record].dataType
    there = schema_paths(schema)
    usable = [x for x in layouts if set(x.paths) <= there]
    mark = F.col("_fingerprint")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in usable:
        same = mark == _path_hash(F.array(*[F.lit(p) for p in sorted(x.paths)]))
        layout = F.when(same, F.lit(x.name)).otherwise(layout)
        turns = F.when(same, _turns(record, x).cast(TURNS)).otherwise(turns)
    role: Callable[[Column], Column] = lambda r: F.coalesce(
        *[F.when(r == old, F.lit(new)) for old, new in ALIASES.items()], r, F.lit("")
    )
    clean = F.transform(
        F.col("_turns"),
        lambda t: F.struct(role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    return (
        df.drop("layout", "turns")
        .withColumn("_fingerprint", fingerprint(record, schema, layouts))
        .withColumn("layout", layout)
        .withColumn("_turns", turns)
        .withColumn("turns", clean)
        .drop("_fingerprint", "_turns")
    )


def formatted(df: DataFrame, learned: str = "assistant") -> DataFrame:
    """Adds ``formatted``, the marked text of ``turns``, and ``loss_mask``: (start, length) in
    code points of each learned turn's escaped text, in order.

    No turns give an empty text; null turns (no known layout) give null.
    """
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE))
    parts = F.transform(
        F.col("turns"),
        lambda t: F.struct(
            head(t).alias("head"), F.concat(escape(t["text"])).alias("body"), (t["role"] == learned).alias("learned")
        ),
    )
    spans = F.aggregate(
        F.col("_parts"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda state, p: F.struct(
            (state["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long").alias("at"),
            F.when(
                p["learned"],
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(p["head"])).cast("long").alias("start"),
                            F.length(p["body"]).cast("long").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
        lambda state: state["spans"],
    )
    whole = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return (
        df.drop("formatted", "loss_mask")
        .withColumn("_parts", parts)
        .withColumn("formatted", whole)
        .withColumn("loss_mask", F.when(F.col("_parts").isNotNull(), spans))
        .drop("_parts")
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, texts and roles as they were."""
    pieces = F.slice(F.split(text, r"<\|im_end\|>"), 1, F.greatest(F.size(F.split(text, r"<\|im_end\|>")) - 1, F.lit(0)))
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>", 2))
    return F.transform(
        halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))
    )


def read_loss(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(
        F.transform(mask, lambda m: unescape(F.substring(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""
    )


def conversations(rows: DataFrame) -> DataFrame:
    """One record per ``conv_id`` from rows by turn, each in the layout that its shape allows.

    The rows of a conversation stand in order of turn, then role and text. A user row and an
    assistant row alone become prompt and response, with a system row before them system,
    prompt and response; odd ids are lists in the from/value layout, the rest role/content.
    A conversation is one record here and in the result, so it has to fit one task.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_rows"))
    roles = F.transform("_rows", lambda r: r["role"])
    pair = F.size("_rows") == 2
    pair &= (roles == F.array(F.lit("user"), F.lit("assistant")))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    odd = F.coalesce(F.col("conv_id") % 2 != 0, F.lit(False))
    text = lambda n: F.element_at("_rows", n)["text"]
    listed = ~pair & ~triple
    record = F.struct(
        F.when(triple, text(1)).alias("system"),
        F.when(pair | triple, text(-2)).alias("prompt"),
        F.when(pair | triple, text(-1)).alias("response"),
        F.when(
            listed & ~odd, F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
        ).alias("messages"),
        F.when(
            listed & odd, F.transform("_rows", lambda r: F.struct(r["role"].alias("from"), r["text"].alias("value")))
        ).alias("conversations"),
    )
    return grouped.select("conv_id", record.alias("record"))
