"""Chat formatting with DataFrame functions only: layouts are recognised by a fingerprint of their field paths."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema, lower-case: ``a.b`` for nested fields, ``a[]`` for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """Declarative mapping of one record layout to turns.

    ``rows``: one row per turn; ``fields`` = (turn, role, text). ``messages``: an array of turns; ``fields`` =
    (array, role, text). ``fixed``: one field per turn; ``fields`` = (role, field) pairs, fields that are null give no
    turn. ``aliases`` renames roles.
    """

    name: str
    kind: str
    fields: tuple
    aliases: tuple = ()

    def paths(self) -> list[str]:
        if self.kind == "rows":
            return list(self.fields)
        if self.kind == "messages":
            return [f"{self.fields[0]}[].{self.fields[1]}", f"{self.fields[0]}[].{self.fields[2]}"]
        return [field for _, field in self.fields]


_SHORT = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("turn_rows", "rows", ("turn", "role", "text")),
    Layout("messages", "messages", ("messages", "role", "content")),
    Layout("conversations", "messages", ("conversations", "from", "value"), _SHORT),
    Layout("instruction", "fixed", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", "fixed", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", "fixed", (("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", "fixed", (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
)


def choose_layout(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema's paths give, or else contain: of several the one with the most paths, on
    ties the first of the list. So columns beside a layout, named like fields of another or not, do not matter."""
    mine = set(field_paths(schema))
    known = {p for layout in layouts for p in layout.paths()}
    exact = fingerprint([p for p in mine if p in known])
    best = None
    for layout in layouts:
        own = layout.paths()
        if fingerprint(own) == exact:
            return layout
        if fingerprint([p for p in own if p in mine]) == fingerprint(own) and (best is None or len(set(own)) > len(set(best.paths()))):
            best = layout
    if best is None:
        raise ValueError(f"no layout has the paths {sorted(mine & known)}")
    return best


def _role(value: Column, layout: Layout) -> Column:
    role = F.coalesce(value.cast("string"), F.lit(""))
    for old, new in layout.aliases:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def turns(df: DataFrame, key: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text): canonical turns of a table in any known layout; one row per turn."""
    layout = choose_layout(df.schema, layouts)
    conv = F.col(key).cast("long").alias("conv_id")
    if layout.kind == "rows":
        turn, role, text = layout.fields
        return df.select(conv, F.col(turn).cast("long").alias("turn"), _role(F.col(role), layout).alias("role"),
                         _text(F.col(text)).alias("text"))
    if layout.kind == "messages":
        array, role, text = layout.fields
        rows = df.select(conv, F.posexplode(F.col(array)).alias("turn", "_m"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("_m")[role], layout).alias("role"),
                           _text(F.col("_m")[text]).alias("text"))
    parts = F.array(*[
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(field).cast("string").alias("text"))
        for i, (role, field) in enumerate(layout.fields)
    ])
    return df.select(conv, F.explode(parts).alias("_m")).select("conv_id", "_m.*").filter(F.col("text").isNotNull())


_SCALAR = r"\b(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|BINARY|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\s*\d+\))"


def _shape(layout: Layout) -> str:
    """How ``schema_of_variant`` writes the layout, with every scalar as ``*``: fields in order of name."""
    if layout.kind == "messages":
        inner = ", ".join(f"{f}: *" for f in sorted(layout.fields[1:]))
        return f"OBJECT<{layout.fields[0]}: ARRAY<OBJECT<{inner}>>>"
    return "OBJECT<" + ", ".join(f"{f}: *" for f in sorted(f for _, f in layout.fields)) + ">"


def _from_messages(x: Layout) -> Column:
    array, role, text = x.fields
    found = F.try_variant_get("_v", f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>")
    return F.transform(found, lambda m, i: F.struct(
        i.cast("long").alias("turn"), _role(m[role], x).alias("role"), _text(m[text]).alias("text")))


def _from_fields(x: Layout) -> Column:
    return F.filter(F.array(*[
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.try_variant_get("_v", f"$.{field}", "string").alias("text"))
        for i, (role, field) in enumerate(x.fields)
    ]), lambda m: m["text"].isNotNull())


def turns_from_json(df: DataFrame, record: str = "record", key: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) from JSON texts whose layout differs from row to row.

    Each record's own shape is hashed and selects its mapping. Records of unknown shape, broken JSON and nulls come
    back as one row with turn, role and text null, so none is lost unseen. Shapes count all fields of a record.
    """
    usable = [x for x in layouts if x.kind != "rows"]
    rows = df.select(F.col(key).cast("long").alias("conv_id"), F.try_parse_json(F.col(record).cast("string")).alias("_v"))
    shape = F.regexp_replace(F.schema_of_variant("_v"), _SCALAR, "*")
    rows = rows.withColumn("_print", F.sha2(shape, 256))
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    chosen = F.lit(None).cast(kind)
    for x in usable:
        made = _from_messages(x) if x.kind == "messages" else _from_fields(x)
        chosen = F.when(F.col("_print") == hashlib.sha256(_shape(x).encode()).hexdigest(), made.cast(kind)).otherwise(chosen)
    return rows.select("conv_id", F.explode_outer(chosen).alias("_m")).select("conv_id", "_m.turn", "_m.role", "_m.text")


# Template: <s> opens a conversation; each turn is [INST]user[/INST], [SYS]system[/SYS], assistant</s> or
# [ROLE name]text[/ROLE]. Inside names and texts a control string gets a backslash after its first character, one more
# if it has some already, so no control string is left and taking one away restores the text.
_CONTROL = r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|ROLE )"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|ROLE )"
_SEGMENT = r"(?s)\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|\[ROLE .*?\].*?\[/ROLE\]|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_name(role: Column) -> Column:
    """Role names may hold no closing bracket; percent signs and brackets are written as %25 and %5D."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))


def _role_back(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))


def format_chats(canonical: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) from canonical turns.

    ``mask`` is the loss mask: (start, length) in code points of ``formatted``, one span for each assistant text.
    Turns stand in order of turn, then role and text where turns tie; repeated rows stay; null turns come first. A
    conversation is one row, as its template is one string. Rows with a null conv_id form one conversation.
    """
    t = canonical.select("conv_id", "turn", "role", "text")
    text, role = escape(F.col("text")), F.col("role")
    before = (
        F.when(role == "user", F.lit("[INST]")).when(role == "system", F.lit("[SYS]")).when(role == "assistant", F.lit(""))
        .otherwise(F.concat(F.lit("[ROLE "), escape(_role_name(role)), F.lit("]")))
    )
    after = (
        F.when(role == "user", F.lit("[/INST]")).when(role == "system", F.lit("[/SYS]"))
        .when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/ROLE]"))
    )
    t = t.select("conv_id", F.struct("turn", "role", "text").alias("o"), F.concat(before, text, after).alias("seg"),
                 F.when(role == "assistant", F.length(text)).alias("own"))
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("o", "seg", "own"))).alias("s"))
    # running offsets: one pass over the turns, spans appended only for assistant turns
    state = F.aggregate(
        "s", F.struct(F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["seg"])).alias("at"),
            F.when(x["own"].isNotNull(), F.concat(a["mask"], F.array(F.struct(
                a["at"].alias("start"), x["own"].cast("long").alias("length"))))).otherwise(a["mask"]).alias("mask")))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("s", lambda x: x["seg"]), ""))
    return whole.select("conv_id", formatted.alias("formatted"), state["mask"].alias("mask"))


def read_chats(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Adds ``turns``: array of (role, text) read back from the template."""
    segments = F.regexp_extract_all(F.expr(f"substring({column}, 4)"), F.lit(_SEGMENT), F.lit(0))

    def one(s: Column) -> Column:
        def between(role: str, a: str, b: str):
            return F.struct(F.lit(role).alias("role"), unescape(
                F.substring(s, F.lit(len(a) + 1), F.length(s) - len(a) - len(b))).alias("text"))

        name = F.regexp_extract(s, r"(?s)^\[ROLE (.*?)\]", 1)
        other = F.struct(
            _role_back(unescape(name)).alias("role"),
            unescape(F.substring(s, F.length(name) + 8, F.length(s) - F.length(name) - 14)).alias("text"))
        return (
            F.when(s.startswith("[INST]"), between("user", "[INST]", "[/INST]"))
            .when(s.startswith("[SYS]"), between("system", "[SYS]", "[/SYS]"))
            .when(s.startswith("[ROLE "), other).otherwise(between("assistant", "", "</s>"))
        )

    return formatted.withColumn("turns", F.transform(segments, one))


def loss_text(column: str = "formatted", mask: str = "mask") -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substring(F.col(column), m["start"].cast("int") + 1, m["length"].cast("int")))), "")


def is_control(text: str) -> bool:
    return re.search(_CONTROL, text) is not None
