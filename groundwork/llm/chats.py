"""Chat formatting: records of many layouts become turns, turns become one text with a loss mask.

The nested field paths of a record are hashed; the hash selects a declarative mapping to turns. Records of a typed
table share the paths of its schema, so the mapping is chosen once; records that are JSON texts are mapped row by
row, still by built-in functions only. The text marks turns and escapes whatever in a text looks like a mark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
# What public chat templates use as marks (``<s>``, ``[INST]``, ``<<SYS>>``, ``<|name|>``, and their ends).
MARK = r"(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]+\|>)"
NAMED_ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant"}

# -- layouts --------------------------------------------------------------------------------------

# Every field that a mapping reads, as a JSON record may hold it.
FIELDS = {
    "messages": "array<struct<role: string, content: string>>",
    "conversations": "array<struct<`from`: string, value: string>>",
    "system": "string", "context": "string", "instruction": "string", "input": "string", "output": "string",
    "prompt": "string", "completion": "string", "response": "string", "question": "string", "answer": "string",
}


class Layout(NamedTuple):
    """A mapping from fields to turns: the paths it needs, those it may use, and an SQL expression over ``FIELDS``."""

    name: str
    needed: Sequence[str]
    optional: Sequence[str]
    turns: str


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def _joined(first: str, second: str) -> str:
    """Both texts with an empty line between, or the second alone where the first is empty or null."""
    return rf"if({first} <> '' AND {second} <> '', concat({first}, '\n\n', {second}), concat(coalesce({first}, ''), coalesce({second}, '')))"


def _pair(question: str, answer: str) -> str:
    return f"array({_turn('user', question)}, {_turn('assistant', answer)})"


def _with_system(turns: str) -> str:
    return f"if(system <> '', concat(array({_turn('system', 'system')}), {turns}), {turns})"


LAYOUTS = [
    Layout("messages", ["messages", "messages[].role", "messages[].content"], [],
           "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from and value", ["conversations", "conversations[].from", "conversations[].value"], ["system"],
           _with_system("transform(conversations, m -> named_struct('role', m.`from`, 'text', m.value))")),
    Layout("instruction", ["instruction", "output"], ["input", "system"],
           _with_system(_pair(_joined("instruction", "input"), "output"))),
    Layout("completion", ["prompt", "completion"], ["system"], _with_system(_pair("prompt", "completion"))),
    Layout("response", ["prompt", "response"], ["system"], _with_system(_pair("prompt", "response"))),
    Layout("question", ["question", "answer"], ["context"], _pair(_joined("context", "question"), "answer")),
]
# One row per turn. Only a typed table can have this layout, as its records span rows.
TURN_ROWS = Layout("turn rows", ["turn", "role", "text"], [], "")

KNOWN = sorted({p for one in (*LAYOUTS, TURN_ROWS) for p in (*one.needed, *one.optional)})


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of those of the paths that some layout knows; other fields of a record do not matter."""
    return hashlib.md5(",".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


def layout_prints(layout: Layout) -> list[str]:
    """The fingerprints of the needed paths with any of the optional ones."""
    return [fingerprint([*layout.needed, *some]) for size in range(len(layout.optional) + 1)
            for some in combinations(layout.optional, size)]


def schema_paths(schema: StructType) -> list[str]:
    """Field paths of a schema, ``[]`` behind lists."""
    paths = []

    def walk(kind, at: str) -> None:
        if isinstance(kind, StructType):
            for field in kind.fields:
                path = f"{at}.{field.name}" if at else field.name
                paths.append(path)
                walk(field.dataType, path)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, at + "[]")
        elif isinstance(kind, MapType):
            walk(kind.valueType, at + "{}")

    walk(schema, "")
    return paths


def _keys(record: Column) -> Column:
    return F.coalesce(F.call_function("json_object_keys", record), F.array().cast("array<string>"))


def json_fingerprint(record: Column) -> Column:
    """The same hash for a JSON text: its fields, and the fields of the first element of those that are lists."""
    def below(top: str) -> Column:
        first = F.get_json_object(record, f"$.{top}[0]")
        return F.transform(_keys(first), lambda k: F.concat(F.lit(f"{top}[]."), k))

    nested = [below(top) for top in sorted({p.split("[]")[0] for p in KNOWN if "[]" in p})]
    paths = F.array_intersect(F.concat(_keys(record), *nested), F.array(*map(F.lit, KNOWN)))
    return F.md5(F.array_join(F.array_sort(paths), ",").cast("binary"))


# -- canonical turns ------------------------------------------------------------------------------


def _plain(turns: Column) -> Column:
    """Roles by their usual names; null roles and texts empty; null turns left out."""
    names = F.create_map(*[F.lit(x) for pair in NAMED_ROLES.items() for x in pair])
    turns = F.filter(F.coalesce(turns, F.array().cast("array<struct<role: string, text: string>>")), lambda m: m.isNotNull())
    return F.transform(turns, lambda m: F.struct(
        F.coalesce(names[m["role"]], m["role"], F.lit("")).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))


def _exploded(held: DataFrame) -> DataFrame:
    """A row per turn of (id, layout, turns). Records equal in id and turns are told apart by number."""
    held = held.withColumn("print", F.xxhash64("turns"))
    alike = Window.partitionBy("id", "print").orderBy("layout")
    return held.withColumn("copy", F.row_number().over(alike)).select(
        "id", "print", "copy", "layout", F.posexplode_outer("turns").alias("turn", "m")).select(
        "id", "print", "copy", "layout", "turn", "m.role", "m.text", F.col("m").isNotNull().alias("is_turn"))


def canonical_turns(records: DataFrame, id_col: str, record_col: str | None = None) -> DataFrame:
    """One row per turn: id, print and copy (with id the key of a conversation), layout, turn, role, text, is_turn.

    With ``record_col`` every row holds a record as a JSON text, and the fingerprint of each row selects its mapping.
    Else the fingerprint of the schema does, for a table of records or one of turns (``turn``, ``role``, ``text``).
    A record of an unknown layout (a null or broken one too) or without turns has one row with ``is_turn`` false, so
    that none is lost. Null roles and texts are empty. Fields no layout knows are ignored whatever their names; a
    table whose known fields fit no layout is refused with a ValueError.
    """
    ident = F.col(f"`{id_col}`").alias("id")
    if record_col is not None:
        record = F.col(f"`{record_col}`").cast("string")
        schema = ", ".join(f"`{name}` {kind}" for name, kind in FIELDS.items())
        held = records.select(ident, json_fingerprint(record).alias("print"), F.from_json(record, schema).alias("r")).select(
            "id", "print", "r.*")
        layout, turns = F.lit(None).cast("string"), F.lit(None)
        for one in LAYOUTS:
            fits = F.col("print").isin(layout_prints(one))
            layout, turns = F.when(fits, one.name).otherwise(layout), F.when(fits, F.expr(one.turns)).otherwise(turns)
        return _exploded(held.select("id", layout.alias("layout"), _plain(turns).alias("turns")))
    found = fingerprint(schema_paths(records.schema))
    if found in layout_prints(TURN_ROWS):
        return records.select(
            ident, F.lit(0).cast("long").alias("print"), F.lit(1).alias("copy"), F.lit(TURN_ROWS.name).alias("layout"),
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.lit(True).alias("is_turn"))
    fitting = [one for one in LAYOUTS if found in layout_prints(one)]
    if not fitting:
        raise ValueError(f"no layout for a table of {records.columns}")
    held = records.select(ident, *[
        (F.col(name) if name in records.columns else F.lit(None)).cast(kind).alias(name)
        if not kind.startswith("array") else (F.col(name) if name in records.columns else F.lit(None).cast(kind)).alias(name)
        for name, kind in FIELDS.items()])
    return _exploded(held.select("id", F.lit(fitting[0].name).alias("layout"), _plain(F.expr(fitting[0].turns)).alias("turns")))


# -- template -------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    """One more backslash behind the first character of whatever is a mark but for backslashes there."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + MARK, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role in one line."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def format_turns(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, print, copy, layout, n_turns, formatted, loss.

    ``turns`` as ``canonical_turns`` gives them. Each turn is ``<|im_start|>role``, a line end, the escaped text and
    ``<|im_end|>`` with a line end. ``loss`` lists the places of the texts of ``trained`` roles, in order: start and
    length in code points, and both in bytes. Turns are ordered by turn (null first), ties by role, then text;
    repeated rows all count. Rows with a null id are one conversation. A conversation is one example and so lies in
    one row; its turns are ordered, measured and summed by a window that spills, in time linear in its length.
    """
    key = ["id", "print", "copy"]
    role, text = F.when(F.col("is_turn"), _escape_role(F.col("role"))), escape(F.col("text"))
    rows = turns.select(*key, "layout", "turn", "role", "text", "is_turn", F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
                        F.when(F.col("is_turn"), text).alias("body"))
    order = Window.partitionBy(*key).orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = {"chars": F.length, "bytes": F.octet_length}
    marks = {"chars": len(END), "bytes": len(END.encode())}
    for unit, measure in size.items():
        rows = rows.withColumn(unit, F.coalesce(measure("head") + measure("body") + marks[unit], F.lit(0)).cast("long"))
    for unit in size:
        rows = rows.withColumn(f"{unit}_before", F.coalesce(F.sum(unit).over(before), F.lit(0)))
    span = F.struct(*[c for unit, measure in size.items() for c in (
        (F.col(f"{unit}_before") + measure("head")).alias("start" if unit == "chars" else "first_byte"),
        measure("body").cast("long").alias("length" if unit == "chars" else "bytes"))])
    piece = F.struct(
        "chars_before", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("role").isin(list(trained)), span).alias("span"))
    held = rows.groupBy(*key).agg(F.first("layout").alias("layout"),
                                  F.array_sort(F.collect_list(F.when(F.col("is_turn"), piece))).alias("pieces"))
    spans = F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull())
    return held.select(*key, "layout", F.size("pieces").cast("long").alias("n_turns"),
                       F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as a list of role and text: the inverse of the template."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other. Reads by bytes, so that no text is walked twice."""
    raw = formatted.cast("binary")
    texts = F.transform(loss, lambda s: unescape(
        F.substr(raw, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")))
    return F.array_join(texts, "")
