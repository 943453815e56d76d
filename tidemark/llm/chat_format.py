"""Chat formatting: heterogeneous conversation layouts into canonical turns, a reversible template, a loss mask.

DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
_TURN_ENDS = "</turn>\n"
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(role: str, text: str) -> Callable[[Callable[[str, str], Column]], Column]:
    def build(get: Callable[[str, str], Column], path: str) -> Column:
        def one(x: Column) -> Column:
            named = F.coalesce(x[role], F.lit(""))
            mapped = F.coalesce(F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])[F.lower(named)], named)
            return F.struct(mapped.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.transform(get(path, f"array<struct<{role}:string,{text}:string>>"), one)

    return build


#: Declared layouts: the nested field paths that make one, and how its turns are read with get(path, type).
LAYOUTS: dict[tuple[str, ...], Callable] = {
    ("messages[].content", "messages[].role"): lambda get: _listed("role", "content")(get, "messages"),
    ("conversations[].from", "conversations[].value"): lambda get: _listed("from", "value")(get, "conversations"),
    ("turns[].role", "turns[].text"): lambda get: _listed("role", "text")(get, "turns"),
    ("prompt", "response"): lambda get: F.array(_turn("user", get("prompt", "string")), _turn("assistant", get("response", "string"))),
    ("completion", "prompt"): lambda get: F.array(_turn("user", get("prompt", "string")), _turn("assistant", get("completion", "string"))),
    ("answer", "question"): lambda get: F.array(_turn("user", get("question", "string")), _turn("assistant", get("answer", "string"))),
    ("prompt", "response", "system"): lambda get: F.array(_turn("system", get("system", "string")), _turn("user", get("prompt", "string")), _turn("assistant", get("response", "string"))),
    ("instruction", "output"): lambda get: F.array(_turn("user", get("instruction", "string")), _turn("assistant", get("output", "string"))),
    ("input", "instruction", "output"): lambda get: F.array(
        _turn("user", F.concat_ws("\n\n", get("instruction", "string"), F.nullif(get("input", "string"), F.lit("")))), _turn("assistant", get("output", "string"))
    ),
}
#: The layout of a table that has one row for each turn: it is gathered by conversation, not mapped row by row.
ROWS = ("role", "text", "turn")
_BY_SIZE = sorted([*LAYOUTS, ROWS], key=len, reverse=True)  # of two that both fit, the one that names more fields
_KNOWN = sorted({p for paths in _BY_SIZE for p in paths})


def fingerprint(paths: tuple[str, ...] | list[str]) -> str | None:
    """Hash of the nested field paths of the declared layout that a set of paths holds: the one with the most paths,
    whatever other fields stand beside them; None if it holds none."""
    found = next((x for x in _BY_SIZE if set(x) <= set(paths)), None)
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest() if found else None


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a schema, [] marking array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def record_turns(record: Column) -> tuple[Column, Column]:
    """Fingerprint and canonical turns of JSON records whose layout may differ from row to row.

    Text that is no JSON object, or has a layout that isn't declared, has null turns.
    """
    value = F.try_parse_json(record)

    def present(path: str) -> Column:
        where = "$." + path.replace("[]", "[0]")
        return F.when(F.try_variant_get(value, where, "string").isNotNull(), F.lit(path))

    found = F.array_compact(F.array(*[present(p) for p in _KNOWN]))
    fits = [F.when(F.size(F.array_except(F.array(*map(F.lit, x)), found)) == 0, F.lit(fingerprint(x))) for x in _BY_SIZE if x != ROWS]
    key = F.coalesce(*fits)

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(value, f"$.{path}", kind)

    turns = F.lit(None).cast(TURNS)
    for paths, build in LAYOUTS.items():
        turns = F.when(key == fingerprint(paths), build(get)).otherwise(turns)
    return key, turns


def canonical_turns(df: DataFrame, id_col: str = "conv_id", record_col: str | None = None) -> DataFrame:
    """``conv_id, turns`` of a DataFrame in any declared layout; ``turns`` is array<struct<role, text>>.

    With ``record_col`` each row is a JSON record mapped by its own fingerprint. Else the schema's fingerprint picks
    the mapping; columns that the mapping doesn't name are ignored, an unknown layout is an error. A table of one row a
    turn is gathered by conversation in the order of turn, then role and text, nulls first; its roles are kept as they
    are. A null text is an empty one, a null role is empty too; a null id is an id of its own.
    """
    if record_col:
        return df.select(F.col(id_col).alias("conv_id"), record_turns(F.col(record_col))[1].alias("turns"))
    key = fingerprint(field_paths(df.schema))
    if key == fingerprint(ROWS):
        text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
        one = df.select(F.col(id_col).alias("conv_id"), F.struct(F.col("turn").alias("turn"), role, text).alias("t"))
        gathered = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
        return gathered.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    for paths, build in LAYOUTS.items():
        if key == fingerprint(paths):
            return df.select(F.col(id_col).alias("conv_id"), build(lambda path, kind: F.col(path).cast(kind)).alias("turns"))
    raise ValueError(f"no layout is declared for the fields {sorted(field_paths(df.schema))}")


def escape(text: Column) -> Column:
    """Free of '<', '#' and ':' so that no control string can stand in it; each backslash begins a pair."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((":", "\\c"), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id, formatted, spans``: each turn as ``### role: text</turn>`` and a line break, its parts escaped.

    ``spans`` has for each turn the code points [start, end) of its escaped text in ``formatted`` and whether they are
    under the loss mask (turns of the role ``trained``). Null turns give null outputs, no turns an empty text.
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit("### "), escape(t["role"]), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss")))
    shaped = turns.select("conv_id", parts.alias("parts"))
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["loss"].alias("loss")))
    shaped = shaped.withColumn("sizes", sizes)
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(_TURN_ENDS))), "")
    start = F.aggregate(
        "sizes",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,loss:boolean>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["head"] + p["body"] + len(_TURN_ENDS)).alias("at"),
            F.array_append(s["spans"], F.struct((s["at"] + p["head"]).alias("start"), (s["at"] + p["head"] + p["body"]).alias("end"), p["loss"].alias("loss"))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return shaped.select("conv_id", text.alias("formatted"), start.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` recovered from a formatted text and its spans alone."""
    pieces = F.slice(F.split("formatted", _TURN_ENDS), F.lit(1), F.greatest(F.size(F.split("formatted", _TURN_ENDS)) - 1, F.lit(0)))
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(F.regexp_extract(p, "^### ([^:]*): ", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, ": ") + 2)).alias("text"),
        ),
    )
    found = formatted.select("conv_id", "spans", pieces.alias("pieces"), F.length("formatted").cast("long").alias("formatted_chars")).withColumn("turns", turns)
    masked = F.transform("turns", lambda t, i: F.when(F.get("spans", i)["loss"], t["text"]).otherwise(""))
    return found.select("conv_id", "turns", F.array_join(masked, "").alias("loss_text"), "formatted_chars")
