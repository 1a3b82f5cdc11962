"""Chat formatting of records in different layouts, in column expressions only.

Records are rows of one table whose columns are the union of all layouts, as the JSON and Parquet readers give mixed files;
fields that a record lacks are null. The nested field paths that a record has are hashed to a fingerprint, which selects a
declarative mapping to canonical turns: role and text in order. Unknown fingerprints give no turns and a null ``layout``,
so they can be listed and mapped.

The template marks each turn with its role and end. Control strings inside texts are broken by a backslash after their
first character; a string that already holds such backslashes gets one more, so unescaping gives the text back exactly.

Null texts count as empty, null roles as the empty role; a record without turns formats to an empty string. Turns are in the
order of their number, then role and text, so repeated numbers have a defined order; repeated records are formatted one by one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: The rest of each control string after its first character, "<" or "[".
RESTS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|INST\]|/INST\]"
TURNS = "array<struct<role:string,text:string>>"

#: Mappings by layout: the field paths of the record, and its turns as (fixed role, field) or (None, list, role field, text field).
LAYOUTS = {
    "messages": (["messages[].content", "messages[].role"], [(None, "messages", "role", "content")]),
    "conversations": (["conversations[].from", "conversations[].value"], [(None, "conversations", "from", "value")]),
    "prompt": (["completion", "prompt"], [("user", "prompt"), ("assistant", "completion")]),
    "instruction": (["input", "instruction", "output"], [("system", "instruction"), ("user", "input"), ("assistant", "output")]),
    "bare_instruction": (["instruction", "output"], [("user", "instruction"), ("assistant", "output")]),
}


def present_paths(fields: list[T.StructField], parent: str = "", owner: Column | None = None) -> list[tuple[str, Column]]:
    """Nested leaf paths with the test whether a record has them; the fields of a list's items are there if the list is."""
    found = []
    for f in fields:
        col = owner[f.name] if owner is not None else F.col(f"`{f.name}`")
        kind, path = f.dataType, parent + f.name
        if isinstance(kind, T.StructType):
            found += present_paths(kind.fields, path + ".", col)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found += [(f"{path}[].{x.name}", col.isNotNull()) for x in kind.elementType.fields]
        else:
            found.append((path, col.isNotNull()))
    return found


def fingerprint(df: DataFrame, fields: list[str]) -> Column:
    """SHA-256 of the sorted nested field paths that a record has."""
    paths = sorted(present_paths([df.schema[f] for f in fields]), key=lambda x: x[0])
    return F.sha2(F.concat_ws(",", *[F.when(there, F.lit(p)) for p, there in paths]), 256)


def list_turns(field: str, role: str, text: str) -> Column:
    return F.transform(F.col(field), lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))


def canonical_turns(records: DataFrame, fields: list[str], layouts: dict | None = None) -> DataFrame:
    """Adds ``layout`` and ``turns``; the mapping of each record is chosen by the fingerprint of its ``fields``."""
    layout, turns, mark = F.lit(None).cast("string"), F.lit(None).cast(TURNS), fingerprint(records, fields)
    for name, (paths, mapping) in (layouts or LAYOUTS).items():
        if not {p.split("[")[0].split(".")[0] for p in paths} <= set(fields):
            continue
        parts = []
        for role, field, *inner in mapping:
            if inner:
                parts.append(list_turns(field, *inner))
            else:
                parts.append(F.array(F.struct(F.lit(role).alias("role"), F.col(field).alias("text"))))
        chosen = F.col("_mark") == hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()
        layout, turns = F.when(chosen, F.lit(name)).otherwise(layout), F.when(chosen, F.concat(*parts)).otherwise(turns)
    return records.withColumn("_mark", mark).withColumns({"layout": layout, "turns": turns}).drop("_mark")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({RESTS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({RESTS})", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo :func:`escape_role`; a backslash pair is set aside while line breaks come back."""
    pieces = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: start and end (exclusive), in code points, of each text of the role to learn."""
    t = F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    pieces = F.transform(t, lambda x: F.struct(
        F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == learn).alias("learn")))
    end = F.lit(END + "\n")
    df = df.withColumn("_pieces", pieces)
    df = df.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], end)), ""))
    # running place of each body: lengths are small structs, so texts are not copied again
    lengths = F.transform("_pieces", lambda p: F.struct(F.char_length(p["head"]).alias("h"), F.char_length(p["body"]).alias("b"), p["learn"].alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["h"]
        span = F.array(F.struct(s.alias("start"), (s + x["b"]).alias("end")))
        return F.struct((s + x["b"] + len(END) + 1).alias("at"), F.when(x["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return df.withColumn("_lengths", lengths).withColumn("loss_spans", F.aggregate("_lengths", start, add)["spans"]).drop("_pieces", "_lengths")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.struct(p.alias("p"), F.locate("\n", p).alias("at")))
    return F.transform(cut, lambda x: F.struct(
        unescape_role(F.substring(x["p"], F.lit(len(START) + 1), x["at"] - len(START) - 1)).alias("role"),
        unescape(F.substring(x["p"], x["at"] + 1, F.char_length(x["p"]))).alias("text")))


def digest(df: DataFrame) -> DataFrame:
    """Result rows of the query, read back from ``formatted`` and ``loss_spans``."""
    back = df.withColumn("_turns", read_turns(F.col("formatted")))
    all_turns = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    back = back.withColumn("_loss", loss)
    return back.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
                       F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def records_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record a conversation from rows of turns: a pair of user and assistant as ``prompt`` record, system, user and assistant as
    ``instruction`` record, all others as ``messages``."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    roles, t = F.col("t.role"), F.col("t")  # compared as lists: a role may hold any character
    pair, three = (roles == F.array(*map(F.lit, x)) for x in (("user", "assistant"), ("system", "user", "assistant")))

    def content(i: int) -> Column:
        return F.get(t, F.lit(i))["content"]

    return grouped.select(
        "conv_id", F.when(pair, content(0)).alias("prompt"), F.when(pair, content(1)).alias("completion"),
        F.when(three, content(0)).alias("instruction"), F.when(three, content(1)).alias("input"), F.when(three, content(2)).alias("output"),
        F.when(~pair & ~three, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))
