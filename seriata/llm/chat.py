"""Chat formatting: a hash of a record's nested field paths selects the declarative mapping that turns it into canonical turns.

Turns are ``array<struct<role, text>>``. The template marks each turn and escapes control strings inside texts and roles
so that reading back is exact; the loss mask is a list of spans over the formatted string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that this or another common template gives a meaning; none of them occurs in formatted texts but as this template's own mark.
CONTROLS = (START, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The escape sign and its codes: the sign itself is ``E0``, control string k is ``E`` and the k-th letter, a line feed in a role ``En``.
ESCAPE = "␛"
_CODES = "ABCDEFGHIJKLMOPQRSTUVWXYZ"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for c, code in zip(CONTROLS, _CODES, strict=False):
        out = F.replace(out, F.lit(c), F.lit(ESCAPE + code))
    return out


def unescape(text: Column) -> Column:
    """The inverse. After ``escape`` every sign is followed by its own code, so codes can't overlap."""
    out = text
    for c, code in zip(CONTROLS, _CODES, strict=False):
        out = F.replace(out, F.lit(ESCAPE + code), F.lit(c))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


# --- layouts ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``list_path`` names an array of turns with ``role`` and ``text`` fields, or ``fields`` lists (role, field) of
    single turns in order. ``roles`` renames roles."""

    name: str
    list_path: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

    def shapes(self) -> list[set[str]]:
        """The sets of nested field paths that this layout reads; a list may also be empty."""
        if self.list_path:
            return [{self.list_path, f"{self.list_path}[].{self.role}", f"{self.list_path}[].{self.text}"}, {self.list_path}]
        return [{path for _, path in self.fields}]


LAYOUTS = (
    Layout("messages", "messages"),
    Layout("chat_text", "turns", text="text"),
    Layout("sharegpt", "conversations", role="from", text="value"),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def vocabulary(layouts: tuple[Layout, ...] = LAYOUTS) -> set[str]:
    """All field paths that any layout reads. What a record has besides doesn't count for its fingerprint."""
    return set().union(*[shape for x in layouts for shape in x.shapes()])


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The nested field paths of a JSON record that some layout reads, sorted; null for what isn't a JSON object.

    A field counts whatever its value is, a null too. For a list, fields of any of its elements count.
    """
    paths = F.json_object_keys(record)
    for name in sorted({x.list_path for x in layouts if x.list_path}):
        # ARRAY<OBJECT<a: STRING, b: ..>>: inner types are cut out, then names stand before their colons
        shape = F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{name}", "variant"))
        inside = F.regexp_extract(shape, r"^ARRAY<OBJECT<(.*)>>$", 1)
        for _ in range(6):
            inside = F.regexp_replace(inside, r"<[^<>]*>", "")
        names = F.regexp_extract_all(inside, F.lit(r"(?:^|, )`?([^,:`]+)`?: "), F.lit(1))
        paths = F.concat(paths, F.coalesce(_prefixed(names, f"{name}[]."), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.array_intersect(paths, F.array(*[F.lit(p) for p in sorted(vocabulary(layouts))]))))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def layout_fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """XXH64 of the field paths; null for what isn't a JSON object."""
    paths = field_paths(record, layouts)
    return F.when(paths.isNotNull(), F.xxhash64(F.array_join(paths, "\n")))


def layout_fingerprints(spark: SparkSession, layouts: tuple[Layout, ...] = LAYOUTS) -> dict[int, str]:
    """Fingerprint to layout name; the layouts are code, so their number is fixed. Two layouts of one shape are an error."""
    rows = spark.createDataFrame([(x.name, "\n".join(sorted(shape))) for x in layouts for shape in x.shapes()], "name string, paths string")
    found = [(r.f, r.name) for r in rows.select("name", F.xxhash64("paths").alias("f")).collect()]
    if len(dict(found)) < len(found):
        raise ValueError("two layouts read the same fields")
    return dict(found)


def canonical_turns(record: Column, known: dict[int, str], layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The turns of a JSON record by the layout with its fingerprint; null where no layout fits."""
    kind, out = layout_fingerprint(record, layouts), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        if x.list_path:
            got = F.from_json(F.get_json_object(record, f"$.{x.list_path}"), f"array<struct<`{x.role}`:string,`{x.text}`:string>>")
            turns = _listed_turns(got, x)
        else:
            turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit("")).alias("text")) for role, path in x.fields])
        out = F.when(kind.isin([f for f, name in known.items() if name == x.name]), turns).otherwise(out)
    return out


def _listed_turns(got: Column, layout: Layout) -> Column:
    empty = F.lit("")
    return F.transform(got, lambda t: F.struct(_renamed(F.coalesce(t[layout.role], empty), layout).alias("role"), F.coalesce(t[layout.text], empty).alias("text")))


def _renamed(role: Column, layout: Layout) -> Column:
    out = role
    for a, b in layout.roles:
        out = F.when(role == a, F.lit(b)).otherwise(out)
    return out


def record_turns(records: DataFrame, column: str) -> DataFrame:
    """``records`` with ``turns`` made from the JSON strings of ``column``. Fields that no layout reads don't matter; a nested value where text
    should be counts as its JSON. Rows of an unknown layout have null turns, so ``unmatched`` can set them apart."""
    known = layout_fingerprints(records.sparkSession)
    return records.withColumn("turns", canonical_turns(F.col(column), known))


def unmatched(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matched, unmatched)`` rows of ``record_turns``: no conversation is lost without being told."""
    return records.where("turns is not null"), records.where("turns is null")


#: Layouts of typed tables by the columns' nested field paths that they read.
TABLE_LAYOUTS = {"turn_rows": ("conv_id", "role", "text", "turn"), "nested_turns": ("conv_id", "turns[].role", "turns[].text"), "pairs": ("conv_id", "prompt", "response")}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema; ``[]`` marks an array."""
    if isinstance(kind, T.StructType):
        return set().union(*[schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields]) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def path_hash(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def table_layout(kind: T.DataType) -> str:
    """The layout of a typed table: its fingerprint, the hash of those of its paths that any layout reads, is looked up among the layouts'. Other
    columns don't matter; a table with the columns of two layouts, or of none, is an error."""
    read = {p for paths in TABLE_LAYOUTS.values() for p in paths}
    own = schema_paths(kind) & read
    found = {path_hash(paths): name for name, paths in TABLE_LAYOUTS.items()}.get(path_hash(own))
    if found is None:
        raise ValueError(f"no layout has just the fields {sorted(own)}")
    return found


def table_turns(df: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` of a typed table, by ``table_layout``."""
    kind, empty = table_layout(df.schema), F.lit("")
    if kind == "turn_rows":
        return conversation_turns(df)
    if kind == "nested_turns":
        turns = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], empty).alias("role"), F.coalesce(t["text"], empty).alias("text")))
        return df.select("conv_id", turns.alias("turns"))
    pair = [F.struct(F.lit(role).alias("role"), F.coalesce(F.col(c), empty).alias("text")) for role, c in (("user", "prompt"), ("assistant", "response"))]
    return df.select("conv_id", F.array(*pair).alias("turns"))


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from one row per turn: by turn, then role and text, nulls first; null role or text counts as empty.

    A row without an id is a conversation by itself, so such rows never meet. A conversation is one training example and so
    must fit one row; nothing larger is gathered anywhere.
    """
    one = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    alone = one.where("conv_id is null").select("conv_id", plain(F.array("t")))
    gathered = one.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", plain(F.col("t"))).unionByName(alone)


# --- template ---------------------------------------------------------------------------------------------------


def format_turns(df: DataFrame) -> DataFrame:
    """``df(turns, ..)`` with ``formatted`` and ``loss_spans`` (start, end in code points of ``formatted``, end exclusive)
    in place of ``turns``. Null turns give an empty string without spans."""
    keep = [c for c in df.columns if c != "turns"]
    turns = F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>"))
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss")
        ),
    )
    df = df.select(*keep, pieces.alias("_p"))
    tail = F.lit(END + "\n")
    joined = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], tail)), "")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return df.select(*keep, joined.alias("formatted"), F.aggregate("_p", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns, read back from a formatted string."""
    pieces = F.filter(F.split(formatted, r"\Q" + END + r"\E\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring(F.substring_index(p, "\n", 1), F.lit(len(START) + 1), F.length(p))).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def turns_digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
