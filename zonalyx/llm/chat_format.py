"""Chat formatting: schema fingerprints select declarative mappings to turns.

A record's fingerprint is the hash of its nested field paths, sorted, without
the paths that no layout knows. It selects one of LAYOUTS, and the layout says
where the turns are. Turns become one template:

    <turn ROLE>TEXT</turn>\\n

In TEXT and ROLE a backslash becomes \\0, "<turn " \\1, "</turn>" \\2 and, in
ROLE only, ">" \\3. A backslash then always starts an escape, no control string
is left inside a turn, and reading back is exact.

The loss mask is a list of byte spans (start, length) in the UTF-8 form of the
output; it covers the text of assistant turns and nothing else.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<turn ", "</turn>"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    rows: the fields (id, order, role, text) of a table with a row per turn.
    items: the list field, and the fields (role, text) of its members.
    turns: (role, fields) pairs; the fields that hold text, joined by a line feed.
    """

    name: str
    rows: tuple[str, str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.items:
            field, role, text = self.items
            return sorted([field, f"{field}[].{role}", f"{field}[].{text}"])
        return sorted({f for _, fields in self.turns for f in fields})

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.paths).encode()).hexdigest()


LAYOUTS = (
    Layout("turn_rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("instruction", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)
KNOWN_PATHS = sorted({p for layout in LAYOUTS for p in layout.paths})
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths; [] marks the members of an array."""
    out = []
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, path + ".")
    return out


def schema_fingerprint(schema: T.StructType) -> str:
    known = sorted(set(schema_paths(schema)) & set(KNOWN_PATHS))
    return hashlib.sha256("\n".join(known).encode()).hexdigest()


def _under(field: str):
    return lambda key: F.concat(F.lit(f"{field}[]."), key)


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON record; a list counts by the keys of all its members. Null for what is no object."""
    found = [F.json_object_keys(record)]
    for field in sorted({layout.items[0] for layout in LAYOUTS if layout.items}):
        members = F.from_json(record, f"struct<`{field}`:array<map<string,string>>>")[field]
        keys = F.array_distinct(F.flatten(F.transform(F.filter(members, lambda m: m.isNotNull()), F.map_keys)))
        found.append(F.coalesce(F.transform(keys, _under(field)), F.array().cast("array<string>")))
    known = F.array_intersect(F.concat(*found), F.array(*map(F.lit, KNOWN_PATHS)))
    return F.sha2(F.array_join(F.array_sort(known), "\n"), 256)


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, role), role, F.lit(""))


_TURNS = "array<struct<role:string,text:string>>"


def _json_turns(record: Column, layout: Layout) -> Column:
    if layout.items:
        field, role, text = layout.items
        got = F.from_json(record, f"struct<`{field}`:array<struct<`{role}`:string,`{text}`:string>>>")[field]
        return F.transform(got, lambda m: F.struct(_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))).cast(_TURNS)
    fields = ",".join(f"`{f}`:string" for f in layout.paths)
    got = F.from_json(record, f"struct<{fields}>")
    turns = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(got[f], F.lit("")) for f in names]).alias("text")) for role, names in layout.turns]
    return F.array(*turns).cast(_TURNS)


def turns_from_json(df: DataFrame, record_col: str, id_col: str) -> DataFrame:
    """Rows conv_id, turn, role, text, layout of records in any of LAYOUTS, one JSON object in record_col.

    A record whose fingerprint no layout has (null and broken JSON too) gives one
    row with null turn, role, text and layout, so that nothing is lost silently.
    """
    record = F.col(f"`{record_col}`")
    print_ = json_fingerprint(record)
    nested = [x for x in LAYOUTS if not x.rows]
    turns, name = F.lit(None).cast(_TURNS), F.lit(None).cast("string")
    for layout in nested:
        turns = F.when(F.col("__print") == layout.fingerprint, _json_turns(F.col("__record"), layout)).otherwise(turns)
        name = F.when(F.col("__print") == layout.fingerprint, layout.name).otherwise(name)
    base = df.select(F.col(f"`{id_col}`").alias("conv_id"), record.alias("__record"), print_.alias("__print"))
    flat = base.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("turn", "__t"))
    return flat.select("conv_id", F.col("turn").cast("long"), F.col("__t.role").alias("role"), F.col("__t.text").alias("text"), "layout")


def turns_from_table(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows conv_id, turn, role, text, layout of a typed table; its schema's fingerprint selects the layout.

    Columns that no layout knows are ignored. An unknown fingerprint is an error.
    Null text and null role count as empty. A null list gives no turns.
    """
    layout = next((x for x in LAYOUTS if x.fingerprint == schema_fingerprint(df.schema)), None)
    if layout is None:
        raise ValueError(f"no layout has the field paths {schema_paths(df.schema)}")
    name = F.lit(layout.name).alias("layout")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if layout.rows:
        conv, turn, role, body = layout.rows
        return df.select(
            F.col(conv).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            _role(F.col(role)).alias("role"),
            text(F.col(body)).alias("text"),
            name,
        )
    if layout.items:
        field, role, body = layout.items
        flat = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.posexplode(field).alias("turn", "__t"))
        return flat.select("conv_id", F.col("turn").cast("long"), _role(F.col(f"__t.{role}")).alias("role"), text(F.col(f"__t.{body}")).alias("text"), name)
    turns = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in names]).alias("text")) for role, names in layout.turns]
    flat = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.posexplode(F.array(*turns)).alias("turn", "__t"))
    return flat.select("conv_id", F.col("turn").cast("long"), "__t.role", "__t.text", name)


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\0"), (OPEN, "\\1"), (CLOSE, "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in ((">", "\\3"), (CLOSE, "\\2"), (OPEN, "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (byte start and length).

    Turns are ordered by turn (nulls first), equal ones by role and text; rows
    that repeat are turns of their own. Null text and role count as empty. A
    conversation is one output string, so it must fit into one value; there is
    no other limit on its turns. Empty input gives no rows.
    """
    head = F.concat(F.lit(OPEN), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(">"), F.lit("\\3")), F.lit(">"))
    rows = turns.select(
        "conv_id", "turn",
        (F.coalesce("role", F.lit("")) == LOSS_ROLE).alias("loss"),
        head.alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "head", "body")
    width = F.octet_length("head") + F.octet_length("body") + len(CLOSE) + 1
    start = F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.octet_length("head")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("no"),
        "loss",
        start.alias("start"),
        F.octet_length("body").cast("long").alias("length"),
        F.concat("head", "body", F.lit(CLOSE + "\n")).alias("part"),
    )
    parts = F.sort_array(F.collect_list(F.struct("no", "start", "length", "loss", "part"))).alias("parts")
    got = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), parts)
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return got.select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read from the template alone."""
    parts = F.split(formatted, CLOSE + "\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        at = F.locate(">", part)
        return F.struct(
            unescape(F.substr(part, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))).alias("role"),
            unescape(F.substr(part, at + 1)).alias("text"),
        )

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted.cast("binary"), (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))


def digest(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives, as counts and digests."""
    got = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
