"""Chat formatting: any known layout of a conversation to canonical turns, to one marked text, and back.

The fingerprint of a layout is a hash of its sorted nested field paths. It picks
a declarative mapping, a list of (role, text) paths; data in a layout that no
mapping names is refused by name. For JSON rows each row's own paths are hashed,
so one column may hold many layouts. All of it is column expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the template, and control strings of common templates.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL_REST = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>|pad>|unk>|bos>|eos>"
_OPEN = r"([<\[])"
ESCAPE = _OPEN + r"(\\*)(" + CONTROL_REST + ")"
UNESCAPE = _OPEN + r"(\\*)\\(" + CONTROL_REST + ")"

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """`turns`: (role, path) of fields in order; `listed`: (list, role field,
    text field) for layouts that hold a list; `rows`: one turn a row."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


# Names that layouts give to the same roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Layout("shared chats", ("conversations", "conversations[].from", "conversations[].value"), listed=("conversations", "from", "value")),
    Layout("prompt and response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question and answer", ("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system, prompt and response", ("prompt", "response", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("nested", ("data", "data.completion", "data.prompt"), turns=(("user", "data.prompt"), ("assistant", "data.completion"))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; [] stands for a list's elements."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            here = f"{at}.{f.name}" if at else f.name
            out += [here, *paths_of(f.dataType, here)]
        return out
    return paths_of(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else []


def layout_of(schema: T.StructType, ignore: tuple[str, ...] = ()) -> Layout:
    """The mapping whose fingerprint the schema has; where columns besides those
    of a layout stand in it, the layout with the most paths among them."""
    paths = [p for p in paths_of(schema) if p.split(".")[0].split("[")[0] not in ignore]
    exact = {x.fingerprint: x for x in LAYOUTS}.get(fingerprint(paths))
    if exact:
        return exact
    within = [x for x in LAYOUTS if set(x.paths) <= set(paths)]
    if not within:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return max(within, key=lambda x: (len(x.paths), x.name))


def role_named(role: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), low), F.coalesce(role, F.lit("")))


def turn_of(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def turns_from(layout: Layout, field) -> Column:
    """The canonical turns of one row; `field` gives the column of a path. A
    field that is null gives no turn in a field layout, an empty text in a list."""
    if layout.listed:
        items, role, text = layout.listed
        return F.transform(F.coalesce(field(items), F.array()), lambda m: turn_of(role_named(m[role]), m[text]))
    return F.filter(F.array(*[F.when(field(p).isNotNull(), turn_of(F.lit(r), field(p))) for r, p in layout.turns]), lambda t: t.isNotNull())


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a DataFrame in any known layout. Turn rows
    keep their order: turn, then role, then text for equal or null turns; equal
    rows stay as often as they occur. Null texts and roles are empty."""
    layout = layout_of(df.schema, ignore=() if conv_id in LAYOUTS[0].paths and set(LAYOUTS[0].paths) <= set(df.columns) else (conv_id,))
    if layout.rows:
        c, turn, role, text = (F.col(f"`{x}`") for x in layout.rows)
        return df.select(c.alias("conv_id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = df.select(F.col(conv_id).alias("conv_id"), turns_from(layout, lambda p: F.col(p)).alias("_turns"))
    return turns.select("conv_id", F.posexplode("_turns").alias("turn", "_t")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "_t.role", "_t.text")


def json_paths(json: Column) -> Column:
    """The sorted field paths of a JSON object, two levels deep, through its lists of objects."""
    top = F.coalesce(F.json_object_keys(json), F.array())
    fields = F.from_json(json, "map<string,string>")

    def nested(name: Column) -> Column:
        value = fields[name]
        listed = F.from_json(value, "array<map<string,string>>")
        inner = F.when(value.startswith("["), F.transform(F.array_distinct(F.flatten(F.transform(F.coalesce(listed, F.array()), lambda m: F.map_keys(m)))), lambda k: F.concat(name, F.lit("[]."), k)))
        return F.when(value.startswith("{"), F.transform(F.json_object_keys(value), lambda k: F.concat(name, F.lit("."), k))).otherwise(inner)

    return F.array_sort(F.array_distinct(F.concat(top, F.flatten(F.transform(top, lambda n: F.coalesce(nested(n), F.array()))))))


def json_fingerprint(json: Column) -> Column:
    return F.substring(F.sha2(F.array_join(json_paths(json), "\n"), 256), 1, 16)


def canonical_json(df: DataFrame, json: str = "json", conv_id: str = "conv_id") -> DataFrame:
    """conv_id, fingerprint, layout, turns of rows that each hold a JSON object
    in a layout of their own. A row whose paths no mapping names, or that is no
    object, has a null layout and null turns, and stays."""
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(json).alias("_json"), json_fingerprint(F.col(json)).alias("fingerprint"))

    def field(path: str) -> Column:
        return F.get_json_object("_json", "$." + path)

    def turns(layout: Layout) -> Column:
        if layout.listed:
            items, role, text = layout.listed
            found = F.from_json(field(items), f"array<struct<`{role}`:string,`{text}`:string>>")
            return F.transform(F.coalesce(found, F.array()), lambda m: turn_of(role_named(m[role]), m[text]))
        return turns_from(layout, field)

    known = [x for x in LAYOUTS if not x.rows]
    pick = lambda of: F.coalesce(*[F.when(F.col("fingerprint") == x.fingerprint, of(x)) for x in known])
    return rows.select("conv_id", "fingerprint", pick(lambda x: F.lit(x.name)).alias("layout"), pick(turns).alias("turns"))


def escaped(text: Column) -> Column:
    """Control strings broken by a backslash after their first character; one
    that has k backslashes there gets k + 1, so `unescaped` gives back any text."""
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def formatted(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans of canonical turns: a span is the start and
    length, in code points of `formatted`, of a text whose role is in `learn`."""
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("_head"), escaped(F.col("text")).alias("_body"))
    sized = parts.select(
        "conv_id", F.struct("turn", "role", "text", F.concat("_head", "_body", F.lit(END)).alias("piece"), F.char_length("_head").cast("bigint").alias("head"), F.char_length("_body").cast("bigint").alias("body")).alias("_p")
    )
    # a conversation is one value of the result, so its turns meet in one row
    whole = sized.groupBy("conv_id").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    ends = F.aggregate(
        "_ps",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + p["head"] + p["body"] + len(END)).alias("at"),
            F.when(p["role"].isin(*learn), F.concat(a["spans"], F.array(F.struct((a["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return whole.select("conv_id", F.array_join(F.transform("_ps", lambda p: p["piece"]), "").alias("formatted"), ends["spans"].alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The canonical turns of a formatted conversation."""
    pieces = F.slice(F.split(text, r"\Q" + TURN + r"\E", -1), F.lit(2), F.greatest(F.size(F.split(text, r"\Q" + TURN + r"\E", -1)) - 1, F.lit(0)))
    cut = lambda p: F.split(F.substring(p, F.lit(1), F.char_length(p) - len(END)), r"\Q" + SAYS + r"\E", -1)
    return F.transform(pieces, lambda p: F.struct(unescaped(cut(p)[0]).alias("role"), unescaped(cut(p)[1]).alias("text")))


def loss_texts(text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
