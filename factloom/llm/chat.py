"""Operator 1, chat formatting, by schema fingerprints; DataFrame and SQL functions only.

A layout is told by the hash of its nested field paths (arrays as ``[]``).  The hash selects a declarative mapping that
says where the turns are; every layout becomes canonical turns ``array<struct<role, text>>``, and one template renders
them.  Tables carry one layout and are mapped by their schema; columns of JSON records may mix layouts, and there each
row's own hash selects its mapping.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside texts and roles, ``<`` followed by any backslashes and
``|`` gets one more backslash, so that no text can hold a marker and the escape is undone exactly; line ends and
backslashes of roles are written ``\\1`` and ``\\0``.

Loss masks are runs of code points, one for each turn; a conversation may have any number of turns, in one row, and its
work grows with its length alone.  Null text is empty, null role is empty, null turn comes first, null conv_id is a conversation of its own; turns of equal
number are ordered by role and text, and repeated rows stay.  An empty table gives an empty result.  Columns besides those
of the layout are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.  ``turns`` pairs a fixed role with a path; ``each`` names the array, its role and text."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def json_schema(self) -> str:
        if self.each:
            return f"{self.each[0]} array<struct<`{self.each[1]}`:string,`{self.each[2]}`:string>>"
        return ", ".join(f"`{p}` string" for p in self.paths)


LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), rows=("turn", "role", "text")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", ("prompt", "response", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("input", "instruction", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction_only", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    if not isinstance(schema, T.StructType):
        return []
    return [p for f in schema.fields for name in [f"{at}.{f.name}" if at else f.name] for p in (name, *schema_paths(f.dataType, name))]


def layout_of(schema: T.StructType) -> Layout:
    """The layout of a table: the one whose hash is that of the schema, else the largest whose hash is that of the schema cut down to its paths."""
    paths = set(schema_paths(schema))
    if exact := BY_FINGERPRINT.get(fingerprint(paths)):
        return exact
    held = [x for key, x in BY_FINGERPRINT.items() if fingerprint(paths & set(x.paths)) == key]
    if not held:
        raise ValueError(f"no layout is known for the paths {sorted(paths)}")
    return max(held, key=lambda x: len(x.paths))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _role(layout: Layout, role: Column) -> Column:
    if not layout.roles:
        return role
    return F.coalesce(*(F.when(role == a, F.lit(b)) for a, b in layout.roles), role)


def _turns_of(layout: Layout, field) -> Column:
    """Canonical turns of a record; ``field(name)`` gives its columns.  Fixed turns without text are left out, unless it is null in a reply."""
    if layout.each:
        array, role, text = layout.each
        return F.coalesce(F.transform(field(array), lambda x: _turn(_role(layout, x[role]), x[text])), F.array().cast(TURNS))
    turns = F.array(*(_turn(F.lit(role), field(path)) for role, path in layout.turns))
    return F.filter(turns, lambda x: (x["role"] == "assistant") | (x["text"] != ""))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns) of a table in any known layout."""
    layout = layout_of(df.schema)
    if not layout.rows:
        return df.select(F.col(key).alias("conv_id"), _turns_of(layout, F.col).alias("turns"))
    turn, role, text = layout.rows
    rows = df.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(_role(layout, F.col(role)), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def json_fingerprint(column: str) -> Column:
    """The hash of each JSON record's paths: its keys, and the keys of the first element of its arrays."""
    return F.expr(
        f"""sha2(array_join(array_sort(concat(json_object_keys(`{column}`), flatten(transform(json_object_keys(`{column}`),
            k -> transform(coalesce(json_object_keys(get_json_object(`{column}`, concat('$.', k, '[0]'))), array()), j -> concat(k, '[].', j)))))), '\\n'), 256)"""
    )


def canonical_json(df: DataFrame, column: str, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns, layout) of JSON records that may mix layouts; unknown layouts and broken records have null turns."""
    named = df.select(F.col(key).alias("conv_id"), F.col(column).alias("_json"), json_fingerprint(column).alias("_print"))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for print_, layout in BY_FINGERPRINT.items():
        if not layout.rows:
            record = F.from_json("_json", layout.json_schema)
            turns = F.when(F.col("_print") == print_, _turns_of(layout, lambda c, r=record: r[c])).otherwise(turns)
            name = F.when(F.col("_print") == print_, F.lit(layout.name)).otherwise(name)
    return named.select("conv_id", turns.alias("turns"), name.alias("layout"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\0")), F.lit("\n"), F.lit("\\1")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\1"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def render(turned: DataFrame, reply: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): the rendered text and its loss mask, a run for each turn: after ``skip`` code points the turn's
    text takes ``take``, and counts towards the loss if ``loss``.  Runs are relative, so no sums run along a conversation.
    """
    parts = F.transform("turns", lambda x: F.struct((x["role"] == reply).alias("loss"), F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body")))

    def run(x: Column, i: Column) -> Column:
        between = F.when(i > 0, F.lit(len(END) + 1)).otherwise(0)
        return F.struct((between + F.char_length(x["head"])).cast("long").alias("skip"), F.char_length(x["body"]).cast("long").alias("take"), x["loss"].alias("loss"))

    return turned.select("conv_id", parts.alias("p")).select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.transform("p", run).alias("mask"),
    )


def loss_spans(rendered: DataFrame) -> DataFrame:
    """(conv_id, begin, end): the code points of each masked text in its conversation's ``formatted``, as rows."""
    runs = rendered.select("conv_id", F.posexplode("mask").alias("turn", "run"))
    end = F.sum(F.col("run.skip") + F.col("run.take")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return runs.withColumn("end", end).filter("run.loss").select("conv_id", (F.col("end") - F.col("run.take")).alias("begin"), "end")


def _blocks(formatted: Column) -> Column:
    """A rendered text cut before each turn, without the marks that begin them."""
    blocks = F.split(formatted, r"<\|im_start\|>")
    return F.when(F.size(blocks) > 1, F.slice(blocks, F.lit(2), F.size(blocks) - 1)).otherwise(F.array().cast("array<string>"))


def parse(formatted: Column) -> Column:
    """Canonical turns of a rendered text."""

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        skip = F.char_length(role) + 1
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(x, skip + 1, F.char_length(x) - skip - len(END) - 1)).alias("text"))

    return F.transform(_blocks(formatted), turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between: of each masked turn's block the characters of its run.

    A block ends with its text, a closing mark and a line end, so the run's length tells where it begins in the block.
    """

    def masked(block: Column, run: Column) -> Column:
        size = run["take"].cast("int")
        return F.when(run["loss"], unescape(F.substring(block, F.char_length(block) - len(END) - size, size))).otherwise("")

    return F.array_join(F.zip_with(_blocks(formatted), mask, masked), "")
