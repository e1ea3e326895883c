"""Operator 10: chat formatting by schema fingerprint.

A table's fingerprint is the hash of its sorted nested field paths, that of a JSON
record the hash of its paths at every depth with the kinds of their values. Each
known layout is a declarative mapping under its fingerprint: where the
conversation's id is, and where turns, their roles and their texts are. Records are
turned into canonical turns by the mapping that their fingerprint selects. Records of
unknown layouts, with values of other kinds than the layout has, or that are no JSON
are returned apart with their paths; none is lost. A field may be null in any record.

Template, per turn: ``<|im_start|>role``, a line break, the text, ``<|im_end|>``
and a line break. Control strings inside a text get one backslash behind their
first character, and one more if they have some already, so taking one away gives
the text again. Roles are written URL-encoded. A turn is one row, so a
conversation of any length is never held whole; reading back streams through turns
in order.

Null text, role or turn: empty text, empty role, turn sorted first. Turns with
equal numbers follow role and text; repeated rows stay. A null conversation id is
a conversation of its own. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import product
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that texts may hold and that must not act as marks, without their first character; fixed values.
CONTROL_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>"
#: The roles that roles of other layouts stand for; others stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Whose texts are learned.
LEARNED = "assistant"


# --- fingerprints -----------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` marks the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``turns`` lists (role, field of the text) for layouts with named fields, or is
    empty for layouts with an array ``items`` (its own field, or the record itself
    if "") of ``role`` and ``text`` fields. ``number`` numbers single-turn rows.
    """

    name: str
    id: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    number: str = ""

    @property
    def paths(self) -> list[str]:
        if self.turns:
            return [self.id, *(field for _, field in self.turns)]
        inside = f"{self.items}[]." if self.items else ""
        return [self.id, *([self.number] if self.number else []), inside + self.role, inside + self.text]

    @property
    def record_fingerprints(self) -> list[str]:
        """Fingerprints of records of this layout: any field may hold nothing but null."""
        whole = {self.id, self.number}
        kinds = [(f"{p}:{'integer' if p in whole else 'text'}", f"{p}:null") for p in self.paths]
        return [fingerprint(list(chosen)) for chosen in product(*kinds)]

    def schema(self) -> T.StructType:
        """The record's type, to read it from JSON."""
        field = T.StructField
        if self.turns:
            rest = [field(name, T.StringType()) for _, name in self.turns]
        else:
            inner = [field(self.role, T.StringType()), field(self.text, T.StringType())]
            rest = [field(self.items, T.ArrayType(T.StructType(inner)))] if self.items else inner
            rest += [field(self.number, T.LongType())] if self.number else []
        return T.StructType([field(self.id, T.LongType()), *rest])


LAYOUTS = (
    Layout("turn rows", "conv_id", role="role", text="text", number="turn"),
    Layout("messages", "id", items="messages", role="role", text="content"),
    Layout("conversations", "id", items="conversations", role="from", text="value"),
    Layout("prompt and response", "id", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", "id", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question and answer", "id", turns=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", "id", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", "id", turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system and prompt", "id", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
MAPPINGS = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def _role(role: Column) -> Column:
    plain = F.lower(F.trim(role))
    known = F.coalesce(*(F.when(plain == old, new) for old, new in ROLES.items()))
    return F.coalesce(known, role, F.lit(""))


def _turns(df: DataFrame, layout: Layout, record: str = "") -> DataFrame:
    """conv_id, turn, role, text by the layout, from columns or a struct column."""
    at = lambda name: F.col(f"{record}.`{name}`" if record else f"`{name}`")
    text = lambda c: F.coalesce(c, F.lit(""))
    if not layout.turns and not layout.items:
        return df.select(
            at(layout.id).cast("long").alias("conv_id"), at(layout.number).cast("long").alias("turn"),
            _role(at(layout.role)).alias("role"), text(at(layout.text)).alias("text"),
        )
    if layout.items:
        exploded = df.select(at(layout.id).cast("long").alias("conv_id"), F.posexplode(at(layout.items)).alias("turn", "_item"))
        inner = lambda name: F.col("_item").getField(name)
        return exploded.select("conv_id", F.col("turn").cast("long"), _role(inner(layout.role)).alias("role"), text(inner(layout.text)).alias("text"))
    made = [
        F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text(at(field)).alias("text"))
        for k, (role, field) in enumerate(layout.turns)
    ]
    return df.select(at(layout.id).cast("long").alias("conv_id"), F.inline(F.array(*made)))


def canonical_table(df: DataFrame, mappings: dict[str, Layout] = MAPPINGS) -> DataFrame:
    """Turns of a typed table, by the fingerprint of its schema."""
    paths = field_paths(df.schema)
    layout = mappings.get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"No mapping for the fields {sorted(paths)}")
    return _turns(df, layout)


def record_paths(record: str | None) -> list[str] | None:
    """Sorted paths of a JSON object at every depth, each with the kind of its values; null for what is no JSON object.

    Where values of one path differ in kind, each kind counts; null only where no
    other value is there. Dots, brackets and colons of names stand behind a backslash.
    """
    try:
        whole = json.loads(record or "", parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return None
    if not isinstance(whole, dict):
        return None
    found: dict[str, set[str]] = {}
    left = [("", whole)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict) and value:
            for name, inner in value.items():
                name = "".join("\\" + c if c in "\\.[]:" else c for c in name)
                left.append((f"{at}.{name}" if at else name, inner))
        elif isinstance(value, list) and value:
            left += [(at + "[]", inner) for inner in value]
        else:
            found.setdefault(at, set()).add(_kind(value))
    return sorted(f"{at}:{k}" for at, kinds in found.items() for k in (kinds - {"null"} or kinds))


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(1 << 63) <= value < 1 << 63 else "number"
    return {dict: "object", list: "array", str: "text", float: "number"}.get(type(value), "null")


def with_fingerprint(records: DataFrame, column: str) -> DataFrame:
    """Adds ``paths`` and ``fingerprint`` of a column of JSON texts, row by row; null for a text that is no JSON object."""

    @F.arrow_udf("array<string>")
    def paths(values: pa.Array) -> pa.Array:
        return pa.array([record_paths(v) for v in values.to_pylist()], pa.list_(pa.string()))

    out = records.withColumn("paths", paths(F.col(column)))
    return out.withColumn("fingerprint", F.substring(F.sha2(F.array_join("paths", "\n").cast("binary"), 256), 1, 16))


def canonical_records(records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """(turns, records of unknown layout) of JSON records in mixed layouts."""
    marked = with_fingerprint(records.select(F.col(column).alias("_json")), "_json")
    turns, known = None, []
    for layout in layouts:
        marks = layout.record_fingerprints
        mine = marked.where(F.col("fingerprint").isin(marks)).select(F.from_json("_json", layout.schema()).alias("_record"))
        own = _turns(mine, layout, "_record")
        turns, known = own if turns is None else turns.unionByName(own), known + marks
    unknown = marked.where(~F.coalesce(F.col("fingerprint").isin(known), F.lit(False)))
    return turns, unknown.select(F.col("_json").alias("record"), "paths", "fingerprint")


# --- template ---------------------------------------------------------------


def escape(text: Column) -> Column:
    """No control string is left whole."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?=(?:{CONTROL_TAILS}))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?=(?:{CONTROL_TAILS}))", "$1$2")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_length: one formatted row per turn.

    The loss mask covers ``loss_length`` characters of ``formatted`` from
    ``loss_start`` (from 0); it is empty for turns that are not learned.
    """
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    learned = F.col("role") == LEARNED
    parts = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).select("conv_id", "turn", head.alias("_head"), body.alias("_body"), learned.alias("_learned"))
    return parts.select(
        "conv_id", "turn", F.concat("_head", "_body", F.lit(END + "\n")).alias("formatted"),
        F.char_length("_head").cast("long").alias("loss_start"),
        F.when(F.col("_learned"), F.char_length("_body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and learned text, from the formatted rows alone."""
    inside = F.substring("formatted", F.lit(len(START) + 1), F.char_length("formatted") - len(START) - len(END) - 1)
    line = F.locate("\n", F.col("_inside"))
    parts = formatted.withColumn("_inside", inside)
    return parts.select(
        "conv_id", "turn",
        F.url_decode(F.substring("_inside", F.lit(1), line - 1)).alias("role"),
        unescape(F.substring("_inside", line + 1, F.char_length("_inside"))).alias("text"),
        unescape(F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))).alias("learned"),
        F.char_length("formatted").cast("long").alias("size"),
    )


DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation; its sorted turns stream through two running hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, rows = none, []
        n, chars, size, all_hash, loss_hash = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            rows.append((current, n, all_hash.hexdigest(), chars, loss_hash.hexdigest(), size))

        def emit() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DIGEST, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=DIGEST)

        for batch in batches:
            for conv, role, text, learned, long in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "size")), strict=True):
                if current is none or conv != current:
                    if current is not none:
                        close()
                    current, n, chars, size = conv, 0, 0, 0
                    all_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                n, chars, size = n + 1, chars + len(learned), size + long
                all_hash.update(f"{role}\n{text}\n".encode())
                loss_hash.update(learned.encode())
            if len(rows) >= 1000:
                yield emit()
        if current is not none:
            close()
        if rows:
            yield emit()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, DIGEST_DDL)
