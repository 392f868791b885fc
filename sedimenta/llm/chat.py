"""Chat formatting: layouts are recognised by a fingerprint of their field paths and mapped to canonical turns.

fingerprint() hashes the sorted nested field paths of a schema (arrays as [], names lower-case, types left out). LAYOUTS
maps the fingerprints of known layouts to declarative mappings: where a conversation's id is, and either one turn per
row, an array of messages, or fields that are turns of fixed roles. Extra columns at the top level are ignored when
no layout has the whole schema: then the layout with the most fields among those that it covers is taken.

The template writes a turn as <turn ROLE>TEXT</turn> and a line feed. In roles and texts a backslash is written \\\\
and < is written \\l, and in roles > is written \\g, so no control string can appear inside and the text comes back
exactly. Each turn is a row (conversation, turn number, text, loss spans in code points), so a long conversation never
has to be in one value; assistant texts are the spans under the loss mask.

Null texts and roles are empty, and so are null messages. Turns are in order of their number, nulls first, ties by their
formatted text. A conversation whose messages are null or empty is one row of a null role: no turn, an empty formatted
text. Rows with a null conversation id are one conversation with a null id. Ids keep their type; layouts without ids get
long ones, written to the shared folder before use so that a task that runs again sees the same. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.session import scratch


@dataclass(frozen=True)
class Mapping:
    """How a layout's rows become turns. kind: rows, messages or fields."""

    name: str
    paths: tuple[str, ...]
    kind: str
    conv: str | None = None
    turn: str | None = None
    role: str = "role"
    text: str = "text"
    messages: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    rename: bool = False


#: Roles as other layouts name them.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "prompter": "user", "ai": "assistant"}

#: The column of ids that layouts without any get.
NUMBER = "__conversation"

MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), "rows", conv="conv_id", turn="turn"),
    Mapping("turn rows, content", ("conversation_id", "turn", "role", "content"), "rows", conv="conversation_id", turn="turn", text="content"),
    Mapping("messages", ("id", "messages[].role", "messages[].content"), "messages", conv="id", messages="messages", text="content"),
    Mapping("messages without id", ("messages[].role", "messages[].content"), "messages", messages="messages", text="content"),
    Mapping("conversations from/value", ("id", "conversations[].from", "conversations[].value"), "messages", conv="id", messages="conversations", role="from", text="value", rename=True),
    Mapping("conversations without id", ("conversations[].from", "conversations[].value"), "messages", messages="conversations", role="from", text="value", rename=True),
    Mapping("prompt and completion", ("prompt", "completion"), "fields", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), "fields", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion, id", ("id", "prompt", "completion"), "fields", conv="id", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), "fields", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction and input", ("instruction", "input", "output"), "fields", fields=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction, system", ("system", "instruction", "input", "output"), "fields", fields=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("question and answer", ("question", "answer"), "fields", fields=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def path_hash(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprint(schema: T.StructType) -> str:
    return path_hash(field_paths(schema))


LAYOUTS = {path_hash(m.paths): m for m in MAPPINGS}


def layout_of(schema: T.StructType) -> Mapping:
    """The mapping of a schema, by its fingerprint or that of the largest known part of it."""
    if found := LAYOUTS.get(fingerprint(schema)):
        return found
    have = set(field_paths(schema))
    fitting = [m for m in MAPPINGS if have.issuperset(m.paths)]
    if not fitting:
        raise ValueError(f"no layout for the fields {sorted(have)}")
    part = max(fitting, key=lambda m: len(m.paths))
    return LAYOUTS[path_hash(part.paths)]


def canonical_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of every turn. Layouts without an id get one from Spark, unique in the table."""
    m = layout_of(rows.schema)
    if not m.conv:
        folder = scratch(rows.sparkSession, "conversations")
        rows.select([p.split("[")[0] for p in dict.fromkeys(m.messages or p for p in m.paths)]).withColumn(NUMBER, F.monotonically_increasing_id()).write.parquet(folder)
        rows = rows.sparkSession.read.parquet(folder)
    if m.kind == "rows":
        return rows.select(F.col(m.conv).alias("conv_id"), F.col(m.turn).cast("long").alias("turn"), _role(F.col(m.role), m.rename), _text(F.col(m.text)))
    conv = F.col(m.conv or NUMBER)
    if m.kind == "messages":
        flat = rows.select(conv.alias("conv_id"), F.posexplode_outer(m.messages).alias("turn", "m"))
        role = F.when(F.col("turn").isNotNull(), _role(F.col("m")[m.role], m.rename))
        return flat.select("conv_id", F.col("turn").cast("long"), role.alias("role"), _text(F.col("m")[m.text]))
    turns = []
    for role, field in m.fields:
        parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in field.split("+")]
        text = parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    flat = rows.select(conv.alias("conv_id"), F.posexplode(F.array(*turns)).alias("turn", "m"))
    if any(role == "system" for role, _ in m.fields):
        flat = flat.where("m.role != 'system' or m.text != ''")
    return flat.select("conv_id", F.col("turn").cast("long"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def _role(c: Column, rename: bool) -> Column:
    plain = F.coalesce(c.cast("string"), F.lit(""))
    if not rename:
        return plain.alias("role")
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(plain)), plain).alias("role")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")).alias("text")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, formatted and loss, the spans (start, end) of formatted under the mask, for each turn."""
    role = F.replace(_escaped(F.col("role")), F.lit(">"), F.lit("\\g"))
    opening, body = F.concat(F.lit("<turn "), role, F.lit(">")), _escaped(F.col("text"))
    formatted = F.coalesce(F.concat(opening, body, F.lit("</turn>\n")), F.lit(""))
    start = F.length(opening)
    loss = F.when(F.col("role") == loss_role, F.array(F.struct(start.alias("start"), (start + F.length(body)).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return turns.select("conv_id", "turn", formatted.alias("formatted"), loss.alias("loss"))


_TURN = re.compile(r"<turn ([^<>]*)>([^<]*)</turn>\n")
_ESCAPE = re.compile(r"\\(.)", re.S)
_PLAIN = {"\\": "\\", "l": "<", "g": ">"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text; anything but whole turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted turns, a row for each conversation.

    The turns of a conversation pass through hashes in order, so memory is that of a batch however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        done: list[tuple] = []

        def close():
            conv, n, sha, loss_chars, loss_sha, chars = state
            done.append((conv, n, sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))
            state.clear()

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state and state[0] != conv:
                    close()
                if not state:
                    state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, plain in parse_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{plain}\n".encode())
                for span in loss:
                    plain = unescape(text[span["start"] : span["end"]])
                    state[3] += len(plain)
                    state[4].update(plain.encode())
                state[5] += len(text)
            if done:
                yield _digest_batch(done, batch.schema.field(0).type)
                done = []
            kind = batch.schema.field(0).type
        if state:
            close()
            yield _digest_batch(done, kind)

    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)
