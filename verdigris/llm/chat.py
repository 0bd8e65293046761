"""Conversations of any known layout as text for training, with the places that bear loss.

Records come as prompt and completion, instruction with input and output, message lists under several names, or as a
table with a row for each turn. The nested field paths of a record are hashed, and the fingerprint selects one of the
declarative mappings below, which says how the fields become turns (role, text). Tables are recognised by the paths
of their schema, records of mixed layouts one by one.

Turns are written between marks of a template. Texts and roles may hold any control string, so each one gets a
backslash behind its first character, and one more where backslashes already stand there. This can be undone exactly,
and no mark can be forged. Offsets are prefix sums in the order of turns, so the loss mask is known without reading
the formatted text.

Only DataFrame functions are used; nothing here runs Python on the executors.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: What follows the first character, < or [, of a control string of the public chat templates.
_BEHIND_FIRST = r"(\||/?s>|</?SYS>>|/?INST\])"
_CONTROL = r"([<\[])(\\*)" + _BEHIND_FIRST
_ESCAPED = r"([<\[])\\(\\*)" + _BEHIND_FIRST


@dataclass(frozen=True)
class One:
    """A turn from fields of the record; those that are there are joined by an empty line."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list; ``parts`` names the text inside a text that is a list itself."""

    list: str
    role: str
    text: str
    parts: str | None = None


@dataclass(frozen=True)
class Exchange:
    """Turns for each element of a list whose elements hold a text for each role: (role, field) in order."""

    list: str
    said: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Layout:
    """Paths a record must have, paths it may have, and what its turns are made of."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[One | Each | Exchange, ...]
    optional: tuple[str, ...] = ()


@dataclass(frozen=True)
class RowLayout:
    """A table with a row for each turn: its key, order, role and text columns."""

    name: str
    key: str
    order: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.key, self.order, self.role, self.text)


@dataclass(frozen=True)
class Template:
    """Marks around a turn: before the role, between role and text, behind the text.

    Each begins with a control string, so that no text has one.
    """

    begin: str
    between: str
    end: str

    def __post_init__(self) -> None:
        for mark in (self.begin, self.between, self.end):
            if not re.match(r"[<\[]" + _BEHIND_FIRST, mark):
                raise ValueError(f"{mark!r} isn't a mark that texts can't hold")


_SYSTEM = One("system", ("system",))

#: Field names of public instruction and chat data sets.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (_SYSTEM, Each("messages", "role", "content")), ("system",)),
    Layout(
        "message_parts",
        ("messages[].role", "messages[].content[].text"),
        (_SYSTEM, Each("messages", "role", "content", "text")),
        ("system", "messages[].content"),
    ),
    Layout("shared", ("conversations[].from", "conversations[].value"), (_SYSTEM, Each("conversations", "from", "value")), ("system",)),
    Layout("conversation", ("conversation[].role", "conversation[].content"), (_SYSTEM, Each("conversation", "role", "content")), ("system",)),
    Layout("dialog", ("dialog[].role", "dialog[].text"), (_SYSTEM, Each("dialog", "role", "text")), ("system",)),
    Layout("pairs", ("conversation[].human", "conversation[].assistant"), (_SYSTEM, Exchange("conversation", (("user", "human"), ("assistant", "assistant")))), ("system",)),
    Layout("instruction_output", ("instruction", "output"), (_SYSTEM, One("user", ("instruction", "input")), One("assistant", ("output",))), ("input", "system")),
    Layout("instruction_response", ("instruction", "response"), (_SYSTEM, One("user", ("instruction", "context")), One("assistant", ("response",))), ("context", "system")),
    Layout("prompt_completion", ("prompt", "completion"), (_SYSTEM, One("user", ("prompt",)), One("assistant", ("completion",))), ("system",)),
    Layout("prompt_response", ("prompt", "response"), (_SYSTEM, One("user", ("prompt",)), One("assistant", ("response",))), ("system",)),
    Layout("preference", ("prompt", "chosen"), (_SYSTEM, One("user", ("prompt",)), One("assistant", ("chosen",))), ("rejected", "system")),
    Layout("question_answer", ("question", "answer"), (_SYSTEM, One("user", ("context", "question")), One("assistant", ("answer",))), ("context", "system")),
)

#: Column names of tables with a row for each turn.
ROW_LAYOUTS = (
    RowLayout("turn_rows", "conv_id", "turn", "role", "text"),
    RowLayout("message_rows", "conversation_id", "message_index", "role", "content"),
    RowLayout("shared_rows", "conversation_id", "position", "from", "value"),
)

#: Names that list layouts use for the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

CHATML = Template("<|im_start|>", "<|im_sep|>", "<|im_end|>\n")
HEADERS = Template("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>")

LOSS_ROLE = "assistant"
_TURN = "struct<role: string, text: string>"


# ---------------------------------------------------------------- layouts


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a type; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    return {at}


def _known_paths() -> list[str]:
    return sorted(set(chain.from_iterable(layout.paths + layout.optional for layout in LAYOUTS)))


def _by_fingerprint() -> dict[str, str]:
    """Fingerprints of every layout with any of its optional paths."""
    return {
        fingerprint(layout.paths + more): layout.name
        for layout in LAYOUTS
        for size in range(len(layout.optional) + 1)
        for more in combinations(layout.optional, size)
    }


def _field(record: Column, name: str, kind: str) -> Column:
    """A field of a variant object, null where the object has none or it isn't of this kind."""
    return F.try_variant_get(record, f"$.{name}", kind)


def _is_there(record: Column, path: str) -> Column:
    """Whether the record has a value at the path; for lists, whether any element has one."""
    name, is_list, rest = path.partition("[].")
    if not is_list:
        return _field(record, name, "string").isNotNull()
    inside = F.exists(_field(record, name, "array<variant>"), lambda item: _is_there(item, rest))
    return F.coalesce(inside, F.lit(False))


def recognise(records: DataFrame, record: str) -> DataFrame:
    """``records`` with fingerprint (of the known paths that hold a value) and layout (null where none fits).

    ``record`` is a variant column. Fields that are null everywhere in a record count as absent, unknown fields don't
    count. A record with more known paths than any layout has takes the one with the most paths among those whose
    required paths it has.
    """
    known = F.array_compact(
        F.array(*(F.when(_is_there(F.col(record), path), F.lit(path)) for path in _known_paths()))
    )
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(_by_fingerprint().items())))
    by_size = sorted(LAYOUTS, key=lambda layout: -len(layout.paths + layout.optional))
    fallback = F.coalesce(
        *(
            F.when(F.size(F.array_except(F.array(*map(F.lit, layout.paths)), "_known")) == 0, F.lit(layout.name))
            for layout in by_size
        )
    )
    return (
        records.withColumn("_known", known)
        .withColumn("fingerprint", F.sha2(F.array_join("_known", ","), 256))
        .withColumn("layout", F.coalesce(F.try_element_at(table, F.col("fingerprint")), fallback))
        .drop("_known")
    )


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _part_turns(record: Column, part: One | Each | Exchange) -> Column:
    if isinstance(part, One):
        there = F.array_compact(F.array(*(_field(record, name, "string") for name in part.fields)))
        turn = _turn(F.lit(part.role), F.array_join(F.array_remove(there, ""), "\n\n"))
        return F.when(F.size(there) > 0, F.array(turn)).otherwise(F.array().cast(f"array<{_TURN}>"))
    items = F.coalesce(_field(record, part.list, "array<variant>"), F.array().cast("array<variant>"))
    if isinstance(part, Exchange):
        return F.flatten(
            F.transform(
                items,
                lambda item: F.array(*(_turn(F.lit(role), _field(item, name, "string")) for role, name in part.said)),
            )
        )
    names = F.create_map(*(F.lit(x) for x in chain.from_iterable(ROLE_NAMES.items())))

    def turn(item: Column) -> Column:
        role = _field(item, part.role, "string")
        text = _field(item, part.text, "string")
        if part.parts:
            inside = F.transform(
                _field(item, part.text, "array<variant>"), lambda x: F.coalesce(_field(x, part.parts, "string"), F.lit(""))
            )
            text = F.coalesce(F.array_join(inside, ""), text)
        return _turn(F.coalesce(F.try_element_at(names, role), role), text)

    return F.transform(items, turn)


def record_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """key, layout, place, role, text: the canonical turns of records given as JSON text or as a variant column.

    A record that is null, no JSON or of no known layout, or that has no turn, gives one row whose place is null.
    Nulls inside a turn are empty texts. Equal keys are one conversation only for ``formatted``; the caller chooses them.
    """
    kind = records.schema[record].dataType
    variant = F.col(record) if isinstance(kind, T.VariantType) else F.try_parse_json(F.col(record))
    known = recognise(records.select(F.col(key).alias("key"), variant.alias("record")), "record")
    turns = F.lit(None).cast(f"array<{_TURN}>")
    for layout in LAYOUTS:
        made = F.concat(*(_part_turns(F.col("record"), part) for part in layout.turns))
        turns = F.when(F.col("layout") == layout.name, made).otherwise(turns)
    return known.select("key", "layout", F.posexplode_outer(turns).alias("place", "turn")).select(
        "key", "layout", F.col("place").cast("long"), "turn.role", "turn.text"
    )


def as_record(rows: DataFrame, names: list[str] | None = None) -> Column:
    """The columns of a table (or the named ones) as one variant, for ``record_turns``."""
    return F.to_variant_object(F.struct(*(F.col(f"`{name}`") for name in names or rows.columns)))


def row_layout(rows: DataFrame) -> RowLayout:
    """The layout of a table with a row for each turn, by the fingerprint of its schema's paths.

    Paths that no such layout has don't count. Of several layouts whose paths are all there, the first one is taken.
    """
    vocabulary = set(chain.from_iterable(layout.paths for layout in ROW_LAYOUTS))
    paths = schema_paths(rows.schema) & vocabulary
    exact = {fingerprint(layout.paths): layout for layout in ROW_LAYOUTS}.get(fingerprint(paths))
    fitting = [layout for layout in ROW_LAYOUTS if set(layout.paths) <= paths]
    if not exact and not fitting:
        raise ValueError(f"no layout with a row for each turn has the columns {rows.columns}")
    return exact or fitting[0]


def row_turns(rows: DataFrame) -> DataFrame:
    """key, layout, place, role, text of a table with a row for each turn. Null role or text is empty."""
    layout = row_layout(rows)
    return rows.select(
        F.col(layout.key).alias("key"),
        F.lit(layout.name).alias("layout"),
        F.col(layout.order).cast("long").alias("place"),
        F.coalesce(F.col(layout.role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(layout.text).cast("string"), F.lit("")).alias("text"),
    )


# ---------------------------------------------------------------- template


def escaped(text: Column) -> Column:
    """The text with one more backslash behind the first character of each control string."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def formatted(turns: DataFrame, template: Template = CHATML, loss_role: str = LOSS_ROLE) -> DataFrame:
    """key, formatted, loss: each conversation as one text, and (start, length) in UTF-8 bytes of the texts bearing loss.

    Turns (key, place, role, text) are taken by place, a null place of a turn first, ties by role and text; repeated
    rows are turns each. Rows without role are conversations without a turn, whose text is empty. Rows without key are
    one conversation. A conversation becomes one text, so it must fit into one (2 GB); nothing else is gathered.
    """
    head = F.concat(F.lit(template.begin), escaped(F.col("role")), F.lit(template.between))
    pieces = turns.select(
        "key",
        "place",
        "role",
        "text",
        head.alias("head"),
        escaped(F.col("text")).alias("body"),
    ).withColumn("bytes", F.octet_length("head") + F.octet_length("body") + len(template.end.encode()))
    order = Window.partitionBy("key").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "key",
        F.when(
            F.col("role").isNotNull(),
            F.struct(
                F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("start"),
                F.concat("head", "body", F.lit(template.end)).alias("piece"),
                (F.col("role") == loss_role).alias("bears_loss"),
                F.octet_length("head").alias("before"),
                F.octet_length("body").alias("length"),
            ),
        ).alias("turn"),
    )
    whole = placed.groupBy("key").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    loss = F.transform(
        F.filter("turns", lambda t: t.bears_loss),
        lambda t: F.struct((t.start + t.before).cast("long").alias("start"), t.length.cast("long").alias("length")),
    )
    return whole.select("key", F.array_join("turns.piece", "").alias("formatted"), loss.alias("loss"))


def read_turns(text: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(text, re.escape(template.end)), lambda piece: piece != "")
    halves = F.transform(pieces, lambda piece: F.split(piece, re.escape(template.between), 2))
    return F.transform(
        halves,
        lambda half: F.struct(
            unescaped(F.substr(half[0], F.lit(len(template.begin) + 1))).alias("role"),
            unescaped(half[1]).alias("text"),
        ),
    )


def loss_texts(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order."""
    whole = F.encode(text, "UTF-8")
    return F.transform(
        loss,
        lambda span: unescaped(F.decode(F.substr(whole, (span.start + 1).cast("int"), span.length.cast("int")), "UTF-8")),
    )


def digest(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``formatted``."""
    read = conversations.select(
        F.col("key").alias("conv_id"),
        "formatted",
        read_turns(F.col("formatted"), template).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("under_loss"),
    )
    said = F.transform("turns", lambda turn: F.concat(turn.role, F.lit("\n"), turn.text, F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_rows(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """A table of conv_id, turn, role, text with further rows, made of literals."""
    names = ("conv_id", "turn", "role", "text")
    more = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))
    added = table.sparkSession.range(1).select(F.inline(more))
    kinds = {name: table.schema[name].dataType for name in names}
    return table.select(*names).unionByName(added.select(*(F.col(n).cast(kinds[n]) for n in names)))
