"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths, list items as []; its fingerprint is their hash. Declarative
mappings, found by fingerprint, say where a layout keeps its turns. Turns are written by a template whose control strings
are escaped inside texts, so that the output can be parsed back into the same turns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What opens and closes a turn, and the strings that texts may not hold as they are.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[SYSTEM_PROMPT]", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")


def paths(value: object, at: str = "") -> set[str]:
    """The paths of a record's leaves."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(fields: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """fields: all paths of the layout. Either items, the path of the list of turns, with the paths of role and text in each;
    or turns: (role, paths whose texts are joined by a blank line). roles: names of roles in the layout that differ.
    optional: fields of the record itself that it may lack."""

    fields: frozenset[str]
    items: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
    optional: frozenset[str] = frozenset()

    def layouts(self) -> Iterator[frozenset[str]]:
        yield self.fields
        for p in self.optional:
            yield self.fields | {p}
        if len(self.optional) > 1:
            yield self.fields | self.optional


def _list(items: str, role: str, text: str, order: str | None = None, optional: tuple[str, ...] = ()) -> Mapping:
    return Mapping(frozenset(f"{items}[].{x}" for x in (role, text, order) if x), items, role, text, order, optional=frozenset(optional))


def _flat(turns: tuple[tuple[str, tuple[str, ...]], ...], optional: tuple[str, ...] = ()) -> Mapping:
    return Mapping(frozenset(p for _, ps in turns for p in ps if p not in optional), turns=turns, optional=frozenset(optional))


MAPPINGS = (
    _list("messages", "role", "content"),
    replace(_list("messages", "role", "text", "turn"), roles=()),
    _list("conversations", "from", "value", optional=("system",)),
    _list("conversation", "role", "content"),
    _list("dialog", "speaker", "utterance"),
    _list("data.messages", "role", "content"),
    _list("turns", "author.role", "content.text"),
    _flat((("user", ("example.prompt",)), ("assistant", ("example.response",)))),
    _flat((("user", ("prompt",)), ("assistant", ("completion",)))),
    _flat((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    _flat((("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    _flat((("user", ("question",)), ("assistant", ("answer",)))),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(set(layout)): m for m in mappings for layout in m.layouts()}


def _at(value: object, path: str) -> object:
    """What a record holds at a path of names; LookupError if it has none there."""
    for name in path.split("."):
        if not isinstance(value, dict) or name not in value:
            raise LookupError(path)
        value = value[name]
    return value


def _say(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _number(value: object) -> tuple[bool, float]:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int | float)):
        raise LookupError("a turn's place isn't a number")
    return value is not None, value or 0


def _turns(record: dict, m: Mapping) -> list[tuple[str, str]]:
    named = dict(m.roles)
    if m.items:
        rows = _at(record, m.items)
        if not isinstance(rows, list):
            raise LookupError(m.items)
        if m.order:
            rows = sorted(rows, key=lambda r: _number(_at(r, m.order)))
        said = [(named.get(_say(_at(r, m.role)), _say(_at(r, m.role))), _say(_at(r, m.text))) for r in rows]
        return ([("system", _say(record["system"]))] if "system" in m.optional & record.keys() else []) + said
    have = {p: _say(_at(record, p)) for _, ps in m.turns for p in ps if p not in m.optional or p in record}
    return [(role, "\n\n".join(have[p] for p in ps if have.get(p))) for role, ps in m.turns if any(p in have for p in ps)]


def canonical(record: object, known: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]] | None]:
    """A record's fingerprint and its (role, text) turns; None if no mapping has the fingerprint, or if an item lacks a field
    that the others have (the fingerprint is of all of them), or turns are numbered by what aren't numbers."""
    mark = fingerprint(paths(record))
    m = known.get(mark)
    if m is None or not isinstance(record, dict):
        return mark, None
    try:
        return mark, _turns(record, m)
    except LookupError:
        return mark, None


def to_turns(records: DataFrame, id_col: str, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """id, fingerprint and turns (array of role and text) of JSON records.

    Turns are null for a record that isn't JSON, is null, or whose layout no mapping has (also if only some of its items
    have it); nothing is guessed. Null roles and texts are empty. Rows with the same turn number stay in the record's order; those without come first.
    """
    known = registry(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, out = [], []
            for text in batch.column("record").to_pylist():
                try:
                    mark, turns = canonical(json.loads(text), known) if text is not None else (None, None)
                except ValueError:
                    mark, turns = None, None
                marks.append(mark)
                out.append(None if turns is None else [{"role": r, "text": t} for r, t in turns])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.string()), pa.array(out, kind)], names=[id_col, "fingerprint", "turns"])

    rows = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, fingerprint string, turns array<struct<role:string,text:string>>")


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|<>" else c for c in s)


#: Wherever a control string starts, its first character gets a mark after it; backslashes are doubled, so marks are unique.
_STARTS = f"(?s)(?=(?:{'|'.join(map(_quote, CONTROL))}))(.)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _STARTS, r"$1\\.")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(?:\.|(\\))", "$1")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text. Its marks can't be inside texts, so splitting by them is enough."""
    parts = F.filter(F.split(formatted, _quote(OPEN)), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(x, BODY, 1)).alias("role"),
            unescape(F.substring(x, F.locate(BODY, x) + F.lit(len(BODY)), F.char_length(x) - F.locate(BODY, x) - F.lit(len(BODY) + len(CLOSE) - 1))).alias("text"),
        ),
    )


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Where the role's escaped texts are in the formatted text: code points from 0, the end not included."""
    piece = lambda t: F.char_length(F.concat(escape(t["role"]), escape(t["text"]))) + F.lit(len(OPEN) + len(BODY) + len(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.lit(len(OPEN) + len(BODY)) + F.char_length(escape(t["role"]))
        span = F.struct(first.cast("int").alias("start"), (first + F.char_length(escape(t["text"]))).cast("int").alias("stop"))
        return F.struct((acc["at"] + piece(t)).cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_chats(chats: DataFrame, id_col: str) -> DataFrame:
    """chats has turns; gives id, formatted and loss_spans (null turns: null)."""
    return chats.select(id_col, render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def digest(formatted: DataFrame, id_col: str) -> DataFrame:
    """Turn and loss digests from formatted texts and their loss spans alone."""
    x = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = x.withColumn("masked", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))))
    x = x.withColumn("loss", F.array_join("masked", ""))
    return x.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _layouts(messages: Column) -> list[Column]:
    """Records that say the same in several layouts; messages: structs of turn, role and text."""
    each = lambda f: F.transform(messages, f)
    plain = each(lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return [
        F.struct(messages.alias("messages")),
        F.struct(plain.alias("messages")),
        F.struct(each(lambda m: F.struct(m["role"].alias("from"), m["text"].alias("value"))).alias("conversations")),
        F.struct(plain.alias("conversation")),
        F.struct(each(lambda m: F.struct(m["role"].alias("speaker"), m["text"].alias("utterance"))).alias("dialog")),
        F.struct(F.struct(plain.alias("messages")).alias("data")),
        F.struct(each(lambda m: F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(m["text"].alias("text")).alias("content"))).alias("turns")),
    ]


def records_of_rows(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, mixed: bool = False) -> DataFrame:
    """Rows by turn put together: a JSON record for each id (one record is one conversation).

    Records have numbered messages; mixed: one of several layouts, by the id. Roles that other layouts have names of their
    own for are kept in the first one, where roles are as they are.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    one = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(turn)).alias("_m"))
    first, *others = [F.to_json(x, {"ignoreNullFields": "false"}) for x in _layouts(F.col("_m"))]
    record = first
    if mixed:
        named = F.exists("_m", lambda m: m["role"].isin([a for a, _ in Mapping.roles]))
        pick = F.when(named, 0).otherwise(F.pmod(F.xxhash64(id_col), F.lit(len(others) + 1)))
        for k, other in enumerate(others, 1):
            record = F.when(pick == k, other).otherwise(record)
    return one.select(id_col, record.alias("record"))
