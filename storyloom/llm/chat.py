"""Chat formatting with schema fingerprints.

Records come in many layouts: prompt and response, instruction with input and output, lists of messages under
several names, tables with one row per turn. A layout is recognised by its fingerprint, the hash of its nested
field paths, which selects a declarative mapping to canonical turns (role, text). Of several layouts whose paths a
record has, that with the most paths is taken (the first listed of equals), so further fields do not matter, whatever
their names. Tables are recognised once, by their schema, and mapped by column expressions; JSON records one by one.
Every record gives one row of ``read_records``: one that no layout fits or that is malformed has no turns and says
why in ``error``; ``turns_of_records`` has the turns of all others.

The template puts every turn between control strings. Control strings inside roles and texts get one more escape
character after their first character, whatever number they had, so no text can end a turn, and reading back
removes exactly one. Formatting is row-local and native; a conversation is its turns' pieces in order, so one with
very many turns is never held in memory, neither in writing nor in reading back (a hash over all its turns is one
sequential pass, though, which one task makes).

Defined results: null texts and roles count as empty; turns go by ``turn``, nulls last, then role and text;
repeated rows are turns of their own; rows with a null conversation id form one conversation with a null id; an
empty table gives an empty result; further columns are ignored, also those whose names other layouts use. In
records, roles and texts that are no strings become their JSON text; half surrogate pairs become U+FFFD; an id that
is no 64-bit whole number (however long), or none at all, becomes a hash of the id, or of the record; field names
that look like paths are no paths; a message that is no object
is an error of its record.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import prepare, rows_of

TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Layout:
    """How a layout's fields become turns.

    fields: (path, role) of single texts, in order; or list, role_at and text_at of a list of messages; or
    row_role and row_text of a table with one row per turn. Paths are dotted, [] marks a list's elements.
    """

    name: str
    paths: tuple[str, ...]
    id_at: str = "conv_id"
    fields: tuple[tuple[str, str], ...] = ()
    list: str = ""
    role_at: str = ""
    text_at: str = ""


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn")),
    Layout("prompt_response", ("id", "prompt", "response"), "id", (("prompt", "user"), ("response", "assistant"))),
    Layout("prompt_completion", ("id", "prompt", "completion"), "id", (("prompt", "user"), ("completion", "assistant"))),
    Layout("instruction", ("id", "instruction", "output"), "id", (("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input", ("id", "instruction", "input", "output"), "id", (("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("system_prompt", ("id", "system", "prompt", "response"), "id", (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("messages", ("id", "messages[].content", "messages[].role"), "id", list="messages", role_at="role", text_at="content"),
    Layout("conversations", ("id", "conversations[].from", "conversations[].value"), "id", list="conversations", role_at="from", text_at="value"),
    Layout("nested_messages", ("data.id", "data.messages[].content", "data.messages[].role"), "data.id", list="data.messages", role_at="role", text_at="content"),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: What a record must have for a layout; one row a record needs no id.
NEEDED = {x.name: frozenset(x.paths) - ({x.id_at} if x.fields or x.list else set()) for x in LAYOUTS}
KNOWN = frozenset().union(*NEEDED.values())
_chosen: dict[str, Layout | None] = {}


def layout_of(paths: set[str], rows: bool) -> tuple[str, Layout | None]:
    """The fingerprint of the known paths among these, and the layout it selects; rows: tables with a row per turn count."""
    known = KNOWN & paths
    mark = fingerprint(known)
    if (key := f"{mark}{rows}") not in _chosen:
        fit = [x for x in LAYOUTS if NEEDED[x.name] <= known and (rows or x.fields or x.list)]
        _chosen[key] = max(fit, key=lambda x: len(NEEDED[x.name]), default=None)
    return mark, _chosen[key]


def step_to(at: str, name: str) -> str:
    """The path of a field below another path: marks of paths inside its name are escaped, and a name is never nothing,
    so no name looks like a longer path."""
    own = re.sub(r"[\\.\[]", r"\\\g<0>", name) or "\\"
    return f"{at}.{own}" if at else own


def paths_of_type(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(paths_of_type(f.dataType, step_to(at, f.name)) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    return {at}


def paths_of_value(value, at: str = "") -> set[str]:
    """The paths of a parsed record's fields; lists and objects have one as well, as a text may be given as either."""
    if isinstance(value, dict):
        return {at}.union(*(paths_of_value(v, step_to(at, k)) for k, v in value.items()))
    if isinstance(value, list):
        return {at}.union(*(paths_of_value(v, f"{at}[]") for v in value))
    return {at}


def _canonical_role(role: Column) -> Column:
    pairs = [F.lit(x) for pair in ROLES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[role], role)


def turns_of_table(df: DataFrame) -> DataFrame:
    """The turns of a table whose schema is one of the layouts."""
    _, found = layout_of(paths_of_type(df.schema), rows=True)
    if found is None:
        raise ValueError(f"no layout has the fields {sorted(paths_of_type(df.schema))}")
    if found.name == "turn_rows":
        return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    if found.fields:
        messages = F.array(*[F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("text")) for path, role in found.fields])
    else:
        messages = F.transform(found.list, lambda m: F.struct(_canonical_role(m[found.role_at]).alias("role"), m[found.text_at].cast("string").alias("text")))
    own = F.col(found.id_at).cast("long") if found.id_at in paths_of_type(df.schema) else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(own.alias("conv_id"), F.posexplode(messages).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


def _at(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value) -> str | None:
    """A value as text that can be written as UTF-8."""
    text = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if text is not None and not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text):
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _own_id(value, line: str) -> int:
    if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63:
        return value
    mark = line if value is None else json.dumps(value, sort_keys=True)
    return xxhash.xxh64_intdigest(mark.encode("utf-8", "replace")) - 2**63


def _whole(digits: str) -> int | str:
    """A JSON number; one too long for a number of Python's stays text."""
    return int(digits) if len(digits) <= 4000 else digits


def turns_of_record(line: str | None) -> dict:
    """conv_id, fingerprint, layout, turns and error of a JSON record."""
    out = {"conv_id": None, "fingerprint": None, "layout": None, "turns": [], "error": None}
    try:
        record = json.loads(line, parse_int=_whole) if line is not None else None
        out["fingerprint"], found = layout_of(paths_of_value(record), rows=False)
        if found is None:
            return out | {"error": "no layout has these fields" if isinstance(record, dict) else "no object"}
        own = _own_id(_at(record, found.id_at), line)
        if found.fields:
            turns = [(role, _text(_at(record, path))) for path, role in found.fields]
        else:
            messages = _at(record, found.list)
            if not isinstance(messages, list):
                return out | {"conv_id": own, "layout": found.name, "error": f"{found.list} is no list"}
            wrong = [i for i, m in enumerate(messages) if not isinstance(m, dict)]
            if wrong:
                return out | {"conv_id": own, "layout": found.name, "error": f"message {wrong[0]} is no object"}
            roles = [_text(m.get(found.role_at)) for m in messages]
            turns = [(ROLES.get(r, r), _text(m.get(found.text_at))) for r, m in zip(roles, messages, strict=True)]
    except RecursionError:
        return out | {"error": "nested too deeply"}
    except ValueError:
        return out | {"error": "no JSON"}
    return out | {"conv_id": own, "layout": found.name, "turns": [{"role": r, "text": t} for r, t in turns]}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    kinds = {"conv_id": pa.int64(), "fingerprint": pa.string(), "layout": pa.string(), "turns": pa.list_(turn), "error": pa.string()}
    for b in rows_of(batches):
        yield pa.RecordBatch.from_pylist([turns_of_record(line) for line in b.column(0).to_pylist()], schema=pa.schema(kinds.items()))


def read_records(lines: DataFrame) -> DataFrame:
    """JSON records, one a row in the first column -> conv_id, fingerprint, layout, turns, error: a row for each."""
    prepare(lines.sparkSession)
    kind = "conv_id long, fingerprint string, layout string, turns array<struct<role:string,text:string>>, error string"
    return lines.select(F.col(f"`{lines.columns[0]}`").cast("string")).mapInArrow(_records, kind)


def turns_of_records(lines: DataFrame) -> DataFrame:
    """The turns of the JSON records that read_records gives no error for."""
    return read_records(lines).where("error is null").select("conv_id", F.posexplode("turns").alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


#: The template's control strings, and those of others that a text must not smuggle in. Each has < or [ only at its start.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|turn\|>|\|text\|>|\|end\|>|\|endoftext\|>|/?s>|/?INST\])"
PIECE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One piece per turn: conv_id, turn, role, text (as they came, for the order), piece, loss_start and loss_length within it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    body = escape(text)
    at = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"), (role == loss_role).alias("loss"))
    length = F.when(F.col("loss"), F.length("body")).otherwise(0)
    return at.select("conv_id", "turn", "role", "text", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.length("head").alias("loss_start"), length.alias("loss_length"))


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces with those of a conversation together and in order."""
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "piece", "loss_start", "loss_length")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pieces -> one row per conversation, from what the pieces say."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    done: list[tuple] = []
    key, state = None, None

    def close():
        n, turns, chars, loss, size = state
        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def batch():
        out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    for b in rows_of(batches):
        for conv, piece, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or conv != key:
                if state is not None:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in PIECE.findall(piece):
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            under = unescape(piece[start : start + length])
            state[2] += len(under)
            state[3].update(under.encode())
            state[4] += len(piece)
        if done:
            yield batch()
    if state is not None:
        close()
        yield batch()


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each formatted conversation: its turns, and the text under its loss mask."""
    prepare(pieces.sparkSession)
    return in_order(pieces).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(pieces: DataFrame) -> DataFrame:
    """One row per conversation, for conversations that fit a row: conv_id, text, loss (start, length in code points)."""
    order = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text", "piece", "loss_start", "loss_length")
    held = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["piece"])).alias("at"),
        F.when(x["loss_length"] > 0, F.concat(a["loss"], F.array(F.struct((a["at"] + x["loss_start"]).alias("start"), x["loss_length"].alias("length"))))).otherwise(a["loss"]).alias("loss"),
    )
    return held.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), F.aggregate("p", start, step, lambda a: a["loss"]).alias("loss"))
