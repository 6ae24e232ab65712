"""Chat formatting by schema fingerprint.

The nested field paths of a record, or of a table's schema, are hashed; the
hash selects a declarative mapping (where turns lie, which field says who
speaks and what) that turns the layout into canonical (conversation, turn,
role, text) rows.  Paths that no mapping names (ids, names, metadata) don't
count.  Where paths of several layouts are there at once, the first layout in
the order of ``LAYOUTS`` whose own paths hash to its fingerprint is taken.

Turns become template segments: marks around an escaped text.  Escaping doubles
backslashes and breaks every control string by one, so a text can't forge a
mark and is read back exactly.  A conversation's segments are joined to one
text with its loss mask; over ``PART_CHARACTERS`` it goes on in further parts,
so conversations of any length need constant memory.

Null role and null text count as empty.  Null conv_ids form one conversation.
Null turns come first; equal turns are ordered by role, then text; repeated
rows are repeated turns.  Records of unknown layout, broken or null JSON give
one turn of null role with the raw text, which no loss mask covers.  An empty
list of messages gives no turns, an empty table no conversations.  Columns that
no mapping names are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WorkFolder, table

# ------------------------------------------------------------ layouts, mappings


def paths_of_type(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type; [] marks a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of_type(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    return [at]


def paths_of_value(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON record."""
    if isinstance(value, dict):
        return set().union(*[paths_of_value(v, f"{at}.{k}" if at else k) for k, v in value.items()]) if value else {at}
    if isinstance(value, list):
        return set().union(*[paths_of_value(v, f"{at}[]") for v in value]) if value else {f"{at}[]"}
    return {at}


def schema_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: Who speaks, by the names that layouts use.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user", "instruction": "user"}


def _listed(name: str, who: str, what: str) -> dict:
    return {"name": name, "paths": [f"{name}[].{who}", f"{name}[].{what}"], "list": name, "role": who, "text": what}


def _fields(name: str, *fields: tuple[str, list[str]], optional: tuple[str, ...] = ()) -> dict:
    return {"name": name, "paths": [p for _, names in fields for p in names if p not in optional], "optional": list(optional), "fields": list(fields)}


#: Each layout: the paths it must have and may have, and either fields per turn (rows), a list of messages, or fields in order.
LAYOUTS = [
    {"name": "turn_rows", "paths": ["conv_id", "turn", "role", "text"], "rows": {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}},
    _listed("messages", "role", "content"),
    _listed("conversations", "from", "value"),
    _listed("conversation", "role", "content"),
    _fields("instruction_output", ("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"]), optional=("system", "input")),
    _fields("instruction_response", ("system", ["system"]), ("user", ["instruction", "context"]), ("assistant", ["response"]), optional=("system", "context")),
    _fields("prompt_completion", ("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"]), optional=("system",)),
    _fields("prompt_response", ("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"]), optional=("system",)),
    _fields("question_answer", ("system", ["system"]), ("user", ["context", "question"]), ("assistant", ["answer"]), optional=("system", "context")),
]


def fingerprints(layout: dict) -> set[str]:
    """Of the layout's paths with any of its optional ones; a list may be empty."""
    optional = layout.get("optional", [])
    chosen = [[o for k, o in enumerate(optional) if bits >> k & 1] for bits in range(1 << len(optional))]
    return {schema_fingerprint([*layout["paths"], *more]) for more in chosen} | ({schema_fingerprint([f"{layout['list']}[]"])} if "list" in layout else set())


def _own(layout: dict) -> set[str]:
    return {*layout["paths"], *layout.get("optional", []), *([f"{layout['list']}[]"] if "list" in layout else [])}


class Mappings:
    """Layouts by fingerprint; what a fingerprint selects is remembered."""

    def __init__(self, layouts: list[dict] = LAYOUTS):
        self.layouts = [(layout, _own(layout), fingerprints(layout)) for layout in layouts]
        self.named = set().union(*[own for _, own, _ in self.layouts])
        self.known: dict[str, dict | None] = {f: layout for layout, _, prints in reversed(self.layouts) for f in prints}

    def select(self, paths) -> dict | None:
        paths = self.named.intersection(paths)
        found = schema_fingerprint(paths)
        if found not in self.known:
            self.known[found] = next((layout for layout, own, prints in self.layouts if schema_fingerprint(own & paths) in prints), None)
        return self.known[found]


MAPPINGS = Mappings()


def _said(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of_record(record: dict, mappings: Mappings = MAPPINGS) -> list[tuple[str, str]] | None:
    """(role, text) of a nested record; None if no mapping knows its layout."""
    layout = mappings.select(paths_of_value(record))
    if layout is None or "rows" in layout:
        return None
    if "list" in layout:
        said = [m if isinstance(m, dict) else {layout["text"]: m} for m in record[layout["list"]] or []]
        return [(ROLES.get(r, r), _said(m.get(layout["text"]))) for m in said for r in [_said(m.get(layout["role"]))]]
    return [(role, "\n\n".join(t for t in (_said(record.get(n)) for n in names) if t)) for role, names in layout["fields"] if any(n in record for n in names)]


def _text(column: Column, kind: T.DataType) -> Column:
    """Text as it is, nested values as JSON, null as empty."""
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return F.coalesce(F.to_json(column) if nested else column.cast("string"), F.lit(""))


def _canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[role], role)


def canonical_turns(df: DataFrame, id_column: str = "conv_id", mappings: Mappings = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of a table, by the fingerprint of its schema: turn rows, a list of messages or fields in a row."""
    layout = mappings.select(p for f in df.schema.fields for p in paths_of_type(f.dataType, f.name))
    if layout is None:
        raise ValueError(f"no mapping for the fields {sorted(df.columns)}")
    types = {f.name: f.dataType for f in df.schema.fields}
    if "rows" in layout:
        rows = layout["rows"]
        return df.select(df[rows["conv_id"]].cast("long").alias("conv_id"), df[rows["turn"]].cast("long").alias("turn"), _text(df[rows["role"]], types[rows["role"]]).alias("role"), _text(df[rows["text"]], types[rows["text"]]).alias("text"))
    own = df[f"`{id_column}`"].cast("long").alias("conv_id")
    if "list" in layout:
        message = {f.name: f.dataType for f in types[layout["list"]].elementType.fields}
        turns = df.select(own, F.posexplode(df[layout["list"]]).alias("turn", "m"))
        role = _canonical_role(_text(F.col("m")[layout["role"]], message[layout["role"]]))
        return turns.select("conv_id", F.col("turn").cast("long"), role.alias("role"), _text(F.col("m")[layout["text"]], message[layout["text"]]).alias("text"))
    said = []
    for role, names in layout["fields"]:
        if own_names := [n for n in names if n in types]:
            parts = F.filter(F.array(*[_text(df[n], types[n]) for n in own_names]), lambda t: t != "")
            said.append(F.struct(F.lit(len(said)).cast("long").alias("turn"), F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    return df.select(own, F.explode(F.array(*said)).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def canonical_json(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Turn rows of JSON records of mixed layouts; unknown ones give one row of role null, the record as text."""

    def run(batches):
        for b in batches:
            out = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    record = json.loads(raw or "")
                    turns = turns_of_record(record) if isinstance(record, dict) else None
                except ValueError:
                    turns = None
                out += [(i, k, *t) for k, t in enumerate([(None, raw)] if turns is None else turns)]
            c = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["conv_id", "turn", "role", "text"])

    return df.select(df[f"`{id_column}`"].cast("long"), df[f"`{json_column}`"].cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string")


# --------------------------------------------------------------------- template

#: Strings with a meaning in this or a well-known template; none survives in an escaped text.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: A segment: OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
#: A conversation's text goes on in a further part beyond this.
PART_CHARACTERS = 1 << 20


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


_ESCAPED_ONE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED_ONE.sub(r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): the loss mask covers the escaped assistant texts, in code points of the segment."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", (role == "assistant").alias("learn"), F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)).alias("head"), escape(text).alias("body"))
    start = F.when(F.col("learn"), F.char_length("head")).cast("long")
    return rows.select("conv_id", "turn", F.concat("head", "body", F.lit(CLOSE)).alias("segment"), start.alias("loss_start"), (start + F.char_length("body")).alias("loss_end"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = "conv_id long, part long, last boolean, text string, loss array<struct<start:long,end:long>>"


def _joined(characters):
    """Segments in order -> a row per conversation, or several for a long one."""

    def run(batches):
        key, part, held, size, loss, begun = None, 0, [], 0, [], False
        out: list = []

        def done(last):
            out.append((key, part, last, "".join(held), loss))

        def batch():
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.bool_(), pa.string(), _SPANS])], names=["conv_id", "part", "last", "text", "loss"])
            out.clear()
            return rows

        waiting = 0
        for b in batches:
            for conv, segment, start, end in zip(*[c.to_pylist() for c in b.columns]):
                if begun and (conv != key or size + len(segment) > characters):
                    done(conv != key)
                    waiting += size
                    part = part + 1 if conv == key else 0
                    held, size, loss = [], 0, []
                    if waiting > characters or len(out) >= 1000:
                        yield batch()
                        waiting = 0
                key, begun = conv, True
                if start is not None:
                    loss.append({"start": size + start, "end": size + end})
                held.append(segment)
                size += len(segment)
        if begun:
            done(True)
        if out:
            yield batch()

    return run


def format_conversations(turns: DataFrame, characters: int = PART_CHARACTERS) -> DataFrame:
    """(conv_id, part, last, text, loss): each conversation's formatted text and the spans of its loss mask, in code points of the text."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return format_turns(dealt).select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_joined(characters), _FORMATTED)


def read_conversation(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns = [s.removeprefix(OPEN).partition(MIDDLE) for s in text.split(CLOSE)[:-1]]
    return [(unescape(role), unescape(said)) for role, _, said in turns]


def _digests(batches):
    """Parts in order -> one row per conversation, in constant memory."""
    state, out = None, []

    def batch():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for conv, _, last, text, loss in zip(*[c.to_pylist() for c in b.columns]):
            state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = read_conversation(text)
            state[0] += len(turns)
            state[1].update("".join(f"{role}\n{said}\n" for role, said in turns).encode())
            learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(text)
            if last:
                n, all_, chars, masked, total = state
                out.append((conv, n, all_.hexdigest(), chars, masked.hexdigest(), total))
                state = None
        if len(out) >= 5000:
            yield batch()
            out = []
    if out:
        yield batch()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Of stored conversations; only those of several parts are shuffled."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole = formatted.where("part = 0 AND last").mapInArrow(_digests, schema)
    parts = formatted.where("part > 0 OR NOT last").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(parts.mapInArrow(_digests, schema))


#: A conversation that spells out control strings; the query carries it beside the table.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_turns(table(spark, sf_dir, "conversations"))
    probe = spark.range(len(PROBE)).select(*[F.element_at(F.array(*[F.lit(r[k]) for r in PROBE]), F.col("id").cast("int") + 1).cast(t).alias(n) for k, (n, t) in enumerate((("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))])
    stored = WorkFolder(spark, "chat").materialise(format_conversations(rows.unionByName(probe)), "conversations")
    return conversation_digests(stored)


_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len(OPEN + MIDDLE + CLOSE)}) AS formatted
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM said
"""
