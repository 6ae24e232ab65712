"""Layouts by fingerprint, of tables and of records; whole conversations and long ones."""

import json
from collections import defaultdict

import pytest

from stratagram.llm import chat
from stratagram.llm.common import WorkFolder

TALK = [("user", "q"), ("assistant", "a")]
TABLES = {
    "messages": ("conv_id long, messages array<struct<role:string,content:string,name:string>>, source string", (5, [("user", "q", "n"), ("assistant", "a", None)], "s")),
    "conversations": ("conv_id long, conversations array<struct<`from`:string,value:string>>", (5, [("human", "q"), ("gpt", "a")])),
    "prompt": ("conv_id long, prompt string, completion string, score double", (5, "q", "a", 0.5)),
    "instruction": ("conv_id long, instruction string, input string, output string", (5, "q", None, "a")),
    "context": ("conv_id long, context string, instruction string, response string, category string", (5, "", "q", "a", "c")),
    "rows beside other layouts": ("conv_id long, turn int, role string, text string, prompt string, messages string", None),
}


@pytest.mark.parametrize("name", TABLES)
def test_tables(spark, name):
    schema, row = TABLES[name]
    rows = [row] if row else [(5, 0, "user", "q", "p", "m"), (5, 1, "assistant", "a", "p", "m")]
    got = chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["conv_id"], r["turn"]) + (r["role"], r["text"]) for r in got) == [(5, k, *t) for k, t in enumerate(TALK)]


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


RECORDS = [
    ({"id": "x", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, TALK),
    ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": 1}]}]}, TALK),
    ({"instruction": "q", "context": "", "response": "a", "category": "c"}, TALK),
    ({"system": "s", "instruction": "q", "input": "i", "output": "a"}, [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")]),
    ({"prompt": "p", "prompt_id": 3, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": {"k": 1}}]}, [("user", "q"), ("assistant", '{"k": 1}')]),
    ({"messages": []}, []),
    ({"prompt": None, "response": 5}, [("user", ""), ("assistant", "5")]),
]
UNKNOWN = ['{"body": "x", "name": "n"}', "{}", "[1]", "not json", None]


def test_records_to_digests(spark):
    """From JSON of every layout, unknown ones too, to stored conversations and back."""
    lines = [json.dumps(r) for r, _ in RECORDS] + UNKNOWN
    turns = chat.canonical_json(spark.createDataFrame(list(enumerate(lines)), "id long, json string"), "id", "json")
    by = defaultdict(list)
    for r in turns.collect():
        by[r["conv_id"]].append((r["role"], r["text"]))
    for i, (_, want) in enumerate(RECORDS):
        assert by[i] == want
    for i, raw in enumerate(UNKNOWN, len(RECORDS)):
        assert by[i] == [(None, raw)]
    stored = WorkFolder(spark, "test").materialise(chat.format_conversations(turns), "c")
    by = {k: v for k, v in by.items() if v}
    assert stored.count() == len(by) and stored.where("last AND part = 0").count() == len(by)
    for r in stored.collect():
        assert chat.read_conversation(r["text"]) == [(role or "", text or "") for role, text in by[r["conv_id"]]]
        assert [chat.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]] == [t for role, t in by[r["conv_id"]] if role == "assistant"]
    assert {r["conv_id"]: r["n_turns"] for r in chat.conversation_digests(stored).collect()} == {k: len(v) for k, v in by.items()}


def test_long_conversations_in_parts(spark):
    """Parts of any size give the same digests."""
    rows = [(c, t, ["user", "assistant"][t % 2], f"<|end|>\n \\ {c} {t} " * (1 + t % 7)) for c in (1, 2, None) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: str(tuple(r))
    results = []
    for characters in (1, 300, 1 << 20):
        stored = WorkFolder(spark, "test").materialise(chat.format_conversations(turns, characters), "c")
        assert (stored.count() == 3) == (characters == 1 << 20)
        results.append(sorted(map(key, chat.conversation_digests(stored).collect())))
    assert results[0] == results[1] == results[2]


def test_fingerprints_tell_layouts_apart():
    seen = {}
    for layout in chat.LAYOUTS:
        for f in chat.fingerprints(layout):
            assert seen.setdefault(f, layout["name"]) == layout["name"]
