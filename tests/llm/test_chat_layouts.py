"""Each layout with null texts, a missing text and further keys."""

from __future__ import annotations

import json

import pytest

from postgrove.llm import chat

U, A, E = ("user", "a"), ("assistant", "b"), ("assistant", "")
CASES = [
    ({"role": "user", "text": None}, "turn", [("user", "")]),
    ({"role": None, "text": "a", "id": 3}, "turn", [("", "a")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [U, E]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant"}]}, "messages", [U, E]),
    ({"messages": [{"role": "user"}]}, "messages", [("user", "")]),
    ({"messages": [{"role": "user", "content": "a", "name": "n"}, None], "id": 1, "tools": [{"x": {"y": []}}]}, "messages", [U, ("", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": None}, None]}, {"role": "assistant", "content": None}]}, "messages_parts", [U, E]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": []}], "source": "s"}, "messages_parts", [U, E]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}], "id": "7"}, "conversations", [U, E]),
    ({"prompt": "a", "completion": None}, "prompt", [U, E]),
    ({"prompt": "a", "completion": "b", "system": None}, "prompt", [U, A]),
    ({"prompt": "a", "response": None, "id": 1}, "prompt_response", [U, E]),
    ({"prompt": "a"}, "prompt", [U, E]),
    ({"instruction": "a", "output": None, "meta": {"k": None}}, "instruction", [U, E]),
    ({"instruction": "a", "input": None, "output": "b"}, "instruction_input", [U, A]),
    ({"instruction": "a", "input": "c", "source": "s"}, "instruction_input", [("user", "a\n\nc"), E]),
    ({"system": None, "prompt": "a", "response": None}, "system_prompt", [("system", ""), U, E]),
    ({"system": "s", "prompt": "a", "response": "b", "tools": []}, "system_prompt", [("system", "s"), U, A]),
    # Texts that the mapping would lose or cannot read leave the layout unknown.
    ({"system": "s", "prompt": "a", "completion": "b"}, None, None),
    ({"messages": [{"role": "user", "content": 5}]}, None, None),
    ({"messages": [{"role": "user", "content": {"text": "a"}}]}, None, None),
    ({"messages": [{"role": "user", "content": "a"}, [{"role": "user"}]]}, None, None),
    ({"messages": [{"role": "user", "content": "a"}, "b"]}, None, None),
    ({"id": 1}, None, None),
    ([], None, None),
]


@pytest.mark.parametrize("record,layout,turns", CASES)
def test_nulls_missing_texts_and_further_keys(record, layout, turns):
    name, _ = chat.layout_of(frozenset(chat.field_paths(record)))
    assert name == layout
    if name:
        assert chat.turns_of(record, name) == turns


def test_no_turn_is_dropped(spark):
    rows = spark.createDataFrame([(k, 0, json.dumps(r)) for k, (r, *_) in enumerate(CASES)], "conv_id long, turn long, record string")
    turns = chat.canonical_turns(rows)
    assert chat.format_chat(turns).count() == sum(len(t) for *_, t in CASES if t)
    assert turns.where("layout IS NULL").count() == sum(t is None for *_, t in CASES)
