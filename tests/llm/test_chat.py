from __future__ import annotations

import hashlib
import json

import pytest

from provlens.llm import chat

TRAPS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "\\l\\b\\e\\n \\\\", "<<s>s><</SYS>>",
         "a\nb\r\n", "日本 ünï", "[[INST]INST]", "<|im_end|", "ends with <"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_round_trip(spark):
    rows = [(c, t, r, TRAPS[(c * 3 + t) % len(TRAPS)]) for c in range(12)
            for t, r in enumerate(("system", "user", "assistant", "assistant\nodd")[:1 + c % 4])]
    rows += [(50, 0, None, None), (50, None, "assistant", None), (51, 3, "assistant", "b"), (51, 3, "assistant", "b"),
             (None, 0, "user", "no id"), (52, 0, "user", "long " * 40_000), (52, 1, "assistant", "reply " * 40_000)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, formatted string, n_turns int")
    got = {r["conv_id"]: r for r in chat.conversation_report(df.repartition(4)).collect()}
    convs = {-1: [(0, "user", TRAPS[2]), (1, "assistant", TRAPS[2])]}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        row = got[c]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), sha(learned))


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TRAPS)], "id int, prompt string, completion string")
    for row in chat.formatted(df, ["id"]).collect():
        text = row["formatted"]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2
        assert not any(x in text for x in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages",
     [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "conversations",
     [("user", "q"), ("assistant", "r")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "system_conversations",
     [("system", "s"), ("user", "q")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"system": "s", "prompt": "p", "completion": "c"}, "prompt_completion",
     [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, "instruction",
     [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "only"}, None, []),
    ({"messages": []}, None, []),
    ({"unknown": {"deep": 1}}, None, []),
    ({"prompt": "p", "completion": "c", "unknown": {"deep": 2}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
]


def test_layouts_are_chosen_by_fingerprint(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text("\n".join(json.dumps({"id": i, "turns": "clash", "layout": 3, **r}) for i, (r, _, _) in enumerate(RECORDS)))
    df = spark.read.json(str(path))
    out = chat.formatted(df, ["id"])
    layouts = {r["id"]: r["layout"] for r in out.collect()}
    turns = {r["id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(out, ["id"]).collect()}
    for i, (_, layout, want) in enumerate(RECORDS):
        assert (layouts[i], turns[i]) == (layout, want)


def test_fingerprint_is_the_hash_of_sorted_paths(spark):
    df = spark.createDataFrame([("x", None), (None, "y")], "prompt string, completion string")
    got = [r[0] for r in df.select(chat.fingerprint(df.schema)).collect()]
    assert got == [chat.hash_of(["prompt"]), chat.hash_of(["completion"])]


def test_native_plan_and_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [r["conv_id"] for r in chat.conversation_report(df).collect()] == [-1]
    plan = chat.conversation_report(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("kind", ["string", "array<string>"])
def test_fields_of_another_type_fit_no_layout(spark, kind):
    df = spark.createDataFrame([(1, "x" if kind == "string" else ["x"])], f"id int, messages {kind}")
    (row,) = chat.formatted(df, ["id"]).collect()
    assert row["layout"] is None and row["formatted"] == ""
