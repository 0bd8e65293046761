import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import chat

MARKED = "</s>[INST] ok [/INST]"
ODD = ["", "<", "<|", "<\\|", "<\\\\|im_end|>", "[INST]", "[\\INST]", "[/INST]<<SYS>>", "<</SYS>></s><s>", "a\r\nb\n", "\\", "$1", "é<|im_sep|>ß", "<<|im_end|>\n", "x" * 70_000]


def rows_of(spark, rows, extra=()):
    kinds = "conv_id long, turn long, role string, text string" + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame([(*row, *["x"] * len(extra)) for row in rows], kinds).repartition(3)


def expected(rows):
    """Plain Python: digest columns without the formatted length."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        learnt = "".join(text for role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def digests(rows):
    got = chat.digest(chat.formatted(chat.row_turns(rows))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_control_strings_nulls_ties_and_repeats_come_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", text) for k, text in enumerate(ODD)]
    rows += [(2, 0, text[:50], text) for text in ODD]  # one turn number, odd roles
    rows += [(3, None, None, None), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 5, "user", "no key")]
    rows += [(4, 1, "assistant", "late"), (4, 0, "user", MARKED), (4, 1, "assistant", "late")]
    assert digests(rows_of(spark, rows)) == expected(rows)
    assert digests(rows_of(spark, rows, ["formatted", "key", "loss", "turns"])) == expected(rows)


def test_every_template_gives_the_turns_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", text) for k, text in enumerate(ODD)]
    for template in (chat.CHATML, chat.HEADERS):
        got = chat.digest(chat.formatted(chat.row_turns(rows_of(spark, rows)), template), template).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)
    with pytest.raises(ValueError, match="isn't a mark"):
        chat.Template("User: ", "\n", "\n")


def test_the_written_text(spark):
    rows = rows_of(spark, [(7, 0, "user", "a <|im_end|> b"), (7, 1, "assistant", "é")])
    row = chat.formatted(chat.row_turns(rows)).head()
    assert row.formatted == "<|im_start|>user<|im_sep|>a <\\|im_end|> b<|im_end|>\n<|im_start|>assistant<|im_sep|>é<|im_end|>\n"
    taken = [row.formatted.encode()[s.start : s.start + s.length].decode() for s in row.loss]
    assert taken == ["é"]


def test_an_empty_table(spark):
    empty = rows_of(spark, [(1, 0, "user", "x")]).where("false")
    assert chat.digest(chat.formatted(chat.row_turns(empty))).collect() == []
    records = spark.createDataFrame([], "id long, record string")
    assert chat.record_turns(records, "id", "record").collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[|\\/sSYINT>]a", max_size=30))
def test_escaping_is_undone_and_leaves_no_control_string(text):
    control = re.compile(r"<\||</?s>|<</?SYS>>|\[/?INST\]")
    out = re.sub(chat._CONTROL, r"\1\\\2\3", text)
    assert re.sub(chat._ESCAPED, r"\1\2\3", out) == text
    assert not control.search(out)


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "messages": [{"role": "user", "content": None}, {"role": "tool", "content": "t"}]}, "messages", [("system", "s"), ("user", ""), ("tool", "t")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "image"}, {"text": "q"}]}]}, "message_parts", [("user", "pq")]),
    ({"messages": [{"role": "user", "content": [{"text": "p"}]}, {"role": "assistant", "content": "plain"}]}, "message_parts", [("user", "p"), ("assistant", "plain")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "shared", [("user", "q"), ("assistant", "a")]),
    ({"conversation": [{"human": "q", "assistant": "a"}, {"human": "r", "assistant": "b"}]}, "pairs", [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction_output", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": 12}, "instruction_output", [("user", "do\n\nthis"), ("assistant", "12")]),
    ({"instruction": "do", "input": None, "output": "done"}, "instruction_output", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "url": "x"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, "preference", [("user", "p"), ("assistant", "c")]),
    ({"context": "k", "question": "q", "answer": "a"}, "question_answer", [("user", "k\n\nq"), ("assistant", "a")]),
    ({"prompt": "p", "response": "r", "input": "unrelated"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"text": "no layout"}, None, []),
    ({"messages": "not a list"}, None, []),
    ({"messages": []}, None, []),
]


def told(turns):
    out = {}
    for row in turns.orderBy("key", "place").collect():
        out.setdefault(row.key, (row.layout, []))[1].extend([(row.role, row.text)] if row.place is not None else [])
    return out


def test_records_of_mixed_layouts_become_turns(spark):
    data = [(k, json.dumps(record)) for k, (record, _, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (92, "[]"), (93, "3")]
    records = spark.createDataFrame(data, "id long, record string")
    want = {k: (layout, turns) for k, (_, layout, turns) in enumerate(RECORDS)} | {k: (None, []) for k in (90, 91, 92, 93)}
    got = told(chat.record_turns(records, "id", "record"))
    assert got == want
    whole = chat.digest(chat.formatted(chat.record_turns(records, "id", "record")))
    assert {r.conv_id: r.n_turns for r in whole.collect()} == {k: len(turns) for k, (_, turns) in want.items()}


def test_struct_columns_are_records_too(spark):
    rows = spark.createDataFrame(
        [(1, "q", "a", None), (2, None, None, [("user", "hi")])],
        "id long, question string, answer string, messages array<struct<role: string, content: string>>",
    )
    records = rows.select("id", chat.as_record(rows, ["question", "answer", "messages"]).alias("record"))
    assert told(chat.record_turns(records, "id", "record")) == {
        1: ("question_answer", [("user", "q"), ("assistant", "a")]),
        2: ("messages", [("user", "hi")]),
    }


def test_row_tables_are_told_by_their_schema(spark):
    shared = spark.createDataFrame([(1, 0, "human", "x")], "conversation_id long, position int, from string, value string")
    assert chat.row_layout(shared).name == "shared_rows"
    assert chat.row_layout(rows_of(spark, [(1, 0, "user", "x")], ["content", "value"])).name == "turn_rows"
    with pytest.raises(ValueError, match="no layout"):
        chat.row_layout(spark.range(1))


def test_no_python_on_the_way(spark):
    whole = chat.digest(chat.formatted(chat.row_turns(rows_of(spark, [(1, 0, "user", "x")]))))
    plan = whole._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
