"""Chat formatting: round trips of any text, the machine, and templates that cannot be read back."""

import copy
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventcast.llm import chat

ROWS = "conv_id long, turn long, role string, text string, segment long, loss string"
PIECES = [*chat.INSTRUCT["control"], "\\", "\\\\", "<", ">", "[", "]", "/", "s", "INST", "SYS", " ", "\n", "é", "😀", "<\\/s>", "[ROLE] x [/ROLE] "]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join) | st.text(max_size=12)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_hidden_texts_hold_no_control_string_and_come_back(text):
    escape = chat.Escape(chat.INSTRUCT["control"])
    hidden = escape.hide(text)
    assert escape.show(hidden) == text
    assert not any(c in hidden for c in chat.INSTRUCT["control"])


def test_overlapping_control_strings():
    escape = chat.Escape(["aba", "bab"])
    for text in ("ababababa", "aabab", "\\aba\\"):
        assert "aba" not in escape.hide(text) and "bab" not in escape.hide(text)
        assert escape.show(escape.hide(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "</s>"]) | TEXT, TEXT), max_size=6),
       st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_reader_finds_the_turns_whatever_the_pieces(turns, cut):
    template, escape = chat.INSTRUCT, chat.Escape(chat.INSTRUCT["control"])
    whole = ""
    for role, text in turns:
        marks = template["roles"].get(role)
        opening = marks["open"] if marks else template["other"]["open"] + escape.hide(role) + template["other"]["named"]
        whole += opening + escape.hide(text) + (marks or template["other"])["close"]
    reader, found = chat.Reader(template), []
    for i in range(0, len(whole), cut):
        found += reader.take(whole[i:i + cut])
    assert [f[:2] for f in found] == turns and reader.left == ""
    assert sum(f[2] for f in found) == len(whole)


def say(*turns):
    return "".join(f"{r}\n{t}\n" for r, t in turns)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    convs = {
        1: [("system", "be kind"), ("user", "hi"), ("assistant", "[INST] no [/INST]"), ("user", ""), ("assistant", None)],
        2: [("assistant", "first?"), ("user", "x")],
        3: [("user", "a"), ("user", "b")],
        4: [(None, None), ("tool", "</s>\\"), ("[/ROLE] user", "q")],
        5: [("user", "q"), ("assistant", "w" * 300_000), ("user", "open")],
        None: [("user", "no id"), ("assistant", "none")],
    }
    data = [(c, None if c == 3 and i == 0 else i, r, t, 9, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    data += [(6, 0, "user", "same", 1, "y")] * 3 + [(6, 0, "assistant", "same", 1, "y")]
    return spark.createDataFrame(data, ROWS).repartition(7)


def test_conversations(spark, rows):
    found = {r["conv_id"]: r for r in chat.formatted(rows).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, None}
    assert found[1]["turns_sha256"] == sha(say(("system", "be kind"), ("user", "hi"), ("assistant", "[INST] no [/INST]"), ("user", ""), ("assistant", "")))
    assert found[1]["loss_sha256"] == sha("[INST] no [/INST]") and found[1]["loss_chars"] == 17
    assert found[3]["turns_sha256"] == sha(say(("user", "a"), ("user", "b")))
    assert found[4]["turns_sha256"] == sha(say(("", ""), ("tool", "</s>\\"), ("[/ROLE] user", "q")))
    assert found[5]["loss_chars"] == 300_000 and found[5]["loss_sha256"] == sha("w" * 300_000)
    assert found[6]["n_turns"] == 4 and found[6]["turns_sha256"] == sha(say(("assistant", "same"), *[("user", "same")] * 3))
    assert {k: (v["valid"], v["final_state"]) for k, v in found.items()} == {
        1: (True, "answered"), 2: (False, "rejected"), 3: (False, "rejected"), 4: (False, "rejected"), 5: (False, "asked"),
        6: (False, "rejected"), None: (True, "answered")}


def test_segments_and_their_reading(spark, rows):
    parts = chat.segments(rows)
    text = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), "").alias("t"))
    whole = {r["conv_id"]: r["t"] for r in text.collect()}
    assert whole[2] == "<s> first? </s>\n[INST] x [/INST]\n"
    assert whole[1].startswith("<<SYS>> be kind <</SYS>>\n[INST] hi [/INST]\n<s> [\\INST] no [\\/INST] </s>\n")
    sizes = {r["conv_id"]: r["formatted_chars"] for r in chat.formatted(rows).collect()}
    assert sizes == {k: len(v) for k, v in whole.items()}
    loss = parts.filter("loss").groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in loss} == {1: 2, 2: 1, 5: 1, 6: 1, None: 1}
    # Written, shuffled and read again, the segments give the same turns.
    again = chat.turns(parts.repartition(5, "segment")).select("conv_id", "turn", "role", "text", "loss_text", "state")
    straight = chat.turns(parts, in_order=True).select(again.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, straight.collect()))


def test_broken_output_is_seen(spark, rows):
    cut = chat.segments(rows).filter("NOT (conv_id <=> 2 AND segment = 5)")
    found = {r["conv_id"]: r for r in chat.turns(cut).filter("role IS NULL").collect()}
    assert list(found) == [2] and found[2]["formatted_chars"] == len("[INST] x")


def test_nothing(spark, rows):
    assert chat.formatted(rows.limit(0)).collect() == []


def test_templates_that_cannot_be_read_back():
    for change in (lambda t: t["control"].append("x"), lambda t: t["control"].append("a\\b"),
                   lambda t: t["roles"]["user"].update(open="[INST]<"), lambda t: t["roles"]["user"].update(close="]\n[/INST]"),
                   lambda t: t["roles"]["user"].update(open="<s> "), lambda t: t["roles"]["user"].update(close=" stop ")):
        template = copy.deepcopy(chat.INSTRUCT)
        change(template)
        with pytest.raises(ValueError):
            chat.check_template(template)
