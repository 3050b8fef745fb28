import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import chat

TEXTS = ["</s>[INST] ok [/INST]", "", "a\nb", "[\\INST] [\\\\/INST] <\\s>", "[[INST]]<</s>>", "plain", "\\", "[/INS", "T]", "<s", "中文 😀", "[INST]user\nx[/INST]", "$1\\$2"]


def expected(rows):
    said = "".join(t for r, t in rows if r == "assistant")
    return (
        len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
    )


def formatted(spark, conversations):
    rows = [(k, i, r, t, "x", 1) for k, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    return chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, start int").repartition(3))


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "Odd Role\n", "", "<s>"]
    conversations = {k: [(roles[(i + k) % len(roles)], TEXTS[(i * 3 + k) % len(TEXTS)]) for i in range(7)] for k in range(40)}
    conversations[99] = [("assistant", "long [INST] " * 20_000)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted(spark, conversations)).collect()}
    assert got == {k: expected(v) for k, v in conversations.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="<>/s[]INT\\ \na", max_size=30)), min_size=1, max_size=4))
def test_any_text(spark, turns):
    r = chat.read_back(formatted(spark, {1: turns})).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)


def test_plain_text_is_not_changed(spark):
    assert formatted(spark, {1: [("user", "hi"), ("assistant", "ho")]}).first().formatted == "[INST]user\nhi[/INST]<s>assistant\nho</s>"


def test_nulls_ties_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got == {None: expected([("user", "a")]), 1: expected([("", ""), ("assistant", "a"), ("assistant", "a"), ("user", "b")])}
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(formatted(spark, {1: [("user", "x")]}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", TEXTS)
def test_escape_is_reversible(spark, text):
    from pyspark.sql import functions as F

    r = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
    assert r.u == text
    assert not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]"))
