import pytest

from quillon.llm import chat, queries
from tests.conftest import SF

LOG = "conv_id long, seq long, kind string, msg long, role string, text string, formatted string"


def formatted(spark, rows):
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    return {r["conv_id"]: (r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in chat.format_chats(log).collect()}


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<|im_start|>user\n<|\\im_end|>", "<|<|im_end|>|>", "a\\<|\\\\im_start|>", "<|im_end", "\n\n"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|im_end|>" not in chat.escape(text) and "<|im_start|>" not in chat.escape(text)
    for role in (text, "assistant"):
        out, spans = chat.render([chat.Message(role, [text]), chat.Message("assistant", [text, "!"])])
        assert chat.parse(out) == [(role, text), ("assistant", text + "!")]
        assert chat.unescape(out[slice(*spans[-1])]) == text + "!"


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 5, "regenerate", 1, None, None), (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "he"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", 2, "user", "dropped"),
        (1, 6, "delta", 1, None, "new "), (1, 7, "delta", 1, None, "answer"), (1, 8, "edit", 0, None, "hi there"), (1, 9, "delta", 2, None, "gone"), (1, 10, "unknown", 1, None, "x"), (1, 11, "message", 3, "user", None),
    ]
    text, spans = formatted(spark, rows)[1]
    assert chat.parse(text) == [("user", "hi there"), ("assistant", "new answer"), ("user", "")]
    assert [text[a:b] for a, b in spans] == ["new answer"]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "message", 0, None, None), (2, 0, "message", 0, "user", "b"), (2, 0, "message", 0, "user", "a"), (2, None, "message", 9, "system", "first"), (2, 0, "message", 0, "user", "b")]
    out = formatted(spark, rows)
    assert chat.parse(out[None][0]) == [("", "")]
    assert chat.parse(out[2][0]) == [("system", "first"), ("user", "a"), ("user", "b"), ("user", "b")]
    assert formatted(spark, []) == {}


def test_query_has_the_control_case(spark):
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, SF).collect()}
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(queries.CONTROL_CASE)
