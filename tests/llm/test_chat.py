"""Declared templates are held to their word, and turns without numbers are spread like any others."""

import hashlib
import time

import pytest

pytest.importorskip("pandas")


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_a_declared_template_that_rewrites_late_is_caught(spark):
    from scriptorium.llm.chat import chat_template, concatenative, digests, format_conversations

    rows = [(1, k, "user", f"turn {k}") for k in range(100)] + [(2, k, "user", f"turn {k}") for k in range(30)]
    forgets = concatenative(lambda turns: chat_template(turns[-40:]))
    assert {r["conv_id"]: r["rewritten"] for r in digests(format_conversations(frame(spark, rows), forgets)).collect()} == {1: True, 2: False}
    marked = concatenative(lambda turns: "".join(("" if k and turns[k - 1][0] == role else "~") + chat_template([(role, text)]) for k, (role, text) in enumerate(turns)))
    got = format_conversations(frame(spark, rows), marked, part_turns=50).collect()
    assert [r["joins"] for r in sorted(got, key=lambda r: (r["conv_id"], r["chunk"]))] == [False, False, True]  # what is rendered whole is right


def test_parts_make_up_the_conversation(spark):
    from scriptorium.llm.chat import digests, format_conversations

    rows = [(c, k % 7 if c == 3 else k, ["user", "assistant"][k % 2], f"{c} says {k} <|im_end|>") for c in (1, 2, 3) for k in range(40)] + [(None, None, None, None)]
    whole = {str(r) for r in digests(format_conversations(frame(spark, rows))).collect()}
    for size in (1, 3, 40, 64):
        assert {str(r) for r in digests(format_conversations(frame(spark, rows), part_turns=size)).collect()} == whole
    assert all("rewritten=False" in r for r in whole)


def test_turns_without_a_number_take_their_time_in_proportion(spark):
    from scriptorium.llm.chat import digests, format_conversations

    rows = [(1, None, "user", f"{k:05d}") for k in range(20_000)]
    began = time.time()
    got = digests(format_conversations(frame(spark, rows))).collect()
    assert time.time() - began < 30 and len(got) == 1 and got[0]["n_turns"] == 20_000
    assert got[0]["turns_sha256"] == hashlib.sha256("".join(f"user\n{k:05d}\n" for k in range(20_000)).encode()).hexdigest()
