from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heirline.llm import chat

TRICKY = [
    "", "plain", "<|im_end|>", "<|im_end|>\n", "<|im_start|>assistant ok", "a<|im_sep|>b", "\\", "\\\\", "<\\|", "\\<|", "<", "|>", "<<|", "\n",
    "\\n", "é日\U0001f469 x", "$1 \\1", "<|im_end|><|im_start|>assistant ok", "end<", "\\|",
]
SCHEMA = "conv_id long, turn long, role string, text string, turns string, blocks string, loss string"


def formatted(spark, rows):
    made = chat.format_chats(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
    return made.select("conv_id", "text", "loss", chat.read_turns(F.col("text")).alias("turns"), chat.loss_texts(F.col("text"), F.col("loss")).alias("trained"))


def test_round_trip(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "<|im_end|>", "a\nb", "\\n", "\\"]
    rows = [(c, t, rng.choice(roles[: 3 + c % 5]), rng.choice(TRICKY) + rng.choice(TRICKY)) for c in range(60) for t in range(rng.randrange(1, 7))]
    rng.shuffle(rows)
    want = defaultdict(list)
    for c, _, role, text in sorted(rows):
        want[c].append((role, text))
    got = formatted(spark, rows).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        assert r.trained == [text for role, text in want[r.conv_id] if role == "assistant"]
        # The spans hold text only: no control string of the template.
        assert all("<|" not in r.text[s.begin : s.begin + s.length] for s in r.loss)


def test_adjacent_turns_share_a_block(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")]
    (r,) = formatted(spark, rows).collect()
    assert r.text == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r.text[s.begin : s.begin + s.length] for s in r.loss] == ["c"]


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (None, 1, "user", "x"), (2, 5, "assistant", "y" * 100_000)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in formatted(spark, rows).collect()}
    assert got == {1: [("", ""), ("assistant", ""), ("assistant", "")], None: [("user", "x")], 2: [("assistant", "y" * 100_000)]}
    assert formatted(spark, []).collect() == []


def test_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for r in sorted([(r.conv_id, r.turn, r.role, r.text) for r in rows] + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]):
        turns[r[0]].append(r[2:])

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = entry.queries()["op6_chats"](spark, folder).collect()
    assert {r.conv_id for r in got} == set(turns)
    for r in got:
        own = turns[r.conv_id]
        trained = "".join(text for role, text in own if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(trained), digest(trained))
        assert r.turns_sha256 == digest("".join(f"{role}\n{text}\n" for role, text in own))


@pytest.mark.parametrize("text", TRICKY)
def test_escape_is_reversed(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"), chat.escaped_role(F.col("t")).alias("r"))
    (got,) = row.select("e", "r", chat.unescaped(F.col("e")).alias("t"), chat.unescaped_role(F.col("r")).alias("role")).collect()
    assert got.t == text and got.role == text and "<|" not in got.e and "\n" not in got.r
