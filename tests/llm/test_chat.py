import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from oracle import duck_rows, rounded

from tilewright.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL.values(), *chat.FOREIGN, "\\", "<\\|turn|>", "<\\\\|end|>", "<", "|", "[", "a b", "é\n", " ", "\U0001f600"]), max_size=8).map("".join)


@given(PIECES)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(s in chat.escape(text) for s in chat._STRINGS)


@given(st.sampled_from(["user", "assistant", "", "<|text|>"]), PIECES)
def test_turn_round_trip(role, text):
    ids, delta = chat.assemble(role, text)
    loss = np.cumsum(delta)
    got = chat.read_back(ids, loss)
    assert got[:3] == (role, text, text if role == "assistant" else "")
    assert got[3] == len(chat.render(ids))
    assert loss.min() >= 0 and loss[-1] == 0 and set(loss) <= {0, 1}


def test_against_sql(spark, sf_dir):
    names, want = duck_rows(chat.ORACLE_SQL, sf_dir)
    got = chat.op9_chat(spark, sf_dir)
    assert rounded(tuple(r) for r in got.select(*names).collect()) == rounded(want)


def test_odd_rows(spark):
    rows = [(1, 2, "user", None, 5), (1, None, None, "x", 5), (1, 2, "user", None, 5), (None, 0, "assistant", "y", 5), (2, 0, "assistant", "w " * 20000, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids long")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 40000
    assert chat.digests(chat.formatted(df.where("conv_id = 9"))).count() == 0
