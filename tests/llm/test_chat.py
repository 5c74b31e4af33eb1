import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, loss int"


def expected(rows):
    """Digests by plain string work."""
    out = {}
    order = lambda x: (x is not None, x)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (order(r[0]), order(r[1]), order(r[2]), order(r[3]))):
        out.setdefault(conv, []).append((role or "", text or ""))
    found = {}
    for conv, turns in out.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        found[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                       hashlib.sha256(loss.encode()).hexdigest())
    return found


TRICKY = ["", "<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|x|", "a|b<", "é<|ü|>\n", "<<||", "\\", "<|im_end|>\n" * 3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\n<|tem\\"]), st.text(alphabet="<|\\aé\n>", max_size=12)),
                min_size=1, max_size=6))
def test_assembled_text_reads_back(turns):
    roles, texts = zip(*turns)
    formatted, start, length = chat.assemble(pa.array(roles), pa.array(texts), np.zeros(len(turns), int))
    text = formatted[0].as_py()
    assert chat.read_turns(text) == list(turns)
    assert text.count(chat.START) == len(turns) and text.count(chat.END) == len(turns)
    assert [chat._unescape(text[s:s + n]) for s, n in zip(start, length)] == list(texts)


@pytest.mark.parametrize("part_bytes", [chat.PART_BYTES, 300])
def test_digests(spark, part_bytes):
    rows = [(c, t, ("user", "assistant")[t % 2], TRICKY[(c + t) % len(TRICKY)], "p", 1) for c in range(7) for t in range(6)]
    rows += [(8, None, None, None, None, None), (8, 0, "assistant", None, None, None), (None, 0, "user", "x", None, 2),
             (9, 1, "assistant", "same", "", 0), (9, 1, "assistant", "same", "", 0), (10, 0, "user", "z" * 5000, None, 0)]
    rows += [(11, t, "assistant", f"long {t} <|", None, 0) for t in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_conversations(df, part_bytes)
    if part_bytes == 300:
        assert formatted.where("conv_id = 11").count() > 5
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_conversations(df)).count() == 0
