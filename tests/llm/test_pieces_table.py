import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tastemill.llm import pieces_table as pt

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = pt.PieceTable(MODEL)
TEXTS = ["", " ", "  ", "\n", "\n\n a", "a ", " a  b\nc\n d ", "▁a▁▁ b", "<s> </s> <unk>", "x\x00y\tz\r\n", "é漢字🙂‍", "　 \xa0",
         "word " * 2000, "y" * 20_000]


def check(texts, chunks):
    for text, (ids, decoded) in zip(texts, chunks.encode(texts)):
        assert ids.tolist() == SP.encode(text)
        assert decoded == SP.decode([SP.bos_id(), *SP.encode(text), SP.eos_id()])


def test_same_as_the_library():
    assert TABLE.chunkable
    check(TEXTS, TABLE)
    check(TEXTS[::-1], TABLE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n▁ab,'é<0x0A>", max_size=20), st.text(max_size=12)), max_size=5))
def test_any_text(texts):
    check(texts, TABLE)


def test_a_full_table():
    small = pt.PieceTable(MODEL, max_chunks=3)
    for _ in range(3):
        check(["a b c d e f", "g a\nh"], small)
    assert len(small.chunks.numbers) <= 20 and len(small.chunks.texts) == len(small.chunks.numbers)


def test_decodes_what_the_ids_say():
    """The decoded text comes from ids: with other ids in the table it is another text."""
    other = pt.PieceTable(MODEL)
    segment = other.chunks.segment
    other.chunks.segment = lambda chunks: segment([c.replace("cat", "dog") for c in chunks])
    (ids, decoded), = other.encode(["a cat\nsat"])
    assert decoded == "a dog\nsat" == SP.decode(ids.tolist())


def test_without_chunks():
    whole = pt.PieceTable(MODEL)
    whole.chunkable = False
    check(TEXTS[:8], whole)


def test_table(spark):
    rows = [(i, t, "a", 1) for i, t in enumerate([*TEXTS, None])] + [(3, "\n", "b", 2), (None, "z", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 int")
    got = pt.digests(df, MODEL).collect()
    want = []
    for i, text, *_ in rows:
        ids = [SP.bos_id(), *SP.encode(text or ""), SP.eos_id()]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pt.digests(df.limit(0), MODEL).count() == 0
