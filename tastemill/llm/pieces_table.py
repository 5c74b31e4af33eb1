"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary continues over a white space marker, so merges never cross from one marked word
to the next: a text's ids are the ids of its chunks one after another. A chunk is a run of markers with the
letters up to the next marker; a character that is in no piece (a line feed, say) starts a chunk as well.
Each worker keeps a table of the distinct chunks it has met, segments a new one once, and joins ids back by
position: chunk numbers of a text become lengths, cumulated offsets and one gather from the table. Beside its ids
the table keeps what a chunk's ids decode to, and a text is decoded by joining these by the same chunk numbers.

The conditions are read from the model (``chunkable``); a model that breaks them is run on whole texts. The
table is bounded (``chunk_table``).

Null and empty texts have only the begin and end ids and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tastemill.llm.chunk_table import ChunkTable
from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import pieces

MARK = "▁"


class PieceTable:
    """Ids and decoded texts by a SentencePiece model, from its distinct chunks."""

    def __init__(self, model: str, **limits: int):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        normal = [n for i, n in enumerate(names)
                  if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i))]
        self.chunkable = self._chunkable(normal)
        # A line feed that no piece has is never merged with its neighbours.
        alone = "" if any("\n" in n for n in normal) else "\n"
        self.find = re.compile(f"(?:[ {MARK}]+|{alone or '(?!)'})[^ {MARK}{alone}]*").findall
        self.chunks = ChunkTable(self._segment, text_of=self._texts, **limits)

    def _chunkable(self, names: list[str]) -> bool:
        """Markers only begin pieces, text is not normalised, and a blank is put before every text and kept."""
        sp = self.processor
        probe = "  a Å Å ﬁ́  b "
        return (not any(MARK in n.lstrip(MARK) or " " in n for n in names) and sp.decode(sp.encode(probe)) == probe
                and sp.encode("a", out_type=str)[0][0] == MARK and sp.encode("\n", out_type=str)[0] == MARK)

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks in the middle of a text. The blank put before every text stands for a chunk's first marker."""
        found = self.processor.encode([c if c[0] == "\n" else c[1:] for c in chunks], num_threads=1)
        marker = self.processor.piece_to_id(MARK)
        return [ids[1:] if c[0] == "\n" else ids or [marker] for c, ids in zip(chunks, found)]

    def _texts(self, chunks: list[str], found: list[list[int]]) -> list[str]:
        """What the ids of chunks decode to in the middle of a text, where the first marker is a blank."""
        decoded = self.processor.decode(found, num_threads=1)
        return [text if c[0] == "\n" else f" {text}" for c, text in zip(chunks, decoded)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text without begin and end, and their decoded text."""
        if not self.chunkable:
            return [(np.array(ids := self.processor.encode(t), np.uint32), self.processor.decode(ids)) for t in texts]
        own = [self.find(" " + text) if text else [] for text in texts]
        counts = [len(c) for c in own]
        ids, bounds, at = self.chunks.join([c for chunks in own for c in chunks], counts)
        decoded, at, ends = self.chunks.texts, at.tolist(), np.cumsum([0, *counts]).tolist()
        # The blank put before every text is no part of it.
        return [(ids[bounds[k]:bounds[k + 1]], "".join([decoded[i] for i in at[ends[k]:ends[k + 1]]])[1:]) for k in range(len(texts))]


@cache
def _table(model: str) -> PieceTable:
    return PieceTable(model)


def digests(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """Number and digest of all ids (begin and end included) and digest of the text decoded from them."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _table(model)
        begin, end = (np.array([i], np.uint32) for i in (chunks.processor.bos_id(), chunks.processor.eos_id()))
        for piece in pieces(batches):
            counts, ids_hash, text_hash = [], [], []
            for ids, decoded in chunks.encode([t or "" for t in piece.column(1).to_pylist()]):
                ids = np.concatenate([begin, ids, end]).astype("<u4")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, "text").mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
