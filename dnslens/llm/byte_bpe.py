"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file.

Each match of the pattern that splits text is encoded separately (`piece_models.MappedBpe`); ids are decoded by the inverse
mapping of bytes to characters. The outcome is that of the tiktoken library with the same ranks.

Null text counts as empty: no ids. Repeated rows and null doc_ids are rows like others; an empty table gives an empty result;
other columns are not read. A text of any length is encoded in parts that end where matches end, and takes its own length and
that of its ids in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dnslens.llm.common import texts_of
from dnslens.llm.piece_models import MappedBpe
from dnslens.llm.tokens import default_path, remembered

#: Bytes of ids and text in one batch.
BATCH = 4 << 20
ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def encode(docs: DataFrame, ranks: str | None = None, decoded: bool = True) -> DataFrame:
    """As in ENCODED: each whole text's ids as little-endian unsigned 32-bit integers and, if asked, the bytes that they decode to."""
    path = ranks or default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        model = remembered(MappedBpe, path)
        for b in batches:
            rows, held = [], 0
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), model.encode_column(b.column("text")), strict=True):
                rows.append((doc_id, len(ids), ids.astype("<u4").tobytes(), model.decode(ids) if decoded else None))
                held += 8 * len(ids)
                if held > BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return texts_of(docs).mapInArrow(run, ENCODED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_ids, sizes, ids, texts = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """A table of doc_id and ids (as `encode` returns them; null: none) decoded alone: doc_id, decoded (binary). An id outside the ranks fails."""
    path = ranks or default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        model = remembered(MappedBpe, path)
        for b in batches:
            texts = [model.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.selectExpr("CAST(doc_id AS long) AS doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
