"""Byte-level BPE encoding and decoding of whole texts (operator 4).

The merges are compiled into the lazily determinised transducer of
:mod:`pathglass.llm.bpe_fst`; ids are decoded by its incremental UTF-8 machine.
Encoding is a narrow transformation: no shuffle, one pass, bounded tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.llm.bpe_fst import Utf8Decoder, encoder, forget, load_vocabulary
from pathglass.llm.common import release_with, task_tables, text_stream

#: Ids decoded at a time; the decoder carries its state from chunk to chunk.
DECODE_CHUNK = 4096


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", scale: float = 1) -> DataFrame:
    """(id_col, ids): each whole text as a binary of little-endian unsigned 32-bit ids.

    Null and empty texts give an empty binary. Rows are treated one by one, so
    null, repeated or tied ids and repeated rows give a row each; an empty table
    gives no rows. Other columns are not read.
    """

    def run(batches):
        with task_tables("bpe"):
            enc = encoder(vocabulary, scale)
            release_with("bpe", forget)
            for b in batches:
                ids = [enc.encode(x) for x in text_stream(b, "__text")]
                yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(ids, pa.binary())], ["__id", "__ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, __ids binary").select(F.col("__id").alias(id_col), F.col("__ids").alias("ids"))


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the texts of binaries as :func:`encode_texts` makes them; null ids give an empty text."""

    def run(batches):
        with task_tables("bpe"):
            decoder = Utf8Decoder(load_vocabulary(vocabulary))
            release_with("bpe", forget)
            for b in batches:
                texts = [decode_text(decoder, x or b"") for x in b.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(texts, pa.string())], ["__id", "__text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"))
    return rows.mapInArrow(run, f"__id {kind}, __text string").select(F.col("__id").alias(id_col), F.col("__text").alias("text"))


def decode_text(decoder: Utf8Decoder, ids: bytes) -> str:
    values = np.frombuffer(ids, "<u4")
    parts = [decoder.feed(values[k : k + DECODE_CHUNK].tolist()) for k in range(0, len(values), DECODE_CHUNK)]
    return "".join([*parts, decoder.finish()])


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", scale: float = 1) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode, then decode what was encoded.

    Both steps run in one pass over the rows. Null texts count as empty: no
    tokens, and the digests of no bytes. Every row gives a row.
    """

    def run(batches):
        with task_tables("bpe"):
            enc, decoder = encoder(vocabulary, scale), Utf8Decoder(load_vocabulary(vocabulary))
            release_with("bpe", forget)
            for b in batches:
                n, ids_sha, text_sha = [], [], []
                for x in text_stream(b, "__text"):
                    ids = enc.encode(x)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decode_text(decoder, ids).encode()).hexdigest())
                columns = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("__id"), *columns], ["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = rows.mapInArrow(run, f"__id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("__id", id_col)
