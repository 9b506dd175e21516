"""Token-id files with Elias-Fano document boundaries (operator 3).

A file is a byte string: a header, the document ids and the document ends as
Elias-Fano sequences, then all ids in one array of 2 or 4 bytes each. Files are
stored as rows of a Parquet folder: Spark's commit protocol makes each one whole
or absent, and any store that Spark reaches holds them. Documents ascend in and
across files; rows also hold how many ids come before a file in its partition, so
the global start of a document needs one sum for each written partition.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathglass.llm.bpe_fst import PieceTable, byte_letters, split_as_library
from pathglass.llm.common import new_path, release_with, task_tables, text_stream
from pathglass.llm.elias_fano import EliasFano

_HEAD = struct.Struct("<4sBBQQq")  # magic, version, bytes of an id, documents, of these without id, smallest id
MAGIC = b"PGTS"

#: A file is closed when it holds this many ids.
FILE_IDS = 2_000_000

STORED = "part int, before long, n_docs long, n_ids long, file binary"


def pack_file(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """``doc_ids`` ascending, nulls first; ``ids``: little-endian unsigned 32-bit ids of each document."""
    known = [i for i in doc_ids if i is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    head = _HEAD.pack(MAGIC, 1, width, len(doc_ids), len(doc_ids) - len(known), base)
    values = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    # Differences of signed 64-bit ids always fit unsigned ones, where they wrap around.
    above = np.array(known, np.int64).view(np.uint64) - np.uint64(base % (1 << 64))
    return b"".join([head, EliasFano.build(above).to_bytes(), EliasFano.build(ends).to_bytes(), values.tobytes()])


class TokenFile:
    """Random access into a file: nothing but the header is decoded up front."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, self.n_null, self.base = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        self.keys, at = EliasFano.from_bytes(data, _HEAD.size)
        self.ends, at = EliasFano.from_bytes(data, at)
        self.values = np.frombuffer(data, f"<u{self.width}", offset=at)

    def doc_id(self, i: int):
        return None if i < self.n_null else self.base + self.keys.select(i - self.n_null)

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.values[a:b]

    def documents(self):
        """(doc_id, start, ids) of every document, its place selected from the ends."""
        start = 0
        for i in range(self.n_docs):
            end = self.ends.select(i)
            yield self.doc_id(i), start, self.values[start:end]
            start = end


@lru_cache(maxsize=2)
def _library(path: str):
    """(whole texts, table of pieces or None, special strings, number of ids) of the tokenizer."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    whole = lambda text: _packed(t.encode(text, add_special_tokens=False).ids)
    by_piece = type(t.pre_tokenizer).__name__ == "ByteLevel" and type(t.model).__name__ == "BPE" and t.normalizer is None
    shown = "".join(sorted(byte_letters(), key=byte_letters().get))
    # The model sees bytes as printable letters.
    piece = lambda p: _packed([x.id for x in t.model.tokenize(p.encode().decode("latin-1").translate(shown))])
    specials = [a.content for a in t.get_added_tokens_decoder().values()]
    return whole, PieceTable(piece, 300_000) if by_piece else None, specials, t.get_vocab_size(with_added_tokens=True)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encode(path: str, text: str) -> bytes:
    """The library's ids of ``text``. A byte-level tokenizer treats its pieces one
    by one, so a piece met before isn't encoded again; other texts go in whole."""
    encode, pieces, specials, _ = _library(path)
    if pieces is None or any(s in text for s in specials):
        return encode(text)
    return b"".join(map(pieces.__getitem__, split_as_library(text)))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Encode every whole text and write the token files to ``path`` in ascending id order.

    Null ids come first, equal ids stand next to each other in the order of their
    texts (repeated rows are all kept). A null text has no ids but ``end_id``. An
    empty table writes a folder without rows. Other columns are not read.
    """

    def run(batches):
        width = 2 if _library(tokenizer)[3] <= 1 << 16 else 4
        end, part = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        keys, ids, held, before = [], [], 0, 0

        def flush():
            file = pack_file(keys, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([file], pa.binary())], ["part", "before", "n_docs", "n_ids", "file"])

        with task_tables("token files"):
            release_with("token files", _library.cache_clear)
            for b in batches:
                for key, text in zip(b.column("__id").to_pylist(), text_stream(b, "__text"), strict=True):
                    got = _encode(tokenizer, text) + end
                    keys.append(key)
                    ids.append(got)
                    held += len(got) // 4
                    if held >= file_ids:
                        yield flush()
                        before, keys, ids, held = before + held, [], [], 0
            if keys:
                yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    order = F.col("__id").asc_nulls_first()
    rows = rows.repartitionByRange(n, order).sortWithinPartitions(order, "__text")
    rows.mapInArrow(run, STORED).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files at ``path``.

    ``start`` counts the ids of all documents before it in the whole folder;
    ``ids`` (little-endian unsigned 32 bit) is left out with ``digest_only``.
    """
    files = spark.read.schema(STORED).parquet(path)
    # One row for each partition of the writing job, whatever the data.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("base"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ([] if digest_only else ["ids"])

    def run(batches):
        for b in batches:
            for base, before, data in zip(*(b.column(c).to_pylist() for c in ("base", "before", "file")), strict=True):
                keys, starts, counts, sums, whole = [], [], [], [], []
                for key, start, ids in TokenFile(data).documents():
                    raw = ids.astype("<u4").tobytes()
                    keys.append(key)
                    starts.append(base + before + start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(raw))
                    if not digest_only:
                        whole.append(raw)
                columns = [pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)]
                yield pa.RecordBatch.from_arrays(columns + ([] if digest_only else [pa.array(whole, pa.binary())]), names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids binary")
    return files.join(F.broadcast(base), "part").select("base", "before", "file").mapInArrow(run, schema)


def token_files_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, tokenizer, path, id_col=id_col, text_col=text_col)
    return read_token_files(spark, path, digest_only=True)
