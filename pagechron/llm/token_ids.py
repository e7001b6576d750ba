"""Token ids in files: frequency ranks in a byte-aligned variable-length code."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bases, prepare
from .encoding import encoder, ship

MAGIC = b"RVB1"
#: A block is closed with the document that brings it to so many ids.
BLOCK_IDS = 1_000_000
_HEAD = struct.Struct("<4sIQIQ")
#: Byte lengths of the four values that a control byte stands for.
LENGTHS = np.array([[((c >> (2 * k)) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: head, documents, vocabulary by falling frequency, control bytes, data bytes.

    An id is written as its rank among the block's ids by frequency (ties: the
    lesser id), in 1 to 4 bytes; a control byte holds the lengths of four.
    """
    n = np.bincount(ids)
    vocab = np.flatnonzero(n)
    by_rank = np.lexsort((vocab, -n[vocab]))
    rank = np.empty(len(n), dtype=np.uint32)
    rank[vocab[by_rank]] = np.arange(len(vocab), dtype=np.uint32)
    ranks = rank[ids]
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(vocab), len(data))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join((head, known.tobytes(), docs.tobytes(), counts.astype("<u4").tobytes(), vocab[by_rank].astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def unpack_block(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a block."""
    magic, n_docs, n_ids, n_vocab, n_data = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    known, docs, counts, vocab = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs), take("<u4", n_vocab)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    if at != len(blob):
        raise ValueError("a block of token ids is cut short or too long")
    size = LENGTHS[control].reshape(-1)[:n_ids]
    first = np.cumsum(size, dtype=np.int64) - size
    ranks = np.zeros(n_ids, dtype=np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        ranks[has] |= data[first[has] + k].astype(np.uint32) << (8 * k)
    return [int(d) if ok else None for d, ok in zip(docs, known, strict=True)], counts, vocab[ranks]


_FILE = "pid int, block int, n_docs long, n_ids long, ids_before long, blob binary"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write their ids under ``path`` in ascending doc_id order.

    Texts are dealt by ranges of the id, once; a task encodes its range in order
    and writes blocks. Null and empty texts have the end id alone; null ids come
    first; rows with one id keep no defined order among themselves; an empty
    table gives files without blocks.
    """
    prepare(docs.sparkSession)
    tokenizer = ship(docs.sparkSession, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid = encoder(tokenizer, keep_space), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        n = block = before = 0

        def close() -> pa.RecordBatch:
            nonlocal n, block, before, held
            counts = np.array([len(b) // 4 for _, b in held], dtype=np.int64)
            blob = pack_block([d for d, _ in held], counts, np.frombuffer(b"".join(b for _, b in held), dtype="<u4"))
            row = {"pid": [pid], "block": [block], "n_docs": [len(held)], "n_ids": [n], "ids_before": [before], "blob": [blob]}
            before, block, n, held = before + n, block + 1, 0, []
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("pid", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("ids_before", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, text in zip(doc_ids, batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                held.append((doc_id, ids))
                n += len(ids) // 4
                if n >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(encode, _FILE).write.option("compression", "zstd").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files.

    ``start`` counts the ids of all documents before it, over all files: the
    files' own totals give each its base, one number a file.
    """
    prepare(spark)
    files = spark.read.schema(_FILE).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids, before, blobs = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                docs, counts, ids = unpack_block(blobs[k].as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"pid": pa.array([pids[k].as_py()] * len(docs), pa.int32()), "doc_id": pa.array(docs, pa.int64()), "local": pa.array(starts + before[k].as_py(), pa.int64()), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
                )

    base = bases(files.groupBy("pid").agg(F.sum("n_ids").alias("ids")), "pid", ["ids"])
    rows = files.select("pid", "ids_before", "blob").mapInArrow(decode, "pid int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(base, "pid").select("doc_id", (F.col("ids_before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
