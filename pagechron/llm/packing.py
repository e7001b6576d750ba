"""Sum-of-squares packing of documents into windows of token ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bases, prepare, stage
from .encoding import encoder, ship

WINDOW = 2048
#: Bytes of ids in partly filled windows at which a task closes them all, as at its end, and goes on.
RUN_BYTES = 128 << 20
_ROWS = 4096


class SumOfSquares:
    """Online packing by the sum of squared counts of partly filled windows.

    ``level[h]`` counts the open windows filled to h. A piece of s ids goes to
    the fill that makes the sum of squared counts least, an empty window
    included (ties: the fullest). A document of a window or more first gives
    whole windows. Any number of windows may be open. At the end the fullest
    open windows are filled up, one by one, with pieces cut from the emptiest;
    the last gives sequences of powers of two, so nothing is padded. ``moved``
    counts the ids that were taken out of the window that the rule had chosen.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = self.sequences = self.held = self.moved = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.sequences, at, ids))
            at += n
        self.sequences += 1

    def _choose(self, s: int) -> int:
        level, fills = self.level, np.fromiter(self.open, dtype=np.int64, count=len(self.open))
        fills = fills[fills + s <= self.window]
        best, least = 0, 2 * level[s] + 1
        if len(fills):
            closing = fills + s == self.window
            change = np.where(closing, 1 - 2 * level[fills], 2 * (level[fills + s] - level[fills]) + 2)
            k = np.lexsort((-fills, change))[0]
            if change[k] <= least:
                best = int(fills[k])
        return best

    def _put(self, fill: int, piece: tuple) -> None:
        if fill:
            held = self.open[fill].pop()
            self.level[fill] -= 1
            self.n_open -= 1
            if not self.open[fill]:
                del self.open[fill]
        else:
            held = []
        held.append(piece)
        fill += len(piece[2]) // 4
        self.held += len(piece[2])
        if fill == self.window:
            self.held -= 4 * fill
            self._emit(held)
        else:
            self.open.setdefault(fill, []).append(held)
            self.level[fill] += 1
            self.n_open += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        """Place a document given as little-endian 32-bit ids."""
        total, start, whole = len(ids) // 4, 0, 4 * self.window
        while len(ids) >= whole:
            self._emit([(doc, start, ids[:whole], total)])
            ids, start = ids[whole:], start + self.window
        if ids:
            self._put(self._choose(len(ids) // 4), (doc, start, ids, total))

    def finish(self) -> None:
        """Close the open windows: the fullest with pieces of the emptiest, the last in powers of two."""
        windows = [(fill, held) for fill in sorted(self.open, reverse=True) for held in self.open[fill]]
        self.open, self.n_open, self.held = {}, 0, 0
        self.level[:] = 0
        full, last = 0, len(windows) - 1
        while full < last:
            fill, held = windows[full]
            left, donor = windows[last]
            while fill < self.window and donor:
                doc, start, ids, total = donor.pop()
                n = min(self.window - fill, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    donor.append((doc, start + n, ids[4 * n :], total))
                fill, left, self.moved = fill + n, left - n, self.moved + n
            windows[full], windows[last] = (fill, held), (left, donor)
            if fill == self.window:
                self._emit(held)
                full += 1
            if not donor:
                last -= 1
        if full == last:
            self._powers(*windows[full])

    def _powers(self, left: int, rest: list[tuple]) -> None:
        """The last window's pieces as sequences of powers of two, the longest first."""
        now, room = [], 0
        for doc, start, ids, total in rest:
            while ids:
                room = room or 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n], total))
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if not room:
                    self._emit(now)
                    now = []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, keep_space: bool = True, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place there, sequence and offset in it.

    Each task packs the rows of its input split in order; nothing is shuffled,
    and a repeated task packs alike. What a task holds is the ids of its partly
    filled windows, RUN_BYTES at most: beyond that it closes them, as at its end. Sequences are numbered over all tasks by the
    tasks' totals. Null and empty texts are the end id alone; null ids and
    repeated rows are packed like others; an empty table gives no rows.
    ``with_ids`` adds the ids (little-endian unsigned 32-bit) as a column.
    """
    prepare(docs.sparkSession)
    tokenizer = ship(docs.sparkSession, tokenizer)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "offset", "ids"]
    kept = names if with_ids else names[:-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, ss = encoder(tokenizer, keep_space), TaskContext.get().partitionId(), SumOfSquares(window)
        end = np.array([end_id], dtype="<u4").tobytes()

        def rows() -> pa.RecordBatch:
            columns = dict(zip(names, zip(*ss.out, strict=True), strict=True))
            out = {k: pa.array(columns[k], pa.binary() if k == "ids" else pa.int64()) for k in kept}
            ss.out = []
            return pa.RecordBatch.from_pydict(out | {"pid": pa.array([pid] * len(out["doc_id"]), pa.int32())})

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, text in zip(doc_ids, batch.column(1), strict=True):
                ss.add(doc_id, enc.encode(text.as_py()) + end)
                if ss.held >= RUN_BYTES:
                    ss.finish()
                if len(ss.out) >= _ROWS:
                    yield rows()
        ss.finish()
        if ss.out:
            yield rows()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in kept) + ", pid int"
    pieces = stage(narrow.mapInArrow(pack, schema), "pieces")
    base = bases(pieces.groupBy("pid").agg((F.max("local") + 1).alias("sequences")), "pid", ["sequences"])
    return pieces.join(base, "pid").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequences_before") + F.col("local")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
