"""Packing by concatenate and cut.

Pass one turns every text into ids and writes them with their place in their partition; the partitions'
token totals, a row each, become global offsets by a prefix sum.  Pass two reads the ids again and cuts
the one long stream at every multiple of the window, recording where documents and windows meet.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they
occur; a null doc_id is kept; a text longer than a window spans as many as it needs; an empty table gives
no pieces; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import storage, tokens

#: Partition offsets are broadcast up to so many partitions (16 bytes each), else joined by a shuffle.
BROADCAST_PARTITIONS = 500_000
_STEP = 256


def _encode(path: str, end: int):
    def run(batches):
        part, start, code = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        for batch in tokens.gathered(batches):
            ids, n = tokens.with_end(*code.flat(batch.column(1)), end)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, "int32")), batch.column(0), pa.array(start + ends - n), pa.array(n), _packed(ids, ends - n, ends)],
                ["part", "doc_id", "start", "n", "ids"],
            )
            start += len(ids)
        storage.give_back()

    return run


def _packed(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's ids in two bytes each, or, behind a zero byte, in four; see ``_wide``."""
    if ids.max(initial=0) >> 16:
        return pa.array([ids[a:b].astype("<u2").tobytes() if _narrow(ids[a:b]) else b"\0" + ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends)], pa.binary())
    bounds = np.r_[0, 2 * ends].astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u2"))])
    return whole.cast(pa.binary())


def _narrow(ids: np.ndarray) -> bool:
    return not ids.max(initial=0) >> 16


def _wide(ids: bytes) -> np.ndarray:
    """Two bytes an id, or, behind a zero byte, four."""
    return np.frombuffer(ids, "<u2").astype("<u4") if len(ids) % 2 == 0 else np.frombuffer(ids, "<u4", offset=1)


def _cut(window: int):
    def run(batches):
        tokens.forget()
        for batch in batches:
            doc, first, n, ids = (batch.column(k) for k in range(4))
            for at in range(0, batch.num_rows, _STEP):
                g, m = (x.slice(at, _STEP).to_numpy(zero_copy_only=False) for x in (first, n))
                pieces = (g + m - 1) // window - g // window + 1
                row = np.repeat(np.arange(len(g)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                seq = g[row] // window + k
                lo = np.maximum(seq * window, g[row])
                hi = np.minimum((seq + 1) * window, g[row] + m[row])
                wide = [_wide(x.as_py()) for x in ids.slice(at, _STEP)]
                a, b = lo - g[row], hi - g[row]
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(at, _STEP).take(pa.array(row)), pa.array(a), pa.array(b - a),
                     pa.array([wide[r][x:y].tobytes() for r, x, y in zip(row, a, b)], pa.binary()),
                     pa.array(m[row]), pa.array(seq), pa.array(lo - seq * window), pa.array(b < m[row])],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "continues"],
                )

    return run


def pack(docs: DataFrame, path: str, *, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of windows: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id,
    offset, continues (the document goes on in the next window)."""
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    storage.small_batches(spark)
    ids = storage.written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _encode(path, end_id), "part int, doc_id long, start long, n long, ids binary"
        ),
        "packing-ids",
    )
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = storage.written(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "packing-offsets")
    if offsets.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = ids.join(offsets, "part").select("doc_id", (F.col("base") + F.col("start")).alias("first"), "n", "ids")
    return placed.mapInArrow(
        _cut(window),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, continues boolean",
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues")
