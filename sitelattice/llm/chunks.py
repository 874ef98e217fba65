"""Documents packed into chunks, and integer lists that travel small.

A chunk is one row that holds whole documents of one task, about ``chunk_bytes`` of text. Chunks let a
task send each distinct fingerprint once, however often its documents repeat it, and let the
answers come back as one bit per fingerprint sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.common import materialise

LAST = np.iinfo(np.int64).max
FIELDS = "chunk long, n_bytes long, keys binary, ends binary, body binary, rest binary"


def shut(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte planes: planes that hold little are small after compression."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = [p for p in range(8) if planes[p].any()]
    return shut(np.array([len(values)], "<u8").tobytes() + bytes([len(used), *used]) + planes[used].tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    raw = opened(data)
    n, k = int(np.frombuffer(raw[:8], "<u8")[0]), raw[8]
    out = np.zeros((n, 8), np.uint8)
    for i, p in enumerate(raw[9:9 + k]):
        out[:, p] = np.frombuffer(raw, np.uint8, n, 9 + k + i * n)
    return out.reshape(-1).view("<u8").copy() if n else np.zeros(0, np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_ints(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, carry: list[str], chunk_bytes: int) -> DataFrame:
    """One row per chunk, written to the shared folder. ``keys`` are the ids as 64-bit integers (a null id
    comes last), ``ends`` where each text ends in ``body``, ``rest`` the id and the carried columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            lengths = pc.binary_length(b.column(1)).to_pylist()
            first = 0
            for i, n in enumerate(lengths):
                size += n
                if size >= chunk_bytes:
                    held.append(b.slice(first, i + 1 - first))
                    yield chunk(number, held)
                    number, first, size, held = number + 1, i + 1, 0, []
            if first < b.num_rows:
                held.append(b.slice(first))
        if held:
            yield chunk(number, held)

    def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        texts = [x.encode() for x in t.column(1).to_pylist()]
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        keys = np.array([LAST if k is None else k for k in t.column(0).to_pylist()], np.int64)
        rest = pa.BufferOutputStream()
        with pa.ipc.new_stream(rest, t.drop_columns([t.schema.names[1]]).schema) as w:
            w.write_table(t.drop_columns([t.schema.names[1]]))
        row = [number, int(ends[-1]), pack_ints(keys.view(np.uint64)), pack_ints(ends.view(np.uint64)),
               shut(b"".join(texts)), shut(rest.getvalue().to_pybytes())]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 2 else pa.binary())
                                           for i, x in enumerate(row)], [f.split()[0] for f in FIELDS.split(", ")])

    names = [f"c{i}" for i in range(len(carry) + 2)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long"), text, *carry).toDF(*names)
    return materialise(rows.mapInArrow(run, FIELDS))


def rest_of(chunk: dict) -> pa.Table:
    """The id and the carried columns of a chunk's documents, named c0, c2, c3, ..."""
    return pa.ipc.open_stream(opened(chunk["rest"])).read_all()


def row_of(t: pa.Table) -> dict:
    return {n: t[n][0].as_py() for n in t.schema.names}
