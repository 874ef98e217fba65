"""Packing token sequences by minimum bin slack.

A document's ids (and one end id) are cut into pieces of at most ``capacity`` ids: whole
windows first, then the rest. Rests wait in a buffer of their task. To fill a window, the longest
waiting rest is set first; a bitset subset-sum over the waiting lengths (a length with many rests
enters as 1, 2, 4, ... copies) finds the multiset that comes closest to the capacity, and
walking the bitsets back gives how many rests of each length go in. The pattern found is used
for as many windows as the counts allow. Where no multiset closes the window, the longest rest
left is cut to close it, so only the last window of a buffer can hold padding.

Everything happens in the task that reads the documents: no shuffle, and memory is bounded by
the buffer and the longest document. A task that runs again on the same split gives the same rows;
sequence ids hold the split number in their upper bits.

Defined results: a null or empty text has the end id only; a document longer than the capacity
gives several pieces; repeated rows are packed each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.bpe import byte_letters
from sitelattice.llm.common import Memo, file_bytes, per_process

#: The pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids of a byte-level BPE vocabulary (tokenizers JSON). No pre-token goes on past a space
    that a non-space follows, so a text is cut there and the parts are remembered."""

    def __init__(self, data: bytes, memo: int = 1 << 19):
        import tiktoken

        spec = json.loads(data)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.special = special
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.memo = Memo(lambda part: self._ids(" " + part), memo)
        self.runs = re.compile(r" \s")
        self.parts = re.compile(r" (?=\S)")

    def _ids(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def _plain(self, text: str) -> bytes:
        parts = self.parts.split(text) if self.runs.search(text) else text.split(" ")
        memo = self.memo
        first = self._ids(parts[0])
        del parts[0]
        return first + b"".join([memo[p] for p in parts])

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers; special strings become their tokens."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p)
                        for p in self.cut.split(text))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``room`` from below.

    ``reach`` has bit s set when some multiset sums to s. Lengths enter from the longest; the
    search ends as soon as ``room`` itself is reached.
    """
    limit = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            many = min(many, left)
            steps.append((reach, length, many))
            reach |= reach << length * many & limit
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, many in reversed(steps):
        if not before >> at & 1:
            at -= length * many
            taken[length] = taken.get(length, 0) + many
    return taken


class Packer:
    """Takes documents, gives pieces (doc, start, length, doc_tokens, sequence, offset, ids)."""

    def __init__(self, capacity: int, window: int, first_sequence: int):
        self.capacity, self.window = capacity, window
        self.sequence = first_sequence
        self.rests: dict[int, list] = {}
        self.waiting = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, c = len(ids) // 4, self.capacity
        whole = n // c * c
        for start in range(0, whole, c):
            yield doc, start, c, n, self.sequence, 0, ids[4 * start:4 * (start + c)]
            self.sequence += 1
        if n > whole:
            self._wait(doc, whole, n, ids[4 * whole:])
            if self.waiting >= self.window:
                yield from self.flush()

    def _wait(self, doc, start: int, n: int, ids: bytes) -> None:
        self.rests.setdefault(len(ids) // 4, []).append((doc, start, n, ids))
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        found = self.rests[length]
        piece = found.pop()
        if not found:
            del self.rests[length]
        self.waiting -= 1
        return piece

    def flush(self) -> Iterator[tuple]:
        """Fill windows until nothing waits."""
        while self.rests:
            counts = {n: len(p) for n, p in self.rests.items()}
            seed = max(counts)
            counts[seed] -= 1
            pattern = best_fill(counts, self.capacity - seed)
            pattern[seed] = pattern.get(seed, 0) + 1
            slack = self.capacity - sum(n * k for n, k in pattern.items())
            times = min(len(self.rests[n]) // k for n, k in pattern.items()) if not slack else 1
            for _ in range(times):
                yield from self._fill(pattern, slack)

    def _fill(self, pattern: dict[int, int], slack: int) -> Iterator[tuple]:
        offset = 0
        for length, many in pattern.items():
            for _ in range(many):
                doc, start, n, ids = self._take(length)
                yield doc, start, length, n, self.sequence, offset, ids
                offset += length
        if slack and self.rests:
            doc, start, n, ids = self._take(max(self.rests))
            yield doc, start, slack, n, self.sequence, offset, ids[:4 * slack]
            self._wait(doc, start + slack, n, ids[4 * slack:])
        self.sequence += 1


COLUMNS = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, window: int = 8192,
         id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, with
    ``keep``, ``ids`` (unsigned 32-bit integers). ``window`` is how many rests a task's buffer holds;
    it bounds memory, and every rest is packed."""
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    end = array("I", [end_id]).tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_process(("byte_bpe", vocabulary), lambda: ByteBpe(data.value))
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 33)
        kind = pa.int64()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(list(zip(*rows))[:6])]
            ids = [r[6] for r in rows]
            cols.append(pa.array([zlib.crc32(x) for x in ids], pa.int64()))
            return pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if keep else []),
                                              COLUMNS + (["ids"] if keep else []))

        for b in batches:
            kind = b.column(0).type
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += packer.add(doc, bpe.encode(text) + end)
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        if rows := list(packer.flush()):
            yield batch(rows)

    schema = (f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, "
              "ids_crc32 long" + (", ids binary" if keep else ""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
