"""Removal of repeated word passages, anchored on fixed blocks.

A window is ``window`` consecutive words of one document. Every word is removed that is covered by a
window whose word sequence also starts earlier, in a smaller id or at an earlier place of the same
document; windows are judged on the input.

1. Index: every document is cut into non-overlapping blocks of ``(window + 1) // 2`` words. Any
   window holds a whole block. Probe: the rolling hash of every run of so many words is looked up
   among the blocks' hashes. A hash that belongs to a block and occurs at two places is an anchor.
2. Extend: around every anchor the windows that hold it are compared exactly, by 96 bits of hash of
   their words, which grows hits to maximal repeats: the windows of a maximal repeat that share an
   anchor follow one another. Of equal windows the earliest keeps its words.

Documents travel in chunks (``chunks``). A chunk sends each distinct hash once, sorted and packed
by range of hash, so that a passage shared by very many documents costs a bucket one entry per
chunk; the buckets answer with one bit per entry. Nothing is sampled, capped or dropped: hashes of
anchors are cut to a width that grows with the corpus, and a false anchor costs a comparison only.

Defined results: a null or empty text has no words and is kept; a null id comes after all others;
rows with equal ids (repeated rows) are ordered by their place in the input; texts shorter than a
window are kept; other columns are carried only if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.chunks import (opened, pack_chunks, pack_ints, pack_sorted, rest_of, row_of, unpack_ints,
                                    unpack_sorted)
from sitelattice.llm.common import materialise, per_process

BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    have = per_process("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(have[0]) < n:
        for at, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 22), base, np.uint64)
            x[0] = 1
            have[at] = np.multiply.accumulate(x)
    return have[0], have[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all, start of every word) of texts
    laid end to end."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64), np.zeros(0, np.int64)
    solid = ~SPACES[body]
    first = np.zeros(n, bool)  # a text begins here
    begins = np.concatenate([[0], ends[:-1]])
    first[begins[begins < n]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    starts = np.flatnonzero(start)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:]
    stops = np.flatnonzero(stop) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(power[:n] * (body.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    h = (sums[stops] - sums[starts]) * inverse[starts]
    h = _mix(h + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, np.concatenate([[0], ends])), starts


def rolling(h: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Sum of h[i + j] * factor**j for j < length, for every i with so many words after it."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, power, size = None, 0, h, 1
    while True:
        if length & size:
            part = power[done:done + n] * np.uint64(pow(factor, done, 1 << 64))
            total = part if total is None else total + part
            done += size
        if done == length:
            return total
        power = power[:-size] + power[size:] * np.uint64(pow(factor, size, 1 << 64))
        size *= 2


class Words:
    """A chunk's words with the fingerprints of both steps."""

    def __init__(self, chunk: dict, window: int, bits: int):
        self.chunk, self.window, self.block = chunk, window, (window + 1) // 2
        self.body = np.frombuffer(opened(chunk["body"]), np.uint8)
        self.ends = unpack_ints(chunk["ends"]).view(np.int64)
        self.keys = unpack_ints(chunk["keys"]).view(np.int64)
        self.hash, self.first, self.starts = word_hashes(self.body, self.ends)
        counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], counts)
        self.left = np.repeat(counts, counts) - self.place
        self.bits = bits
        short = np.repeat(counts < window, counts)
        run = rolling(self.hash, self.block, 0xC2B2AE3D27D4EB4F)
        #: Places whose run of ``block`` words lies in one text that is long enough for a window.
        self.at = np.flatnonzero((self.left >= self.block) & ~short)
        self.run = _mix(run[self.at]) >> np.uint64(64 - bits)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct run hashes ascending, their flags: 1 some block, 2 at two places)."""
        order = np.argsort(self.run, kind="stable")
        h = self.run[order]
        aligned = self.place[self.at][order] % self.block == 0
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        if not len(h):
            return h, np.zeros(0, np.uint8)
        many = np.diff(cut, append=len(h)) > 1
        return h[cut], np.logical_or.reduceat(aligned, cut) + 2 * many.astype(np.uint8)

    def windows(self, anchor_hashes: np.ndarray) -> Windows:
        """The windows that hold an anchor."""
        hit = np.zeros(len(self.hash) + 1, np.int64)
        hit[self.at[np.isin(self.run, anchor_hashes)] + 1] = 1
        hits = np.cumsum(hit)
        n = len(self.hash) - self.window + 1
        if n <= 0:
            return Windows(self, np.zeros(0, np.int64))
        span = self.window - self.block + 1
        near = hits[span:span + n] > hits[:n]
        return Windows(self, np.flatnonzero(near & (self.left[:n] >= self.window)))


class Windows:
    """Windows of a chunk by their first word, with the distinct ones ascending by hash."""

    def __init__(self, words: Words, at: np.ndarray):
        self.words, self.at = words, at
        h = _mix(rolling(words.hash, words.window, 0x165667B19E3779F9)[at]) if len(at) else np.zeros(0, np.uint64)
        check = _mix(rolling(words.hash, words.window, 0x27D4EB2F165667C5)[at]) if len(at) else np.zeros(0, np.uint64)
        check &= np.uint64(0xFFFFFFFF)
        # documents of a chunk in the order of (id, place in the input)
        rank = np.empty(len(words.keys), np.int64)
        rank[np.argsort(words.keys, kind="stable")] = np.arange(len(words.keys))
        order = np.lexsort((at, rank[words.text_of[at]], check, h)) if len(at) else np.zeros(0, np.int64)
        h, check = h[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        self.order, self.group = order, np.cumsum(new) - 1
        self.hash, self.check = h[new], check[new]
        self.owner = words.keys[words.text_of[at[order[new]]]] if len(at) else np.zeros(0, np.int64)
        self.first = new

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """First words of the windows that start earlier too: those whose hash an earlier chunk owns,
        and all but the first of their hash here. ``elsewhere``: one flag per distinct hash."""
        return self.at[self.order[elsewhere[self.group] | ~self.first]]


def _sent(number: int, shift: int, hashes: np.ndarray, extras: list[np.ndarray]) -> Iterator[tuple]:
    """(bucket, chunk, blob, extra blobs): sorted hashes cut by their upper bits."""
    bucket = (hashes >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(hashes) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield (int(bucket[a]), number, pack_sorted(hashes[a:b]), *[pack_ints(x[a:b]) for x in extras])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary())
                                       for i, c in enumerate(zip(*rows) if rows else [()] * len(names))], names)


def _answers(t: pa.Table, decide) -> pa.Table:
    """Bucket rows to (chunk, bucket, bits): ``decide(hash, chunk index, extras)`` gives a flag per entry."""
    chunks = t["chunk"].to_numpy()
    lists = [unpack_sorted(x.as_py()) for x in t["hashes"]]
    sizes = [len(x) for x in lists]
    extras = [np.concatenate([unpack_ints(x.as_py()) for x in t[n]]) for n in t.schema.names if n.startswith("extra")]
    flags = decide(np.concatenate(lists), np.repeat(chunks, sizes), *extras)
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    some = [i for i, p in enumerate(parts) if p.any()]
    return pa.table({"chunk": pa.array(chunks[some], pa.int64()),
                     "bucket": pa.array(t["bucket"].to_numpy()[some], pa.int64()),
                     "bits": pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary())})


ANSWER = "chunk long, bucket long, bits binary"


def _flags(answer: list[dict], shift: int, hashes: np.ndarray) -> np.ndarray:
    """One flag per distinct hash of a chunk from its buckets' answers."""
    bucket = (hashes >> np.uint64(shift)).astype(np.int64)
    out = np.zeros(len(hashes), bool)
    for a in answer:
        span = slice(*np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1]))
        out[span] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=span.stop - span.start).astype(bool)
    return out


def _anchored(h: np.ndarray, chunk: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """A hash is an anchor if it belongs to a block and occurs twice."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    either = np.bitwise_or.reduceat(flags[order], cut)
    size = np.diff(cut, append=len(s))
    good = (either & np.uint64(1)).astype(bool) & ((size > 1) | (either & np.uint64(2)).astype(bool))
    out = np.empty(len(h), bool)
    out[order] = np.repeat(good, size)
    return out


def _owned_elsewhere(h: np.ndarray, chunk: np.ndarray, check: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Entries whose window starts earlier in another chunk."""
    order = np.lexsort((chunk, owner.view(np.int64), check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    out = np.empty(len(h), bool)
    out[order] = ~new
    return out


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None, keep: bool = True, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(id, *carry, n_words, n_removed, kept_sha256) of every row; ``kept_sha256`` is over the kept words
    joined by one space. With ``keep`` also ``kept``: the text without its removed words, white space
    between kept words as it was, and a text that loses nothing unchanged."""
    carry = carry or []
    chunks = pack_chunks(docs, id_col, text_col, carry, chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    size_bits = max(20, total.bit_length())
    bits, spread = min(62, size_bits + 12), max(0, size_bits - 23)  # buckets of some MB of text
    shift, wide = bits - spread, 64 - spread

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                chunk = {n: c[r].as_py() for n, c in zip(b.schema.names, b.columns)}
                h, flags = Words(chunk, window, bits).anchors()
                rows = list(_sent(chunk["chunk"], shift, h, [flags.astype(np.uint64)]))
                yield _batch(rows, ["bucket", "chunk", "hashes", "extra1"])

    sent = "bucket long, chunk long, hashes binary, extra1 binary"
    anchors = materialise(chunks.drop("rest").mapInArrow(probe, sent).groupBy("bucket")
                          .applyInArrow(lambda t: _answers(t, _anchored), ANSWER))

    def found(t: pa.Table, answers: list[dict]) -> Windows:
        words = Words(row_of(t), window, bits)
        h, _ = words.anchors()
        return words.windows(h[_flags(answers, shift, h)])

    def extend(key, t: pa.Table, answer: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows and answer.num_rows:
            w = found(t, answer.to_pylist())
            rows = list(_sent(key[0].as_py(), wide, w.hash, [w.check, w.owner.view(np.uint64)]))
        return pa.Table.from_batches([_batch(rows, ["bucket", "chunk", "hashes", "extra1", "extra2"])])

    by_chunk = chunks.drop("rest").groupBy("chunk").cogroup(anchors.groupBy("chunk"))
    repeats = materialise(by_chunk.applyInArrow(extend, sent + ", extra2 binary").groupBy("bucket")
                          .applyInArrow(lambda t: _answers(t, _owned_elsewhere), ANSWER))

    def finish(key, t: pa.Table, answer: pa.Table) -> pa.Table:
        if not t.num_rows:
            return empty
        rows = answer.to_pylist()
        w = found(t, [a for a in rows if not a["last"]])
        at = w.repeated(_flags([a for a in rows if a["last"]], wide, w.hash))
        chunk = row_of(t)
        rest = rest_of(chunk)
        out = list(_cut(w.words, at, keep))
        return pa.table([*rest.columns, *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=names)

    answers = anchors.withColumn("last", F.lit(False)).unionByName(repeats.withColumn("last", F.lit(True)))
    kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep
    head = docs.select(F.col(id_col).cast("long"), *carry).toDF(*[f"c{i}" for i in range(len(carry) + 1)])
    names = [*head.columns, "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep
    schema = ", ".join(f"{n} {t}" for n, t in head.dtypes) + ", n_words long, n_removed long, kept_sha256 string" + (
        ", kept string" if keep else "")
    empty = pa.table({n: pa.array([], pa.null()) for n in names})
    done = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
    return done.toDF(id_col, *carry, *names[len(head.columns):])


def _cut(words: Words, at: np.ndarray, keep: bool) -> Iterator[tuple]:
    """(n_words, n_removed, kept_sha256[, kept]) of the chunk's texts; ``at``: first words of repeats."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + words.window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    body, begin = words.body.tobytes(), 0
    for i, end in enumerate(words.ends.tolist()):
        text = body[begin:end]
        a, b = words.first[i], words.first[i + 1]
        off = gone[a:b]
        n = int(off.sum())
        kept = text.split()
        if n:
            kept = [w for w, g in zip(kept, off.tolist()) if not g]
        row = (int(b - a), n, hashlib.sha256(b" ".join(kept)).hexdigest())
        if keep and n:
            place = words.starts[a:b] - begin
            turn = np.flatnonzero(np.diff(off.astype(np.int8), prepend=0, append=0))
            left, parts = 0, []
            for x, y in zip(turn[::2], turn[1::2]):
                parts.append(text[left:place[x]])
                left = int(place[y]) if y < len(place) else len(text)
            row += ((b"".join(parts) + text[left:]).decode(),)
        elif keep:
            row += (text.decode(),)
        yield row
        begin = end
