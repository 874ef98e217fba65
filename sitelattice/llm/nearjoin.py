"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two documents are linked when their sets' Jaccard similarity is at
least ``threshold``. The result is one row per document with its class (the connected component) and
its number of links, and no pair is ever a row.

1. Documents with equal sets are one node; everything below works on nodes, with counts.
2. Every node has 128 MinHash values. Bands of four values give buckets; each node of a bucket is
   compared with the bucket's least node only. Pairs whose posterior probability of a similarity
   of ``family`` is negligible are dropped, the rest joins nodes to families. A family holds every
   pair that can be a link: two texts of similarity 0.8 miss each other in all bands with
   probability 5e-8.
3. In a family all pairs of nodes are candidates. They are compared MinHash value by MinHash value, in
   steps of 16; a pair is dropped as soon as the posterior probability that it reaches
   ``threshold``, given its matches so far, falls below ``tolerance``. What is left is verified
   exactly on the shingle sets. Large families are cut into blocks, and each pair of blocks is a task
   of its own that returns link counts and a spanning forest.

MinHash values are kept as bytes, so two differing values match with probability 1/256, which the
posterior takes into account.

Defined results: words are what stands between ASCII white space, unchanged; a text of one to four
words has one shingle, all its words; a null or empty text has none and is linked to nothing, its
class is its own id; equal texts (also repeated rows) are linked; a null id takes part, and a class of
null ids only is null; other columns are carried only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.chunks import opened, shut
from sitelattice.llm.common import step
from sitelattice.llm.components import connected_components
from sitelattice.llm.repeats import _mix, rolling, word_hashes

SHINGLE, VALUES, ROWS, STEP = 5, 128, 4, 16
SLICE = 1 << 20
_DRAW = np.random.Generator(np.random.PCG64(20_240_501))
FACTORS = _DRAW.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text ascending, end to end; where each text's begin, and the end)."""
    body = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    h, first, _ = word_hashes(body, ends)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(first[1:], counts) - np.arange(len(h))
    run = rolling(h, size, 0xFF51AFD7ED558CCD)
    at = np.flatnonzero(left[:len(run)] >= size)
    value, owner = [_mix(run[at])], [text_of[at]]
    for n in range(1, size):  # texts shorter than a shingle
        few = np.flatnonzero(counts == n)
        if len(few):
            value.append(_mix(rolling(h, n, 0xFF51AFD7ED558CCD)[first[few]] + np.uint64(n)))
            owner.append(few)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= SLICE or i == len(sizes) - 1:
            yield a, i + 1
            a, total = i + 1, 0


def signatures(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash bytes: texts x VALUES, band keys: texts x bands) of texts that have shingles."""
    n = len(starts) - 1
    least = np.empty((n, VALUES), np.uint64)
    for i, f in enumerate(FACTORS):
        least[:, i] = np.minimum.reduceat(value * f, starts[:-1])
    least = _mix(least)
    bands = np.zeros((n, VALUES // ROWS), np.uint64)
    bands += np.arange(bands.shape[1], dtype=np.uint64)  # equal values in two bands are no match
    for r in range(ROWS):
        bands = bands * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS]
    return (least >> np.uint64(56)).astype(np.uint8), _mix(bands)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 1, 2, ... steps: the fewest matches at which the posterior probability of a similarity of
    ``threshold`` (uniform prior) is at least ``tolerance``."""
    s = np.linspace(0, 1, 2001)[1:-1]
    q = s + (1 - s) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(q) + (n - m) * np.log1p(-q)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= tolerance * weight.sum():
                break
        out.append(m)
    return np.array(out)


def pruned(a: np.ndarray, b: np.ndarray, least: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of signatures that survive; ``upper``: a is b, take i < j."""
    same = np.zeros((len(a), len(b)), np.int16)
    for c in range(STEP):
        same += a[:, c, None] == b[None, :, c]
    good = same >= least[0]
    if upper:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    count = same[i, j]
    for step in range(1, VALUES // STEP):
        cols = slice(step * STEP, (step + 1) * STEP)
        count = count + (a[i, cols] == b[j, cols]).sum(1)
        stay = count >= least[step]
        i, j, count = i[stay], j[stay], count[stay]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, value: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of texts reach the threshold, on their sets. ``i`` ascends."""
    good = np.zeros(len(i), bool)
    if not len(i):
        return good
    _, number = np.unique(value, return_inverse=True)
    mark = np.zeros(len(value), bool)
    size = np.diff(starts)
    cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for x, y in zip(cut[:-1], cut[1:]):
        own = number[starts[i[x]]:starts[i[x] + 1]]
        mark[own] = True
        for lo in range(x, y, 256):
            with_ = j[lo:min(y, lo + 256)]
            spans = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in with_])
            shared = np.add.reduceat(mark[number[spans]].astype(np.int64),
                                     np.concatenate([[0], np.cumsum(size[with_])[:-1]]))
            good[lo:lo + len(with_)] = shared >= threshold * (size[i[x]] + size[with_] - shared) - 1e-9
        mark[own] = False
    return good


def _sign(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Every row with its node (null without words), signature, band keys and packed text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().partitionId() << 33
        for b in batches:
            given = b.column(1).to_pylist()
            texts = [(t or "").encode() for t in given]
            for x, y in _slices([len(t) for t in texts]):
                value, starts = shingles(texts[x:y])
                has = np.flatnonzero(np.diff(starts))
                cut = np.concatenate([starts[has], starts[-1:]])
                nodes, sigs, bands = [None] * (y - x), [None] * (y - x), [None] * (y - x)
                packed = [None if given[i] is None else shut(texts[i]) for i in range(x, y)]
                if len(has):
                    sig, band = signatures(value, cut)
                    size = np.diff(cut).astype(np.uint64)
                    one = _mix(np.add.reduceat(_mix(value + np.uint64(1)), cut[:-1]) + size)
                    two = _mix(np.add.reduceat(_mix(value ^ np.uint64(0x5BD1E9955BD1E995)), cut[:-1]) ^ size)
                    for k, i in enumerate(has.tolist()):
                        nodes[i] = one[k].tobytes() + two[k].tobytes()
                        sigs[i], bands[i] = sig[k].tobytes(), band[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), *[c.slice(x, y - x) for c in b.columns[2:]],
                     pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary()),
                     pa.array(np.arange(tag, tag + y - x))], names)
                tag += y - x

    head = [f"c{i}" for i in range(len(carry) + 1)]
    names = [*head, "node", "sig", "bands", "packed", "tag"]
    rows = docs.select(F.col(id_col), F.col(text_col), *carry)
    kinds = [rows.dtypes[0][1], *[t for _, t in rows.dtypes[2:]]]
    schema = ", ".join(f"{n} {t}" for n, t in zip(head, kinds)) + ", node binary, sig binary, bands array<bigint>, packed binary, tag long"
    return step(rows.toDF("c0", "t", *head[1:]).mapInArrow(run, schema))


def _families(nodes: DataFrame, family: float, tolerance: float) -> DataFrame:
    """(node, root) of nodes that have a likely neighbour. Buckets hold the short names of nodes."""
    buckets = nodes.select("short", F.explode("bands").alias("key"))
    lead = buckets.groupBy("key").agg(F.min("short").alias("lead"), F.max("short").alias("most")).where("lead <> most")
    pairs = buckets.join(lead.select("key", "lead"), "key").where("short <> lead").select("short", "lead").distinct()
    sigs = nodes.select("short", "node", "sig")
    both = pairs.join(sigs, "short").join(
        sigs.select(F.col("short").alias("lead"), F.col("node").alias("lead_node"), F.col("sig").alias("lead_sig")), "lead")
    least = least_matches(family, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(-1, VALUES)
                    for n in ("sig", "lead_sig"))
            same = np.cumsum((a == c).reshape(len(a), -1, STEP).sum(2), axis=1)
            stay = pa.array((same >= least).all(1))
            yield pa.RecordBatch.from_arrays([b.column("node").filter(stay), b.column("lead_node").filter(stay)], ["a", "b"])

    return connected_components(both.select("node", "lead_node", "sig", "lead_sig").mapInArrow(run, "a binary, b binary"))


BLOCK = 512


def _links(signed: DataFrame, families: DataFrame, counts: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, parent): links of a node within one pair of blocks, by documents, and the least
    node of its component there."""
    size = families.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = families.join(size, "root").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.select("root", "node", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    # families of one block share units of some hundred nodes; larger ones have a unit per pair of blocks
    n_units = max(1, families.count() // 500)
    unit = F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(n_units)).cast("string"))).otherwise(
        F.concat(F.hex("root"), F.lit("|"), F.least("block", "o").cast("string"), F.lit("|"), F.greatest("block", "o").cast("string")))
    # one copy of each node's text: equal sets may come from many rows; the families have no size
    # bound, so they are not broadcast at any size
    texts = (signed.where("node is not null").withColumn("row", F.xxhash64("packed"))
             .join(families.select("node").hint("merge"), "node", "left_semi").groupBy("node")
             .agg(F.min_by(F.struct("sig", "packed"), "row").alias("t")))
    rows = (texts.join(counts, "node").join(met, "node")
            .select(unit.alias("unit"), "root", "node", "block", "n", "t.sig", "t.packed"))
    least = least_matches(threshold, tolerance)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("root", "ascending"), ("block", "ascending"), ("node", "ascending")])
        roots = t["root"].to_pylist()
        cut = [0] + [i for i in range(1, len(roots)) if roots[i] != roots[i - 1]] + [len(roots)]
        out: list[tuple] = []
        for x, y in zip(cut[:-1], cut[1:]):
            out += _block_pair(t.slice(x, y - x), least, threshold)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()),
                                                        (pa.binary(), pa.int64(), pa.binary()))],
                        names=["node", "links", "parent"])

    return step(rows.groupBy("unit").applyInArrow(run, "node binary, links long, parent binary"))


def _block_pair(t: pa.Table, least: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(node, links, parent) from one family's nodes of one block, or the pairs between two blocks."""
    nodes, n = t["node"].to_pylist(), t["n"].to_numpy()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)
    block = t["block"].to_numpy()
    a = int(np.searchsorted(block, block[0], "right"))
    if a == len(nodes):
        i, j = pruned(sig, sig, least, True)
    else:
        i, j = pruned(sig[:a], sig[a:], least, False)
        j = j + a
    used, number = np.unique(np.concatenate([i, j]), return_inverse=True)
    value, starts = shingles([opened(p) for p in t["packed"].take(used).to_pylist()])
    good = verified(number[:len(i)], number[len(i):], value, starts, threshold)
    i, j = i[good], j[good]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    parent = np.arange(len(nodes))
    while True:  # least number reached over the links
        low = np.minimum(parent[i], parent[j])
        new = parent.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    for k in np.flatnonzero(links):
        yield nodes[k], int(links[k]), nodes[parent[k]]


def jaccard_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, family: float = 0.6,
                 id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                 keep_text: bool = False) -> DataFrame:
    """(id, *carry, class_id, n_links, keep) of every row: class_id is the least id of the class, n_links
    the number of other rows whose similarity is at least ``threshold``, and exactly one row of each
    class has ``keep``, one with the least id. With ``keep_text`` the rows that stay have their text."""
    carry = carry or []
    head = [f"c{i}" for i in range(len(carry) + 1)]
    signed = _sign(docs, id_col, text_col, carry)
    # of each class one row stays: least id, then first in the input
    first = F.min(F.struct(F.col("c0").isNull().alias("nul"), "c0", "tag")).alias("first")
    nodes = step(signed.where("node is not null").groupBy("node").agg(
        F.count("*").alias("n"), F.min("c0").alias("least"), first, F.min("sig").alias("sig"), F.min("bands").alias("bands"))
        .withColumn("short", F.xxhash64("node")))
    families = step(_families(nodes, family, tolerance))
    found = _links(signed, families, nodes.select("node", "n"), threshold, tolerance)
    classes = step(connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b"))))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = step(nodes.drop("sig", "bands").join(classes, "node", "left").join(links, "node", "left").select(
        "node", "least", "first", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    best = known.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("first"))
    known = known.select("node", "root", "n_links").join(best, "root").select(
        "node", "class_id", "n_links", F.col("first.tag").alias("kept"))
    text = ["packed"] * keep_text
    out = signed.select(*head, "node", "tag", *text).join(known, "node", "left").select(
        *head, F.when(F.col("node").isNull(), F.col("c0")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("tag") == F.col("kept"), F.lit(True)).alias("keep"), *text)
    if not keep_text:
        return out.toDF(id_col, *carry, "class_id", "n_links", "keep")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = b.column(b.num_columns - 2).to_pylist()
            texts = [opened(p).decode() if k and p is not None else None
                     for k, p in zip(stays, b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "t"])

    schema = ", ".join(f"{n} {t}" for n, t in out.dtypes[:-1]) + ", t string"
    return out.mapInArrow(unpack, schema).toDF(id_col, *carry, "class_id", "n_links", "keep", text_col)
