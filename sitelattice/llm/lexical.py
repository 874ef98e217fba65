"""Ranked lexical search with hashed max-sketches.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. A document's impact
of a term depends on the term's occurrences and the document's length only; a query term's weight on how many
documents hold it.

1. One pass over the documents counts documents, terms, and documents per query term.
2. In a second pass a task folds each document's impacts, of all its terms, into a sketch of ``coordinates`` values: a
   term's hash names its coordinate, which keeps the largest impact (coordinatewise maxima).
3. A block of sketches looks up all queries at once (a matrix product of maxima and weights); weight times maximum
   is at least weight times impact, so the sums are upper bounds.
4. For each query the documents are scored exactly in the order of descending bounds, until the bound is below
   the k-th best score that the task has found so far. Results are exact; only how many documents are scored depends on the
   sketch. No candidate list is cut.
5. Spark ranks the tasks' k best of each query, first in salted parts.

Texts never move: both passes are map-only and only counts and scores leave the tasks. Queries are read by the driver in batches of at
most ``batch_rows`` rows and ``BATCH_BYTES`` of text, so what is handed to the tasks is bounded; every batch is a
pass over the documents. ``coordinates`` bounds a block's memory: ``BLOCK`` documents of 4 bytes a coordinate.

Defined results: a null or empty text has no terms; a text of any length is used whole; a query without terms gives no rows; each
row of the queries is a query of its own and each row of the documents a document of its own, whatever their ids; equal scores go
by ascending id, a null id last; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.llm.common import Memo, materialise

#: ASCII that belongs to no term parts terms; A-Z become a-z; bytes of characters beyond ASCII stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of one block, and distinct terms after which it ends earlier.
BLOCK, BLOCK_TERMS = 1024, 1 << 20
BATCH_BYTES = 4 << 20
#: Bounds are widened by this share, above what single precision can lose.
ROUNDING = 1e-3
DOCUMENTS, OCCURRENCES = -1, -2
SALTS = 64


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(TERMS).split()


class Queries:
    """A batch of queries: the count of each term in each, and terms by number."""

    def __init__(self, texts: list[str]):
        self.counts = [Counter(terms((t or "").encode())) for t in texts]
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}

    def weigh(self, documents: int, held: dict[int, int]) -> list[list[tuple[bytes, int]]]:
        """For each query its (term, weight times occurrences in the query), terms of no weight left out."""
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1)))
                  for t, i in self.numbers.items() if held.get(i)}
        return [[(t, weight[t] * k) for t, k in c.items() if weight.get(t)] for c in self.counts]


def _count(docs: DataFrame, queries: Queries) -> dict[int, int]:
    """Documents by term number; DOCUMENTS and OCCURRENCES hold the table's totals."""
    numbers = docs.sparkSession.sparkContext.broadcast(queries.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = frozenset(numbers.value), Counter()
        for b in batches:
            for text in b.column(0):
                words = terms(text.as_py())
                if words:
                    found[DOCUMENTS] += 1
                    found[OCCURRENCES] += len(words)
                    found.update([numbers.value[t] for t in wanted.intersection(words)])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                                         ["term", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term int, n long")
    return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Searcher:
    """The k best documents of each query among those given so far."""

    def __init__(self, weighed: list[list[tuple[bytes, int]]], documents: int, occurrences: int, k: int, coordinates: int):
        self.weighed, self.k, self.coordinates = weighed, k, coordinates
        self.documents, self.occurrences = documents, occurrences
        self.place = Memo(lambda t: zlib.crc32(t) % coordinates)
        self.lookup = np.zeros((coordinates, len(weighed)), np.float32)
        for q, own in enumerate(weighed):
            for t, w in own:
                self.lookup[self.place[t], q] += w
        self.best: list[list[tuple]] = [[] for _ in weighed]
        self.scored = 0
        self.ids: list = []
        self.counts: list[Counter] = []
        self.norms: list[int] = []
        self.held = 0

    def add(self, doc, text: bytes) -> None:
        words = terms(text)
        if not words:
            return
        counts = Counter(words)
        self.ids.append(doc)
        self.counts.append(counts)
        self.norms.append(25 + 75 * len(words) * self.documents // self.occurrences)
        self.held += len(counts)
        if len(self.ids) >= BLOCK or self.held >= BLOCK_TERMS:
            self.search()

    def _bounds(self) -> np.ndarray:
        """Upper bounds of the block's documents (rows) for all queries (columns)."""
        sizes = np.array([len(c) for c in self.counts])
        tf = np.fromiter((n for c in self.counts for n in c.values()), np.int64, self.held)
        place = self.place
        at = np.fromiter((place[t] for c in self.counts for t in c), np.int64, self.held)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(self.norms, np.int64), sizes))
        sketch = np.zeros(len(sizes) * self.coordinates, np.float32)
        np.maximum.at(sketch, np.repeat(np.arange(len(sizes)) * self.coordinates, sizes) + at, impact.astype(np.float32))
        return (sketch.reshape(len(sizes), -1) @ self.lookup) * (1 + ROUNDING) + 1

    def _score(self, own: list[tuple[bytes, int]], i: int) -> int:
        get, norm = self.counts[i].get, 8 * self.norms[i]
        return sum([w * (1_000_000_000 * tf // (1000 * tf + norm)) for t, w in own if (tf := get(t))])

    def search(self) -> None:
        """Take the block's documents into the best of each query, and start a new block."""
        if self.ids:
            bounds = self._bounds()
            for q, own in enumerate(self.weighed):
                self._rescore(self.best[q], own, bounds[:, q])
        self.ids, self.counts, self.norms, self.held = [], [], [], 0

    def _rescore(self, best: list[tuple], own: list[tuple[bytes, int]], bounds: np.ndarray) -> None:
        least = -best[-1][0] if len(best) == self.k else 1
        able = np.flatnonzero(bounds >= least)
        for i in able[np.argsort(-bounds[able], kind="stable")].tolist():
            if bounds[i] < least:
                break
            self.scored += 1
            score = self._score(own, i)
            if score >= least:
                doc = self.ids[i]
                insort(best, (-score, doc is None, doc or 0))
                del best[self.k:]
                least = -best[-1][0] if len(best) == self.k else 1


def _batches(queries: DataFrame, batch_rows: int) -> Iterator[list]:
    rows, held = [], 0
    for r in queries.toLocalIterator():
        rows.append(r)
        held += len(r["text"] or "")
        if len(rows) >= batch_rows or held >= BATCH_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _search_batch(docs: DataFrame, rows: list, k: int, coordinates: int, id_type: str) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries([r["text"] for r in rows])
    held = _count(docs, queries)
    shared = spark.sparkContext.broadcast((queries.weigh(held.get(DOCUMENTS, 0), held), held.get(DOCUMENTS, 0),
                                           held.get(OCCURRENCES, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, k, coordinates)
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                searcher.add(doc.as_py(), text.as_py())
        searcher.search()
        found = [(q, None if none else doc, -score) for q, best in enumerate(searcher.best) for score, none, doc in best]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                                         ["query", "doc", "score"])

    found = docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "query int, doc long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    parts = Window.partitionBy("query", "salt").orderBy(*order)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).withColumn("r", F.row_number().over(parts))
    ranked = salted.where(F.col("r") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"query int, item {id_type}")
    return materialise(ranked.where(F.col("rank") <= k).join(F.broadcast(names), "query")
                       .select("item", "rank", "doc", "score"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, coordinates: int = 8192, batch_rows: int = 1024,
           id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query id, rank, doc id, score): the k documents of highest score above 0 for every row of ``queries``."""
    spark = docs.sparkSession
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    id_type = queries.schema[query_id_col].dataType.simpleString()
    asked = queries.select(F.col(query_id_col).alias("id"), F.col(query_text_col).alias("text"))
    out = spark.createDataFrame([], f"item {id_type}, rank int, doc long, score long")
    for rows in _batches(asked, batch_rows):
        out = out.unionAll(_search_batch(own, rows, k, coordinates, id_type))
    return out.toDF(query_id_col, "rank", id_col, "score")
