"""Grouping of spelling variants by asymmetric q-chunks.

1. Words and how often they occur are counted in the task that reads the documents, in a dictionary of
   bounded size, and summed by Spark.
2. Two words are near if one inserted, deleted or replaced code point turns one into the other. One of a pair (the
   longer; of two equally long ones the smaller), of length L, contributes two disjoint chunks of q = L div 2 code points,
   its beginning and its end. The other contributes its positional grams of that q. One edit leaves one chunk as it
   is, and the chunk then lies in the other word at a shift of at most one: none for the beginning, the difference of
   the lengths for the end. Other grams can meet no chunk and are not made.
3. The edit is in the rest of the word, and it leaves one of the rest's two halves, of r = (L - q) div 2 code points,
   as it is, by the same argument. So the two words meet on a chunk and such a half: four keys a word, whose
   buckets hold words that differ in about a quarter of their letters. Lossless, as the two steps are.
4. Candidates are verified within the join (edit distance at most one), and a pair counts under the first of the four
   keys that it shares, so pairs that are not near never become rows and none comes twice.
5. A word's form is its near word of largest count; roots come by pointer doubling. Counts grow by ``factor`` along
   a chain, so chains are at most log(rows) long and have no cycles.

Buckets and words are joined and pre-aggregated, never gathered; a skewed bucket is split by Spark. Ties of count go to
the smaller word in code-point order.

Defined results: a null or empty text has no words; texts count whole, whatever their length; a null id is the empty text
in the hash that damages runs; repeated rows count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.common import materialise

#: Latin-1 letters of the runs (U+00C0 to U+00FF whole) stay, A-Z become a-z, all else parts runs.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The text's runs of letters, lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def damaged(run: bytes, seed: int, every: int) -> bytes:
    """The run without the code point that its hash names, if ``every`` divides the hash."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, every: int, least_length: int, id_col: str, text_col: str,
                held: int = 1 << 18) -> DataFrame:
    """(word, n): occurrences of words of at least ``least_length`` code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()),
                                              pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                seed = zlib.crc32(f"{doc.as_py()}:".encode())
                for r, times in Counter(runs(text.as_py())).items():
                    word = damaged(r, seed, every)
                    if len(word) >= least_length:
                        found[word] += times
                if len(found) > held:
                    yield flush()
        yield flush()

    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts(word: Column, length: Column) -> list[tuple[Column, Column]]:
    """The four (beginning, end) that a word keeps of itself when another of ``length`` code points gives the chunks."""
    q = F.floor(length / 2).cast("int")
    r = F.floor((length - q) / 2).cast("int")
    none = F.lit(0)
    return [(F.left(word, a), F.right(word, b)) for a, b in ((q + r, none), (q, r), (r, q), (none, q + r))]


def _keyed(words: DataFrame, lengths: list[Column], word: str, n: str) -> DataFrame:
    keys = [F.struct(F.lit(i).alias("kind"), F.xxhash64(F.lit(i), length, *part).alias("key"), length.alias("length"))
            for length in lengths for i, part in enumerate(_parts(F.col("word"), length))]
    return (words.select(F.col("word").alias(word), F.col("n").alias(n), F.explode(F.array(*keys)).alias("k"))
            .select(word, n, "k.kind", "k.key", "k.length"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of every pair of near words, once, from distinct words (word, n) of two code points and more."""
    size = F.char_length("word")
    chunks = _keyed(words, [size], "a", "a_n")
    grams = _keyed(words, [size, size + 1], "b", "b_n")
    a, b = F.col("c.a"), F.col("g.b")
    first = F.lit(4)
    for i, ((x, y), (u, v)) in reversed(list(enumerate(zip(_parts(a, F.col("c.length")), _parts(b, F.col("c.length")))))):
        first = F.when((x == u) & (y == v), i).otherwise(first)
    met = (F.col("c.key") == F.col("g.key")) & (F.col("c.kind") == F.col("g.kind")) & (F.col("c.length") == F.col("g.length"))
    verified = ((F.char_length(a) > F.char_length(b)) | (a < b)) & (F.levenshtein(a, b, 1) == 1) & (first == F.col("c.kind"))
    return chunks.alias("c").join(grams.alias("g"), met & verified).select("a", "a_n", "b", "b_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, from (word, form)."""
    now = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        told = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")))
        now = told.select("word", "root")
        if not told.where("moved").limit(1).count():
            return now


def group_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, every: int = 199,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_length`` code points and ``least_count``
    occurrences. A form has at least ``factor`` times the word's count. A run whose hash ``every`` divides has lost a letter."""
    if least_length < 2 or factor < 2:
        raise ValueError("least_length and factor are at least 2")
    words = materialise(count_words(docs, every, least_length, id_col, text_col).where(F.col("n") >= least_count))
    pairs = near_pairs(words)
    both = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form")).alias("best")),
                   F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("form")).alias("best")))
    near = (pairs.select(F.explode(both).alias("p")).groupBy("p.word")
            .agg(F.count("*").alias("n_near"), F.min("p.best").alias("best")))
    common = -F.col("best.n") >= factor * F.col("n")
    known = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.form")).alias("form"),
        F.when(common, -F.col("best.n")).alias("form_n")))
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
