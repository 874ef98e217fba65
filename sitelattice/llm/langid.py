"""Language identification by language-bitmask n-gram filters.

``learn`` fits one Bloom filter per language over the letter n-grams typical of it. The filters
are bit-sliced: they share their hash functions and are stored as one table whose entry at a
position is a bitmask of the languages that have this bit. Looking an n-gram up is ``n_hashes``
reads and an AND, and gives all languages that contain it. ``predict`` counts these bits per language
over the whole text, takes off the filter's expected false positives, divides by the share that the
language's own training text reaches, and decides for the largest value.

The fit uses a sample of about ``sample_docs`` labelled documents a language (all, if there are
fewer), drawn by the hash of their id, and at most ``most_grams`` n-grams a language; both
bound the model, and prediction reads whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0; letters but no known
n-gram give the commonest learned language with score 0; nothing to learn from gives ``und``
throughout; a null id is never learned from; a row without label is predicted like any other;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.llm.common import per_process

ORDER = 4
CHUNK = 1 << 19
SPACE = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every n-gram, where each text's n-grams begin (one more than texts), texts' letter counts).
    Case is dropped; what stands between letters counts as one space, also before and after."""
    table = per_process("letters", _letters)
    raw = [np.frombuffer(f" {t} ".lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in raw])
    codes = np.concatenate(raw) if raw else np.empty(0, "<u4")
    letter = table[codes]
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (text_of[1:] != text_of[:-1])
    n_letters = np.bincount(text_of[letter], minlength=len(texts))
    codes, text_of = np.where(letter, codes, SPACE)[keep].astype(np.uint64), text_of[keep]
    n = max(0, len(codes) - order + 1)
    h = np.zeros(n, np.uint64)
    for i in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    whole = text_of[:n] == text_of[order - 1:order - 1 + n] if n else np.zeros(0, bool)
    starts = np.searchsorted(text_of[:n][whole], np.arange(len(texts) + 1))
    return h[whole], starts, n_letters


@dataclass
class Filters:
    """Bit-sliced filters: ``table[w]`` holds the bitmasks of the languages 64 w to 64 w + 63."""
    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    reach: np.ndarray
    n_hashes: int

    @classmethod
    def build(cls, langs: list[str], members: list[tuple[int, list[int]]], bits: int, n_hashes: int) -> Filters:
        """members: (gram hash, numbers of the languages that have it)."""
        table = np.zeros((-(-max(len(langs), 1) // 64), 1 << bits), np.uint64)
        own = cls(langs, table, np.zeros(len(langs)), np.ones(len(langs)), n_hashes)
        hashes = np.array([g for g, _ in members], np.int64).view(np.uint64)
        for lang in range(len(langs)):
            has = np.fromiter((lang in m for _, m in members), bool, len(members))
            for at in own.positions(hashes[has]):
                table[lang // 64][at] |= np.uint64(1) << np.uint64(lang % 64)
            filled = (table[lang // 64] >> np.uint64(lang % 64) & np.uint64(1)).mean()
            own.false_rate[lang] = filled ** n_hashes
        return own

    def positions(self, h: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(self.table.shape[1] - 1)
        step = h >> np.uint64(32) | np.uint64(1)
        for i in range(self.n_hashes):
            yield h + np.uint64(i) * step & size

    def counts(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """n-grams of each text that each language's filter holds: texts x languages."""
        out = np.zeros((len(starts) - 1, len(self.langs)))
        places = list(self.positions(h))
        for w, words in enumerate(self.table):
            mask = words[places[0]]
            for at in places[1:]:
                mask &= words[at]
            for lang in range(64 * w, min(64 * w + 64, len(self.langs))):
                run = np.concatenate([[0], np.cumsum(mask >> np.uint64(lang % 64) & np.uint64(1))])
                out[:, lang] = np.diff(run[starts].astype(float))
        return out

    def shares(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Corrected share of each text's n-grams per language, before division by ``reach``."""
        n = np.maximum(np.diff(starts), 1)[:, None]
        return np.maximum(self.counts(h, starts) / n - self.false_rate, 0) / (1 - self.false_rate)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHUNK letters, with the place of their first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield first, texts[first:i + 1]
            first, size = i + 1, 0


def learn(docs: DataFrame, train: Column, sample_docs: int = 2000, most_grams: int = 20_000, least_count: int = 3,
          typical: float = 0.25, bits: int = 18, n_hashes: int = 3, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Filters:
    """Fit on rows where ``train`` holds. A language's filter takes the n-grams that occur ``least_count``
    times in its sample and at least ``typical`` times as often, by share, as in any other language."""
    own = docs.where(train & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Filters.build([], [], bits, n_hashes)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["count"]))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = own.where(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("lang"),
                                                           F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(0).to_numpy()
            for first, texts in _chunks(b.column(1).to_pylist()):
                h, starts, _ = grams(texts)
                of = np.repeat(numbers[first:first + len(texts)], np.diff(starts))
                for lang in np.unique(of):
                    g, n = np.unique(h[of == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), lang), pa.int32()),
                                                      pa.array(g.view(np.int64)), pa.array(n, pa.int64())],
                                                     ["lang", "gram", "n"])

    seen = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang, by_gram = Window.partitionBy("lang"), Window.partitionBy("gram")
    kept = (seen.withColumn("share", F.col("n") / F.sum("n").over(by_lang))
            .withColumn("most", F.max("share").over(by_gram))
            .where((F.col("n") >= least_count) & (F.col("share") >= typical * F.col("most"))))
    rank = F.row_number().over(by_lang.orderBy(F.desc("n"), "gram"))
    rows = kept.withColumn("rank", rank).where(F.col("rank") <= most_grams).select("lang", "gram", "share").collect()
    members: dict[int, list[int]] = {}
    reach = np.zeros(len(langs))
    for r in rows:
        members.setdefault(r["gram"], []).append(r["lang"])
        reach[r["lang"]] += r["share"]
    filters = Filters.build(langs, list(members.items()), bits, n_hashes)
    filters.reach = np.maximum(reach, 1e-9)
    return filters


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text",
            carry: list[str] | None = None) -> DataFrame:
    """(id, *carry, lang_pred, score, coverage): score is the best language's part of all languages'
    values, coverage its corrected share of the text's n-grams, both 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by bits and languages
    carry = carry or []
    names = [f"c{i}" for i in range(len(carry) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        langs = np.array([*own.langs, "und"], object)
        for b in batches:
            found, score, cover = [], [], []
            for _, texts in _chunks([t or "" for t in b.column(len(names)).to_pylist()]):
                h, starts, n_letters = grams(texts)
                if not own.langs:
                    found += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    cover += [0.0] * len(texts)
                    continue
                share = own.shares(h, starts)
                value = share / own.reach
                best = value.argmax(1)
                at = np.arange(len(texts)), best
                some = n_letters > 0
                score += np.where(some, value[at] / np.maximum(value.sum(1), 1e-12), 0).clip(0, 1).tolist()
                cover += np.where(some, share[at], 0).clip(0, 1).tolist()
                found += langs[np.where(some, best, len(own.langs))].tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(found, pa.string()),
                                              pa.array(score, pa.float64()), pa.array(cover, pa.float64())],
                                             [*names, "lang_pred", "score", "coverage"])

    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, [id_col, *carry])], F.col(text_col).alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", lang_pred string, score double, coverage double"
    out = rows.mapInArrow(run, schema)
    return out.toDF(*[id_col, *carry, "lang_pred", "score", "coverage"])


def held_out(id_col: str = "doc_id") -> Column:
    """One fold of five by the id's text; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
