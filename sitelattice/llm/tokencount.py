"""Token counts with a whole-token shortcut.

For a piece vocabulary with scores and byte fallback, a text becomes ``▁`` + text with every
space written ``▁``. No piece holds ``▁`` after another letter (checked when the vocabulary is
loaded), so no merge crosses such a place and the text can be cut before every ``▁`` run.
``whole_tokens`` proves once, by merging each vocabulary string, which of them encode alone as
one token; these segments count one without being merged. The other segments are merged and
remembered per task.

Defined results: a null or empty text has no tokens; a letter outside the vocabulary counts one
token per UTF-8 byte; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.bpe import SYMBOL_BITS, merge_symbols, pair_value
from sitelattice.llm.common import Memo, file_bytes, per_process

SPACE = "▁"
INNER = re.compile(f"[^{SPACE}]{SPACE}")


class Pieces:
    """A piece vocabulary as integer symbols: its strings by symbol and the pair table."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(INNER.search(s) for s in score):
            raise ValueError(f"a piece holds {SPACE} after another letter: texts can't be cut there")
        rank = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.strings = [*score, *sorted({c for s in score for c in s} - set(score))]
        self.symbol = {s: i for i, s in enumerate(self.strings)}
        self.n_pieces = len(score)
        self.pairs = {}
        for s, x in score.items():
            for i in range(1, len(s)):
                a, b = self.symbol.get(s[:i]), self.symbol.get(s[i:])
                if a is not None and b is not None:
                    self.pairs[a << SYMBOL_BITS | b] = pair_value(rank[x], self.symbol[s])

    def count(self, segment: str) -> int:
        """Tokens of a segment by merging its letters, best score first."""
        foreign = len(self.strings)  # stands for any letter that no piece holds
        symbols = [self.symbol.get(c, foreign) for c in segment]
        if foreign in symbols or max(symbols) >= self.n_pieces:
            extra = sum(len(c.encode()) for c in segment if c not in self.symbol)
            left = [s for s in merge_symbols(symbols, self.pairs) if s != foreign]
            return extra + sum(1 if s < self.n_pieces else len(self.strings[s].encode()) for s in left)
        return len(merge_symbols(symbols, self.pairs))

    def whole_tokens(self) -> frozenset[str]:
        """The vocabulary strings that are one token when encoded alone."""
        return frozenset(s for s in self.strings[:self.n_pieces] if self.count(s) == 1)


class Counter:
    """Counts tokens of texts; a segment is named by what follows its first ``▁``."""

    def __init__(self, pieces: Pieces, whole: frozenset[str], memo: int = 1 << 19):
        self.memo = Memo(lambda rest: pieces.count(SPACE + rest), memo)
        self.whole = {s[1:]: 1 for s in whole if s[0] == SPACE}
        self.segments = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] == SPACE or SPACE + SPACE in text:
            parts = self.segments.findall(SPACE + text)
        else:
            parts = text.split(SPACE)
        known = list(map(self.whole.get, parts))
        memo = self.memo
        return sum([memo[p] if k is None else k for p, k in zip(parts, known)])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text."""
    pieces = Pieces(file_bytes(model_path))
    tables = docs.sparkSession.sparkContext.broadcast((pieces, pieces.whole_tokens()))  # bounded by the vocabulary
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("pieces", model_path), lambda: Counter(*tables.value))
        for b in batches:
            counts = pa.array([counter.count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return (rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col))
