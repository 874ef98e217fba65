"""BPE encoding and decoding with a priority queue of merge ranks over a linked symbol list.

``encode_decode`` gives every document's token ids and the text decoded from them, for a
word-level BPE vocabulary (lower-cased words, the last symbol of a word carries ``</w>``).
White space never reaches the merges, so a text is cut at white space and the pieces between
are remembered per task (``Memo``): only pieces not seen lately are merged.

Defined results: a null or empty text has no ids and decodes to the empty text; the strings of
special tokens inside a text become those tokens; repeated rows each give a row; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.common import Memo, file_bytes, per_process

#: The word pattern of the vocabulary file's pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


SYMBOL_BITS = 20


def pair_value(rank: int, symbol: int) -> int:
    """What the pair table holds for a pair: its merge rank and the symbol it becomes."""
    return rank << SYMBOL_BITS | symbol


def merge_symbols(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge adjacent symbols, best rank first and leftmost among equals, until none is left.

    ``pairs`` maps ``a << SYMBOL_BITS | b`` to ``pair_value``. Symbols are linked by two index
    lists. A queue entry is rank and left position in one integer; it is stale when the pair
    that now begins there has another rank or none.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, none = pairs.get, -1
    sym = symbols
    cur = [get(a << SYMBOL_BITS | b, none) for a, b in zip(sym, sym[1:])] + [none]
    queue = [v >> SYMBOL_BITS << 32 | i for i, v in enumerate(cur) if v >= 0]
    if not queue:
        return symbols
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFF
        v = cur[i]
        if v >> SYMBOL_BITS != entry >> 32:
            continue
        new = sym[i] = v & (1 << SYMBOL_BITS) - 1
        j = nxt[i]
        sym[j] = cur[j] = none
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
            v = cur[i] = get(new << SYMBOL_BITS | sym[k], none)
            if v >= 0:
                push(queue, v >> SYMBOL_BITS << 32 | i)
        else:
            cur[i] = none
        h = prev[i]
        if h >= 0:
            v = cur[h] = get(sym[h] << SYMBOL_BITS | new, none)
            if v >= 0:
                push(queue, v >> SYMBOL_BITS << 32 | h)
    return [s for s in sym if s >= 0]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others count up from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-level BPE vocabulary file (JSON, as bytes)."""

    def __init__(self, data: bytes, memo: int = 1 << 19):
        spec = json.loads(data)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        ids = self.vocab
        self.pairs = {ids[a] << SYMBOL_BITS | ids[b]: pair_value(r, ids[a + b])
                      for r, (a, b) in enumerate(model["merges"])}
        by_id = sorted((i, s.encode()) for s, i in [*self.vocab.items(), *self.special.items()])
        self.strings = [s for _, s in by_id]
        if by_id[-1][0] != len(by_id) - 1:
            raise ValueError("the vocabulary's ids have gaps")
        self.first = [ids[c] for c in self.letters]
        self.last = [ids[c + self.suffix] for c in self.letters]
        self.words = regex.compile(WORDS)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(r"\p{White_Space}+")
        self.word_memo = Memo(self._word, memo)
        self.memo = Memo(self._piece, memo)

    def _word(self, word: str) -> bytes:
        letters = word.encode()
        symbols = [self.first[b] for b in letters]
        symbols[-1] = self.last[letters[-1]]
        return array("I", merge_symbols(symbols, self.pairs)).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.words.findall(piece)
        return self._word(piece) if found == [piece] else b"".join([self.word_memo[w] for w in found])

    def _pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()  # no final-sigma rule
        return self.space.split(text) if self.odd.search(text) else text.split()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers (little-endian machines, as Arrow assumes too)."""
        memo = self.memo
        if "<|" not in text:
            return b"".join([memo[p] for p in self._pieces(text)])
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += [memo[p] for p in self._pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the vocabulary strings joined by one space, special tokens included."""
        i = array("I", ids)
        return b" ".join(itemgetter(*i)(self.strings) if len(i) > 1 else [self.strings[x] for x in i])


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; with ``keep`` also ``ids`` (binary,
    little-endian unsigned 32-bit) and ``decoded`` (text)."""
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_process(("word_bpe", vocabulary), lambda: WordBpe(data.value))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append(row + ((ids, decoded.decode()) if keep else ()))
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if keep else [])
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids binary, decoded string" if keep else "")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
