"""WARC archives of captures and their globally ordered index.

``write_archives`` writes one record per capture. Spark's text sink writes the files: a record is
one text value and the blank lines that end a WARC record are the line separator, so any file
system that Spark writes to will do. Of captures with equal payloads of at least ``least`` bytes the
one with the largest id is a response, the others are revisits of it; smaller ones are all responses.

``read_runs`` parses the archives again. Each archive gives one capture run, sorted by URL key,
time and id. ``merge_runs`` deals the runs' rows to ranges of that key (a URL with very many
captures is split by time and id) and merges the runs of a range with a loser tree, which gives
the captures in one global order: ``capture_no`` rises with (URL key, time, id).

Defined results: a null page is an empty payload; a null URL is written without target and sorts
first; a null id is written as such, is never the response that others refer to, and is a response
itself where no other copy has an id; a repeated row (same id and payload) gives a record each, all
of the same type; line breaks in a URL become spaces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelattice.llm.common import ensure_checkpoint_dir, materialise

END = "\r\n"
RECORD_END = END + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, seconds: Column, id_col: str = "page_id", url_col: str = "url",
                   body_col: str = "html", least: int = 1000) -> None:
    """Write a record per row to gzipped archives under ``path``; ``seconds`` is the capture time."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), seconds.alias("at"),
                       F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    own = own.withColumn("size", F.octet_length("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    response = own.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("response"))
    # a left join, so that Spark can split the side of the captures where one payload is very frequent
    both = own.join(response, ["digest", "size"], "left")
    again = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("size").cast("string"), F.lit(RECORD_END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit(END))
    record = F.concat(
        F.lit("WARC/1.1" + END), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.timestamp_seconds("at"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("response")))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)
    (both.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", 20_000).text(path))


def _head(data: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in data.decode().split(END)[1:] if ": " in x)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a gzipped archive; inflates as it goes."""
    inflate, held, gap = zlib.decompressobj(31), bytearray(), (RECORD_END).encode()
    at, step = 0, 1 << 18

    def more() -> bool:
        nonlocal at, inflate
        if at >= len(data):
            return False
        held.extend(inflate.decompress(data[at:at + step]))
        at += step
        while inflate.eof and inflate.unused_data:  # archives with a gzip member per record
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            held.extend(inflate.decompress(rest))
        return True

    begin = 0
    while True:
        while (cut := held.find(gap, begin)) < 0:
            if not more():
                if held[begin:].strip():
                    raise ValueError("the archive ends within a header")
                return
        head = _head(bytes(held[begin:cut]))
        start = cut + len(gap)
        end = start + int(head["Content-Length"])
        while len(held) < end + len(gap):
            if not more():
                break
        if held[end:end + len(gap)] != gap:
            raise ValueError("a record's length does not match its block")
        yield head, bytes(held[start:end])
        begin = end + len(gap)
        if begin > 1 << 20:
            del held[:begin]
            begin = 0


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, lower case, then path and query."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").strip(), re.I)
    return ",".join(reversed(m[1].lower().removeprefix("www.").split("."))) + ")" + (m[2] or "/") if url else ""


RUN_SCHEMA = ("run string, pos long, url_key string, at string, id long, url string, record_type string, "
              "payload_digest string, payload_bytes long, refers_to long")


def _id(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def _capture(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(RECORD_END.encode())
    kind, size = head["WARC-Type"], int(_head(http)["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its record")
    url = head.get("WARC-Target-URI")
    return (url_key(url), head["WARC-Date"], _id(head["WARC-Record-ID"]), url, kind, digest, size,
            _id(head.get("WARC-Refers-To")))


def _order(row: tuple) -> tuple:
    """URL key, time, id; a row without id comes first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures: a sorted run per archive, rows numbered within their run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = sorted((_capture(*r) for r in records(data.as_py())), key=_order)
                if found:
                    cols = [[name] * len(found), list(range(len(found))), *zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    s, n = pa.string(), pa.int64()
    kinds = [s, n, s, s, n, s, s, s, n, n]
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RUN_SCHEMA)


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, so that taking the
    least row replays one path from leaf to root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        k = self.k = len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            i = self.at[w]
            yield self.runs[w][i]
            self.at[w] = i = i + 1
            self.heads[w] = self.key(self.runs[w][i]) if i < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame, range_rows: int = 20_000) -> DataFrame:
    """All captures with ``capture_no``, which rises with (url_key, at, id) over the whole table.
    ``range_rows`` is the aimed size of a key range, which one task merges."""
    n = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(n, "url_key", "at", F.col("id").asc_nulls_first(), "run", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list] = {}
        names, schema = None, None
        for b in batches:
            names, schema = b.schema.names, b.schema
            cols = [c.to_pylist() for c in b.columns]
            for r in zip(*cols):
                by_run.setdefault(r[0], []).append(r[2:])  # rows of a run arrive in its order
        if not by_run:
            return
        first, out = TaskContext.get().partitionId() << 33, []
        for i, r in enumerate(LoserTree(list(by_run.values()), _order)):
            out.append((first + i, *r))
            if len(out) == 10_000:
                yield batch(out, names, schema)
                out = []
        if out:
            yield batch(out, names, schema)

    def batch(rows: list, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [pa.int64()] + [schema.field(n).type for n in names[2:]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          ["capture_no", *names[2:]])

    return (dealt.sortWithinPartitions("run", "pos")
            .mapInArrow(run, "capture_no long, " + RUN_SCHEMA.split(", ", 2)[2]))


def capture_index(pages: DataFrame, seconds: Column, path: str | None = None, **columns) -> DataFrame:
    """Write archives (under the shared folder unless ``path`` says otherwise), read them back, merge."""
    spark = pages.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path, seconds, **columns)
    return merge_runs(materialise(read_runs(spark, path)))
