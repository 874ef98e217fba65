"""Archives read back as written, and the merged index in order."""

import gzip
import hashlib
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sitelattice.llm import warc

BIG = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 200
ROWS = [(1, "http://www.B.example/x", BIG, "e1"), (2, "https://a.example:80/y?q=1#f", BIG, None), (3, None, BIG, "z"),
        (4, "http://a.example/y?q=1", "short", None), (5, "http://a.example/\r\ninjected: 1", "short", None),
        (6, "http://c.example", None, None), (7, "", "", None), (None, "http://n.example/", BIG, None),
        (8, "http://a.example/dup", "w" * 1000, None), (8, "http://a.example/dup", "w" * 1000, None),
        (9, "http://a.example/long", "wörd " * 300_000, None), (10, None, None, None)]


def seconds():
    return F.lit(1704067200) + F.coalesce("page_id", F.lit(0))


@pytest.fixture(scope="module")
def captures(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").repartition(4)
    return warc.capture_index(pages, seconds())


def test_rows(captures):
    bodies = {}
    for i, _, b, _ in ROWS:
        if len((b or "").encode()) >= 1000:
            bodies[b] = max(bodies.get(b, -1), -1 if i is None else i)
    want = []
    for i, u, b, _ in ROWS:
        data = (b or "").encode()
        to = bodies.get(b)
        again = to is not None and to != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    got = captures.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_global_order(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    runs = pages.select(F.spark_partition_id().cast("string").alias("run"), "page_id", "url")
    rows = [(str(random.Random(r.page_id).randint(0, 6)), warc.url_key(r.url), f"2024-{r.page_id % 3}", r.page_id)
            for r in runs.collect()] + [("0", "hot", "2024", i) for i in range(60)]
    rows.sort(key=lambda r: (r[0], *r[1:]))
    at, table = {}, []
    for run, key, t, i in rows:
        at[run] = at.get(run, -1) + 1
        table.append((run, at[run], key, t, i, None, "response", "d", 1, None))
    out = warc.merge_runs(spark.createDataFrame(table, warc.RUN_SCHEMA), range_rows=20).orderBy("capture_no").collect()
    assert [(r.url_key, r.at, r.id) for r in out] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.randint(0, 20) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_are_valid_files(spark):
    path = tempfile.mkdtemp() + "/warc"
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, x string")
    warc.write_archives(pages.coalesce(1), path, seconds())
    (row,) = spark.read.format("binaryFile").load(path).select("content").collect()
    data = bytes(row.content)
    found = list(warc.records(data))
    assert len(found) == len(ROWS)
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert all("injected" not in h for h, _ in found)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_index(pages, seconds()).count() == 0
