"""Language identification: held-out accuracy, filter algebra and corner cases."""

import numpy as np
from pyspark.sql import functions as F

from sitelattice.llm import langid


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = langid.predict(docs, langid.learn(docs, ~langid.held_out()), carry=["lang"])
    rows = found.where(langid.held_out()).collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in rows)


def test_grams_do_not_cross_texts():
    h, starts, letters = langid.grams(["ab, cd", "", "12", "ab CD", "x"])
    spans = [h[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert spans[0] == spans[3] and len(spans[0]) == len(" ab cd ") - langid.ORDER + 1
    assert spans[1] == spans[2] == spans[4] == [] and letters.tolist() == [4, 0, 0, 4, 1]
    one, _, _ = langid.grams(["ab cd"])
    assert one.tolist() == spans[0]


def test_filters_hold_their_members_in_every_slice():
    langs = [f"l{i}" for i in range(130)]
    rnd = np.random.default_rng(1)
    members = [(int(g), sorted(set(rnd.integers(0, 130, 3).tolist()))) for g in rnd.integers(-2**60, 2**60, 400)]
    f = langid.Filters.build(langs, members, 12, 3)
    h = np.array([g for g, _ in members], np.int64).view(np.uint64)
    counts = f.counts(h, np.arange(len(h) + 1))
    assert counts.shape == (400, 130)
    for row, (_, m) in zip(counts, members):
        assert all(row[lang] == 1 for lang in m)
    other = rnd.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(3)
    rate = f.counts(other, np.array([0, len(other)]))[0] / len(other)
    assert np.abs(rate - f.false_rate).max() < 0.005


def test_corners(spark):
    train = [(i, "the cat and the hat of that man " * 5, "en", "x", 1.0) for i in range(40)]
    train += [(100 + i, "der hund und die katze von dem mann " * 5, "de", None, None) for i in range(40)]
    odd = [(900, None, "en", "x", 0.5), (901, "", None, None, None), (902, "123 !?", None, None, None),
           (903, "中文中文中文", None, None, None), (None, "the cat and the hat", "fr", None, None),
           (904, "der hund und die katze", None, "s", 1.0), (904, "der hund und die katze", None, "s", 1.0),
           (905, "THE HAT OF THAT MAN " * 20_000, None, None, None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, c0 string, score double")
    filters = langid.learn(docs, ~langid.held_out())
    assert sorted(filters.langs) == ["de", "en"]
    got = {}
    for r in langid.predict(docs.where("doc_id >= 900 or doc_id is null"), filters, carry=["c0"]).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[900] == got[901] == got[902] == [("und", 0.0)]
    assert got[903][0][1] == 0.0 and got[903][0][0] in ("de", "en")
    assert [x[0] for x in got[904]] == ["de", "de"] and got[905][0][0] == "en" and got[None][0][0] == "en"
    empty = docs.limit(0)
    assert langid.predict(empty, langid.learn(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(empty, F.lit(True))).collect()} == {"und"}
