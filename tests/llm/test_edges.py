"""Nulls, ties, repeated rows, long values and frequent keys of the operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastra.llm import differencing, langid, order_minhash, queries, raking, url_rules


# ---- op8


def test_languages_that_cannot_be_told_apart(spark):
    rows = [(k, "one and the same text", "en" if k % 2 else "fr") for k in range(60)]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    out = langid.predict(df, model).collect()
    assert len(out) == 120 and len({(r["lang_pred"], r["score"]) for r in out}) == 1  # equal texts, repeated rows: one answer
    assert 0 <= out[0]["score"] <= 1 and out[0]["lang_pred"] in ("en", "fr")


def test_ties_go_to_the_first_language():
    model = langid.Model(["de", "en"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    assert model.predict(["any text"])[0][:2] == ("de", 0.5)


def test_every_language_is_learnt_however_many(spark):
    rows = [(k, f"text of {k % 40}", f"l{k % 40:02d}") for k in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20)
    assert len(model.langs) == 40  # more than max_rows: one row of each
    same_id = spark.createDataFrame([(7, "wort", "de")] * 500 + [(8, "word", "en")], "doc_id long, text string, lang string")
    assert langid.fit(same_id).langs == ["de", "en"]


def test_sample_is_bounded_in_bytes(spark):
    rows = [(k, "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(3000)), "en" if k % 2 else "fr") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, max_bytes=1).langs == ["en", "fr"]


# ---- op9


def closed_rules(rows, min_support, min_confidence):
    """Best confidence of each antecedent by brute force over all sets of tokens."""
    n, blocked = len(rows), sum(b for _, b in rows)
    out = {}
    tokens = sorted({t for r, _ in rows for t in r})
    for size in range(1, len(tokens) + 1):
        for some in itertools.combinations(tokens, size):
            have = [b for r, b in rows if set(some) <= set(r)]
            both = sum(have)
            if both >= min_support * n and both / len(have) >= min_confidence and both / len(have) > blocked / n:
                out[some] = both / len(have)
    return out


def test_mined_rules_against_all_sets(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        some = [t for t in "abcdef" if rng.random() < 0.4]
        some += ["x", "y", "z"] if "a" in some else []  # these always occur together with a
        rows.append((sorted(some), ("a" in some and "b" in some and rng.random() < 0.9) or rng.random() < 0.1))
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    mined = {tuple(sorted(r["antecedent"])): r["confidence"] for r in url_rules.mine(df, min_support=0.02, min_confidence=0.6).collect()}
    some = [(r, b) for r, b in rows if r]
    want = closed_rules([([t for t in r if t not in "xyz"], b) for r, b in some], 0.02, 0.6)
    assert set(mined) == set(want) and all(mined[k] == pytest.approx(want[k]) for k in want)
    assert len(mined) > 3 and not any({"x", "y", "z"} & set(k) for k in mined)


def test_tokens_that_always_occur_together_do_not_explode(spark):
    many = "/".join(f"part{chr(97 + k)}" for k in range(26))
    urls = spark.createDataFrame([(f"http://h.org/{many}/{k}", True) for k in range(50)] + [(f"http://h.org/fine/{k}", False) for k in range(50)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, f"http://z.org/{many}"), (1, f"http://z.org/{many}"), (2, "http://h.org/fine"), (3, "http://z.org/" + "long/" * 20_000), (4, None)], "page_id long, url string")
    out = sorted((r["page_id"], r["verdict"]) for r in url_rules.judge(pages, urls, queries.URL_RULES).collect())
    assert out == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "allow")]


def test_a_frequent_token_set(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://a.org/bad/1").otherwise(F.concat(F.lit("http://b.org/p"), F.col("id").cast("string"), F.lit("x/"))).alias("url"))
    labels = spark.createDataFrame([("http://a.org/bad/7", True)] * 5 + [("http://b.org/fine", False)] * 5, "url string, blocked boolean")
    out = url_rules.judge(pages, labels, [])
    assert out.count() == 3000 and {r["page_id"] for r in out.where("verdict = 'block'").collect()} == set(range(0, 3000, 3))


# ---- op4, op5, op7


def test_a_text_that_a_third_of_all_rows_hold(spark):
    rows = [(k if k % 5 else None, "common" if k % 3 == 0 else None if k % 3 == 1 else f"text {k}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    out = differencing.shard_documents(df, 6).collect()
    assert len(out) == 900 and all(r["size"] == len(r["text"] or "") + 8 for r in out)
    groups = {}
    for r in out:
        groups.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    for s in range(6):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_copies_and_rows_without_id(spark):
    same = "one text that many rows hold and it has ten words"
    rows = [(k, same) for k in range(500)] + [(None, same), (None, None), (600, None), (601, ""), (602, ""), (603, "..."), (604, same + " more")]
    out = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert len(out) == len(rows) and sum(r["doc_id"] is None and r["class_id"] is None and r["kept"] is None for r in out) == 2
    assert all(got[k] == (0, k == 0) for k in range(500)) and got[604] == (0, False)
    assert got[600] == (600, True) and got[601] == (601, True) and got[602] == (601, False) and got[603] == (603, True)


def test_short_texts_at_the_threshold_are_found(spark):
    rng = random.Random(6)
    rows, pairs = [], []
    for k in range(300):
        n = rng.choice([9, 9, 13])  # 5 or 9 shingles; one word less is one shingle less
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-1]))]
        pairs.append(2 * k)
    out = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[k + 1] == k for k in pairs) >= 299


def test_mix_of_rows_without_id(spark):
    rows = [(None, f"some words of text number {k}", "en", "a") for k in range(400)]
    out = raking.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rate=0.25).collect()
    assert 60 <= sum(r["sampled"] for r in out) <= 140
