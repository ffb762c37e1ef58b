"""Each operator against brute force, a round trip or planted cases, with nulls, ties, repeats and empty tables."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastra.llm import balltree, components, differencing, langid, lattice, order_minhash, packing, queries, raking, repair, storage, tokens, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}x" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], DOCS)
    return df.withColumns({"id": F.lit("x"), "size": F.lit("y"), "bucket": F.lit(1), "topic": F.lit("z"), "score": F.lit(0)}) if clash else df


def hard(rng):
    """Nulls, empty and long texts, ties, repeated rows."""
    long = prose(rng, 9000)
    return [(0, None, "en", "a"), (1, "", None, None), (2, long, "en", "a"), (3, "same text here", "fr", "b"), (4, "same text here", "fr", "b"), (5, "x", "de", "a"), (5, "x", "de", "a"), (None, "no id", "en", "a"), (6, "été ß 123 !!", "fr", None), (7, None, None, None)]


# ---- vectors


def vectors(spark, rng, n=260, dim=32):
    base = rng.normal(size=(20, dim))
    rows = []
    for k in range(n):
        v = base[k % 20] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3)))
    rows[7] = (7, rows[5][1], rows[5][2])  # equal vectors
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * (dim - 1), 0), (n + 5, [], 0), (3, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))


def test_lattice_against_all_pairs(spark):
    rows, df = vectors(spark, np.random.default_rng(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df, 0.98).collect()}
    able = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links, up = dict.fromkeys(able, 0), {i: i for i in got}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    total = 0
    for a, b in itertools.combinations(able, 2):
        (x, p), (y, q) = able[a], able[b]
        if p == q and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links[a] += 1
            links[b] += 1
            total += 1
            r, s = root(a), root(b)
            up[max(r, s)] = min(r, s)
    found = sum(n for n, _, _ in got.values()) / 2
    assert found >= 0.9 * total > 0
    assert all(got[i][0] <= links.get(i, 0) for i in got)  # no link below the threshold
    assert sum(got[i][1] == root(i) for i in got) >= 0.9 * len(got)
    assert all(c == (i == k) for i, (_, k, c) in got.items()) and len(got) == 266
    assert lattice.near_duplicates(df.limit(0), 0.98).count() == 0


def test_e8_decoder_finds_nearest_points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    found = lattice.decode(x)
    whole = np.isclose(found, np.rint(found)).all(1)
    assert (np.isclose(found.sum(1) % 2, 0)).all() and (whole | np.isclose(found - 0.5, np.rint(found - 0.5)).all(1)).all()
    near = found[:, None, :] + lattice.ROOTS[None]
    assert (((x - found) ** 2).sum(1)[:, None] <= ((x[:, None] - near) ** 2).sum(2) + 1e-9).all()


def test_balltree_against_brute_force(spark):
    rows, df = vectors(spark, np.random.default_rng(2))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in balltree.top_k(df, 5, 50, shard_rows=40).collect())
    ints = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in ints if i % 50 == 0):
        best = sorted((-(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert balltree.top_k(df.limit(0)).count() == 0


# ---- documents


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(300, 300)]
    storage.shared_dir(spark)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)}


def brute_similarity(a, b):
    """Longest chain of equal labelled shingles over all of them, by dynamic programming."""

    def labelled(text):
        words = [w for w in text.lower().split()]
        seen, out = {}, []
        for k in range(max(1, len(words) - 4)):
            s = tuple(words[k : k + 5])
            seen[s] = seen.get(s, 0) + 1
            out.append((s, seen[s]))
        return out

    x, y = labelled(a), labelled(b)
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for k, q in enumerate(y):
            new.append(row[k] + 1 if p == q else max(row[k + 1], new[k]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def test_order_minhash_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        words = prose(rng, 120).split()
        rows.append((10 * k, " ".join(words)))
        for j, changes in enumerate((1, 2, 3, 6)):
            w = list(words)
            for p in rng.sample(range(len(w)), changes):
                w[p] = rng.choice(WORDS)
            rows.append((10 * k + j + 1, " ".join(w)))
    rows.append((500, " ".join(rows[0][1].split()[60:] + rows[0][1].split()[:60])))  # the same shingles in another order
    full = [(i, t, "en", "a") for i, t in rows] + [(600, None, "en", "a"), (601, "", "en", "a"), (602, "", "en", "a"), (603, None, None, None), (604, "!!", "en", "a"), (605, rows[0][1].upper(), "en", "a"), (None, "x", "en", "a")]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs(spark, full), 0.8).collect()}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if (i // 10 == j // 10 or 500 in (i, j)) and brute_similarity(a, b) >= 0.8:
            r, s = root(i), root(j)
            up[max(r, s)] = min(r, s)
    assert {i: got[i] for i, _ in rows} == {i: root(i) for i, _ in rows}
    assert (got[600], got[601], got[602], got[603], got[604], got[605], got[None]) == (600, 601, 601, 603, 604, 0, None)
    assert order_minhash.near_duplicates(docs(spark, full).limit(0)).count() == 0


def test_differencing(spark):
    rng = random.Random(6)
    rows = hard(rng) + [(100 + k, prose(rng, rng.randrange(1, 300)), "en", "a") for k in range(150)]
    out = differencing.shard_documents(docs(spark, rows), 6, bucket_groups=30, fan_in=2).collect()
    assert len(out) == len(rows) and {"id", "bucket"} <= set(out[0].asDict())
    place, loads, slots = {}, [0] * 6, [[] for _ in range(6)]
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        place.setdefault(r["text"], set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    rest = sorted(loads)[:-1]  # the long text has a shard of its own
    assert max(rest) - min(rest) <= 0.02 * max(rest)
    assert differencing.difference([[(s, k)] for k, s in enumerate([8, 7, 6, 5, 4])], 2)[0][0] == 16
    assert differencing.shard_documents(docs(spark, rows).limit(0), 6).count() == 0


PLAIN = Tokenizer.from_file(tokens.default_path())


def ids_of(text, end):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(7)
    rows = hard(rng) + [(100 + k, " ".join([prose(rng, 6)] * 30), "en", "a") for k in range(40)]
    df = docs(spark, rows)
    uri = f"file://{tmp_path}/t"
    catalog = storage.written(repair.write_shards(df, tokens.default_path(), uri, shard_ids=4000), "t")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in repair.read_shards(spark, uri, catalog).collect()))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t, *_ in order:
        x = ids_of(t, 1)
        want.append((start, i, len(x), x.tobytes()))
        start += len(x)
    assert got == want
    shard = repair.Shard(next((tmp_path / "t").glob("*.rpg")).read_bytes())
    whole = shard.all_ids()
    for k in range(shard.docs):  # random access gives the same ids as the whole
        a = int(shard.start[k])
        assert np.array_equal(shard.ids(k), whole[a : a + len(shard.ids(k))])
    assert any(len(repair.Shard(p.read_bytes()).rules) for p in (tmp_path / "t").glob("*.rpg"))
    with pytest.raises(ValueError):
        repair.Shard(b"x" * 100)
    empty = repair.write_shards(df.limit(0), tokens.default_path(), f"file://{tmp_path}/e")
    assert repair.read_shards(spark, f"file://{tmp_path}/e", empty).count() == 0


def test_repair_keeps_documents_apart():
    ids = np.array([5, 6] * 40, np.uint32)
    symbols, ends, rules = repair.compress(ids, np.arange(1, 81), terminals=100)
    assert len(symbols) == 80 and not len(rules)
    symbols, ends, rules = repair.compress(ids, np.array([80]), terminals=100)
    flat, places, sizes = repair.expansions(rules, 100)
    assert len(symbols) < 40 and np.array_equal(repair.expand(symbols, flat, places, sizes, 100), ids)


def test_packing_against_one_stream(spark):
    rng = random.Random(8)
    rows = hard(rng) + [(100 + k, prose(rng, 40), "en", "a") for k in range(60)]
    out = packing.pack(docs(spark, rows).repartition(3), tokens.default_path(), window=256).collect()
    by = {}
    for r in out:
        by.setdefault((r["doc_id"]), []).append(r)
        assert 0 < r["length"] <= 256 and r["length"] == len(r["ids"]) // 4
    for i, t, *_ in rows:
        x = ids_of(t, 2)
        pieces = sorted(by[i], key=lambda r: (r["sequence_id"], r["offset"]))
        copies = sum(1 for y in rows if y[0] == i)
        assert b"".join(bytes(r["ids"]) for r in pieces) == copies * x.tobytes()
        assert all(r["doc_tokens"] == len(x) and bytes(r["ids"]) == x[r["start"] : r["start"] + r["length"]].tobytes() for r in pieces)
    fill = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill) == list(range(len(fill))) and all(fill[k] == 256 for k in range(len(fill) - 1))
    assert packing.pack(docs(spark, rows).limit(0), tokens.default_path()).count() == 0
    assert packing.digest(packing.pack(docs(spark, rows), tokens.default_path())).where("doc_id = 0").first()["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())


def test_raking_meets_the_targets(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randrange(1, 60)) + rng.choice(["", " | x", " @"]), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(500)] + hard(rng)
    df = docs(spark, rows)
    out = raking.mix(df).collect()
    assert len(out) == len(rows) and {"id", "bucket", "size"} <= set(out[0].asDict())
    assert all(0 <= r["probability"] <= 1 for r in out) and 0 < sum(r["sampled"] for r in out) < len(out)
    for dim in raking.DIMENSIONS:
        was, now = {}, {}
        for r in out:
            was[r[dim]] = was.get(r[dim], 0) + r["tokens"]
            now[r[dim]] = now.get(r[dim], 0) + r["tokens"] * r["probability"]
        power = {k: v**0.7 for k, v in was.items() if v}
        for k, v in power.items():
            assert now[k] / sum(now.values()) == pytest.approx(v / sum(power.values()), rel=0.05)
    assert raking.mix(df.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(10)
    letters = {"en": "the and of ing tion", "fr": "les eux été que è", "de": "sch ung ß ver ö"}
    rows = [(k, " ".join("".join(rng.choices(letters[x].split(), k=3)) for _ in range(30)), x, "s") for k, x in enumerate(rng.choices(list(letters), k=400))]
    df = docs(spark, rows + [(900, None, "en", "s"), (901, "12 34", "en", "s"), (902, "", None, "s"), (None, "the", "en", "s")])
    model = langid.fit(df.where(langid.fold() != 2))
    out = langid.predict(df.select("doc_id", "text", "lang", "bucket"), model).withColumn("held", langid.fold() == 2).collect()
    held = [r for r in out if r["held"] and r["doc_id"] < 900]
    assert len(out) == 404 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in out if (r["doc_id"] or 0) >= 900} == {("und", 0.0, True)}
    assert all(0 <= r["score"] <= 1 for r in out) and not any(r["rejected"] for r in held)
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    long = rows[0][1] * 40_000  # longer than a piece
    assert model.predict([long])[0][0] == model.predict([rows[0][1]])[0][0]


# ---- pages


def test_url_rules_and_mined_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://x.net/es/1", "http://net/fr", "ftp://com", "no url", None, "http://other.org/spam/ads/1", "http://other.org/good/1", "x://y://z/a?b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("token", F.lit(1))
    labelled = spark.createDataFrame([(f"http://s{k % 5}.org/{'spam/ads' if k % 2 else 'good'}/{k}", k % 2 == 1) for k in range(100)], "url string, blocked boolean")
    out = {r["page_id"]: r for r in url_rules.judge(pages, labelled, queries.URL_RULES).collect()}
    assert [(out[k]["host"], out[k]["path"], out[k]["rule"], out[k]["verdict"]) for k in range(10)] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("net", "/fr", None, "allow"),
        ("com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("other.org", "/spam/ads/1", None, "block"), ("other.org", "/good/1", None, "allow"), ("y:", "//z/a", None, "allow")]
    assert url_rules.judge(pages, labelled.limit(0), queries.URL_RULES).where("rule is null and verdict = 'block'").count() == 0
    assert url_rules.judge(pages.limit(0), labelled, queries.URL_RULES).count() == 0


def test_warc_records(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One</p><!-- no --><p>Two&nbsp;3</p></body></html>"
    rows = [(1, "http://x/", page), (2, None, None), (3, "http://y/", ""), (3, "http://y/", ""), (4, "u", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1))
    out = warc.derivatives(df)
    got = out.collect()
    assert len(got) == 2 * len(rows)
    text, meta = (next(r for r in got if r["page_id"] == 1 and r["record_type"] == k) for k in ("conversion", "metadata"))
    assert text["block"] == "A & B\nOne\nTwo 3" and text["refers_to"] == meta["refers_to"] and text["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] == text["record_id"]
    assert text["source_digest"] == warc.digest(page.encode()) and "title: A & B" in meta["block"] and text["block_digest"] == warc.digest(text["block"].encode())
    files = warc.write_warc(out, f"file://{tmp_path}/w").collect()
    parsed = [x for f in files for x in warc.parse((tmp_path / "w" / f["file"]).read_bytes())]
    assert sorted(h["WARC-Record-ID"] for h, _ in parsed) == sorted(r["record_id"] for r in got)
    blocks = {h["WARC-Record-ID"]: b for h, b in parsed}
    assert all(blocks[r["record_id"]] == r["block"].encode() for r in got)
    assert warc.derivatives(df.limit(0)).count() == 0


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    base = [(k, prose(rng, rng.randrange(20, 80)), rng.choice(["en", "fr"]), rng.choice("ab")) for k in range(80)]
    rows = base + [(200 + k, base[k][1], "en", "a") for k in range(10)] + [(300, None, "en", "a"), (301, "12 34", "en", "a"), (3, base[3][1], "en", "a")]
    docs(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "mixing", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = cp.language_id(spark, now, str(tmp_path))
    assert {r[0] for r in kept.select("doc_id").collect()}.isdisjoint({300, 301}) and kept.columns == cp.COLUMNS
    once = cp.near_dedup(spark, kept, str(tmp_path))
    ids = sorted(r[0] for r in once.select("doc_id").collect())
    assert ids == list(range(80))
    mixed = cp.mixing(spark, once, str(tmp_path))
    assert mixed.columns == cp.COLUMNS and 0 < mixed.count() <= 80
    packed = {r["doc_id"]: r["doc_tokens"] for r in cp.packing_stage(spark, mixed, str(tmp_path)).collect()}
    assert packed == {r["doc_id"]: len(ids_of(r["text"], 2)) for r in mixed.collect()}
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()} == set(packed)
