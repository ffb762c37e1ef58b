"""The pipeline's stages, and run() against brute force."""

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from rastra.llm import tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_judges_each_text(spark, tmp_path):
    rng = random.Random(31)

    def prose(n=120):
        return [f"w{rng.randrange(400)}x" for _ in range(n)]

    a, b, c, d, e = (prose() for _ in range(5))
    near = [*a[:-1], "changed"]  # 115 of 117 shingles shared
    a, b, c, d, e, near = map(" ".join, (a, b, c, d, e, near))
    rows = [
        (1, a, "en", "s", 0), (1, a, "fr", "s", 0), (1, b, "en", "s", 0),  # one id, two texts, one row repeated
        (2, near, "en", "s", 0), (3, b, "en", "s", 0),  # near copy and copy of either
        (4, c, "en", "s", 0), (None, c, "en", "s", 0), (None, d, "en", "s", 0), (None, d, "en", "s", 0), (None, e, "en", "s", 0),
        (5, None, "en", "s", 0), (5, None, "en", "s", 0), (None, None, "en", "s", 0),
    ]
    got = [tuple(r) for r in cp.near_dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()]
    want = [rows[0], rows[2], rows[5], rows[7], rows[9], rows[10], rows[12]]
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert cp.near_dedup(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0


# ---- the whole of run() against brute force


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingled(text):
    """Occurrence-labelled shingles of five words, in order."""
    w, seen, out = words(text), {}, []
    for k in range(max(1, len(w) - 4)):
        s = tuple(w[k : k + 5])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def alike(a, b):
    """Longest common subsequence of shingles over the union."""
    at = {s: k for k, s in enumerate(b)}
    tails = []
    for x in (at[s] for s in a if s in at):
        k = bisect.bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) / (len(a) + len(b) - len(tails))


def one_of_each(rows):
    """The smallest doc_id of each class of texts."""
    made = [(r[0], shingled(r[1])) for r in rows]
    up = {i: i for i, _ in made}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(made):
        for j, b in made[:k]:
            if alike(a, b) >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [r for r in rows if root(r[0]) == r[0]]


def topic(text):
    return "table" if " | " in text else "licence" if "icense" in text or "opyright" in text else "contact" if "@" in text else "prose"


def mixed(rows, rate=0.25, power=0.7):
    """Iterative proportional fitting over a table of cells, the scale by bisection, the draw by a hash of doc_id."""
    cell_of = {r[0]: (r[3], r[2], topic(r[1])) for r in rows}
    tokens = {}
    for r in rows:
        tokens[cell_of[r[0]]] = tokens.get(cell_of[r[0]], 0) + len(r[1].split())
    weight = {c: float(n) for c, n in tokens.items()}
    for _ in range(200):
        for d in range(3):
            have, want = {}, {}
            for c, n in tokens.items():
                want[c[d]] = want.get(c[d], 0) + n
                have[c[d]] = have.get(c[d], 0) + weight[c]
            total = sum(n**power for n in want.values())
            weight = {c: w * want[c[d]] ** power / total / have[c[d]] for c, w in weight.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        kept = sum(min(n, weight[c] * mid) for c, n in tokens.items())
        lo, hi = (mid, hi) if kept < rate * sum(tokens.values()) else (lo, mid)
    chance = {c: min(1.0, weight[c] * lo / n) for c, n in tokens.items()}
    draw = lambda i: int(hashlib.md5(f"{i}|7".encode()).hexdigest()[:13], 16) / 16**13
    sure = [r for r in rows if draw(r[0]) < chance[cell_of[r[0]]] - 1e-3]
    maybe = [r for r in rows if draw(r[0]) < chance[cell_of[r[0]]] + 1e-3]
    return sure, maybe


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(41)
    letters = {"en": "the and of ing tion st", "fr": "les eux ité que è où", "de": "sch ung ß ver ö ck"}

    def prose(lang, n):
        return " ".join("".join(rng.choices(letters[lang].split(), k=3)) for _ in range(n))

    rows = []
    for k in range(240):
        lang = rng.choice(["en", "en", "fr", "de"])
        rows.append((k, prose(lang, rng.randrange(12, 120)) + rng.choice(["", "", " a | b", " x@y", " License"]), lang, rng.choice(["s0", "s0", "s1", "s2"]), 0))
    for k in range(60):  # copies: exact, near, at the threshold and below it
        of = rows[rng.randrange(240)]
        w = of[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = prose(of[2], 1) + "x"
        rows.append((240 + k, " ".join(w[: len(w) - rng.randrange(3)]), of[2], of[3], 0))
    gone = [(400, None, "en", "s0", 0), (401, "", "fr", "s0", 0), (402, "12 34 !", "de", "s1", 0)]
    spark.createDataFrame(rows + gone, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = cp.language_id(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in kept.select("doc_id").collect()} == {400, 401, 402}
    left = one_of_each(rows)
    assert 240 <= len(left) < 300
    assert {r["doc_id"] for r in cp.near_dedup(spark, kept, str(tmp_path)).select("doc_id").collect()} == {r[0] for r in left}
    sure, maybe = mixed(left)
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {r[0] for r in sure} <= {p["doc_id"] for p in pieces} <= {r[0] for r in maybe}

    text = {r[0]: r[1] for r in rows}
    code = Tokenizer.from_file(tokens.default_path())
    for i in {p["doc_id"] for p in pieces}:
        ids = np.array([*code.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        own = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, n, _, _ in own) == len(ids)
        for start, n, crc, whole in own:
            assert (crc, whole) == (zlib.crc32(ids[start : start + n].tobytes()), len(ids))
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s, parts in by.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 4096 or s == max(by))


def test_stages_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, "some text here", None, None, None), (1, None, None, "s", None), (1, "", "en", None, 3), (1, "some text here", "en", "s", 3)], DOCS)
    odd = odd.selectExpr("*", "'x' as class_id", "1 as id", "2.0 as score", "'y' as topic", "3 as tokens", "'z' as __h")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == cp.COLUMNS and out.count() <= 4, name
    assert {r["doc_id"] for r in cp.packing_stage(spark, odd, str(tmp_path)).collect()} == {None, 1}
