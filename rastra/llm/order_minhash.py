"""Near-duplicate documents by Order MinHash over shingles of five words.

Words are runs of letters and digits in lower case.  A document's shingles are labelled with their
occurrence number; each sketch keeps the ``keep`` smallest labelled shingles under its own hash, in the
order of the text, so documents that share shingles in another order seldom meet.  Who meets in a sketch is
verified by a banded alignment of the two shingle sequences: matched m, similarity m / (n1 + n2 - m), which
is the Jaccard similarity of the labelled shingles when both texts keep their order.  The band holds every
alignment that can reach the threshold.  Classes follow ``links.bucket_classes``.

Texts meet by chance: of pairs at exactly 0.8 that keep their order, one in 40,000 shares none of the 20 sketches
if the texts are long.  Short ones, of ``SHORT`` shingles or fewer, would miss each other more often (five shingles
and four: 1 in 80), so they have 8 sketches more, of two shingles.  Whoever has met is tested exactly; what
spares an alignment is a bound on the shingles that two texts can share, never an estimate.

Defined results: documents of equal word sequence are one class; without any word, those of equal text; a text
of fewer than five words is one shingle; null texts are alone; one row per doc_id, where rows that repeat
a doc_id with other texts stand for the document by their smallest content hash; rows with a null doc_id are
returned each, with null class_id and kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import storage
from .links import Forest, bucket_classes, groups_of

TABLES, KEEP, WORDS = 20, 4, 5
SHORT, SHORT_TABLES, SHORT_KEEP = 10, 8, 2
_WORD = re.compile(r"[^\W_]+")
_STEP = 256


class WordHashes(dict):
    """word -> 32-bit hash, emptied when it holds ``most`` words."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, size=64, dtype=np.uint64)


def words_of(text: str, store: WordHashes) -> np.ndarray:
    found = _WORD.findall(text.lower())
    return np.fromiter(map(store.__getitem__, found), np.uint32, len(found))


def shingles(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingles in the order of the text."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out += _mix(words[k : k + n].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    same = out[order][1:] == out[order][:-1]
    if same.any():
        start = np.flatnonzero(np.r_[True, ~same])
        nth = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
        label = np.zeros(n, np.uint64)
        label[order] = nth
        out = out ^ _mix(label * np.uint64(0xD6E8FEB86659FD93))
    return out


def sketches(s: np.ndarray, tables: int = TABLES, keep: int = KEEP) -> np.ndarray:
    """One 64-bit key per table, of the smallest labelled shingles in text order; short texts have further tables."""
    keys = _keys(s, _SEEDS[:tables], keep)
    return np.concatenate([keys, _keys(s, _SEEDS[tables : tables + SHORT_TABLES], SHORT_KEEP)]) if len(s) <= SHORT else keys


def _keys(s: np.ndarray, seeds: np.ndarray, keep: int) -> np.ndarray:
    v = _mix(s[None, :] ^ seeds[:, None])
    if len(s) > keep:
        at = np.sort(np.argpartition(v, keep, axis=1)[:, :keep], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(s)), (len(seeds), len(s)))
    key = seeds.copy()
    for k in range(at.shape[1]):
        key = _mix(key * _POWERS[1] + s[at[:, k]])
    return key.view(np.int64)


def _needed(total, threshold: float):
    """Shingles that two sequences of ``total`` together must share in order."""
    return np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(int)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the banded alignment of two sequences of labelled shingles reaches the threshold."""
    total = len(a) + len(b)
    need = int(_needed(np.float64(total), threshold))
    if min(len(a), len(b)) < need:
        return False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= total - 2 * need  # each unmatched shingle moves the diagonal by one at most
    if near.sum() < need:
        return False
    j = j[near][np.argsort(i[near])]
    if (np.diff(j) > 0).all():
        return True
    # Longest chain that keeps both orders: both sequences hold a labelled shingle once.
    from bisect import bisect_left

    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) >= need


def _sketch(tables: int, keep: int):
    def run(batches):
        store = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                piece = batch.slice(at, _STEP)
                same, keys, data = [], [], []
                for text in piece.column(1).to_pylist():
                    words = words_of(text or "", store)
                    raw = words.tobytes()
                    same.append(None if text is None else hashlib.md5(b"w" + raw if len(words) else b"t" + text.encode("utf-8", "surrogatepass")).digest())
                    keys.append(sketches(shingles(words), tables, keep).tolist() if len(words) else [])
                    data.append(raw)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                    ["id", "same", "keys", "data"],
                )
        storage.give_back()

    return run


def _test_star(threshold: float):
    def run(batches):
        head, of = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, kind, doc, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                s = shingles(np.frombuffer(data, np.uint32))
                if not kind:
                    head, of = hub, s
                elif hub == head and similar(of, s, threshold):
                    a.append(doc)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _test_block(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, cls, data = frame["id"].tolist(), frame["class"].tolist(), frame["data"].tolist()
        forest, failed, made = Forest(), set(), {}
        for i, c, d in zip(ids, cls, data):
            forest.join(i, c, link=False)
            if i not in made:
                s = shingles(np.frombuffer(d, np.uint32))
                made[i] = s, np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.int32)
        for left, right in groups_of(frame):
            size = np.array([len(made[ids[q]][0]) for q in right])
            bins = np.array([made[ids[q]][1] for q in right]).reshape(len(right), -1)
            for p in left.tolist():
                s, own = made[ids[p]]
                # Two texts share no more than their bins do.
                fit = np.minimum(bins, own).sum(1) >= _needed(size + len(s), threshold)
                for q in right[fit].tolist():
                    pair = (min(ids[p], ids[q]), max(ids[p], ids[q]))
                    if forest.root(ids[p]) != forest.root(ids[q]) and pair not in failed:
                        if similar(s, made[ids[q]][0], threshold):
                            forest.join(*pair)
                        else:
                            failed.add(pair)
        return pd.DataFrame(forest.links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, *, tables: int = TABLES, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept (doc_id = class_id)."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    scratch = storage.Scratch(spark, "order-minhash")
    made = scratch.write(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketch(tables, keep), "id long, same binary, keys array<long>, data binary"))
    named = made.where("id is not null")
    shape = named.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).first()
    repeated = shape["n"] != shape["d"]
    ids = named.select("id", "same")
    if repeated:
        ids = scratch.write(ids.groupBy("id").agg(F.min("same").alias("same")))
    # Few texts have an exact copy; only their rows need to learn of it.
    copied = scratch.write(ids.where("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    of = scratch.write(storage.join_unique(ids, copied, "same", "n").select("id", "same", "rep"))
    others = scratch.write(of.where("id <> rep").select("id", "same"))
    chosen = named.where("same is not null").select("id", "same", "keys", "data")
    if repeated:  # of an id's texts one stands for it; rows of other ids stay where they are
        often = scratch.write(named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
        likely, once = storage.divided(chosen, often, "id")
        chosen = scratch.write(once.unionByName(likely.groupBy("id").agg(F.min(F.struct("same", "keys", "data")).alias("s")).select("id", "s.*")))
    payload = chosen.select("id", "data")  # of copies too, which nobody asks for
    copies, single = storage.divided(chosen.select("id", "same", "keys"), others, "id")
    chosen = single.unionByName(copies.join(others, ["id", "same"], "left_anti"))
    members = chosen.select("id", F.posexplode("keys").alias("t", "key")).select(F.xxhash64("key", "t").alias("bucket"), "id")
    classes = bucket_classes(members, payload, _test_star(threshold), _test_block(threshold), block=256, rows_per_bin=1024)
    # A class's smallest representative is its smallest document: representatives are smallest among equals.
    settled = of.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    single = classes.join(of, "id", "left_anti").select("id", F.col("component").alias("class_id"))
    linked = scratch.write(settled.unionByName(single))
    scratch.drop(copied, others, of)
    out = ids.select("id").join(linked, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    nameless = made.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"))
    return out.unionByName(nameless).withColumn("kept", F.col("doc_id") == F.col("class_id"))
