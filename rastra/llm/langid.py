"""Language identification by averaged hashed subword embeddings and a linear softmax.

Features are the 2-, 3- and 4-grams of the UTF-8 bytes of the lower-cased text, ASCII other than letters
being blanks, hashed to buckets.  A text is the mean of its grams' embeddings; a linear softmax gives the
language.  Embeddings and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample: ``max_rows`` (2,400) labelled rows in all, one of each language at least, in equal number from each
where it has so many, chosen by the smallest hashes of doc_id, and no more rows of each than fit into ``max_bytes``
(64 MB) of grams.  A fifth of the sample calibrates: a temperature by likelihood, and the rejection
level below which at most ``reject_share`` of these texts lie.  For use, embedding and softmax are multiplied
into a table of buckets x languages, which is broadcast (2 MB for four languages).

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; without labelled rows
every text is; ties go to the language first in order; repeated rows are predicted each; rows with a null label
or id never train; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import storage

BUCKETS, DIM, MAX_ROWS, MAX_BYTES = 1 << 17, 8, 2400, 64 << 20
_LETTER = re.compile(r"[^\W\d_]")
_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_GAP = b"    "
#: Weights stay within these bounds, so that languages which can't be told apart don't make them diverge.
_LIMIT = 20.0


def grams(data: bytes) -> np.ndarray:
    """Buckets of the 2-, 3- and 4-grams that start at each byte but the last three, a column each."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(b) - 3
    h = b[:n] * np.uint32(0x01000193) ^ b[1 : n + 1]
    out = np.empty((3, n), np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for k in range(3):
        if k:
            h = h * np.uint32(0x01000193) ^ b[k + 1 : n + k + 1]
        out[k] = (h * np.uint32(0x9E3779B1) + np.uint32(k * 0x7F4A7C15)) * np.uint32(0x85EBCA6B) >> shift
    return out


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_BYTES)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.bias, self.temperature, self.reject = langs, table, bias, temperature, reject

    def predict(self, texts: list) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list = [("und", 0.0, True)] * len(texts)
        if not self.langs:
            return out
        group, size = [], 0
        for k, text in enumerate(texts):
            if text and _LETTER.search(text):
                group.append((k, prepared(text)))
                size += len(group[-1][1])
                if size > 1_000_000:
                    self._group(group, out)
                    group, size = [], 0
        self._group(group, out)
        return out

    def _group(self, group, out) -> None:
        if not group:
            return
        sums = np.empty((len(group), len(self.langs)))
        small = [g for g in enumerate(group) if len(g[1][1]) <= 2_000_000]
        for at, (_, data) in enumerate(group):
            if len(data) > 2_000_000:  # a very long text by itself, in pieces that overlap by a gram
                total = np.zeros(len(self.langs))
                for lo in range(0, len(data), 1_000_000):
                    piece = data[lo : lo + 1_000_003]
                    g = grams(piece if lo + 1_000_003 < len(data) else piece + _GAP[:3])
                    total += sum(self.table[row].sum(0, dtype=float) for row in g)
                sums[at] = total / (3 * len(data))
        if small:
            joined = _GAP.join(x[1][1] for x in small) + _GAP
            sizes = np.array([len(x[1][1]) for x in small])
            starts = np.cumsum(sizes + len(_GAP)) - sizes - len(_GAP)
            total = sum(np.add.reduceat(self.table[row], np.ravel(np.column_stack([starts, starts + sizes])), axis=0)[::2] for row in grams(joined))
            sums[[x[0] for x in small]] = total / (3 * np.maximum(sizes, 1))[:, None]
        logits = (sums + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for (k, _), c, s in zip(group, best.tolist(), p.max(1).tolist()):
            out[k] = (self.langs[c], s, s < self.reject)


def train(bags: list[tuple[str, np.ndarray, np.ndarray]], *, epochs: int = 12, rate: float = 1.0, dim: int = DIM, reject_share: float = 0.001, seed: int = 1) -> Model:
    """``bags``: language, buckets, and shares of the text's grams that fall into them."""
    langs = sorted({b[0] for b in bags})
    rng = np.random.default_rng(seed)
    emb = rng.normal(scale=0.1, size=(BUCKETS, dim))
    soft = rng.normal(scale=0.1, size=(dim, len(langs)))
    bias, seen = np.zeros(len(langs)), np.zeros(BUCKETS, bool)
    y = np.array([langs.index(b[0]) for b in bags])
    order = rng.permutation(len(bags))
    hold = order[: len(bags) // 5] if len(bags) >= 20 else order
    fit = order[len(bags) // 5 :] if len(bags) >= 20 else order
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(fit):
            _, at, share = bags[k]
            mean = share @ emb[at]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = soft @ p
            soft = np.clip(soft - step * np.outer(mean, p), -_LIMIT, _LIMIT)
            bias -= 0.1 * step * p
            emb[at] = np.clip(emb[at] - 50 * step * share[:, None] * back, -_LIMIT, _LIMIT)
            seen[at] = True
    emb[~seen] = 0
    table = (emb @ soft).astype(np.float32)
    logits = np.array([bags[k][2] @ table[bags[k][1]] + bias for k in hold]).reshape(len(hold), len(langs))

    def scores(t):
        z = logits / t
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    temperature = min((-np.log(scores(t)[np.arange(len(hold)), y[hold]] + 1e-12).mean(), t) for t in np.geomspace(0.1, 10, 41))[1] if len(hold) else 1.0
    best = np.sort(scores(temperature).max(1)) if len(hold) else np.array([0.0])
    # At most half, and strictly below what the calibration texts of that share reach.
    reject = min(0.5, best[int(reject_share * len(best))] * 0.9)
    return Model(langs, table, bias, float(temperature), float(reject))


def _bags(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for doc, lang, place, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                if text and _LETTER.search(text):
                    found, n = np.unique(grams(_pad(prepared(text))), return_counts=True)
                    rows.append({"doc_id": doc, "lang": lang, "place": place, "at": found.astype("<i4").tobytes(), "share": (n / n.sum()).astype("<f4").tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("place", pa.int32()), ("at", pa.binary()), ("share", pa.binary())]))


def _pad(data: bytes) -> bytes:
    return data + _GAP[:3]


def fit(docs: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Train on a bounded sample of ``docs``, which holds rows that may be learnt from."""
    spark = docs.sparkSession
    scratch = storage.Scratch(spark, "langid")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = rows.select("doc_id", "lang")
    counts = scratch.write(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")))  # a row for each language
    langs = counts.count()
    if not langs:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0, 1.0)
    each = max(1, max_rows // langs)
    # The smallest hashes lie below a bound that lets twice as many pass and some: so few rows meet to be ranked.
    bound = (F.lit(2.0 * each + 50) / F.col("n") * 2.0**64 - 2.0**63).alias("bound")
    few = ids.join(F.broadcast(counts.select("lang", bound)), "lang").where(F.xxhash64("doc_id").cast("double") <= F.col("bound")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = scratch.write(few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each))
    bags = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "place", "text").mapInArrow(_bags, "doc_id long, lang string, place int, at binary, share binary")
    bags = scratch.write(bags.dropDuplicates(["doc_id", "lang"]))
    sizes = bags.groupBy("place").agg(F.sum(F.length("at") * 2).alias("bytes")).orderBy("place").collect()  # at most ``each`` rows
    held = np.cumsum([r["bytes"] for r in sizes])
    last = max([sizes[0]["place"]] + [r["place"] for r, total in zip(sizes, held) if total <= max_bytes]) if sizes else 0
    got = bags.where(F.col("place") <= last).toPandas().sort_values(["doc_id", "lang"])
    scratch.drop(counts, chosen, bags)
    return train([(r.lang, np.frombuffer(r.at, "<i4"), np.frombuffer(r.share, "<f4")) for r in got.itertuples()], **options)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of those names are replaced."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    text_at = keep.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = held.value.predict(piece.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_())))] if found else [*piece.columns, pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.bool_())],
                    names=[*keep, "lang_pred", "score", "rejected"],
                )
        storage.give_back()

    return docs.select(keep).mapInArrow(run, schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
