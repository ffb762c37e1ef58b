"""Token-id files compressed by Re-Pair grammars.

Documents are dealt into ranges of ascending doc_id, encoded, and written shard by shard.  A shard's ids
are rewritten by rounds: count adjacent id pairs, give each frequent pair a nonterminal, replace its
occurrences (where two overlap the more frequent pair wins), and count again.  Pairs never cross a
document, so a document is a run of symbols, found by the index and expanded without its neighbours.

The grammar is complete when no pair occurs ``min_count`` (8) times any more, when a round at that threshold shortens
the shard by less than ``min_gain`` (1/256), or when all symbols of the width that the terminals need anyway are used
up: one more rule would widen every symbol of the shard from 16 to 32 bits.  A vocabulary of 65,536 ids or more has
32-bit symbols from the start and meets no such end.

File layout (little-endian): magic, version, part, seq, end of the terminals, rules, documents, symbols, ids,
then doc_id int64, null flag uint8, first symbol uint32, first id uint64 a document, the rules as two
uint32, the expansion length of each rule as uint32, and the symbols as uint16 or uint32.

Defined results: a null or empty text is the end id alone; null doc_ids come first and stay null; repeated
rows are repeated; an empty table writes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import storage, tokens

_HEAD = struct.Struct("<8sIiiIIIIQ")
_MAGIC = b"RSTRRPG\0"
_BINS = 1 << 20
_FEW = 1 << 15
_STEP = 256


def compress(ids: np.ndarray, ends: np.ndarray, *, terminals: int, min_count: int = 8, min_gain: float = 1 / 256):
    """Symbols, the ends of the documents (none is empty) in them, and rules (left, right).  Symbol ``terminals + k`` is rule k.

    Pairs are counted in hashed bins, without a sort.  While many places lie in frequent bins, one pair of each such
    bin is taken in a round, and the next round hashes otherwise; few places are counted pair by pair.
    """
    a, rules = ids.astype(np.uint32), []
    room = ((1 << 16) if terminals < 1 << 16 else (1 << 32)) - terminals
    odd = np.random.default_rng(2)
    bins_, number_, slots = np.empty(len(a), np.uint32), np.empty(len(a), np.int64), np.empty(_BINS + 1, np.int32)
    least = 1 << 62
    while len(a) > 1 and len(rules) < room:
        m1, m2 = odd.integers(1 << 31, size=2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        bins = np.multiply(a[:-1], m1, out=bins_[: len(a) - 1])
        bins += a[1:] * m2
        bins >>= np.uint32(12)
        number = number_[: len(bins)]
        number[:] = bins  # bincount and look-up are faster so
        number[ends[:-1] - 1] = _BINS
        counts = np.bincount(number, minlength=_BINS + 1)
        counts[_BINS] = 0
        top = int(counts.max())
        if top < min_count:
            break
        least = max(min_count, min(top // 8, least // 3))
        often = counts >= least
        hot = np.flatnonzero(often)
        slots[hot] = np.arange(len(hot))
        at = np.flatnonzero(often[number])  # a table of bytes stays in the cache
        found = _replace(a, ends, at, slots[number[at]], len(hot), least, room - len(rules), terminals + len(rules))
        before = len(a)
        if found is not None:
            a, ends, new = found
            rules += new
        if least == min_count and before - len(a) <= min_gain * before and (len(at) < _FEW or found is not None):
            break
    return a, ends, np.array(rules, np.uint32).reshape(-1, 2)


def _replace(a, ends, at, slot, slots, least, room, first):
    """One round's replacements at ``at``, each of a pair in bin ``slot``: symbols, ends, rules; None if no pair is frequent."""
    key = a[at].astype(np.uint64)
    key <<= np.uint64(32)
    key |= a[at + 1]
    if len(at) < _FEW:
        pair_of, slot = np.unique(key, return_inverse=True)
        slots = len(pair_of)
    else:
        pair_of = np.empty(slots, np.uint64)
        pair_of[slot] = key
        same = pair_of[slot] == key
        if not same.all():
            at, slot = at[same], slot[same]
    number = np.bincount(slot, minlength=slots)
    frequent = np.flatnonzero(number >= least)
    if not len(frequent):
        return None
    frequent = frequent[np.lexsort((pair_of[frequent], -number[frequent]))][:room]
    rank_of = np.full(slots, -1, np.int32)
    rank_of[frequent] = np.arange(len(frequent))
    score = rank_of[slot]
    if score.min() < 0:
        at, score = at[score >= 0], score[score >= 0]
    # Of overlapping occurrences the pair of better rank wins, then the earlier one.
    chosen, ranks = [], []
    for _ in range(3):
        if not len(at):
            break
        touch = np.diff(at) == 1
        beats = score[:-1] <= score[1:]
        win = np.ones(len(at), bool)
        win[1:] &= ~(touch & beats)
        win[:-1] &= ~(touch & ~beats)
        chosen.append(at[win])
        ranks.append(score[win])
        gone = win.copy()
        gone[1:] |= win[:-1] & touch
        gone[:-1] |= win[1:] & touch
        at, score = at[~gone], score[~gone]
    spot, rank = np.concatenate(chosen), np.concatenate(ranks)
    fit = np.bincount(rank, minlength=len(frequent)) >= 3  # a rule costs as much as it saves at two
    if not fit.any():
        return None
    if not fit.all():
        spot, rank = spot[fit[rank]], rank[fit[rank]]
    used = pair_of[frequent[fit]]
    a[spot] = (first - 1 + np.cumsum(fit))[rank]
    stay = np.ones(len(a), bool)
    stay[spot + 1] = False
    kept = np.zeros(len(a) + 1, np.int64)
    np.cumsum(stay, out=kept[1:])
    return a[stay], kept[ends], list(zip((used >> np.uint64(32)).tolist(), (used & np.uint64(0xFFFFFFFF)).tolist()))


def expansions(rules: np.ndarray, terminals: int):
    """Flat ids of all rules, and each rule's place in them and length; rules refer to earlier ones only."""
    flat, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    newest = rules.astype(np.int64).max(1, initial=0) - terminals
    done = 0
    while done < len(rules):  # as many rules at a time as need none of each other
        upto = done + int(np.argmax(np.r_[newest[done:] >= done, True]))
        symbols = rules[done:upto].ravel()
        places = np.cumsum(sizes) - sizes
        length = np.ones(len(symbols), np.int64)
        rule = symbols >= terminals
        length[rule] = sizes[symbols[rule].astype(np.int64) - terminals]
        flat = np.concatenate([flat, expand(symbols, flat, places, sizes, terminals)])
        sizes = np.concatenate([sizes, length[::2] + length[1::2]])
        done = upto
    return flat, np.cumsum(sizes) - sizes, sizes


def expand(symbols: np.ndarray, flat: np.ndarray, places: np.ndarray, sizes: np.ndarray, terminals: int) -> np.ndarray:
    rule = symbols >= terminals
    out_len = np.ones(len(symbols), np.int64)
    which = symbols[rule].astype(np.int64) - terminals
    out_len[rule] = sizes[which]
    ends = np.cumsum(out_len)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    begin = ends - out_len
    out[begin[~rule]] = symbols[~rule]
    n = sizes[which]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(begin[rule], n) + inner] = flat[np.repeat(places[which], n) + inner]
    return out


def to_file(part: int, seq: int, doc_ids: pa.Array, whole: np.ndarray, n: np.ndarray, terminals: int, **options) -> bytes:
    """The shard of documents whose ids, ``n`` each, follow each other in ``whole``."""
    terminals = max(terminals, int(whole.max(initial=0)) + 1)
    symbols, ends, rules = compress(whole, np.cumsum(n), terminals=terminals, **options)
    firsts = np.concatenate([[0], ends[:-1]])
    _, _, sizes = expansions(rules, terminals)
    width = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    return b"".join([
        _HEAD.pack(_MAGIC, 1, part, seq, terminals, len(rules), len(n), len(symbols), len(whole)),
        doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
        doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(),
        firsts.astype("<u4").tobytes(), (np.cumsum(n) - n).astype("<u8").tobytes(),
        rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), symbols.astype(width).tobytes(),
    ])


class Shard:
    """An opened file: ``ids(k)`` expands document k alone, ``all_ids()`` every document."""

    def __init__(self, data: bytes):
        magic, version, self.part, self.seq, self.terminals, rules, self.docs, symbols, self.n_ids = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a Re-Pair shard")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null = take("<i8", self.docs), take("u1", self.docs)
        self.first, self.start = take("<u4", self.docs), take("<u8", self.docs).astype(np.int64)
        self.rules, self.sizes = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take("<u2" if self.terminals + rules <= 1 << 16 else "<u4", symbols)
        if at != len(data):
            raise ValueError("the shard has a wrong length")
        self.flat, self.places, self.lengths = expansions(self.rules, self.terminals)
        if not np.array_equal(self.lengths, self.sizes):
            raise ValueError("expansion lengths differ from the rules")

    def ids(self, k: int) -> np.ndarray:
        end = self.first[k + 1] if k + 1 < self.docs else len(self.symbols)
        return expand(self.symbols[self.first[k] : end], self.flat, self.places, self.lengths, self.terminals)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.flat, self.places, self.lengths, self.terminals)


def put(uri: str, name: str, data: bytes) -> None:
    """Write under another name, then rename: an attempt that is lost half-way leaves no shard."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, f"{base}/{name}")


def _write(path: str, end: int, uri: str, shard_ids: int, terminals: int):
    def run(batches):
        part, seq, code = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        held: list = []
        size = 0
        for batch in tokens.gathered(batches):
            ids, n = code.flat(batch.column(1))
            ids, n = tokens.with_end(ids, n, end)
            held.append((batch.column(0), ids, n))
            size += len(ids)
            if size >= shard_ids:
                yield from _close(held, uri, part, seq, shard_ids, terminals)
                held, size, seq = [], 0, seq + 1 + size // shard_ids
                storage.give_back()
        if held:
            yield from _close(held, uri, part, seq, shard_ids, terminals)
        storage.give_back()

    return run


def _close(held: list, uri: str, part: int, seq: int, shard_ids: int, terminals: int):
    """Write what is held as shards that end with the document that fills them."""
    docs = pa.concat_arrays([x[0] for x in held])
    ids, n = (np.concatenate([x[k] for x in held]) for k in (1, 2))
    ends = np.cumsum(n)
    first = done = 0
    while first < len(n):
        last = min(len(n), int(np.searchsorted(ends, done + shard_ids)) + 1)
        size = int(ends[last - 1]) - done
        put(uri, f"shard-{part:06d}-{seq:06d}.rpg", to_file(part, seq, docs[first:last], ids[done : done + size], n[first:last], terminals))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": [size], "n_docs": [last - first]})
        first, done, seq = last, done + size, seq + 1


def _read(batches):
    tokens.forget()
    for batch in batches:
        for data in batch.column(0):
            shard = Shard(data.as_py())
            whole = shard.all_ids().astype("<u4", copy=False)
            n = np.diff(np.append(shard.start, shard.n_ids))
            for at in range(0, shard.docs, _STEP):
                k = slice(at, at + _STEP)
                ids = [whole[s : s + m].tobytes() for s, m in zip(shard.start[k], n[k])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard.part, "int32")), pa.array(np.full(len(ids), shard.seq, "int32")),
                     pa.array(shard.doc_ids[k], mask=shard.null[k].astype(bool)), pa.array(shard.start[k]), pa.array(n[k]), pa.array(ids, pa.binary())],
                    ["part", "seq", "doc_id", "inner", "n_tokens", "ids"],
                )
    storage.give_back()


def write_shards(docs: DataFrame, path: str, uri: str, *, end_id: int = 1, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard files below ``uri``; returns their catalog part, seq, n_ids, n_docs, base (ids before)."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    terminals = tokens.encoder(path).tokenizer.get_vocab_size()
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows without an id have no order of their own: a hash of the text deals them over many ranges.
    order = [F.col("doc_id").asc_nulls_first(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    ranged = ranged.repartitionByRange(storage.partitions(spark), *order).sortWithinPartitions(*order)
    catalog = storage.written(ranged.mapInArrow(_write(path, end_id, uri, shard_ids, terminals), "part int, seq int, n_ids long, n_docs long"), "repair-catalog")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = catalog.groupBy("part").agg(F.sum("n_ids").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return catalog.join(parts, "part").select("part", "seq", "n_ids", "n_docs", (F.col("part_base") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("base"))


def read_shards(spark, uri: str, catalog: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document, from the files."""
    if not catalog.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.rpg").load(uri).select("content")
    found = files.mapInArrow(_read, "part int, seq int, doc_id long, inner long, n_tokens long, ids binary")
    base = catalog.select("part", "seq", "base")
    if base.count() <= 500_000:  # a row for each shard of about a million ids
        base = F.broadcast(base)
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids")
