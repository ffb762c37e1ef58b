"""Exact tokenizer ids of whole texts at the speed of a dictionary.

Pre-tokenisation of the supported files never joins characters across a blank, line break or tab, nor an
ASCII or Latin-1 letter and the ASCII sign or digit beside it, so the ids of a text are the ids of such pieces in order.  Each
distinct piece goes through the ``tokenizers`` library once per worker (the stores are emptied when they are
full), the rest is look-up.  ``tests/llm/test_tokens.py`` holds this equal to encoding the texts directly.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import regex

from . import storage

#: Lower-casing before the look-up changes nothing below U+0180, save for the dotted capital I.
_NOT_SIMPLE = re.compile("[İƀ-\U0010ffff]")
#: Lower-case pieces of these characters are in normal form, and every part is what it is for the library.
_SIMPLE = re.compile("[!-@\\[-~¡-¿×ß-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĸĺļľłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ]+")
#: Byte-level files write the bytes that print nothing as letters from U+0100 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINT)}
#: Pieces, and parts of pieces, that a worker remembers: about 200 bytes each.
KNOWN_PIECES = 500_000
#: Texts of at most so many bytes are looked up together; a longer one alone.
GROUP_BYTES = 5_000_000
#: Kinds of bytes: 1 blank, tab and line breaks; 2 ASCII letters; 3 other ASCII, without the apostrophe of
#: contractions and the bar of special tokens.  Words are cut out between kinds 2 and 3; nothing joins an ASCII character to the one before it.
_GAP = 1
_KIND = bytes([1 if b in b" \t\n\r" else 2 if chr(b).isalpha() else 3 if 33 <= b < 127 and b not in b"'|" else 0 for b in range(128)] + [0] * 128)
_BORDER = bytes(k in (2 * 4 + 3, 3 * 4 + 2) for k in range(256))
#: This byte and the next are one character of Latin-1, a letter (kind 2) unless the next is the times or division sign.
_ACCENT, _NO_LETTERS = 0xC3, (0x97, 0xB7)
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _translated(data: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte's entry; an array as index would take eight bytes for each."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def _mapped(part: str) -> str:
    return part.encode().decode("latin-1").translate(_BYTE_LEVEL)


class Encoder:
    """Ids of whole texts (null: empty): ``flat(column)`` as one array with a count a text, ``encode(texts)`` as bytes each.

    A column's bytes are cut at blanks and its distinct pieces found without a loop over texts or pieces.  A
    new piece of simple characters is split as the file's pre-tokenizer says, and its parts, which repeat
    more often than pieces, go through the library's model; any other piece goes through the whole tokenizer.
    """

    def __init__(self, path: str, known: int = KNOWN_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
        splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        # Only files that split at blanks, drop them, and know no token with a blank can be cut there.
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"]
        if self.by_piece:
            self.parts = regex.compile(splits[0]["pattern"]["Regex"]).findall
            special = [re.escape(x["content"]) for x in file["added_tokens"]]
            self.special = re.compile("|".join(special) or "(?!)").search
            self.words_stay_whole = self.parts("aéz") == ["aéz"] and not any(x["content"].isalpha() for x in file["added_tokens"])
            self.accents = self.words_stay_whole and self.parts("é*é1é") == ["é", "*", "é", "1", "é"]
            self.model = self.tokenizer.model
        self.known, self.store, self.part_store = known, {}, {}

    def encode(self, texts) -> list[bytes]:
        ids, counts = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of strings, and the number of ids of each text."""
        if not self.by_piece:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            counts = np.array([len(x) for x in found], np.int64)
            return np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())), counts
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ids, counts, first = [], [], 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1)
            part, n = self._look_up(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            ids.append(part)
            counts.append(n)
            first = last
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def _look_up(self, data: np.ndarray, offsets: np.ndarray):
        kind = _translated(data, _KIND)
        if self.accents and len(at := np.flatnonzero(data == _ACCENT)):
            at = at[~np.isin(data[at + 1], _NO_LETTERS)]
            kind = kind.copy()
            kind[at] = kind[at + 1] = 2
        cut = np.zeros(len(data) + 1, bool)  # a piece begins here
        cut[offsets] = True
        cut[:-1] |= kind == _GAP
        cut[1:] |= kind == _GAP
        cut[1:-1] |= _translated(kind[:-1] * 4 + kind[1:], _BORDER).view(bool)
        if b"<|" not in data.tobytes():  # else a token in capitals would turn into a special one
            lower = (data - 65) < 26
            lower[:-1] &= data[1:] < 128  # with a mark behind it, a letter may have a form of its own
            data = np.where(lower, data + 32, data)
        solid = kind != _GAP
        places = np.int32 if len(data) < 1 << 29 else np.int64  # a byte makes two ids at most
        upto = np.zeros(len(data) + 1, places)
        np.cumsum(solid, out=upto[1:])
        bounds = upto[cut]
        bounds = bounds[np.r_[True, np.diff(bounds) > 0]]
        at = upto[offsets]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[solid])]).dictionary_encode()
        del kind, cut, solid, upto, data  # as large as the texts, or four times
        distinct, store = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self.store  # to_pylist takes ten times as long
        found = list(map(store.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(store) + len(new) > self.known:
            store.clear()
        for k in new:
            raw = distinct[k]
            if self.words_stay_whole and raw.isalpha():  # of bytes: ASCII letters only, most pieces
                ids = self._tokenize(raw.decode("ascii").lower())
            elif self.accents and _WORD(raw):
                ids = self._tokenize(_mapped(raw.decode("utf-8").lower()))
            else:
                ids = self._piece(raw.decode("utf-8"))
            found[k] = store[raw] = ids
        size = np.fromiter(map(len, found), places, len(found)) >> 2
        known = np.frombuffer(b"".join(found), "<u4")
        code = pieces.indices.to_numpy()
        n = size[code]
        ends = np.zeros(len(n) + 1, places)
        np.cumsum(n, out=ends[1:])
        place = np.repeat((np.cumsum(size, dtype=places) - size)[code] - ends[:-1], n)
        place += np.arange(len(place), dtype=places)
        return known[place], np.diff(ends[np.searchsorted(bounds, at)]).astype(np.int64)

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not _NOT_SIMPLE.search(piece):
            low = piece.lower()
            # special tokens match the raw text: one that only lower-casing would make is none
            if low == piece or not self.special(low):
                piece = low
        if not _SIMPLE.fullmatch(piece) or self.special(piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._part, self.parts(piece)))

    def _part(self, part: str) -> bytes:
        ids = self.part_store.get(part)
        if ids is None:
            if len(self.part_store) >= self.known:
                self.part_store.clear()
            self.part_store[part] = ids = self._tokenize(part if part.isascii() else _mapped(part))
        return ids

    def _tokenize(self, mapped: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def forget() -> None:
    """Give up this worker's encoders and what they remember: stages that only read ids need the memory for themselves."""
    _OPEN.clear()
    storage.give_back()


def gathered(batches, size: int = GROUP_BYTES):
    """Record batches joined until their bytes reach ``size``: distinct pieces are found once for all of them."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(held: list) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(k) for x in held]) for k in range(held[0].num_columns)], schema=held[0].schema)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts with one id more behind each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1
