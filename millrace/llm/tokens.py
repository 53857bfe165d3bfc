"""Whole-text encoding with the ``tokenizers`` library, as fast as words repeat.

A byte-level tokenizer never merges across the places where its pattern cuts a text. Some
of these show in the bytes: before white space that follows anything else, and before an
ASCII sign that follows a letter or digit. Texts are cut there into chunks, each chunk is
hashed, and only chunks whose hash is new go to the library; a text's ids are its chunks'
ids in order, which is what encoding the whole text gives. Cutting, hashing, looking up and
joining run over a batch's whole buffer.

Added tokens ("<|endoftext|>") are one token wherever their string stands in a text, as they
are for the library without further settings.

Chunks are told apart by 64-bit hashes of their bytes: of 10^12 different chunks, one in
twenty runs would mistake a single one. The table is emptied when full; long chunks are
never kept.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .shingles import _power_tables, mix

_U = np.uint64
_SLOTS = 1 << 21
_KEPT = 800_000
_POOL = 4_000_000
_LONGEST = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
_SIGN = np.array([33 <= b <= 126 for b in range(256)]) & ~_LETTER
#: ASCII bytes after which white space surely starts a run; separators count as white space in some tables.
_SOLID = np.array([b < 128 and not 28 <= b <= 31 for b in range(256)]) & ~_SPACE
_VALUE = mix(np.arange(1, 257, dtype=_U))
#: Chunks that are one piece of the pattern: a word of Latin letters, or signs without an apostrophe.
_ONE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+)")
#: Byte-level vocabularies write bytes that aren't printable Latin-1 as 256 and up, in order.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each starts (and the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at texts, and at cuts that the tokenizer's pattern surely makes."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    space, sign = _SPACE[raw], _SIGN[raw]
    before = raw[:-1]
    cut[1:n] = (space[1:] & _SOLID[before]) | (sign[1:] & _LETTER[before])
    at = np.flatnonzero((space[1:] | sign[1:]) & (before >= 0x80)) + 1
    b1, b2, b3 = raw[at - 1], raw[at - 2], raw[np.maximum(at - 3, 0)]
    # other white space in UTF-8: two bytes after C2, or three that begin as these do
    white = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A)))
    latin = (b2 == 0xC3) & (b1 != 0x97) & (b1 != 0xB7)
    cut[at] = np.where(space[at], ~white, latin)
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class ByteLevelEncoder:
    """Encodes columns of texts into ids. One per Python worker and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Strings that are one token wherever they stand, as the library reads them.
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(_SLOTS, _U), np.zeros(_SLOTS, np.int32)
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and the end)."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), offsets
        if len(self.ends) > _KEPT or len(self.pool) > _POOL:
            self._clear()
        start = self._whole_tokens(raw, offsets, chunk_starts(raw, offsets))
        end = np.append(start[1:], len(raw))
        power, inverse = _power_tables(len(raw))
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum(_VALUE[raw] * power[: len(raw)], out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U)) | _U(1)
        kept = end - start <= _LONGEST
        entry = np.where(kept, self._find(h), -1)
        lack = np.flatnonzero(entry < 0)
        if len(lack):
            short, long = lack[kept[lack]], lack[~kept[lack]]
            new, first, which = np.unique(h[short], return_index=True, return_inverse=True)
            rows, text, n = np.concatenate([short[first], long]), raw.tobytes(), len(self.ends) - 1
            ids = self._learn([text[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist(), strict=True)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])
            self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], np.uint32)])
            entry[short], entry[long] = n + which, n + len(new) + np.arange(len(long))
            room = max(0, _SLOTS * 3 // 4 - n)
            self._keep(new[:room], n + np.arange(len(new))[:room])
        size = self.ends[entry + 1] - self.ends[entry]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.ends[entry] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, offsets)]

    def _whole_tokens(self, raw: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
        """``start`` with a chunk for each added token that stands in a text, and no cut inside."""
        found = np.array([m.span() for m in self.added.finditer(raw.tobytes())] if self.added else [], np.int64).reshape(-1, 2)
        # one that begins in a text and ends in the next is none
        found = found[np.searchsorted(offsets, found[:, 0], "right") == np.searchsorted(offsets, found[:, 1], "left")]
        if not len(found):
            return start
        at = np.searchsorted(found[:, 0], start, "left") - 1
        inside = (at >= 0) & (start < found[at, 1])
        ends = found[:, 1][found[:, 1] < len(raw)]
        return np.unique(np.concatenate([start[~inside], found[:, 0], ends]))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes in the table, -1 where absent."""
        out, live, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & _U(_SLOTS - 1)
        while len(live):
            k = self.keys[slot]
            same = k == h[live]
            out[live[same]] = self.entry[slot[same]]
            on = ~same & (k != 0)
            live, slot = live[on], (slot[on] + _U(1)) & _U(_SLOTS - 1)
        return out

    def _keep(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        slot = h & _U(_SLOTS - 1)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            here = self.keys[slot] == h
            self.entry[slot[here]] = entry[here]
            h, entry, slot = h[~here], entry[~here], (slot[~here] + _U(1)) & _U(_SLOTS - 1)

    def _learn(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of new chunks: those of one piece straight from the library's model."""
        out: list[list[int]] = []
        other, tokenize, one = [], self.tokenizer.model.tokenize, _ONE.fullmatch
        for c in chunks:
            if one(c):
                piece = c.decode("latin-1")
                if not c.isascii():
                    piece = piece.translate(_BYTES)
                elif c[0] == 32:
                    piece = "\u0120" + piece[1:]
                out.append([t.id for t in tokenize(piece)])
            else:
                other.append(len(out))
                out.append([])
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in other], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    rows = len(starts) - 1
    starts = starts + np.arange(rows + 1)
    out, own = np.full(len(ids) + rows, end_id, "<u4"), np.ones(len(ids) + rows, bool)
    own[starts[1:] - 1] = False
    out[own] = ids
    return out, starts


@lru_cache(2)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)
