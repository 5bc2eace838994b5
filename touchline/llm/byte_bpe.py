"""Byte-level BPE ids of many texts at once, by the tokenizers library over distinct segments.

The pattern that splits a text before the merges never reaches across a place where a blank, tab or line
end follows something that is no white space: every alternative ends there. So a text is cut at these
places, the library encodes each distinct segment once, and the ids of a text are gathered from a table
of segments. Ids are those that the library gives for the whole text. Segments are found in the table by a
hash, and their bytes are compared with those of the table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .arrays import U64, run_hash

#: Segments that a Python worker keeps between batches; beyond it the table starts anew.
CACHE_SEGMENTS = 1_000_000
#: New segments that are given to the library as one text.
JOINED = 64


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable Latin-1 characters stand for
    their own code, and the other bytes, in order, are the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def segment_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the segments of all texts.

    After a character beyond ASCII that is or resembles white space there is no cut; that only makes a longer segment.
    """
    edge = np.zeros(len(data) + 1, dtype=bool)
    blank = np.flatnonzero((data == 0x20) | (data == 0x0A) | (data == 0x0D) | (data == 0x09))
    before = data[blank - 1]
    ok = (before > 0x20) & (before != 0x7F) & (blank > 0)
    far = np.flatnonzero(ok & (before >= 0x80))
    at = blank[far]
    two, three = data[at - 2], data[at - 3]
    wide = (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A) | (two == 0xA0))
    ok[far] = ~wide & ~((two == 0xC2) & ((data[at - 1] == 0x85) | (data[at - 1] == 0xA0)))
    edge[blank[ok]] = True
    edge[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(edge[:-1])


class SegmentTable:
    """Ids of distinct segments, in flat arrays. look_up(segments as bytes, their sizes) gives (ids, ids of each) of new ones."""

    def __init__(self, look_up):
        self.look_up = look_up
        self.reset()

    def reset(self) -> None:
        """An empty table: hashes in order and their entries; of each entry its bytes and its ids."""
        self.keys, self.entry = np.full(1, U64(2**64 - 1)), np.zeros(1, np.int64)
        self.raw, self.raw_at, self.raw_len = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.full(1, -1, dtype=np.int64)
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Put segments with new and distinct hashes into the table."""
        raw = data.tobytes()
        whole = [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        ids, count = self.look_up(whole, size)
        base = len(self.starts)
        self.raw_at = np.concatenate((self.raw_at, len(self.raw) + np.cumsum(size) - size))
        self.raw_len = np.concatenate((self.raw_len, size))
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(whole), dtype=np.uint8)))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(count) - count))
        self.sizes = np.concatenate((self.sizes, count))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
        at = np.searchsorted(self.keys, key)
        self.keys, self.entry = np.insert(self.keys, at, key), np.insert(self.entry, at, base + np.arange(len(key)))

    def encode(self, data: np.ndarray, offs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets, the first 0) in one array, and the number of ids of each.

        start: first bytes of the segments, which cover all texts.
        """
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        size = np.diff(np.append(start, len(data)))
        key = run_hash(data, start, size)
        at = np.searchsorted(self.keys, key)
        new = np.flatnonzero(self.keys[at] != key)
        if len(new):
            fresh, which = np.unique(key[new], return_index=True)
            if len(self.keys) + len(fresh) > CACHE_SEGMENTS:
                self.reset()
                fresh, which = np.unique(key, return_index=True)
                new = np.arange(len(key))
            self.learn(fresh, data, start[new[which]], size[new[which]])
            at = np.searchsorted(self.keys, key)
        entry = self.entry[at]
        # equal hashes of unlike segments would be seen here
        same = self.raw_len[entry] == size
        if same.all():
            byte = np.repeat(self.raw_at[entry] - start, size)
            byte += np.arange(len(data))
            same = np.logical_and.reduceat(self.raw[byte] == data, start)
        if not same.all():
            raise ValueError("two segments of one hash")
        n = self.sizes[entry]
        total = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.starts[entry] - total[:-1], n)
        at += np.arange(total[-1])
        return self.flat[at], np.diff(total[np.searchsorted(start, offs)])


class ByteModel:
    """Ids and bytes of a byte-level BPE file. plain: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        byte = byte_alphabet()
        text = [b""] * size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            text[i] = piece.encode() if i in added else bytes(byte[c] for c in piece)
        self.piece_len = np.array([len(t) for t in text], dtype=np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_len)[:-1]))
        self.piece_bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.text = text
        self.table = SegmentTable(self.looked_up)

    def looked_up(self, whole: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments by the library, and the number of ids of each.

        Segments that can stand one after the other are given to it as longer texts, and its ids are dealt out by
        their bytes; all others are texts of their own.
        """
        joined = np.frombuffer(b"".join(whole), dtype=np.uint8)
        first = np.cumsum(size) - size
        cut = np.zeros(len(joined), dtype=bool)
        cut[segment_starts(joined, np.array([0, len(joined)]))] = True
        # a text begins at every segment that would not be cut off, and after so many segments
        begins = ~cut[first] | (np.arange(len(whole)) % JOINED == 0)
        begins[0] = True
        head = np.flatnonzero(begins)
        texts = [b"".join(whole[a:b]).decode() for a, b in zip(head.tolist(), np.append(head[1:], len(whole)).tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for x in found for i in x), dtype=np.int32)
        ends = np.concatenate(([0], np.cumsum(self.piece_len[ids])))
        place = np.searchsorted(ends, np.append(first, len(joined)))
        if (ends[place] != np.append(first, len(joined))).any():
            raise ValueError("the tokenizer does not keep to the bytes of a text")
        return ids, np.diff(place)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets, the first 0) in one array, and the number of ids of each."""
        return self.table.encode(data, offs, segment_starts(data, offs))


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a blank before each that is not empty."""
    some = offs[:-1] < offs[1:]
    out = np.insert(data, offs[:-1][some], 0x20)
    return out, offs + np.concatenate(([0], np.cumsum(some)))


@lru_cache(maxsize=2)
def model(path: str, plain: bool) -> ByteModel:
    """The model of this worker process, loaded once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteModel(path, plain)
