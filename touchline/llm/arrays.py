"""Flat-array text helpers used inside Arrow tasks.

Every helper works on the two buffers of an Arrow string column (UTF-8 bytes and offsets), so a
task never makes one Python object per word. Hashes are 64 bits wide and the same on every
executor: they depend on the content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text that a task turns into arrays at once; these are many times as large.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x += U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd multipliers that differ by seed."""
    return mix(np.arange(n, dtype=U64) + U64(seed * 0x10001)) | U64(1)


_POSITION = odd(7, 1 << 12)
_BASE = odd(11, 1)[0]


def _multipliers(n: int) -> np.ndarray:
    return _POSITION[:n] if n <= len(_POSITION) else odd(7, n)


def byte_class(separators: str | bytes = b"", *, ranges: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """Table of 256 booleans, False for the separator bytes."""
    table = np.ones(256, dtype=bool)
    for b in separators if isinstance(separators, bytes) else separators.encode():
        table[b] = False
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: Words between white space: [^\x20\x09-\x0D]+
SPACED = byte_class(b" ", ranges=((0x09, 0x0D),))
#: Words of digits, letters and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = byte_class(ranges=((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Chunk:
    """Consecutive texts of a batch: bytes, offsets (first is 0) and the rows they came from."""

    __slots__ = ("data", "offs", "valid", "first", "n")

    def __init__(self, data: np.ndarray, offs: np.ndarray, valid: np.ndarray, first: int):
        self.data, self.offs, self.valid, self.first, self.n = data, offs, valid, first, len(offs) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offs, valid


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 14) -> Iterator[Chunk]:
    """Runs of whole texts of about max_bytes together; a longer text is a chunk of its own."""
    data, offs, valid = text_buffers(column)
    n, at = len(valid), 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
        to = min(n, max(to, at + 1), at + max_rows)
        yield Chunk(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], valid[at:to], at)
        at = to


class Words:
    """Words of a chunk in order: byte start, byte end, document and content hash of each."""

    __slots__ = ("start", "end", "doc", "hash", "first", "cut", "sums")

    def __init__(self, start, end, doc, hash_, first, cut=None, sums=None):
        self.start, self.end, self.doc, self.hash, self.first, self.cut, self.sums = start, end, doc, hash_, first, cut, sums

    def prefix_hash(self, which: np.ndarray, size: int) -> np.ndarray:
        """Hash of the first `size` bytes of the chosen words, which have as many; equal to that of a word."""
        with np.errstate(over="ignore"):
            return mix(self.sums[self.cut[which] + size] - self.sums[self.cut[which]] + U64(size) * _BASE)


def words(c: Chunk, table: np.ndarray, data: np.ndarray | None = None, prefixes: bool = False) -> Words:
    """Maximal runs of bytes allowed by the table; a run ends at the end of its document.

    first[d] is the number of words before document d, so document d has words first[d]:first[d + 1].
    """
    data = c.data if data is None else data
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, e, np.zeros(0, U64), np.zeros(c.n + 1, np.int64), e, np.zeros(1, U64))
    m = table[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[c.offs] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, m[:-1]
    start = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, m[1:]
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    first = np.searchsorted(start, c.offs, side="left")
    doc = np.repeat(np.arange(c.n), np.diff(first))
    size = end - start
    h, cut, sums = np.zeros(0, U64), size, np.zeros(1, U64)
    if len(start):
        at = np.flatnonzero(m)
        cut = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(len(at)) - np.repeat(cut, size)
        with np.errstate(over="ignore"):
            v = (data[at].astype(U64) + U64(1)) * _multipliers(int(size.max()))[place]
            h = mix(np.add.reduceat(v, cut) + size.astype(U64) * _BASE)
            if prefixes:
                sums = np.concatenate((sums, np.cumsum(v)))
    return Words(start, end, doc, h, first, cut, sums)


def run_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Content hash of each of consecutive runs that cover all bytes."""
    place = np.arange(len(data))
    place -= np.repeat(start, size)
    with np.errstate(over="ignore"):
        v = data.astype(U64)
        v += U64(1)
        v *= _multipliers(int(size.max()))[place]
        return mix(np.add.reduceat(v, start) + size.astype(U64) * _BASE)


def window_hash(h: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `length` consecutive hashes: len(h) - length + 1 values, by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = int(odd(101 + salt, 1)[0])
    total, done, power, size, block = None, 0, base, 1, h
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                part = block[done : done + n]
                total = part * U64(pow(base, done, 1 << 64)) if total is None else total + part * U64(pow(base, done, 1 << 64))
                done += size
            if done == length:
                return mix(total)
            block = block[:-size] + block[size:] * U64(power)
            power = power * power % (1 << 64)
            size *= 2


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)


def joined_words(c: Chunk, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the kept words of each document joined by one space."""
    n = len(c.data)
    out = c.data.copy()
    s, e, d = w.start[keep], w.end[keep], w.doc[keep]
    hold = np.zeros(n + 1, dtype=np.int32)
    hold[s] += 1
    hold[e] -= 1
    take = np.cumsum(hold[:n]) > 0
    if len(s):
        follows = np.concatenate((d[1:] == d[:-1], [False]))
        gap = e[follows]
        # adjacent words always have a separator byte between them, so the byte at `end` is free
        out[gap] = 0x20
        take[gap] = True
    counts = np.concatenate(([0], np.cumsum(take)))
    return out[take], counts[c.offs]


def chunked_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_FOLD = None


def _fold_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower case, is_letter, is_upper) of the first 65,536 code points, built once a process."""
    global _FOLD
    if _FOLD is None:
        low, letter, upper = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=bool), np.zeros(1 << 16, dtype=bool)
        for cp in range(1 << 16):
            c = chr(cp)
            letter[cp], upper[cp] = c.isalpha(), c.isupper()
            if len(x := c.lower()) == 1:
                low[cp] = ord(x)
        _FOLD = low, letter, upper
    return _FOLD


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of UTF-8 bytes."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    return cp, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case, is_letter, offsets in code points) of UTF-8 bytes."""
    lower, letters, _ = _fold_tables()
    cp, at = code_points(data, offs)
    low, letter = lower[cp & 0xFFFF], letters[cp & 0xFFFF]
    for k in np.flatnonzero(cp > 0xFFFF).tolist():
        c = chr(int(cp[k]))
        low[k], letter[k] = ord(c.lower()[0]), c.isalpha()
    return low, letter, at


def shapes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit shape symbols, document of each): runs of capitals are A, of other letters a, of digits 0."""
    _, letters, uppers = _fold_tables()
    cp, at = code_points(data, offs)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    c = np.where(cp > 0xFFFF, 0xFFFF, cp).astype(np.uint64)
    letter = letters[cp & 0xFFFF] & (cp <= 0xFFFF)
    c[letter] = 0x61
    c[letter & uppers[cp & 0xFFFF]] = 0x41
    c[(cp >= 0x30) & (cp <= 0x39)] = 0x30
    same = np.concatenate(([False], (c[1:] == c[:-1]) & (doc[1:] == doc[:-1]))) if len(c) else np.zeros(0, bool)
    keep = ~(same & ((c == 0x61) | (c == 0x41) | (c == 0x30)))
    return c[keep], doc[keep]
