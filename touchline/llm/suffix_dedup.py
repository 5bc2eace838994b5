"""Exact byte-substring deduplication with a run-length Burrows-Wheeler index.

Windows of WINDOW bytes that start anywhere else too (in the same document or in another) lose
their bytes. Texts are routed by content first, see `regions`: a window's anchor is the smallest
sampled hash of its GRAM-byte substrings, so all occurrences of a window meet under one anchor, and
only regions with a shared anchor and different surroundings reach an index.

The index of a shard of regions is a suffix order and the runs of its Burrows-Wheeler transform. The
length that a suffix shares with its predecessor in that order is computed at run heads, with its
successor at run tails: these are the samples. Between samples it falls by one for each byte, which
streams the matching statistics along the text. Where they reach WINDOW the window is repeated.

The shard of an anchor with very many distinct regions (a passage in very many surroundings) is split to
one shard for each window, so no task holds such a group; its key, anchor and hash of the window, is then
all that an index could tell. Equal regions are one text of the index, and repeats of each other.

Defined cases: null and short texts lose nothing; equal rows are repeats of each other; a text of one
repeated byte is a repeat of itself, however long; rows of one id with unlike texts are judged each by its
own text, and so are rows without an id; very long texts are read whole, one at a time in a task; an
empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Chunk, chunks, mix, window_hash
from .regions import OWN, covered, repeats, with_spans

WINDOW = 200
GRAM = 40
#: One of so many substrings is sampled as an anchor.
SAMPLED = 16
SHARD_BYTES = 1 << 20
_BYTE = mix(np.arange(256, dtype=U64) + U64(77))


def parse(c: Chunk):
    """Byte hashes, offsets, and candidate anchors: sampled substrings, then all of them."""
    symbols = _BYTE[c.data]
    h = window_hash(symbols, GRAM)
    at = np.arange(len(h))
    doc = np.repeat(np.arange(c.n), np.diff(c.offs))[: len(h)]
    inside = at + GRAM <= c.offs[doc + 1]
    at, h = at[inside], h[inside]
    sampled = (h & U64(SAMPLED - 1)) == 0
    return symbols, c.offs, [(at[sampled], at[sampled] + GRAM, h[sampled]), (at, at + GRAM, h)]


class RunLengthIndex:
    """Suffix order, transform runs and sampled run ends of a byte sequence with breaks after each text."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        n = int((size + 1).sum())
        breaks = np.zeros(n, dtype=bool)
        breaks[self.start + size] = True
        data = np.zeros(n, dtype=np.int32)
        data[~breaks] = np.frombuffer(b"".join(texts), dtype=np.uint8)
        # prefix doubling; a break compares by its place and ends every comparison
        rank = np.where(breaks, np.cumsum(breaks) - 1, data + len(texts)).astype(np.int32)
        self.ranks = [rank]
        step = 1
        while True:
            second = np.zeros(n, dtype=np.int64)
            second[: n - step] = rank[step:] + np.int64(1)
            key = rank.astype(np.int64) * (int(rank.max()) + 2) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1]))).astype(np.int32)
            rank = np.empty(n, dtype=np.int32)
            rank[order] = fresh
            step *= 2
            if int(fresh[-1]) == n - 1 or step >= n:
                break
            self.ranks.append(rank)
        self.order, self.n = order, n
        bwt = np.where(breaks, -1 - np.cumsum(breaks), data)[order - 1]
        self.heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.tails = np.append(self.heads[1:], n) - 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ok = (a < self.n) & (b < self.n)
            same = np.zeros(len(a), dtype=bool)
            same[ok] = self.ranks[k][a[ok]] == self.ranks[k][b[ok]]
            grow = same.astype(np.int64) << k
            a, b, out = a + grow, b + grow, out + grow
        return out

    def statistics(self) -> np.ndarray:
        """For each place the longest match that also starts at another place."""
        out = np.zeros(self.n, dtype=np.int64)
        for row, other in ((self.heads[self.heads > 0], -1), (self.tails[self.tails < self.n - 1], 1)):
            sample = np.full(self.n, -1, dtype=np.int64)
            sample[self.order[row]] = self.common(self.order[row], self.order[row + other])
            edge = self.order[0] if other < 0 else self.order[-1]
            sample[edge] = 0
            last = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), 0))
            out = np.maximum(out, np.maximum(sample[last], 0) - (np.arange(self.n) - last))
        return out


def _indexed(rows: DataFrame) -> DataFrame:
    """(doc, twin, other, start, end) of repeated windows among rows (anchor, those, at, ask, content), an anchor in one task."""

    def search(part: pa.Table):
        text = part.column("content").to_pylist()
        index = RunLengthIndex(text)
        far = index.statistics() >= WINDOW
        ask = np.array(part.column("ask").to_pylist(), dtype=bool)
        owner = np.repeat(np.arange(len(text)), np.diff(np.append(index.start, index.n)))
        place = np.flatnonzero(far & ask[owner])
        owner, step = owner[place], place - index.start[owner[place]]
        # runs of windows become one span
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))) if len(place) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(place))[: len(head)] - 1
        at = part.column("at").to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(part.column(k).to_numpy()[owner[head]]) for k in OWN], pa.array((at[owner[head]] + step[head]).astype(np.int32)), pa.array((at[owner[head]] + step[tail] + WINDOW).astype(np.int32))],
            names=[*OWN, "start", "end"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                held.append(batch.slice(k, 1000))
                size += held[-1].nbytes
                if size >= 2 * SHARD_BYTES:
                    table = pa.Table.from_batches(held)
                    # an anchor is never cut: its rows are together, the last one may go on
                    anchor = table.column("anchor").to_numpy()
                    cut = int(np.searchsorted(anchor, anchor[-1]))
                    yield from pieces(table.slice(0, cut))
                    held, size = [b for b in table.slice(cut).to_batches() if b.num_rows], 0
        if held:
            yield from pieces(pa.Table.from_batches(held))

    def pieces(table: pa.Table):
        if not table.num_rows:
            return
        anchor = table.column("anchor").to_numpy()
        total = np.cumsum(np.array([len(x) for x in table.column("content").to_pylist()]))
        at = 0
        while at < len(anchor):
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + SHARD_BYTES, side="right"))
            to = max(to, at + 1)
            if to < len(anchor):
                back = int(np.searchsorted(anchor, anchor[to]))
                to = back if back > at else int(np.searchsorted(anchor, anchor[to], side="right"))
            yield search(table.slice(at, to - at))
            at = to

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc long, twin long, other long, start int, end int")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, twin, other, start, end): byte ranges to remove, they may overlap; see `regions.known`."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return repeats(plain, parse, WINDOW, False, "bytes", _indexed)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                gone = covered(batch.column(2).slice(c.first, c.n), c.offs)
                total = np.concatenate(([0], np.cumsum(gone)))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[c.offs[:-1][c.offs[:-1] < len(gone)]] = gone[c.offs[:-1][c.offs[:-1] < len(gone)]]
                runs = np.concatenate(([0], np.cumsum(begins)))
                kept = memoryview(c.data[~gone])
                offs = c.offs - total[c.offs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.n),
                        pa.array(np.diff(c.offs).astype(np.int64)),
                        pa.array(np.diff(total[c.offs]).astype(np.int64)),
                        pa.array(np.diff(runs[c.offs]).astype(np.int64)),
                        pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return with_spans(plain, spans(plain), "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
