"""Substring deduplication by recompression: words of a long repeat stay in its first document only.

Rounds name runs and pairs of symbols, beginning with the words. A run of equal symbols gets one
name. Then every symbol is on the left or right side by its hash, and each left-right pair gets one
name. A name is the hash of what it names, so it is global without a dictionary or a round trip, and
equal substrings have equal names inside, up to a margin at their ends. For every symbol the stretch of
words that fixes its name is kept. Rounds go on until no stretch is shorter than a third of a window, so
that most windows around a symbol can pick it.

A window of WINDOW words picks the highest symbol whose stretch lies inside it; of one level, that with
the smallest hash of its name and its neighbours' names one level below. Spark brings together the
windows that picked one name: a name that is in one document alone ends the search for all its windows, a
shared one reveals a repeat, and the windows around it are verified by a hash of all their words, see `regions`.

A word goes when a window over it also starts in a document with a smaller id; windows are judged on
the input. Of rows with equal ids none has a smaller id, so none loses words to the other; a row without
an id counts as one with the largest id.

Defined cases: null, empty or short texts keep all their words; overlapping windows are united; one
word repeated many times is a run, however long; rows of one id with unlike texts are judged each by its
own text; very long texts are read whole, one at a time in a task; an empty table gives an empty table;
`clean` keeps other columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import SPACED, U64, Chunk, chunks, joined_words, mix, odd, words
from .regions import covered, repeats, unused, with_spans

WINDOW = 50
_A, _B, _C = odd(301, 3)


def recompress(symbol: np.ndarray, doc: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, key) of the symbols of each level whose stretch has at most `longest` words, highest level first.

    from:to are the words that fix a symbol's name; those at the ends of a document have none. The key is
    the hash of the name and of the names beside it one level below.
    """
    n = len(symbol)
    start, end = np.arange(n), np.arange(1, n + 1)
    known = np.ones(n, dtype=bool)
    out = [(start, end, symbol)]
    r = 0
    while len(symbol) > 1:
        r += 1
        equal = (doc[1:] == doc[:-1]) & (symbol[1:] == symbol[:-1])
        # the side of a run is that of its symbol, so that it depends on no more than one neighbour
        left = (mix(symbol + U64(0x51ED * r)) & U64(1)).astype(bool)
        head = np.flatnonzero(np.concatenate(([True], ~equal)))
        tail = np.append(head[1:], len(symbol)) - 1
        with np.errstate(over="ignore"):
            size = (tail - head + 1).astype(U64)
            name = np.where(size > 1, mix(symbol[head] * _A + size * _C), symbol[head])
        left, own = left[head], doc[head]
        pair = np.append(left[:-1] & ~left[1:] & (own[1:] == own[:-1]), False)
        second = np.concatenate(([False], pair[:-1]))
        with np.errstate(over="ignore"):
            both = mix(name * _A + np.append(name[1:], U64(0)) * _B)
        name = np.where(pair, both, name)[~second]
        last = np.where(pair, np.append(tail[1:], 0), tail)[~second]
        first = head[~second]
        # stretch: from the neighbour before the first member to the neighbour after the last
        inside = (first > 0) & (last < len(symbol) - 1)
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(symbol) - 1)
        inside &= (doc[before] == doc[first]) & (doc[after] == doc[first])
        known_next = inside & known[before] & known[after]
        with np.errstate(over="ignore"):
            key = mix(symbol[before] * _A + name * _B + symbol[after] * _C)
        start, end, symbol, doc, known = start[before], end[after], name, doc[first], known_next
        fits = known & (end - start <= longest)
        if not fits.any():
            break
        out.append((start[fits], end[fits], key[fits]))
    return out[::-1]


def parser(window: int):
    """Words, offsets and levels of symbols for windows of so many words."""

    def parse(c: Chunk):
        w = words(c, SPACED)
        return w.hash, w.first, recompress(w.hash, w.doc, max(1, window // 3))

    return parse


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, twin, other, start, end): word ranges to remove, they may overlap; see `regions.known`."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return repeats(plain, parser(window), window, True, "words")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    import hashlib

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                w = words(c, SPACED)
                gone = covered(batch.column(2).slice(c.first, c.n), w.first)
                out, offs = joined_words(c, w, ~gone)
                view = memoryview(out)
                total = np.concatenate(([0], np.cumsum(gone)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.n),
                        pa.array(np.diff(w.first).astype(np.int64)),
                        pa.array(np.diff(total[w.first]).astype(np.int64)),
                        pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return with_spans(plain, spans(plain, window=window), "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, any other columns) with the removed words cut from the text."""
    keep, added = docs.columns, unused(docs, "spans_")
    found = with_spans(docs, spans(docs, window=window), added)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            lists = batch.column(batch.schema.get_field_index(added))
            for c in chunks(column):
                w = words(c, SPACED)
                gone = np.flatnonzero(covered(lists.slice(c.first, c.n), w.first))
                out = column.slice(c.first, c.n).cast(pa.string())
                if len(gone):
                    # a removed word goes with the gap behind it
                    behind = np.minimum(np.append(w.start[1:], len(c.data))[gone], c.offs[w.doc[gone] + 1])
                    cut = np.bincount(w.start[gone], minlength=len(c.data) + 1) - np.bincount(behind, minlength=len(c.data) + 1)
                    stay = np.cumsum(cut[:-1]) == 0
                    offs = np.concatenate(([0], np.cumsum(stay)))[c.offs].astype(np.int64)
                    out = pa.LargeStringArray.from_buffers(c.n, pa.py_buffer(offs.tobytes()), pa.py_buffer(c.data[stay].tobytes())).cast(pa.string())
                    out = pa.array([v if ok else None for v, ok in zip(out.to_pylist(), c.valid.tolist(), strict=True)], pa.string()) if not c.valid.all() else out
                rows = batch.slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays([out if k == "text" else rows.column(rows.schema.get_field_index(k)) for k in keep], names=keep)

    return found.mapInArrow(run, T.StructType(docs.schema.fields))
