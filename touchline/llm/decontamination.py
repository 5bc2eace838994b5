"""Benchmark decontamination by an FM-index per shard of the training text.

The windows of all benchmark items (WINDOW consecutive words; an item with fewer is one window) are
the test phrases. A shard is a run of whole documents within a task. Its text is the sequence of word
numbers, where words outside the benchmark are breaks; only stretches that are long enough for a
window are indexed. The index is the Burrows-Wheeler transform of that sequence as a wavelet matrix,
the first-column counts and suffix positions sampled every SAMPLE places. All phrases are searched
backward together; occurrences are located by walking to the next sampled position; their word
ranges are merged into removal spans.

The benchmark travels with the tasks in blocks of whole items of about MAX_BENCHMARK_BYTES, which give
arrays of at most 20 bytes a byte of text. Each block scans the documents; the findings of several blocks
are written one after the other, so that one block at a time is on the driver, and merged by row. For
that each row gets a key of its own, so equal ids stay apart.

Defined cases: null texts have no words and no hits; an item without words has no window; windows
shared by several items count for each of them; overlapping spans are merged; repeated rows, and rows of one
id with unlike texts, give a result each; very long texts are a shard of their own; an empty benchmark or
table gives no hits or no rows; an item without an id cannot be named, so its windows count as hits but it is
not among the items; other columns are kept by `clean`, whatever their names, and dropped by `find`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ALNUM, LOWER, Chunk, chunks, words
from .regions import shared_table, unused

WINDOW = 10
SAMPLE = 8
MAX_BENCHMARK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20


class Wavelet:
    """Wavelet matrix of a number sequence: rank of any symbol before any place, for arrays of both."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(symbol), dtype=np.int64), place.astype(np.int64)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; a break (0) compares by its place, so no match crosses it."""
    n = len(seq)
    breaks = seq == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, seq + int(breaks.sum())).astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max()) + 2 if n else 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over a sequence whose last symbol is a break."""

    def __init__(self, seq: np.ndarray, symbols: int):
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.wavelet = Wavelet(self.bwt, symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        # stretches begin with a sample, so no walk leads through a break, whose suffixes go by place
        mark = (order % SAMPLE == 0) | (self.bwt == 0)
        self.mark, self.rows = mark, np.cumsum(mark) - 1
        self.sampled = order[mark]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase; phrases are padded at the end to one width."""
        lo, hi = np.zeros(len(size), dtype=np.int64), np.full(len(size), len(self.bwt), dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((size > k) & (lo < hi))
            c = phrases[on, k]
            lo[on], hi[on] = self.first[c] + self.wavelet.rank(c, lo[on]), self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        row, steps = row.copy(), np.zeros(len(row), dtype=np.int64)
        left = np.flatnonzero(~self.mark[row])
        while len(left):
            c = self.bwt[row[left]]
            row[left] = self.first[c] + self.wavelet.rank(c, row[left])
            steps[left] += 1
            left = left[~self.mark[row[left]]]
        return self.sampled[self.rows[row]] + steps


class Phrases:
    """Distinct windows of benchmark items and the items that have each."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        raw = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        w = words(Chunk(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), None, 0), ALNUM, LOWER[data])
        self.vocabulary = np.unique(w.hash)
        number = (np.searchsorted(self.vocabulary, w.hash) + 1).astype(np.int32)
        count = np.diff(w.first)
        many = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        owner = np.repeat(np.arange(len(items)), many)
        start = np.repeat(w.first[:-1], many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(count, window)[owner]
        # windows of fewer words are filled up with 0, which is no word
        place = start[:, None] + np.arange(window)
        rows = np.where(np.arange(window) < size[:, None], np.append(number, 0)[np.minimum(place, len(number))], 0).astype(np.int32)
        if len(rows):
            self.rows, first, phrase = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            self.size = size[first]
            # an item without an id has windows, but cannot be named
            named = np.array([i is not None for i, _ in items])[owner]
            number = np.array([i or 0 for i, _ in items], dtype=np.int64)[owner]
            pair = np.unique(np.stack((phrase.reshape(-1)[named], number[named]), axis=1), axis=0)
            self.item_ids, self.item_offs = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(self.rows) + 1))
        else:
            self.rows, self.size, self.item_ids, self.item_offs = rows, size, np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.least = int(self.size.min()) if len(self.size) else 0
        self.symbols = len(self.vocabulary) + 1

    def items_of(self, phrase: int) -> list[int]:
        return self.item_ids[self.item_offs[phrase] : self.item_offs[phrase + 1]].tolist()

    def hits(self, c: Chunk):
        """(words of the chunk, document and word range of every occurrence, its phrase)."""
        w = words(c, ALNUM, LOWER[c.data])
        none = np.zeros(0, dtype=np.int64)
        if not len(self.size) or not len(w.hash):
            return w, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == w.hash
        # stretches of known words of one document, long enough for the shortest phrase
        joined = np.concatenate(([False], known[:-1] & known[1:] & (w.doc[:-1] == w.doc[1:])))
        run = np.cumsum(~joined)
        use = known & (np.bincount(run, minlength=1)[run] >= self.least)
        place = np.flatnonzero(use)
        if not len(place):
            return w, none, none, none
        cut = np.flatnonzero(run[place[1:]] != run[place[:-1]]) + 1
        seq = np.append(np.insert(at[place] + 1, cut, 0), 0)
        word = np.append(np.insert(place, cut, -1), -1)
        index = FMIndex(seq, self.symbols)
        lo, hi = index.search(self.rows, self.size)
        many = hi - lo
        phrase = np.repeat(np.arange(len(many)), many)
        row = np.repeat(lo, many) + np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
        start = word[index.locate(row)]
        return w, start, start + self.size[phrase], phrase


def _merged(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Boolean per word: inside a range."""
    change = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SPAN = "array<struct<start:long,end:long,first:long,last:long>>"
_ADDED = {"n_words": "long", "spans": _SPAN, "items": "array<long>"}


def _added(docs: DataFrame) -> list[str]:
    """Names of the columns of _ADDED that docs has no column of."""
    return [unused(docs, k) for k in _ADDED]


def _scanned(docs: DataFrame, phrases: Phrases, text: str, added: list[str]) -> DataFrame:
    """docs with n_words, spans and items of their own rows under the names `added`."""
    keep = docs.columns

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(batch.schema.get_field_index(text)), SHARD_BYTES):
                w, start, end, phrase = phrases.hits(c)
                items: list[set[int]] = [set() for _ in range(c.n)]
                pair = np.unique(w.doc[start] * max(1, len(phrases.size)) + phrase) if len(start) else start
                for k in pair.tolist():
                    items[k // len(phrases.size)].update(phrases.items_of(k % len(phrases.size)))
                spans: list[list[dict]] = [[] for _ in range(c.n)]
                mask = _merged(start, end, len(w.hash))
                # spans end at document ends, as occurrences never cross them
                lead = np.zeros(len(mask) + 1, dtype=bool)
                lead[w.first] = True
                inside = mask & ~lead[: len(mask)]
                a = np.flatnonzero(mask & ~np.concatenate(([False], mask[:-1] & inside[1:]))) if len(mask) else mask
                b = np.flatnonzero(mask & ~np.concatenate((mask[1:] & inside[1:], [False]))) if len(mask) else mask
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    d = int(w.doc[i])
                    spans[d].append({"start": int(w.start[i] - c.offs[d]), "end": int(w.end[j] - c.offs[d]), "first": i - int(w.first[d]), "last": j + 1 - int(w.first[d])})
                rows = batch.slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows.column(rows.schema.get_field_index(k)) for k in keep],
                        pa.array(np.diff(w.first).astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "end", "first", "last")]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    ],
                    names=[*keep, *added],
                )

    fields = [T.StructField(k, T._parse_datatype_string(kind)) for k, kind in zip(added, _ADDED.values(), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def _with_spans(docs: DataFrame, bench: DataFrame, text: str, window: int, block_bytes: int, added: list[str]) -> DataFrame:
    """docs with the columns of _ADDED under the names `added`, merged over all blocks of the benchmark (item_id, text)."""
    size = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))

    def phrases(block: int) -> Phrases:
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        return Phrases([(r["item_id"], r["text"]) for r in part.collect()], window)

    if blocks == 1:
        return _scanned(docs, phrases(0), text, added)
    # the rows' own keys are written once, so that all blocks and the join see the same ones
    row = unused(docs, "row_")
    keyed = shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts, found = keyed.select(F.col(row).alias("row"), F.col(text).alias("text")), None
    for block in range(blocks):
        part = shared_table(_scanned(texts, phrases(block), "text", list(_ADDED)).drop("text"), "block")
        found = part if found is None else found.unionByName(part)
    # one row for each row of docs and block: a bounded group
    found = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "spans",
        F.array().cast(_SPAN),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                        F.element_at(acc, -1)["first"].alias("first"),
                        F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.withColumn("spans", joined).withColumnsRenamed({"row": row, **dict(zip(_ADDED, added, strict=True))})
    return keyed.join(found, row).select(*docs.columns, *added)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans (byte and word ranges to remove) and items.

    A span is half open: bytes start:end of the UTF-8 text, words first:last.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    return _with_spans(plain, bench, "text", window, block_bytes, list(_ADDED)).drop("text")


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return find(docs, benchmark, **names).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs with the removal spans of `find` cut from the text, each with the gap before the next word."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    keep, added = docs.columns, _added(docs)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lists = batch.column(batch.schema.get_field_index(added[1]))
            for c in chunks(column, SHARD_BYTES):
                out = column.slice(c.first, c.n).cast(pa.string())
                own = lists.slice(c.first, c.n)
                span = own.flatten()
                if len(span):
                    w = words(c, ALNUM, LOWER[c.data])
                    lead = w.first[np.repeat(np.arange(c.n), own.value_lengths().to_numpy(zero_copy_only=False))]
                    mask = _merged(lead + span.field("first").to_numpy(), lead + span.field("last").to_numpy(), len(w.hash))
                    cut = np.zeros(len(c.data) + 1, dtype=np.int64)
                    # from each removed word to the end of the gap before the next word of its document
                    nxt = np.append(w.start[1:], len(c.data))
                    gone = np.flatnonzero(mask)
                    np.add.at(cut, w.start[gone], 1)
                    np.add.at(cut, np.minimum(nxt[gone], c.offs[w.doc[gone] + 1]), -1)
                    stay = np.cumsum(cut[:-1]) == 0
                    offs = np.concatenate(([0], np.cumsum(stay)))[c.offs]
                    out = pa.LargeStringArray.from_buffers(c.n, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(c.data[stay].tobytes())).cast(pa.string())
                    out = pa.array([v if ok else None for v, ok in zip(out.to_pylist(), c.valid.tolist(), strict=True)], pa.string()) if not c.valid.all() else out
                rows = batch.slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays([out if k == text else rows.column(rows.schema.get_field_index(k)) for k in keep], names=keep)

    found = _with_spans(docs, bench, text, window, block_bytes, added)
    return found.mapInArrow(run, T.StructType(docs.schema.fields))
