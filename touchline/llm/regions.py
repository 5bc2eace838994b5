"""Exact search for long repeats by content-chosen anchors: the part that Spark partitions.

Every window (of so many words or bytes) picks one anchor inside itself by a rule on the window's
content alone, so equal windows pick equal anchors at equal places. Consecutive windows with one
pick form a region. All that two documents can share is then decided among regions of one anchor:

1. Tasks emit (anchor, region hash, document, place, windows, times): a row for about 15 words or 90
   bytes. Equal regions that follow each other at once, as in a run of one word or byte, are one row.
2. Anchors that occur once drop out (partial aggregation, then a join on the anchor).
3. Equal regions are decided as a whole. Of each distinct region one representative remains, and
   only anchors with several distinct regions need their windows compared.
4. Those windows are fetched from the texts and compared. The windows of an anchor are one shard of an
   index that the caller provides; a shard of more than MAX_INDEXED distinct regions is split further, to
   shards of one window each (anchor, window hash), for which equal keys are equal windows.

A document is known by its id and two 64-bit hashes of its text, so rows of one id with unlike texts stay
apart. A document without an id counts as one with the largest id. Rows of one id and text are one document
with a number of copies, see `one_of_each`: its regions are emitted and its text is fetched once.

No key stands for more than its equal regions or windows, groups are aggregated before and after the
shuffle, and joins on a hot anchor are ordinary sort-merge joins that adaptive execution can split.
Intermediate tables are written to the shared checkpoint folder, so lost executors cost tasks only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from ..sources.shared import materialised as shared_table
from .arrays import U64, chunks, mix, odd, signed, window_hash

MAX_INDEXED = 2048


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class RangeMin:
    """Leftmost smallest key of any range of an array."""

    def __init__(self, key: np.ndarray, longest: int):
        self.key, self.table = key, [np.arange(len(key), dtype=np.int32)]
        size = 1
        while size * 2 <= longest:
            t = self.table[-1]
            a, b = t[:-size], t[size:]
            self.table.append(np.where(key[a] <= key[b], a, b))
            size *= 2

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For ranges lo:hi, none empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level).tolist():
            on = np.flatnonzero(level == k)
            a, b = self.table[k][lo[on]], self.table[k][hi[on] - (1 << k)]
            out[on] = np.where(self.key[a] <= self.key[b], a, b)
        return out


def picks(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, candidate) that each window start picks.

    levels hold (from, to, key) of candidates in text order, most wanted level first; `from` and `to`
    do not fall. A window takes the smallest key of the first level with a candidate inside it.
    """
    level, which = np.full(len(window), -1, dtype=np.int8), np.zeros(len(window), dtype=np.int64)
    left = np.arange(len(window))
    for k, (start, end, key) in enumerate(levels):
        if not len(left):
            break
        lo, hi = np.searchsorted(start, window[left]), np.searchsorted(end, window[left] + size, side="right")
        some = lo < hi
        if some.any():
            on = left[some]
            lo, hi = lo[some], hi[some]
            # only the candidates that a window asks for
            change = np.bincount(lo, minlength=len(key) + 1)[: len(key)] - np.bincount(hi, minlength=len(key) + 1)[: len(key)]
            asked = np.cumsum(change) > 0
            own = np.flatnonzero(asked)
            place = np.concatenate(([0], np.cumsum(asked)))
            which[on] = own[RangeMin(key[own], int((hi - lo).max())).query(place[lo], place[hi])]
            level[on] = k
            left = left[~some]
    return level, which


class RangeHash:
    """Hash of any range of a symbol sequence by prefix sums."""

    BASE = int(odd(211, 1)[0])
    BACK = pow(BASE, -1, 1 << 64)
    _power = np.ones(1, dtype=U64)
    _inverse = np.ones(1, dtype=U64)

    @classmethod
    def _grown(cls, n: int) -> None:
        if len(cls._power) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                one = np.ones(1, dtype=U64)
                cls._power = np.cumprod(np.concatenate((one, np.full(n - 1, cls.BASE, dtype=U64))))
                cls._inverse = np.cumprod(np.concatenate((one, np.full(n - 1, cls.BACK, dtype=U64))))

    def __init__(self, symbols: np.ndarray):
        self._grown(len(symbols) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(symbols * self._power[: len(symbols)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self._inverse[start] + (end - start).astype(U64) * U64(self.BASE))


def regions(symbols: np.ndarray, first: np.ndarray, levels, size: int):
    """(document, place in the document, windows, anchor, region hash, times) of each region of a chunk.

    symbols are the word or byte hashes of all documents, first the offsets of the documents in them. A
    region that is there `times` times in a row has its windows again at each multiple of their number.
    """
    count = np.maximum(np.diff(first) - size + 1, 0)
    total = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(count)), count)
    window = np.arange(total[-1]) - np.repeat(total[:-1] - first[:-1], count)
    level, which = picks(levels, window, size)
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (level[1:] != level[:-1]) | (doc[1:] != doc[:-1]))) if len(window) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(window)))
    start, doc = window[head], doc[head]
    key = np.zeros(len(head), dtype=U64)
    for k, (_, _, keys) in enumerate(levels):
        on = level[head] == k
        # chunks can have different numbers of levels above the same ones
        key[on] = mix(keys[which[head][on]] + U64(len(levels) - k))
    content = RangeHash(symbols).of(start, start + n - 1 + size)
    fresh = np.ones(len(head), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (n[1:] != n[:-1])
    one = np.flatnonzero(fresh)
    times = np.diff(np.append(one, len(head)))
    return doc[one], start[one] - first[doc[one]], n[one], key[one], content[one], times


#: What a document is known by.
OWN = ["doc", "twin", "other"]


def known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list:
    """Columns (doc, twin, other): the id, or the largest long without one, and hashes that tell texts of one id apart."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("twin"), F.xxhash64(F.lit(7), F.col(text)).alias("other")]


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc, twin, other, text, copies): rows of one id and text are one row with their number.

    Only keys are counted; texts are shuffled for documents that do have copies, and aggregated before the shuffle.
    """
    keyed = docs.where(F.col("text").isNotNull()).select(*known(docs), "text")
    often = shared_table(keyed.groupBy(*OWN).agg(F.count("*").cast("int").alias("copies")).where("copies > 1"), "copies")
    if often.isEmpty():
        return keyed.withColumn("copies", F.lit(1))
    alone = keyed.join(often, OWN, "left_anti").withColumn("copies", F.lit(1))
    once = keyed.join(often.select(*OWN), OWN, "left_semi").groupBy(*OWN).agg(F.first("text").alias("text")).join(often, OWN)
    return alone.unionByName(once)


def repeats(docs: DataFrame, parse, size: int, keep_first: bool, unit: str, indexed=None) -> DataFrame:
    """(doc, twin, other, start, end): places of repeated windows of docs (doc_id long, text), by words or bytes.

    parse(chunk) gives (symbols, offsets of documents in them, levels). keep_first: a window repeats when
    a document with a smaller id has it; else when it starts anywhere else. indexed(rows) compares the
    windows of an anchor; without it all are compared by hash.
    """
    docs = one_of_each(docs)

    def emit(batches):
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(3)]
            copies = batch.column(4).to_numpy()
            for c in chunks(batch.column(3)):
                doc, at, n, key, content, times = regions(*parse(c), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(content)), *[pa.array(x[c.first + doc]) for x in own], *[pa.array(x.astype(np.int32)) for x in (at, n, times, copies[c.first + doc])]],
                    names=["anchor", "region", *OWN, "at", "n", "times", "copies"],
                )

    rows = shared_table(docs.mapInArrow(emit, "anchor long, region long, doc long, twin long, other long, at int, n int, times int, copies int"), f"{unit}-regions")
    if keep_first:
        often = rows.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    else:
        often = rows.groupBy("anchor").agg(F.sum(F.col("times") * F.col("copies")).alias("c")).where("c > 1")
    # a table of its own, so that both sides of the join are plain exchanges, which can be split when skewed
    often = shared_table(often.select("anchor"), f"{unit}-often")
    every, rows = rows, shared_table(rows.join(often, "anchor"), f"{unit}-shared")
    discard(every)
    own = F.min(F.struct(*OWN, "at", "n")).alias("own")
    distinct = shared_table(rows.groupBy("anchor", "region").agg(own, F.sum(F.col("times") * F.col("copies")).alias("c")), f"{unit}-distinct")
    several = shared_table(distinct.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), f"{unit}-several")
    # equal regions, as a whole
    if keep_first:
        equal = rows.join(distinct.select("anchor", "region", F.col("own.doc").alias("least")), ["anchor", "region"]).where("doc > least")
        query = rows.join(distinct.select("anchor", "region", F.col("own.doc").alias("least")), ["anchor", "region"]).where("doc = least")
        query = query.join(several, "anchor").select("anchor", *OWN, "at", "n", "k", F.lit(True).alias("ask"), (F.col("n") * (F.col("times") - 1)).alias("reach"))
    else:
        equal = rows.join(distinct.where("c > 1").select("anchor", "region"), ["anchor", "region"])
        query = distinct.join(several, "anchor").select("anchor", *[f"own.{k}" for k in OWN], "own.at", "own.n", "k", (F.col("c") == 1).alias("ask"), F.lit(0).alias("reach"))
    spans = equal.select(*OWN, F.col("at").alias("start"), (F.col("at") + F.col("n") * F.col("times") - 1 + size).alias("end"))
    # the windows of distinct regions
    query = shared_table(query, f"{unit}-query")
    places = query.groupBy(*OWN).agg(F.collect_list(F.struct("anchor", "at", "n", "k", "ask", "reach")).alias("places"))
    text = docs.join(places, OWN).select(*OWN, "text", "places")
    limit = MAX_INDEXED if indexed else 0

    def fetch(batches):
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(3)]
            lists = batch.column(4)
            for c in chunks(batch.column(3)):
                symbols, first, _ = parse(c)
                hashes = window_hash(symbols, size, 1)
                part = lists.slice(c.first, c.n)
                count = part.value_lengths().to_numpy(zero_copy_only=False)
                flat = part.flatten()
                doc = np.repeat(np.arange(c.n), count)
                anchor, at, n, k, ask, reach = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                at, n = at.astype(np.int64), n.astype(np.int64)
                few = k <= limit
                start = first[doc] + at
                whole = [bytes(c.data[a:b]) for a, b in zip(start[few].tolist(), (start + n - 1 + size)[few].tolist(), strict=True)] if few.any() else []
                w = ~few
                total = np.concatenate(([0], np.cumsum(n[w])))
                step = np.arange(total[-1]) - np.repeat(total[:-1], n[w])
                pick = np.repeat(np.flatnonzero(w), n[w])
                row = c.first + np.concatenate((doc[few], doc[pick]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((anchor[few], anchor[pick]))),
                        *[pa.array(x[row]) for x in own],
                        pa.array(np.concatenate((at[few], at[pick] + step)).astype(np.int32)),
                        pa.array(np.concatenate((ask[few], ask[pick])).astype(bool)),
                        pa.array(np.concatenate((reach[few], reach[pick])).astype(np.int32)),
                        pa.array(np.concatenate((np.zeros(int(few.sum()), np.int64), signed(hashes[start[pick] + step])))),
                        pa.array([*whole, *[None] * len(pick)], pa.binary()),
                    ],
                    names=["anchor", *OWN, "at", "ask", "reach", "hash", "content"],
                )

    got = shared_table(text.mapInArrow(fetch, "anchor long, doc long, twin long, other long, at int, ask boolean, reach int, hash long, content binary"), f"{unit}-windows")
    single = got.where(F.col("content").isNull())
    if keep_first:
        again = single.groupBy("anchor", "hash").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
        found = single.join(again, ["anchor", "hash"]).where("doc > a")
    else:
        again = single.groupBy("anchor", "hash").agg(F.count("*").alias("c")).where("c > 1")
        found = single.join(again, ["anchor", "hash"]).where("ask")
    spans = spans.unionByName(found.select(*OWN, F.col("at").alias("start"), (F.col("at") + F.col("reach") + size).alias("end")))
    if indexed:
        spans = spans.unionByName(indexed(got.where(F.col("content").isNotNull()).drop("hash", "reach")))
    return spans


def with_spans(docs: DataFrame, spans: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with an array `out` of (start, end) of each; a document's spans are as many as its regions at most."""
    keep = docs.columns
    names = [unused(docs, f"{x}_") for x in OWN]
    own = spans.groupBy(*OWN).agg(F.collect_list(F.struct("start", "end")).alias(out)).withColumnsRenamed(dict(zip(OWN, names, strict=True)))
    keyed = docs.withColumns(dict(zip(names, known(docs, doc_id, text), strict=True)))
    return keyed.join(own, names, "left").select(*keep, out)


def covered(lists: pa.Array, first: np.ndarray) -> np.ndarray:
    """Boolean per symbol of a chunk: inside a span of its document."""
    count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    base = np.repeat(first[:-1], count)
    start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + base for i in range(2))
    n = int(first[-1])
    change = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0
