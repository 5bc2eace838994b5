"""Best-fit packing of token sequences by linear grouping.

A document is its ids and a closing id. A longer one than a sequence is cut from its end into whole sequences, so only its
first piece may be shorter. Which pieces share a sequence depends on their lengths alone, of which there are at most as many
as a sequence has tokens:

1. Tasks encode whole texts, cut them, and number the pieces of each length within the task. The counts by length, at most
   `width` rows at any size of the corpus, go to the driver, which plans with multiplicities:
   a. lengths above a share of the width are large. In falling order they are dealt into groups of equal cardinality, and
      each is rounded up to the largest length of its group;
   b. the few rounded sizes are packed by whole configurations: the linear programme of configurations is solved by column
      generation (a knapsack over the width prices each next configuration) and rounded down;
   c. actual lengths take the places of their group in order of length, which gives runs of sequences alike in every place;
   d. what rounding left over and all small pieces go, largest first, to the tightest gap that holds them, and open a
      sequence where none does.
   How many lengths are large decides how much is left to fill gaps with, so the plan is made for each of SETTINGS and the
   one with the fewest sequences is used.
2. Counts of (task, length), summed over the tasks before, turn the number within a task into a rank among all pieces of
   that length, without a window over pieces; the plan, whose size is bounded by the width, maps (length, rank) to a
   sequence and an offset inside tasks.

Defined cases: null and empty text is the closing id alone; an empty table gives no pieces; repeated rows and rows without an
id are packed each for itself; ties in length go by place in the table; columns called piece, start, length, ids, sequence_id
or offset are replaced, all others pass through; a very long text is encoded whole and is as many pieces as it needs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks
from .byte_bpe import model
from .regions import shared_table, unused

WIDTH = 2048
#: (share, groups): lengths above width / share are large, and are dealt into so many groups.
SETTINGS = ((3, 512), (8, 96))
CLOSING_ID = 0
CHUNK = 1 << 20
_EPS = 1e-9


def best_configuration(sizes: np.ndarray, worth: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits into the width: a knapsack over all capacities."""
    best = np.zeros(width + 1)
    took = np.zeros((len(sizes), width + 1), dtype=np.int16)
    for g in np.flatnonzero(worth > _EPS).tolist():
        s, base = int(sizes[g]), best.copy()
        for j in range(1, width // s + 1):
            value = base[: width + 1 - j * s] + j * worth[g]
            better = value > best[j * s :] + 1e-12
            best[j * s :][better] = value[better]
            took[g, j * s :][better] = j
    out, left = np.zeros(len(sizes), dtype=np.int64), width
    for g in range(len(sizes) - 1, -1, -1):
        out[g] = took[g, left]
        left -= int(out[g] * sizes[g])
    return float(best[width]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(times, places of each size) of a rounded-down optimum of the linear programme of configurations.

    Column generation with the inverse of the basis updated by pivots; every basis has as many configurations
    as there are sizes.
    """
    n = len(sizes)
    columns = np.diag(width // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(40 * n + 200):
        value, column = best_configuration(sizes, inverse.sum(axis=0), width)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        up = step > _EPS
        if not up.any():
            break
        ratio = np.full(n, np.inf)
        ratio[up] = np.maximum(amount[up], 0) / step[up]
        out = int(ratio.argmin())
        amount -= ratio[out] * step
        amount[out] = ratio[out]
        columns[:, out] = column
        inverse[out] /= step[out]
        rest = np.arange(n) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
    left, found = demand.copy(), []
    for k in np.argsort(-amount, kind="stable").tolist():
        column = columns[:, k].astype(np.int64)
        # no more than is left, should rounding errors have added up
        times = int(min(np.floor(amount[k] + 1e-6), *(left[column > 0] // column[column > 0])))
        if times > 0:
            found.append((times, column))
            left = left - times * column
    return found


@dataclass
class Run:
    """Sequences alike: how many, and how often each length stands in one of them."""

    times: int
    lengths: dict[int, int]

    def gap(self, width: int) -> int:
        return width - sum(n * k for n, k in self.lengths.items())


def _substituted(queues: list[list[list[int]]], times: int, column: np.ndarray) -> list[Run]:
    """Runs of one configuration: its places filled with the next actual lengths of their groups."""
    slots = []
    for g in np.flatnonzero(column).tolist():
        for _ in range(int(column[g])):
            part, need = [], times
            while need:
                length, n = queues[g][-1]
                use = min(n, need)
                part.append((length, use))
                need -= use
                if use == n:
                    queues[g].pop()
                else:
                    queues[g][-1][1] -= use
            slots.append(part)
    cuts = sorted({0, *(c for part in slots for c in np.cumsum([n for _, n in part]).tolist())})
    runs, at = [], [0] * len(slots)
    ends = [np.cumsum([n for _, n in part]).tolist() for part in slots]
    for a, b in zip(cuts, cuts[1:], strict=False):
        lengths: dict[int, int] = {}
        for k, part in enumerate(slots):
            while ends[k][at[k]] <= a:
                at[k] += 1
            lengths[part[at[k]][0]] = lengths.get(part[at[k]][0], 0) + 1
        runs.append(Run(b - a, lengths))
    return runs


def _best_fit(runs: list[Run], rest: np.ndarray, width: int) -> list[Run]:
    """runs with the rest (count of each length) put into the tightest gaps, largest lengths first."""
    by_gap: list[list[Run]] = [[] for _ in range(width + 1)]
    some = np.zeros(width + 1, dtype=bool)

    def put(run: Run) -> None:
        g = run.gap(width)
        by_gap[g].append(run)
        some[g] = True

    for run in runs:
        put(run)
    for length in np.flatnonzero(rest)[::-1].tolist():
        n = int(rest[length])
        while n:
            gap = length + int(some[length:].argmax())
            run = by_gap[gap].pop() if some[gap] else Run(-(-n // (width // length)), {})
            gap = run.gap(width)
            some[gap] = bool(by_gap[gap])
            each = gap // length
            # as many sequences as can be filled with this length, or one that takes what is left of it
            take, each = (min(run.times, n // each), each) if n >= each else (1, n)
            put(Run(take, run.lengths | {length: run.lengths.get(length, 0) + each}))
            if run.times > take and run.lengths:
                put(Run(run.times - take, run.lengths))
            n -= take * each
    return [run for g in by_gap for run in g]


def plan(count: np.ndarray, width: int = WIDTH, settings: tuple[tuple[int, int], ...] = SETTINGS) -> list[Run]:
    """Runs of sequences that hold count[n] pieces of each length n, for all n up to the width."""
    least = -(-int((count * np.arange(width + 1)).sum()) // width)
    best, most = [], None
    for share, groups in settings:
        runs = _planned(count, width, share, groups)
        n = sum(r.times for r in runs)
        if most is None or n < most:
            best, most = runs, n
        if most == least:
            break
    return best


def _planned(count: np.ndarray, width: int, share: int, groups: int) -> list[Run]:
    rest = np.array(count, dtype=np.int64)
    large = np.arange(width, width // share, -1)
    amount = rest[large]
    total = int(amount.sum())
    runs: list[Run] = []
    if total:
        # groups of equal cardinality in falling order; a length can be in several
        queues: list[list[list[int]]] = []
        sizes: list[int] = []
        edge = [total * (g + 1) // groups for g in range(groups)]
        done = g = 0
        fresh = True
        for length, n in zip(large.tolist(), amount.tolist(), strict=True):
            while n:
                while done >= edge[g]:
                    g, fresh = g + 1, True
                use = min(n, edge[g] - done)
                if fresh and not (sizes and sizes[-1] == length):
                    sizes.append(length)
                    queues.append([])
                fresh = False
                queues[-1].append([length, use])
                done += use
                n -= use
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=np.int64)
        for times, column in configurations(np.array(sizes), demand, width):
            runs += _substituted(queues, times, column)
        rest[large] = 0
        for q in queues:
            for length, n in q:
                rest[length] += n
    return _best_fit(runs, rest, width)


class Places:
    """Sequence and offset of the rank-th piece of a length, under a plan."""

    def __init__(self, runs: list[Run]):
        rows, first, used = [], 0, {}
        for run in runs:
            offset = 0
            for length in sorted(run.lengths, reverse=True):
                each = run.lengths[length]
                rows.append((length, used.get(length, 0), each, first, offset))
                used[length] = used.get(length, 0) + each * run.times
                offset += each * length
            first += run.times
        rows.sort()
        self.sequences = first
        self.length, self.base, self.each, self.first, self.offset = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(5))
        self.key = (self.length << 48) | self.base

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | rank, side="right") - 1
        past = rank - self.base[at]
        return self.first[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


def _without(docs: DataFrame, names: list[str]) -> list[str]:
    gone = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in gone]


OUT = ["piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]


def pieces(docs: DataFrame, path: str, *, text: str = "text", width: int = WIDTH, with_ids: bool = True) -> DataFrame:
    """Rows of docs by piece: piece, start, length, ids_crc32, and ids where wanted; columns _task and _nth number them.

    The text itself is not carried on.
    """
    keep = [c for c in _without(docs, OUT) if c != text]
    task, nth = unused(docs, "_task"), unused(docs, "_nth")

    def run(batches):
        m = model(path, False)
        own, seen = TaskContext.get().partitionId(), np.zeros(width + 1, dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column(len(keep)), CHUNK):
                rows = batch.slice(c.first, c.n)
                ids, count = m.encode(c.data, c.offs)
                total = np.concatenate(([0], np.cumsum(count + 1)))
                flat = np.full(total[-1], CLOSING_ID, dtype=np.uint32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(c.n), count)] = ids
                size = count + 1
                n = -(-size // width)
                doc = np.repeat(np.arange(c.n), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (size - (n - 1) * width)[doc]
                start = np.where(piece > 0, head + (piece - 1) * width, 0)
                length = np.where(piece > 0, width, head)
                # number among the pieces of this length in the task
                order = np.argsort(length, kind="stable")
                group = np.searchsorted(length[order], length[order])
                place = np.empty(len(doc), dtype=np.int64)
                place[order] = seen[length[order]] + np.arange(len(doc)) - group
                seen += np.bincount(length, minlength=width + 1)
                at = total[:-1][doc] + start
                raw = flat.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                out = [rows.column(k).take(pa.array(doc)) for k in range(len(keep))]
                out += [pa.array(np.full(len(doc), own, dtype=np.int64)), pa.array(place), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, total[-1]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    whole = [(task, T.LongType()), (nth, T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    whole += [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    names = [*keep, *(k for k, _ in whole)]
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(k, kind) for k, kind in whole])
    return docs.select(*keep, text).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, text: str = "text", width: int = WIDTH, with_ids: bool = True) -> DataFrame:
    """Pieces of docs with sequence_id and offset."""
    task, nth, rank = unused(docs, "_task"), unused(docs, "_nth"), unused(docs, "_before")
    rows = shared_table(pieces(docs, path, text=text, width=width, with_ids=with_ids), "pieces")
    shares = shared_table(rows.groupBy(task, "length").agg(F.count("*").alias("n")), "piece-counts")
    count = np.zeros(width + 1, dtype=np.int64)
    # a row for each length
    for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():
        count[r["length"]] = r["n"]
    places = Places(plan(count, width))
    # a row for each task in a window
    before = Window.partitionBy("length").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(task, "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(rank))
    rows = rows.join(shares, [task, "length"]).withColumn(rank, F.col(rank) + F.col(nth)).drop(task, nth)
    own = [c for c in rows.columns if c != rank]

    def run(batches):
        for batch in batches:
            length, nth_of_all = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", rank))
            sequence, offset = places.of(length, nth_of_all)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in own] + [pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    schema = T.StructType([rows.schema[k] for k in own] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order; one holds at most the width of a sequence."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def report(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: where it came from, its length and checksum, its sequence and offset."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return pack(plain, path, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
