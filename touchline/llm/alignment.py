"""Alignment of two tokenizers' ids by the bytes they stand for, with corpus-wide counts of linked pairs.

A is a byte-level BPE over a space and the text, B a sentence-piece BPE that adds the space itself. Where both end a token
at one byte, a group ends; two tokens are linked where their bytes overlap.

1. Tasks encode whole texts with both and mark token ends in one flat byte array for each chunk of texts; groups and links
   are read off the marks. An array of the A vocabulary names the B id with the same bytes (the identity map): groups of one
   A id and its own B id are counted in a vector of that length, and only other links are counted as pairs. A block (one
   chunk of texts) is one row with its documents, its distinct pairs and its share of counts.
2. Counts of pairs meet in one shuffle, pre-aggregated by block. Vectors are summed by id; two vectors of vocabulary length,
   count of each identity pair and highest count of each B id, are all that the driver holds.
3. Each block asks for the counts of its distinct pairs (a join on the pair, which adaptive execution can split), and meets
   them as a group of its own, which sums them over the links of each document.

A block is a row of megabytes. It is written in small groups of rows and goes to Python alone, so that what a task holds does
not grow with the number of blocks that it reads.

Defined cases: texts that are null, empty or not reproduced byte for byte by both tokenizers have no tokens, so zeros and an
empty digest; strings of special tokens are ordinary text; repeated rows are counted each for itself and get equal rows; an
empty table gives an empty table; columns are read by name and no other column matters; one very long text is a block of its
own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe, sentencepiece_bpe
from .arrays import chunks
from .regions import shared_table

#: Pairs are (A id, B id) in one long.
_SHIFT = 20
#: Rows are blocks of megabytes: by default a writer counts its bytes first after a hundred, and a reader holds as many at once.
_SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


class Aligner:
    """Both tokenizers and the identity map: for each A id the B id of the same bytes, or -1."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe.model(a_path, True), sentencepiece_bpe.model(b_path)
        of_b: dict[bytes, int] = {}
        raw = self.b.piece_bytes.tobytes()
        bytewise = set(self.b.byte_id.tolist())
        for i, (at, n) in enumerate(zip(self.b.piece_at.tolist(), self.b.piece_len.tolist(), strict=True)):
            # a piece of its own goes before the piece of a byte
            if n and (raw[at : at + n] not in of_b or i not in bytewise):
                of_b[raw[at : at + n]] = i
        self.identity = np.array([of_b.get(t, -1) for t in self.a.text], dtype=np.int64)
        self.b_table = byte_bpe.SegmentTable(self._pieces)

    def _pieces(self, whole: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """B ids of segments, and the number of ids of each."""
        self.b.reset()
        self.b.learn([x.decode() for x in whole])
        return self.b.flat, self.b.sizes

    def _b_starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """First bytes of segments that no piece of B reaches across: a run of blanks and a line end begin one."""
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offs[:-1][offs[:-1] < offs[1:]]] = True
        if self.b.cuts and len(data):
            blank, line = data == 0x20, data == 0x0A
            edge[:-1] |= line
            edge[1:-1] |= (blank[1:] & ~blank[:-1]) | line[:-1]
        return np.flatnonzero(edge[:-1])

    def tokens(self, data: np.ndarray, offs: np.ndarray):
        """(A ids, A ends, B ids, B ends, document edges) in bytes of the texts that both reproduce; others have no bytes."""
        data, offs = byte_bpe.spaced(data, offs)
        a, na = self.a.encode(data, offs)
        b, nb = self.b_table.encode(data, offs, self._b_starts(data, offs))
        sizes = np.diff(offs)
        good = sizes > 0
        # the sign that stands for a blank in B would come back as a blank
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        good[np.searchsorted(offs, sign, side="right") - 1] = False
        sides = []
        for m, ids, n in ((self.a, a, na), (self.b, b, nb)):
            doc, size = np.repeat(np.arange(len(sizes)), n), m.piece_len[ids]
            per_doc = np.bincount(doc, weights=size, minlength=len(sizes)).astype(np.int64)
            fits = per_doc == sizes
            # bytes of the documents whose sizes agree, side by side with the text
            on = np.repeat(fits, n)
            part = size[on]
            at = np.repeat(m.piece_at[ids[on]] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))
            text = data[np.repeat(fits, sizes)]
            owner = np.repeat(np.arange(len(sizes)), np.where(fits, sizes, 0))
            wrong = np.bincount(owner[m.piece_bytes[at] != text], minlength=len(sizes)) > 0
            good &= fits & ~wrong
            sides.append((ids, doc, size))
        out = []
        for ids, doc, size in sides:
            on = good[doc]
            out += [ids[on].astype(np.int64), np.cumsum(size[on])]
        return (*out, np.concatenate(([0], np.cumsum(np.where(good, sizes, 0)))))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process, made once."""
    return Aligner(a_path, b_path)


class Links:
    """Groups and links of a chunk, as arrays over bytes, tokens and links in order."""

    def __init__(self, al: Aligner, data: np.ndarray, offs: np.ndarray):
        self.a, a_end, self.b, b_end, self.edge = al.tokens(data, offs)
        n = int(self.edge[-1])
        in_a, in_b = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        in_a[a_end], in_b[b_end] = True, True
        common = in_a & in_b
        # of every token and link: the group it is in, counted over the chunk
        groups = np.cumsum(common)
        self.a_group, self.b_group = groups[a_end - 1], groups[b_end - 1]
        end = np.flatnonzero(in_a | in_b)
        self.link_a, self.link_b = self.a[np.cumsum(in_a)[end - 1]], self.b[np.cumsum(in_b)[end - 1]]
        last = common[end]
        alone = last & np.concatenate(([True], last[:-1]))[: len(last)]
        self.fast = alone & (al.identity[self.link_a] == self.link_b)
        doc_of = lambda x: np.searchsorted(self.edge, x, side="left") - 1  # noqa: E731  document of the byte before an end
        self.doc = doc_of(end)
        self.of_a, self.of_b = doc_of(a_end), doc_of(b_end)
        self.group_doc = doc_of(end[last])

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of documents) of the groups as text: a1,a2|b1;a3|b2,b3."""
        n_a, n_b = np.bincount(self.a_group, minlength=1), np.bincount(self.b_group, minlength=1)
        before_a, before_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        # a group's A ids, then its B ids
        at_a = np.arange(len(self.a)) + before_b[self.a_group]
        at_b = np.arange(len(self.b)) + before_a[self.b_group + 1]
        n = len(self.a) + len(self.b)
        ids, sep, doc = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8), np.empty(n, dtype=np.int64)
        ids[at_a], ids[at_b], doc[at_a], doc[at_b] = self.a, self.b, self.of_a, self.of_b
        ends_a = np.append(self.a_group[1:] != self.a_group[:-1], True)[: len(self.a)]
        ends_b = np.append(self.b_group[1:] != self.b_group[:-1], True)[: len(self.b)]
        sep[at_a[ends_a]], sep[at_b[ends_b]] = ord("|"), ord(";")
        digits = np.empty((n, 7), dtype=np.uint8)
        left = ids
        for k in range(5, -1, -1):
            left, digit = np.divmod(left, 10)
            digits[:, k] = digit + ord("0")
        digits[:, 6] = sep
        size = 1 + (ids[:, None] >= 10 ** np.arange(1, 6)).sum(axis=1)
        shown = np.arange(7) >= (6 - size)[:, None]
        length = np.bincount(doc, weights=size + 1, minlength=len(self.edge) - 1).astype(np.int64)
        return digits[shown], np.concatenate(([0], np.cumsum(length)))


BLOCKS = """block long, n_docs int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
fast_doc array<int>, fast_a array<int>, fast_n array<int>, pair array<long>, pair_n array<long>, link_doc array<int>, link_pair array<int>, link_n array<int>, one array<struct<a:int,n:long>>"""


def blocks(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each chunk of texts: counts of its documents, its distinct pairs, its links as (document, pair, times).

    The last row of a task has no documents but the task's vector of identity pairs, as (A id, count).
    """
    from pyspark import TaskContext

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = [x.split(" ")[0] for x in BLOCKS.replace("\n", " ").split(", ")]
    one_type = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int64())]))

    def row(block: int, n: int, values: dict) -> pa.RecordBatch:
        kinds = dict.fromkeys(names[2:], pa.list_(pa.int32())) | {k: pa.list_(pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "pair", "pair_n")} | {"groups_sha256": pa.list_(pa.string()), "one": one_type}
        columns = [pa.array([block], pa.int64()), pa.array([n], pa.int32())]
        for k in names[2:]:
            v = values.get(k)
            flat = pa.array([], kinds[k].value_type) if v is None else v.cast(kinds[k].value_type) if isinstance(v, pa.Array) else pa.array(v).cast(kinds[k].value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        al = aligner(a_path, b_path)
        own, number = TaskContext.get().partitionId() << 33, 0
        vector = np.zeros(len(al.identity), dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column(1)):
                rows = batch.slice(c.first, c.n)
                x = Links(al, c.data, c.offs)
                of = lambda d, n=c.n: np.bincount(d, minlength=n)
                text, cut = x.written()
                raw = text.tobytes()
                digest = [hashlib.sha256(raw[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                vector += np.bincount(x.link_a[x.fast], minlength=len(vector))
                fast, fast_n = np.unique(x.doc[x.fast] << _SHIFT | x.link_a[x.fast], return_counts=True)
                odd = ~x.fast
                pair, place = np.unique(x.link_a[odd] << _SHIFT | x.link_b[odd], return_inverse=True)
                link, link_n = np.unique(x.doc[odd].astype(np.int64) << 32 | place, return_counts=True)
                yield row(own | number, c.n, {
                    "doc_id": rows.column(0), "n_a": of(x.of_a), "n_b": of(x.of_b), "n_groups": of(x.group_doc), "n_links": of(x.doc), "groups_sha256": pa.array(digest, pa.string()),
                    "fast_doc": fast >> _SHIFT, "fast_a": fast & ((1 << _SHIFT) - 1), "fast_n": fast_n, "pair": pair, "pair_n": np.bincount(place, minlength=len(pair)),
                    "link_doc": link >> 32, "link_pair": link & 0xFFFFFFFF, "link_n": link_n,
                })
                number += 1
        some = np.flatnonzero(vector)
        if len(some):
            one = pa.StructArray.from_arrays([pa.array(some.astype(np.int32)), pa.array(vector[some])], names=["a", "n"])
            yield row(own | number, 0, {"one": one})

    return plain.mapInArrow(run, BLOCKS)


class Counts:
    """Corpus-wide counts: `pairs` (pair, c) of all but identity pairs, and two vectors of vocabulary length."""

    def __init__(self, table: DataFrame, a_path: str, b_path: str):
        al = aligner(a_path, b_path)
        odd = table.select(F.explode(F.arrays_zip("pair", "pair_n")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.pair_n").alias("c"))
        odd = shared_table(odd, "pair-counts")
        ones = table.where("n_docs = 0").select(F.explode("one").alias("o")).groupBy(F.col("o.a").alias("a")).agg(F.sum("o.n").alias("n"))
        # identity pairs also occur inside larger groups; at most as many as A has ids
        names = al.identity
        own = table.sparkSession.createDataFrame([(i << _SHIFT | int(b), i) for i, b in enumerate(names.tolist()) if b >= 0], "pair long, a int")
        again = odd.join(F.broadcast(own), "pair").select("a", F.col("c").alias("n"))
        self.identity = np.zeros(len(names), dtype=np.int64)
        for r in ones.unionByName(again).groupBy("a").agg(F.sum("n").alias("n")).collect():
            self.identity[r["a"]] = r["n"]
        self.pairs = odd
        # the highest count of each B id, at most as many as B has
        self.highest = np.zeros(len(al.b.piece_len), dtype=np.int64)
        for r in odd.groupBy((F.col("pair").bitwiseAND((1 << _SHIFT) - 1)).alias("b")).agg(F.max("c").alias("c")).collect():
            self.highest[r["b"]] = r["c"]
        known = names >= 0
        np.maximum.at(self.highest, names[known], self.identity[known])
        self.names = names

    def table(self) -> DataFrame:
        """(a, b, n, best): every linked pair of ids with its count; best where no A id has more links with b."""
        spark = self.pairs.sparkSession
        some = np.flatnonzero(self.identity)
        own = spark.createDataFrame([(int(a) << _SHIFT | int(self.names[a]), int(self.identity[a])) for a in some], "pair long, c long")
        top = spark.createDataFrame([(int(b), int(self.highest[b])) for b in np.flatnonzero(self.highest)], "b int, top long")
        rows = self.pairs.join(F.broadcast(own.select("pair")), "pair", "left_anti").unionByName(own)
        rows = rows.select(F.shiftright("pair", _SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).cast("int").alias("b"), F.col("c").alias("n"))
        return rows.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def report(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, groups, links, links of the most frequent kind, sum of counts, digest of the groups."""
    table = shared_table(blocks(docs, a_path, b_path, doc_id, text), "aligned", **_SMALL_GROUPS)
    counts = Counts(table, a_path, b_path)
    # what each block asks for: at most as many pairs as its texts have links
    asked = table.where("n_docs > 0").select(F.col("block").alias("asking"), F.explode("pair").alias("pair"))
    found = asked.join(counts.pairs, "pair").select("asking", "pair", "c")
    rows = table.where("n_docs > 0").select(*[k for k in table.columns if k not in ("n_docs", "pair_n", "one")])
    identity, highest, names = counts.identity, counts.highest, counts.names
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        """Rows of the documents of one block, from its row and the counts of its pairs."""
        value = lambda name: own.column(name).combine_chunks().flatten()
        array = lambda name: value(name).to_numpy(zero_copy_only=False)
        n = len(value("doc_id"))
        a, b_best, total = array("fast_a"), np.zeros(n, np.int64), np.zeros(n, np.int64)
        doc, times, c = array("fast_doc"), array("fast_n").astype(np.int64), identity[a]
        # sums of integers, exact
        np.add.at(total, doc, c * times)
        np.add.at(b_best, doc, np.where(c == highest[names[a]], times, 0))
        pair = array("pair")
        if len(pair):
            key, c = (got.column(name).to_numpy() for name in ("pair", "c"))
            order = np.argsort(key)
            c = c[order][np.searchsorted(key[order], pair)]
            same = names[pair >> _SHIFT] == (pair & ((1 << _SHIFT) - 1))
            c = np.where(same, identity[pair >> _SHIFT], c)
            best = c == highest[pair & ((1 << _SHIFT) - 1)]
            doc, place, times = array("link_doc"), array("link_pair"), array("link_n").astype(np.int64)
            np.add.at(total, doc, c[place] * times)
            np.add.at(b_best, doc, np.where(best[place], times, 0))
        columns = {"n_best": pa.array(b_best), "count_sum": pa.array(total)}
        return pa.table([columns.get(name, None) if name in columns else value(name) for name in kept], names=kept)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(found.groupBy("asking")).applyInArrow(run, schema)
