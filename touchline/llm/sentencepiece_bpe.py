"""SentencePiece BPE encoding and decoding as vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across (before a run of spaces, around a
line feed). The distinct segments of a chunk are encoded together: their symbols lie in one flat
numpy array, every round finds the best pair rank of each segment (a segmented minimum), merges its
leftmost occurrences at once and compacts the array, until no segment has a pair left.

Equal-rank occurrences are merged in one round only where the pairs that a merge creates all rank
behind it; elsewhere a segment merges its leftmost occurrence alone. This is the order in which the
library's agenda pops pairs, so ids are the library's, also for one very long word.

Defined cases: null or empty text gives no ids; characters without a piece become byte pieces;
repeated rows give repeated results; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import CHUNK_BYTES, chunks

#: Segments that a Python worker keeps between batches; beyond it the table starts anew.
CACHE_SEGMENTS = 150_000
_INF = np.int32(2**31 - 1)


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        pieces = {sp.id_to_piece(i).replace("▁", " "): i for i in range(size) if i not in special}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.cuts = not any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in pieces)
        self.segment = re.compile(r" +[^ \n]*|[^ \n]+|\n" if self.cuts else r"(?s).+")
        # symbols: pieces by id, then characters that only occur inside pieces
        symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - symbol.keys()):
            symbol[c] = size + len(symbol.keys() - pieces.keys())
        self.char = {c: s for c, s in symbol.items() if len(c) == 1}
        self.inner = {s: c for c, s in self.char.items() if s >= size}
        self.unknown = size + len(self.inner)
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in pieces.values()}))}
        found = {}
        for p, i in pieces.items():
            rank = order[-sp.get_score(i)]
            for k in range(1, len(p)):
                if (a := symbol.get(p[:k])) is not None and (b := symbol.get(p[k:])) is not None:
                    found[a << 32 | b] = (rank, i)
        keys = np.array(sorted(found), dtype=np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.rank = np.array([found[k][0] for k in keys.tolist()] + [_INF], dtype=np.int32)
        self.made = np.array([found[k][1] for k in keys.tolist()] + [0], dtype=np.int32)
        # decoding: the bytes of each id
        text = [b""] * size
        for p, i in pieces.items():
            text[i] = p.encode()
        for b, i in enumerate(self.byte_id.tolist()):
            text[i] = bytes([b])
        for i in range(size):
            if sp.is_unknown(i):
                text[i] = " ⁇ ".encode()
        self.opens = np.array([t.startswith(b" ") and i not in special for i, t in enumerate(text)])
        self.piece_len = np.array([len(t) for t in text], dtype=np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_len)[:-1]))
        self.piece_bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, the last index where there is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of n words and the number of symbols of each; word is sorted."""
        done_sym, done_word = [], []
        while len(sym):
            # best pair of each word
            pair = np.full(len(sym), len(self.keys) - 1, dtype=np.int64)
            same = word[1:] == word[:-1]
            pair[:-1][same] = self.pairs(sym[:-1][same], sym[1:][same])
            while True:
                rank = self.rank[pair]
                head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                best = np.minimum.reduceat(rank, head)
                span = np.diff(np.append(head, len(sym)))
                ends = best == _INF
                if ends.any():
                    gone = np.repeat(ends, span)
                    done_sym.append(sym[gone])
                    done_word.append(word[gone])
                    sym, word, pair, rank = sym[~gone], word[~gone], pair[~gone], rank[~gone]
                    best, span = best[~ends], span[~ends]
                    if not len(sym):
                        break
                each = np.repeat(best, span)
                at = np.flatnonzero(rank == each)
                # of touching occurrences (x x x) every second one, counted from the left
                run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
                place = np.arange(len(at)) - np.searchsorted(run, run)
                at = at[place % 2 == 0]
                made = self.made[pair[at]]
                first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                # neighbours as they stand when the agenda comes to each occurrence
                left = np.where(at > 0, sym[at - 1], -1)
                touch = np.concatenate(([False], at[1:] == at[:-1] + 2))
                left = np.where(touch, np.concatenate(([0], made[:-1])), left)
                has_left = (at > 0) & (word[at - 1] == word[at])
                right_at = np.minimum(at + 2, len(sym) - 1)
                has_right = (at + 2 < len(sym)) & (word[right_at] == word[at])
                mine = rank[at]
                new_left = np.where(has_left, self.rank[self.pairs(np.maximum(left, 0), made)], _INF)
                new_right = np.where(has_right, self.rank[self.pairs(made, sym[right_at])], _INF)
                odd_one = (new_left <= mine) | (new_right <= mine)
                if odd_one.any():
                    group = np.cumsum(first) - 1
                    alone = np.zeros(group[-1] + 1, dtype=bool)
                    alone[group[odd_one]] = True
                    ok = first | ~alone[group]
                    at, made = at[ok], made[ok]
                sym[at] = made
                stay = np.ones(len(sym), dtype=bool)
                stay[at + 1] = False
                here = at - np.arange(len(at))
                sym, word, pair = sym[stay], word[stay], pair[stay]
                redo = np.concatenate((here, here[here > 0] - 1))
                right = np.minimum(redo + 1, len(sym) - 1)
                ok = (redo + 1 < len(sym)) & (word[right] == word[redo])
                pair[redo] = np.where(ok, self.pairs(sym[redo], sym[right]), len(self.keys) - 1)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n)

    def learn(self, segments: list[str]) -> None:
        """Encode segments that are not in the table yet."""
        extra: dict[str, int] = {}
        char, unknown = self.char, self.unknown
        text = "".join(segments)
        sym = np.fromiter((char[c] if c in char else unknown + extra.setdefault(c, len(extra)) for c in text), dtype=np.int64, count=len(text))
        word = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        sym, count = self.merge(sym, word, len(segments))
        if extra or (sym >= len(self.piece_len)).any():
            # symbols without an id become byte pieces
            names = dict(self.inner) | {unknown + i: c for c, i in extra.items()}
            word = np.repeat(np.arange(len(segments)), count)
            size, ids = np.ones(len(sym), np.int64), {s: self.byte_id[np.frombuffer(c.encode(), np.uint8)] for s, c in names.items()}
            odd = np.flatnonzero(sym >= len(self.piece_len))
            size[odd] = [len(ids[s]) for s in sym[odd].tolist()]
            cut = np.concatenate(([0], np.cumsum(size)))
            out = np.repeat(sym, size)
            for k in odd.tolist():
                out[cut[k] : cut[k + 1]] = ids[int(sym[k])]
            count, sym = np.bincount(np.repeat(word, size), minlength=len(segments)), out
        base = len(self.starts)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)))
        self.sizes = np.concatenate((self.sizes, count))
        self.flat = np.concatenate((self.flat, sym.astype(np.int32)))
        self.known.update(zip(segments, range(base, base + len(segments)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        found = [self.segment.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        flat = [s for f in found for s in f]
        new = list(dict.fromkeys(s for s in flat if s not in self.known))
        if len(self.known) + len(new) > CACHE_SEGMENTS:
            self.reset()
            new = list(dict.fromkeys(flat))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        size = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.starts[at] - total[:-1], size) + np.arange(total[-1])]
        cut = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        return ids, np.diff(total[cut])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Text of each row of ids; the space of the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return [""] * (len(offs) - 1)
        size = self.piece_len[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = self.piece_bytes[np.repeat(self.piece_at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cut = total[offs]
        some = offs[:-1] < offs[1:]
        drop = np.zeros(len(offs) - 1, dtype=np.int64)
        drop[some] = self.opens[ids[offs[:-1][some]]]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip((cut[:-1] + drop).tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of this worker process, loaded once."""
    return PieceModel(path)


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids; a column of that name before is replaced."""
    keep = [c for c in docs.columns if c != ids]

    def run(batches):
        m = model(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for c in chunks(column):
                rows = batch.slice(c.first, c.n)
                got, count = m.encode([t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(k)) for k in keep] + [lists], names=[*keep, ids])

    return docs.mapInArrow(run, _schema(docs, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of their ids; null ids give an empty text."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                lists = rows.column(rows.schema.get_field_index(ids))
                size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                out = m.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size))))
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(k)) for k in keep] + [pa.array(out, pa.string())], names=[*keep, text])

    return docs.mapInArrow(run, _schema(docs, text, T.StringType()))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of each text and the text of those ids, in one pass (one worker a task)."""
    keep = [c for c in docs.columns if c not in (ids, decoded)]

    def run(batches):
        m = model(path)
        for batch in batches:
            for c in chunks(batch.column(batch.schema.get_field_index(text)), CHUNK_BYTES):
                rows = batch.slice(c.first, c.n)
                got, count = m.encode([t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()])
                offs = np.concatenate(([0], np.cumsum(count)))
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(got, pa.int32()))
                back = pa.array(m.decode(got, offs), pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(k)) for k in keep] + [lists, back], names=[*keep, ids, decoded])

    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids and of the decoded text."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = round_trip(plain, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
