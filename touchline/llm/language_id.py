"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent 1- to 3-grams of letters within padded words,
most frequent first. A document gets the language whose profile has the least out-of-place distance
to the document's own list: the sum of rank differences, with the profile's length for an n-gram
that the profile lacks.

Fitting reads a sample of labelled rows that is chosen by a hash of the row id and bounded by
MAX_FIT_DOCS per language; the profiles (PROFILE_SIZE n-grams a language) are all that reaches the driver.
Prediction reads every whole text, row by row, without a shuffle.

Defined cases: a null text or one without a letter is `und` with score 0; with no learned language
every text is `und`; ties go to the alphabetically first language, equal counts to the smaller
n-gram; repeated rows are predicted alike, and rows of one id each by its own text; very long texts are read
whole, one at a time in a task; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks, folded

PROFILE_SIZE = 300
MAX_FIT_DOCS = 3000
#: Rows with this remainder of crc32(id) mod 4 are held out of fitting.
FOLDS, HELD_OUT = 4, 2
_SPACE = np.uint64(0x20)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram keys, document of each, has_letter of each document). A key packs up to three code points."""
    low, letter, at = folded(data, offs)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    size = np.bincount(doc[letter], minlength=n)
    # a space for each run of other characters, and one on either side of the document
    before = np.concatenate(([False], letter[:-1]))
    before[at[:-1][at[:-1] < len(low)]] = True
    keep = letter | before
    c, d = np.where(letter[keep], low[keep], 0x20).astype(np.uint64), doc[keep]
    lead = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.zeros(0, np.int64)
    c, d = np.insert(c, lead, _SPACE), np.insert(d, lead, d[lead])
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), size > 0
    same1 = d[1:] == d[:-1]
    inner = c != _SPACE
    two = same1 & (inner[1:] | inner[:-1])
    three = same1[1:] & same1[:-1] & inner[1:-1]
    bi = (c[:-1] << np.uint64(21)) | c[1:]
    tri = (bi[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate((c[inner], bi[two], tri[three])), np.concatenate((d[inner], d[:-1][two], d[:-2][three])), size > 0


def _per_document(keys: np.ndarray, doc: np.ndarray, n: int):
    order = np.argsort(doc, kind="stable")
    keys, cut = keys[order], np.searchsorted(doc[order], np.arange(n + 1))
    for k in range(n):
        yield keys[cut[k] : cut[k + 1]]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the count of each."""
    s = np.sort(keys)
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[head], np.diff(np.append(head, len(s)))


def top(keys: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent keys, most frequent first, smaller key first among equals."""
    k, count = counted(keys)
    if len(k) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        hold = count >= least
        k, count = k[hold], count[hold]
    return k[np.argsort(-count, kind="stable")][:size]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_FIT_DOCS, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Profiles by language from the rows of docs that are not held out and have a language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    share = {r["lang"]: max_docs / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    limit = F.lit(1.0)
    for name, part in share.items():
        limit = F.when(F.col("lang") == name, F.lit(float(part))).otherwise(limit)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def count(batches):
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for c in chunks(batch.column(0)):
                keys, doc, _ = ngrams(c.data, c.offs)
                of = names[c.first : c.first + c.n]
                for name in sorted(set(of.tolist())):
                    k, n = counted(keys[(of == name)[doc]])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = rows.where(chance < limit).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    total = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = total.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    out: dict[str, list] = {name: [] for name in sorted(share)}
    for r in sorted(found, key=lambda r: r["rank"]):
        out[r["lang"]].append(r["gram"])
    return {name: np.array(k, dtype=np.int64).view(np.uint64) for name, k in out.items() if k}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1 minus the share of the greatest distance)."""
    names = sorted(profiles)
    order = [np.argsort(profiles[n]) for n in names]
    keys = [profiles[n][o] for n, o in zip(names, order, strict=True)]

    def distances(mine: np.ndarray) -> list[int]:
        place = np.arange(len(mine))
        out = []
        for k, rank in zip(keys, order, strict=True):
            at = np.minimum(np.searchsorted(k, mine), len(k) - 1)
            out.append(int(np.where(k[at] == mine, np.abs(rank[at] - place), size).sum()))
        return out

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                grams, doc, letters = ngrams(c.data, c.offs)
                lang, score = ["und"] * c.n, [0.0] * c.n
                for i, own in enumerate(_per_document(grams, doc, c.n)):
                    if letters[i] and names:
                        mine = top(own, size)
                        d = distances(mine)
                        best = int(np.argmin(d))
                        lang[i], score[i] = names[best], max(0.0, 1.0 - d[best] / (size * len(mine)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), batch.column(2).slice(c.first, c.n), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id), FOLDS) == HELD_OUT).alias("held_out"))
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
