"""Packing: the plan on its own, pieces against the library, awkward rows."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def counted(runs, width):
    got = np.zeros(width + 1, dtype=np.int64)
    for r in runs:
        assert r.times > 0 and r.gap(width) >= 0
        for n, k in r.lengths.items():
            got[n] += k * r.times
    return got


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("width", [16, 100])
def test_plan_holds_every_piece_and_ranks_fill_places(seed, width):
    rng = np.random.default_rng(seed)
    count = np.zeros(width + 1, dtype=np.int64)
    some = rng.integers(1, width + 1, rng.integers(1, 12))
    count[some] = rng.integers(1, 10 ** rng.integers(1, 4), len(some))
    runs = packing.plan(count, width)
    assert (counted(runs, width) == count).all()
    places = packing.Places(runs)
    used = {}
    for n in np.flatnonzero(count).tolist():
        sequence, offset = places.of(np.full(count[n], n), np.arange(count[n]))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used.setdefault(s, []).append((o, n))
    assert len(used) == places.sequences
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= width


def test_plan_beats_one_length_after_the_other():
    """Three of 683..700 do not fit, pairs with a smaller one do; known optima are reached."""
    count = np.zeros(101, dtype=np.int64)
    count[[50, 30, 20]] = 600
    assert sum(r.times for r in packing.plan(count, 100)) == 600
    count[:] = 0
    count[[34, 33]] = 999, 1998
    assert sum(r.times for r in packing.plan(count, 100)) == 999
    assert packing.plan(np.zeros(101, dtype=np.int64), 100) == []


def check(rows, texts, width=2048):
    """rows of doc_id = place in texts, against the library."""
    t = Tokenizer.from_file(PATH)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(range(len(texts)))
    for k, text in enumerate(texts):
        ids = np.array([*(t.encode(text, add_special_tokens=False).ids if text else []), 0], dtype="<u4")
        parts = sorted(got[k], key=lambda r: r.piece)
        n = -(-len(ids) // width)
        assert [r.piece for r in parts] == list(range(n))
        assert [r.length for r in parts] == [len(ids) - (n - 1) * width] + [width] * (n - 1)
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= width
    return by


def test_query_on_whole_documents(spark):
    from touchline.llm.queries import op11_best_fit_packing

    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    rows = [r.asDict() for r in op11_best_fit_packing(spark, DIR).collect()]
    place = {d.doc_id: i for i, d in enumerate(docs)}
    from pyspark.sql import Row

    by = check([Row(**(r | {"doc_id": place[r["doc_id"]]})) for r in rows], [d.text for d in docs])
    total = sum(r["length"] for r in rows)
    assert len(by) <= 1.02 * -(-total // 2048) + 1


def test_awkward_rows(spark):
    texts = [None, "", "a", "x <|endoftext|> y", "word " * 9000, "é" * 5000, "a", "  \n ", "zz " * 2047]
    rows = [(i, t, "own", 7, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Offset string, _task int, _nth int")
    check(packing.report(docs, PATH).collect(), texts)
    packed = packing.pack(docs, PATH)
    assert {"_task", "_nth"} <= set(packed.columns) and {r._task for r in packed.collect()} == {7}
    # whole sequences hold all ids
    whole = packing.sequences(packed).collect()
    t = Tokenizer.from_file(PATH)
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts)
    assert sum(len(r.ids) for r in whole) == want and max(len(r.ids) for r in whole) <= 2048
    assert packing.report(docs.where("false"), PATH).count() == 0
    same = spark.createDataFrame([(None, "one two")] * 3 + [(5, "one two")] * 2, "doc_id long, text string")
    got = packing.report(same, PATH).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5
