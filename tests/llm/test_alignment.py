"""Alignment against a plain walk over the tokens of both libraries."""

import hashlib
import os
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from touchline.llm import alignment
from touchline.llm.byte_bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(texts):
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte = byte_alphabet()
    links, groups = [], []
    for text in texts:
        want = (" " + (text or "")).encode()
        sides = []
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            sides.append([(i, bytes(byte[c] for c in p)) for i, p in zip(e.ids, e.tokens, strict=True)])
            ids = sp.encode(text)
            sides.append([(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in ids)])
        if not text or any(b"".join(x for _, x in s) != want for s in sides):
            links.append([])
            groups.append([])
            continue
        spans = []
        for s in sides:
            at, out = 0, []
            for i, x in s:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links.append([(a, b) for f, g, a in spans[0] for u, v, b in spans[1] if f < v and u < g] if len(text) < 3000 else overlaps(*spans))
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        own, start = [], 0
        for e in ends:
            own.append(tuple([i for f, g, i in s if f >= start and g <= e] for s in spans) if len(text) < 3000 else None)
            start = e
        if len(text) >= 3000:
            own = walked(spans, ends)
        groups.append(own)
    count = Counter(x for own in links for x in own)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for text, own, parts in zip(texts, links, groups, strict=True):
        s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in parts)
        out.append((sum(len(a) for a, _ in parts), sum(len(b) for _, b in parts), len(parts), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(s.encode()).hexdigest() if parts else ""))
    return out


def overlaps(a, b):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i][2], b[j][2]))
        e, f = a[i][1], b[j][1]
        i, j = i + (e <= f), j + (f <= e)
    return out


def walked(spans, ends):
    i = j = 0
    out = []
    for e in ends:
        a, b = [], []
        while i < len(spans[0]) and spans[0][i][1] <= e:
            a.append(spans[0][i][2])
            i += 1
        while j < len(spans[1]) and spans[1][j][1] <= e:
            b.append(spans[1][j][2])
            j += 1
        out.append((a, b))
    return out


def digest(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_query_on_whole_documents(spark):
    from touchline.llm.queries import op12_tokenizer_alignment

    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: digest(r) for r in op12_tokenizer_alignment(spark, DIR).collect()}
    assert len(got) == len(docs)
    want = plain([d.text for d in docs])
    assert [got[d.doc_id] for d in docs] == want


def test_awkward_rows(spark):
    texts = [None, "", "a", "x <|endoftext|> y </s>", "a▁b", "aaaa aaaa aaaaa", "naïve 中文字 😀😀", "ab\x00c", " two  blanks ", "\n\n\tx", "a", "long " * 3000, "ünïcödé" * 700, "<0x41>"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pair int").repartition(3)
    got = {r.doc_id: digest(r) for r in alignment.report(docs, A, B).collect()}
    want = plain(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want[4] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.report(docs.where("false"), A, B).count() == 0
    assert alignment.report(docs.where("text is null"), A, B).count() == 1
    same = spark.createDataFrame([(None, "one two three")] * 3 + [(5, "one two three")] * 2, "doc_id long, text string")
    assert sorted(map(digest, alignment.report(same, A, B).collect())) == sorted(plain(["one two three"] * 5))


def test_table_of_pairs(spark):
    docs = spark.createDataFrame([(1, "one two three naïve"), (2, "two two")], "doc_id long, text string")
    from touchline.llm.regions import shared_table

    rows = alignment.Counts(shared_table(alignment.blocks(docs, A, B), "t"), A, B).table().collect()
    assert sum(r.n for r in rows) == sum(x[3] for x in plain(["one two three naïve", "two two"]))
    assert len({(r.a, r.b) for r in rows}) == len(rows) and {r.b for r in rows} == {r.b for r in rows if r.best}


def test_blocks_are_read_and_sent_a_few_at_a_time(spark):
    """A block is a row of a megabyte: neither a group of rows of the table nor a batch for Python may hold dozens."""
    import glob
    import random

    import pyarrow.parquet as pq

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(100_000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=90_000))) for i in range(16)], "doc_id long, text string").coalesce(1)
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/aligned-*"))
    rows = alignment.report(docs, A, B)
    (table,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/aligned-*")) - before
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{table}/*.parquet")]
    assert sum(m.num_rows for m in metas) >= 16
    assert max(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)) <= 12
    assert "FlatMapCoGroupsInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 16
