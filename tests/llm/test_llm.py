"""Training-data operators against plain versions, the library or held-out labels, with awkward rows."""

import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import decontamination, jaccard_join, language_id, quality_neighbours, quality_rules, regions, sentencepiece_bpe, substring_dedup, suffix_dedup, toxicity, url_templates
from touchline.llm.queries import QUERIES, table, tokenizer_path

from . import brute

DIR, SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.001", "/root/testdata/sf0.1"
ODD = [None, "", " \n", "a", "a b", "x" * 1500, "ab " * 300, "ab " * 300, "é😀 ß\n\tz", "!" * 250]


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of the smallest table, odd ones, near copies, copies and shared passages."""
    rng = random.Random(3)
    out = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    texts = [t for _, t in out if t and 80 < len(t.split()) < 400][:6]
    extra = list(ODD)
    for t in texts * 6:
        w = t.split()
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        extra.append(" ".join(w))
    passage = " ".join(f"shared{i}" for i in range(60))
    extra += [f"{' '.join(f'own{k}x{i}' for i in range(rng.choice([3, 9, 40])))} {passage}" for k in range(40)]
    return out + [(10**6 + i, t) for i, t in enumerate(extra)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1)).repartition(5)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_decontamination(spark, docs, rows):
    bench = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()] + [(900, None), (901, "own1x1 own1x2"), (902, "ab ab ab"), (903, "")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(brute.decontaminate(rows, bench))
    assert collected(decontamination.report(docs, b)) == want
    assert collected(decontamination.report(docs, b, block_bytes=3000)) == want
    assert decontamination.report(decontamination.clean(docs, b), b).where("n_hit > 0").count() == 0


def test_substring_dedup(docs, rows):
    assert collected(substring_dedup.report(docs)) == sorted(brute.substring_dedup(rows))


@pytest.mark.parametrize("limit", [2048, 3])
def test_suffix_dedup(docs, rows, limit, monkeypatch):
    monkeypatch.setattr(regions, "MAX_INDEXED", limit)
    assert collected(suffix_dedup.report(docs)) == sorted(brute.suffix_dedup(rows))


@pytest.mark.parametrize("rounds, least, most", [(2, 16, 1 << 22), (0, 2, 1 << 22), (1, 1, 50)])
def test_jaccard_join(docs, rows, rounds, least, most, monkeypatch):
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "MIN_FREQUENT", least)
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", most)
    assert collected(jaccard_join.join(docs)) == sorted(brute.shingle_components(rows))


def test_jaccard_join_of_frequent_passages(spark, monkeypatch):
    """Small sets over few words, all of them frequent, over many partitions: links without any rare token."""
    monkeypatch.setattr(jaccard_join, "MIN_FREQUENT", 2)
    rng = random.Random(8)
    base = [[f"p{k}w{i}" for i in range(rng.choice([6, 9, 14, 30]))] for k in range(12)]
    rows = []
    for doc in range(500):
        w = [x for k in rng.sample(range(12), rng.choice([1, 2, 3])) for x in base[k]]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w.pop(rng.randrange(len(w)))
        rows.append((doc, " ".join(w)))
    got = collected(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)))
    assert got == sorted(brute.shingle_components(rows))


def test_sentencepiece(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepiece_bpe.round_trip(docs, tokenizer_path()).collect()}
    for doc, text in rows:
        ids = sp.encode(text or "")
        assert got[doc] == (ids, sp.decode(ids))
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert {r.doc_id: r.decoded for r in back.collect()} == {d: x[1] for d, x in got.items()}


def test_quality_rules_on_odd_rows(docs, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for doc, text in rows:
        w = brute.SPACED.findall(text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(w) < 700 else None
        assert got[doc].n_words == len(w) and got[doc].word_chars == sum(map(len, w))
        if hit is not None:
            assert got[doc].n_repeat_words == len(hit)
        assert not (got[doc].base_failed and got[doc].kept)


def test_language(spark, docs):
    d = table(spark, DIR, "documents")
    model = language_id.fit(d)
    both = language_id.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, good = both.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert good >= 0.97 * n
    odd = {r.doc_id: r for r in language_id.predict(docs, model).where("doc_id between 1000000 and 1000009").collect()}
    assert odd[10**6].lang_pred == odd[10**6 + 9].lang_pred == "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert language_id.predict(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, docs):
    d, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    model = toxicity.fit(d, labels)
    both = toxicity.predict(d, model).join(labels, "doc_id")
    clean, caught, toxic = both.agg(F.avg(F.when(F.col("toxic") == 0, 1 - F.col("predicted"))), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)), F.sum("toxic")).first()
    assert clean > 0.95 and caught >= 0.6 * toxic
    assert toxicity.predict(docs, model).where("doc_id between 1000000 and 1000009 and predicted = 1").count() == 0
    empty = toxicity.fit(d.limit(0), labels.limit(0))
    assert toxicity.predict(docs, empty).where("score < 0 or score > 1").count() == 0


def test_grammar():
    scope = toxicity.SCOPE
    state, seen = 0, []
    for c in [toxicity.NEGATOR] + [toxicity.OTHER] * (scope - 1) + [toxicity.INSULT, toxicity.TARGET, toxicity.REPORTER, toxicity.THREAT]:
        if toxicity.EMIT[state, c] >= 0:
            seen.append(toxicity.PATTERNS[toxicity.EMIT[state, c]])
        state = toxicity.STEP[state, c]
    assert seen == [(toxicity.INSULT, 1, 0, 0), (toxicity.THREAT, 0, 1, 1)]


def test_quality_neighbours(spark, docs):
    d, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    model = quality_neighbours.fit(d, labels)
    both = quality_neighbours.predict(d, model).where("held_out").join(labels, "doc_id")
    n, good = both.agg(F.count("*"), F.count_if(F.col("quality") == F.col("predicted"))).first()
    assert good >= 0.9 * n
    assert quality_neighbours.predict(docs, model).where("score < 0 or score > 1").count() == 0
    assert quality_neighbours.predict(docs, None).where("score <> 0.5").count() == 0


def test_urls(spark):
    urls = [None, "x", "http://A.Example.com/en/7x?q", "https://b.com/en/1#f", "http://ncom/en/1", "ftp://example.net/de/81", "http://q.example.org/es/", "http://h://de/1"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3] == ("b.com", "/en/1", "com/en/", "block")
    assert got[4][2] is None
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("org/es/", "block")
    assert got[7][:2] == ("h:", "//de/1")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.report(none).count() == suffix_dedup.report(none).count() == jaccard_join.join(none).count() == 0
    assert quality_rules.judge(none).count() == sentencepiece_bpe.digests(none, tokenizer_path()).count() == 0


def test_pipeline(spark, monkeypatch):
    """Stages on the smallest table against plain versions of what each decides."""
    import corpus_pipeline as C

    docs = table(spark, SMALL, "documents")
    kept = C.drop_toxic(spark, docs, SMALL)
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    assert collected(kept.select("doc_id")) == collected(toxicity.predict(docs, model).where("predicted = 0").select("doc_id"))
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    one = C.keep_one_of_each_group(spark, kept, SMALL)
    want = {d for d, _, c in brute.shingle_components(pairs) if d == c}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    cut = C.cut_repeats(spark, one, SMALL)
    digest = {d: h for d, _, _, h in brute.substring_dedup([p for p in pairs if p[0] in want])}
    assert {r.doc_id: brute.sha(" ".join(brute.SPACED.findall(r.text or ""))) for r in cut.collect()} == digest
    last = C.encode(spark, C.cut_benchmark(spark, cut, SMALL), SMALL)
    assert last.where("decoded <> text").count() == 0 and last.count() == len(want)


def test_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}


def test_decontamination_of_repeated_rows_in_blocks(spark):
    """Repeated rows, unlike texts under one id and null ids are rows of their own, however the benchmark is cut."""
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    rows = [(1, f"x {a} y", 5), (1, f"x {a} y", 6), (1, f"{b} z", 7), (1, "clean", 8), (None, f"{a} {b}", 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([a, b, *[f"other{i}" for i in range(8)]])], "item_id long, text string")
    order = lambda df: sorted(map(repr, map(tuple, df.collect())))
    whole = order(decontamination.find(docs, bench))
    assert len(whole) == len(rows) and order(decontamination.find(docs, bench, block_bytes=20)) == whole
    cut = order(decontamination.clean(docs, bench))
    assert cut == sorted(map(repr, [(1, "x y", 5), (1, "x y", 6), (1, "z", 7), (1, "clean", 8), (None, "", 9), (None, None, 10)]))
    assert order(decontamination.clean(docs, bench, block_bytes=20)) == cut


def test_cleaning_by_a_benchmark_over_one_block(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"keep {text}")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, text), (1, "some other words")], "item_id long, text string")
    assert decontamination.clean(docs, bench, block_bytes=10).first().text == "keep "


def test_jaccard_join_of_documents_without_an_id(spark):
    import corpus_pipeline as C

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{text} a"), (2, f"{text} b"), (None, f"{text} c"), (None, f"{text} d"), (None, f"{text} c"), (None, None), (3, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, map(tuple, jaccard_join.join(docs).collect())))
    assert got == sorted(map(repr, [(1, 57, 1), (2, 57, 1), (3, 1, 3), *[(None, 57, None)] * 3, (None, 0, None)]))
    kept = C.keep_one_of_each_group(spark, docs, SMALL).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[0], *rows[2:]]))


def test_jaccard_pairs(docs, rows):
    sets = {}
    for doc, text in rows:
        w = brute.SPACED.findall(brute.lower(text))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(d for d in sets if sets[d])
    want = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert collected(jaccard_join.pairs(docs)) == want


def test_repeated_windows_of_long_texts_by_whole_hashes(spark):
    """The hashes of 'c8444438 x y' and 'c15546515 x y' agree in their high 44 bits, and are not a repeat."""
    filler = " ".join(f"w{i}" for i in range(300_000))
    text = f"a b c c8444438 x y {filler} c15546515 x y a b c"
    assert quality_rules.measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_repeat_words == 6


def test_urls_by_host(spark):
    """Pages without a rule follow their host's labels; repeated rows do not change wildcards."""
    import duckdb

    from touchline.llm.queries import ORACLE

    urls = [f"http://a.com/en/{i}" for i in range(9)] + ["http://a.com/fr/1", "http://b.com/en/1", "http://b.com/fr/1", "http://c.net/de/1"]
    urls += [f"http://d.com/fr/{a}{b}/x" for a in "abcde" for b in "abcde"]
    once = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdict = lambda pages, **k: {r.page_id: r.verdict for r in url_templates.judge(pages, **k).collect()}
    got = verdict(once, by_host=True)
    assert got[9] == "block" and got[11] == got[12] == "allow"
    assert verdict(once)[9] == "allow"
    assert verdict(once.union(once).union(once), by_host=True) == got
    shapes = lambda pages: {r.template for r in url_templates.templates(pages.groupBy("host", "shape").agg(F.count_distinct("path").alias("n"))).collect()}
    leaf = once.select(url_templates.host_of(F.col("url")).alias("host"), url_templates.path_of(F.col("url")).alias("path")).withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    assert "/fr/*/x" in shapes(leaf) and shapes(leaf.union(leaf).union(leaf)) == shapes(leaf)
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{DIR}/pages.parquet'")
    for name in ("op7_url_templates", "op7_url_templates_by_host"):
        mine = QUERIES[name](spark, DIR)
        rows = c.execute(ORACLE[name])
        assert [x[0] for x in rows.description] == mine.columns
        assert sorted(map(repr, map(tuple, mine.collect()))) == sorted(map(repr, rows.fetchall()))
    both = QUERIES["op7_url_templates_by_host"](spark, DIR)
    assert both.where("rule is null and verdict = 'block'").count() > 0


def test_composed_transducers_equal_the_cascade():
    """Reading with the composed transducer is reading with the five one after the other."""
    rng = random.Random(4)
    t = toxicity
    marks = lambda x: t.MATCH in x
    for _ in range(300):
        classes = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        state, got = 0, []
        for c in classes:
            if t.EMIT[state, c] >= 0:
                got.append(t.PATTERNS[t.EMIT[state, c]])
            state = int(t.STEP[state, c])
        want = []
        for k, c in enumerate(classes):
            if c in (t.INSULT, t.THREAT):
                before = classes[:k]
                want.append((c, int(t.NEGATOR in before[-t.SCOPE :]), int(t.REPORTER in before), int(t.TARGET in before)))
        assert got == want
    assert t.PRIOR[t.INSULT, 0, 0, 0] == t.PRIOR[t.THREAT, 0, 0, 1] == 1.0 and t.PRIOR[t.THREAT, 1, 1, 0] == pytest.approx(0.4 * 0.5 * 0.7)
    assert not any(marks((x,)) for x in range(6))


def test_toxicity_of_clauses(spark):
    """Negation, reported speech and capitals with marks; a clause counts once; scores against a plain walk over the words."""
    import re

    model = toxicity.Model((), np.where(toxicity.Lexicon().cls == toxicity.INSULT, 0.8, 0.6), np.array([toxicity.PRIOR[p] for p in toxicity.PATTERNS]), 0.01)
    texts = {
        1: "You are an idiot.", 2: "You are not an idiot.", 3: "They said you idiot.", 4: "They never said he was not an idiot.", 5: "idiot, moron and loser", 6: "idiot. moron! loser",
        7: "IMBÉCILE", 8: "They will kill time.", 9: "You: I will kill you. They kill", 10: "", 11: None, 12: "fine words " * 40_000, 13: "You are an idiot.",
    }
    got = {r.doc_id: r.score for r in toxicity.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    kinds = {w: c for c, ws in ((toxicity.INSULT, toxicity.INSULTS), (toxicity.THREAT, toxicity.THREATS), (toxicity.REPORTER, toxicity.REPORTERS), (toxicity.NEGATOR, toxicity.NEGATORS), (toxicity.TARGET, toxicity.TARGETS)) for w in ws}
    for doc, text in texts.items():
        left = 0.99
        for clause in re.split(r"[.!?;:\n]", text or ""):
            w = [kinds.get(x, toxicity.OTHER) for x in brute.ALNUM.findall(clause.lower())]
            best = 0.0
            for k, c in enumerate(w):
                if c in (toxicity.INSULT, toxicity.THREAT):
                    weight = 0.8 if c == toxicity.INSULT else 0.6
                    weight *= 0.4 if toxicity.NEGATOR in w[max(0, k - toxicity.SCOPE) : k] else 1
                    weight *= 0.5 if toxicity.REPORTER in w[:k] else 1
                    weight *= 0.7 if c == toxicity.THREAT and toxicity.TARGET not in w[:k] else 1
                    best = max(best, weight)
            left *= 1 - best
        assert got[doc] == pytest.approx(1 - left), (doc, text and text[:40])
    assert got[1] > got[2] and got[3] > got[4] and got[6] > got[5] == got[1] == got[13]


def test_toxicity_of_held_out_rows(spark):
    """Held-out rows only; the larger table shows the inflected forms that must be learned."""
    d, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    both = toxicity.predict(d, toxicity.fit(d, labels)).where("held_out").join(labels, "doc_id")
    clean, caught, toxic = both.agg(F.avg(F.when(F.col("toxic") == 0, 1 - F.col("predicted"))), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)), F.sum("toxic")).first()
    assert clean > 0.98 and caught >= 0.8 * toxic


def test_quality_votes_against_plain_cosines():
    """Blocks of any size and repeated training vectors give the votes of a plain sort by similarity and place."""
    m = quality_neighbours.Model(None, None, None, quality_neighbours.unit(np.random.default_rng(2).integers(-2, 3, (90, 3)).astype(np.float32)), np.random.default_rng(3).integers(0, 2, 90).astype(np.float32), 0.4)
    docs = quality_neighbours.unit(np.random.default_rng(4).integers(-2, 3, (50, 3)).astype(np.float32))
    got = quality_neighbours.vote(m, docs)
    assert np.array_equal(got, np.concatenate([quality_neighbours.vote(m, docs[k : k + 1]) for k in range(50)]))
    for x, score in zip(docs, got):
        sim = [round(float(np.dot(x.astype(float), v.astype(float))) * quality_neighbours.STEPS) / quality_neighbours.STEPS for v in m.vectors]
        near = sorted(range(90), key=lambda i: (-sim[i], i))[: quality_neighbours.NEIGHBOURS]
        w = [max(sim[i], 0) ** quality_neighbours.POWER for i in near]
        assert score == pytest.approx(sum(a * m.labels[i] for a, i in zip(w, near)) / sum(w) if sum(w) > 1e-12 else m.base, abs=1e-4)
