"""Many copies of one row, many rows without an id, items without an id."""

import random

import pytest

from touchline.llm import decontamination, regions, substring_dedup, suffix_dedup

from . import brute

NONE = (1 << 63) - 1


def text(rng, n):
    return " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))


def windows(monkeypatch):
    """Rows of the table of windows of each call, by name."""
    seen, real = [], regions.shared_table

    def table(df, name):
        out = real(df, name)
        if name.endswith("-windows"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(regions, "shared_table", table)
    return seen


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_copies_of_a_row_cost_no_more_windows_than_one(spark, monkeypatch, operator):
    rng = random.Random(1)
    passage = text(rng, 70)
    base = [(1, f"{text(rng, 20)} {passage} {text(rng, 30)}"), (2, f"{text(rng, 25)} {passage} {text(rng, 5)}")]
    copy = (3, f"{text(rng, 40)} {passage} {text(rng, 40)}")
    seen = windows(monkeypatch)
    for n in (1, 2, 400):
        rows = base + [copy] * n
        got = operator.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        want = brute.substring_dedup(base + [copy]) if operator is substring_dedup else brute.suffix_dedup(base + [copy] * min(n, 2))
        assert len(got) == len(rows)
        assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert seen[1] == seen[2] and seen[0] <= seen[1] <= seen[0] + 400


def test_many_rows_without_an_id(spark):
    rng = random.Random(2)
    passage = text(rng, 60)
    rows = [(None, f"{text(rng, 5)} {passage if i % 100 == 0 else text(rng, 6)} {text(rng, 5)}") for i in range(1000)] + [(5, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = lambda got: sorted(map(repr, (tuple(None if v == NONE else v for v in r) for r in got)))
    assert plain(substring_dedup.report(docs).collect()) == plain(brute.substring_dedup([(NONE if d is None else d, t) for d, t in rows]))
    assert plain(suffix_dedup.report(docs).collect()) == plain(brute.suffix_dedup(rows))


def test_items_without_an_id(spark):
    rows = [(1, "one two three four"), (2, "five six seven"), (3, "nothing here")]
    items = [(None, "two three"), (4, "three four"), (None, "six"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (10, 1 << 20):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.report(docs, bench, block_bytes=size).collect()}
        assert got == {1: (3, 1, True), 2: (1, 0, True), 3: (0, 0, False)}
