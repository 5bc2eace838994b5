"""Neighbour search, order statistics and ranks against plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from touchline import settings as S
from touchline.operators import order, ranking
from touchline.operators import similarity as Sim

FEATS = S.FEATURES
SCHEMA = "player_id long, team_id long, role string, minutes double, eligible boolean, is_ref boolean, " + ", ".join(f"{m} double" for m in FEATS)


def population(seed, n, roles=("CB", "GK", "ST")):
    rng = random.Random(seed)
    rows = []
    for p in range(n):
        role, eligible = rng.choice(roles), rng.random() < 0.9
        x = [rng.choice([None, *range(8)]) if rng.random() < 0.02 else float(rng.randint(0, 8)) for _ in FEATS]
        x = [None if v is None else float(v) for v in x]
        if role == "ST":
            x[3] = 1.0
        rows.append((p, p % 3, role, 500.0, eligible, eligible, *x))
        if rng.random() < 0.1:
            rows.append((p, 9, role, 450.0, eligible, False, *[float(rng.randint(0, 8)) for _ in FEATS]))
    rows.append((n + 1, 1, None, 500.0, False, False, *[1.0] * len(FEATS)))
    return rows


def quantile(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def plain(rows, query, robust=False, chosen=None, top_k=10, min_peers=10):
    player, team, role = query[:3]
    used = [i for i, m in enumerate(FEATS) if (role != "GK" or m in S.KEEPER_FEATURES) and (chosen is None or m in chosen)]
    x = lambda r: [r[6 + i] for i in used]
    if not query[4]:
        return "INELIGIBLE_QUERY", 0, [], [], []
    if None in x(query):
        return "MISSING_QUERY_FEATURES", 0, [], [], []
    peers = [r for r in rows if r[5] and r[2] == role and r[0] != player and None not in x(r)]
    if len(peers) < min_peers:
        return "INSUFFICIENT_PEERS", len(peers), [], [], []
    scale = []
    for k in range(len(used)):
        v = [x(r)[k] for r in peers]
        scale.append(quantile(v, 0.75) - quantile(v, 0.25) if robust else statistics.pstdev(v))
    warnings = ["ZERO_SCALE_FEATURES_OMITTED"] if min(scale) == 0 else []
    if max(scale) == 0:
        return "NO_VARIABLE_FEATURES", len(peers), scale, [], warnings
    near = sorted((math.sqrt(sum(((a - b) / s) ** 2 for a, b, s in zip(x(query), x(r), scale, strict=True) if s > 0)), r[0], r[1]) for r in peers)[:top_k]
    return "AVAILABLE", len(peers), scale, near, warnings + (["FEWER_NEIGHBORS_THAN_REQUESTED"] if len(peers) < top_k else [])


@pytest.mark.parametrize("robust, block", [(False, 1024), (True, 1024), (False, 7)])
def test_search_equals_all_pairs(spark, robust, block):
    rows = population(4, 120)
    wide = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = Sim.search(Sim.plain_rows(wide, FEATS, robust), FEATS, block=block)
    status = {(r.player_id, r.team_id): r for r in found.queries.collect()}
    near = {}
    for r in sorted(found.near.collect(), key=lambda r: r.rank):
        near.setdefault((r.player_id, r.team_id), []).append((r.distance, r.peer_id, r.peer_team))
    assert len(status) == len(rows)
    for q in rows:
        want, peers, scale, best, warnings = plain(rows, q, robust)
        got = status[q[:2]]
        assert (got.status, got.peer_count, got.warnings) == (want, peers, warnings)
        if scale:
            assert [v for v, u in zip(got.s, got.used, strict=True) if u] == pytest.approx(scale, abs=1e-9)
        have = near.get(q[:2], [])
        assert [d for d, _, _ in have] == pytest.approx([d for d, _, _ in best])
        assert [p for _, *p in have] == [list(p) for _, *p in best]
    assert {r[2] for r in rows if status[r[:2]].status == "AVAILABLE"} == {"CB", "GK", "ST"}


def test_shares_of_explained_features(spark):
    found = Sim.neighbours(spark.createDataFrame(population(5, 60), SCHEMA), FEATS)
    rows = found.explained().groupBy("player_id", "team_id", "rank", "distance").agg(F.sum("contribution").alias("c"), F.sum("share").alias("s"), F.count("*").alias("n")).collect()
    assert rows and all(r.c == pytest.approx(r.distance**2) and (r.distance == 0 or r.s == pytest.approx(1)) for r in rows)


def test_choice_of_features_does_not_apply_to_keepers(spark):
    wide = spark.createDataFrame(population(6, 80), SCHEMA)
    for gone in (S.ABLATIONS["without_passing"], S.ABLATIONS["without_carrying"]):
        chosen = [m for m in FEATS if m not in gone]
        rows = Sim.vectors(wide, FEATS, F.array(*map(F.lit, chosen))).withColumns({"scenario": F.lit("x"), "robust": F.lit(False)})
        found = Sim.search(rows, FEATS).queries.where("status <> 'INELIGIBLE_QUERY'").groupBy("role").agg(F.collect_set("status").alias("s")).collect()
        assert {r.role: "NOT_APPLICABLE" in r.s for r in found} == {"GK": True, "CB": False, "ST": False}


def test_find_similar(spark):
    rows = population(7, 70)
    wide = spark.createDataFrame(rows, SCHEMA)
    for role in ("GK", "ST"):
        q = next(r for r in rows if r[2] == role and r[4] and None not in r[6:])
        for kind in ("standard", "robust"):
            got = Sim.find_similar(wide, q[0], q[1], scaling=kind, top_k=50).first()
            status, peers, scale, near, warnings = plain(rows, q, kind == "robust", top_k=50)
            assert (got.status, got.peer_count, got.warnings) == (status, peers, warnings)
            assert [n.peer_id for n in got.neighbours] == [p for _, p, _ in near]
            by_name = sorted(zip([m for m in FEATS if role != "GK" or m in S.KEEPER_FEATURES], scale, strict=True))
            assert [(s.metric, s.scale) for s in got.scaler] == [(m, pytest.approx(v, abs=1e-9)) for m, v in by_name]
            first = got.neighbours[0]
            size = sorted((abs(d.standardized), d.metric) for d in first.differences)
            assert first.key_similarities == [m for _, m in size[:3]]
            assert first.key_differences == [m for _, m in sorted(size, key=lambda x: (-x[0], x[1]))[:3]]
    q = next(r for r in rows if r[2] == "CB" and r[4] and None not in r[6:])
    assert Sim.find_similar(wide, q[0], q[1], features=["shots"]).first().status == "AVAILABLE"
    assert Sim.find_similar(wide.where("role <> 'CB'").unionByName(wide.where(f"player_id = {q[0]}")), q[0], q[1]).first().status == "INSUFFICIENT_PEERS"
    assert Sim.find_similar(wide, 71, 1).first().status == "INELIGIBLE_QUERY"
    wrong = [dict(top_k=0), dict(top_k=51), dict(top_k=True), dict(scaling="log"), dict(features=[]), dict(features=["shots", "shots"]), dict(features=["goals"]), dict(role="GK")]
    for bad in wrong:
        with pytest.raises(ValueError):
            Sim.find_similar(wide, q[0], q[1], **bad)
    with pytest.raises(ValueError):
        Sim.find_similar(wide, 10**6, 0)
    with pytest.raises(ValueError):
        Sim.find_similar(wide.union(wide), q[0], q[1])


def test_empty_search(spark):
    found = Sim.neighbours(spark.createDataFrame([], SCHEMA), FEATS)
    assert found.queries.count() == found.near.count() == found.explained().count() == found.scaler().count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics(spark, seed):
    rng = random.Random(seed)
    rows = [(g, float(rng.choice([rng.randint(0, 5), rng.random() * 1000, 3]))) for g in ("a", "b") for _ in range(rng.randint(1, 900))] + [("c", 7.0)] * 400 + [("d", None), ("e", 1.0)]
    got = {r.g: (r.n, r.at) for r in order.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", lambda n: F.array(F.lit(0), F.floor(n / 2), n - 1, n + 5)).collect()}
    for g in "abce":
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == (len(v), {0: v[0], len(v) // 2: v[len(v) // 2], len(v) - 1: v[-1]})
    assert "d" not in got


@pytest.mark.parametrize("limit", [None, 1, 25, 10**6])
def test_ranks(spark, limit):
    rng = random.Random(9)
    rows = [(g, rng.choice([1.5, 2.5, rng.random() * 10]), i) for g in ("a", "b") for i in range(700)] + [("c", 1.0, i) for i in range(300)] + [("d", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(4)
    got = order.ranked(df, ["g"], "v", ["id"], limit=None if limit is None else F.lit(limit)).collect()
    want = {}
    for g in "abc":
        for i, (_, k) in enumerate(sorted((-v, k) for h, v, k in rows if h == g)):
            if limit is None or i < limit:
                want[g, k] = i + 1
    assert {(r.g, r.id): r["rank"] for r in got} == want


def test_requirements_that_cannot_be_meant():
    good = {"role": "CB", "weights": {"tackles": 1.0}}
    ranking.check_requirement(good)
    for change in ({"role": "XX"}, {"weights": {}}, {"weights": {"tackles": -1.0}}, {"weights": {"average_action_x": 1.0}}, {"weights": {"nothing": 1.0}}, {"min_minutes": -1.0}, {"min_minutes": float("nan")}, {"top_k": 0}, {"top_k": 1.0}, {"role": "GK", "weights": {"shots": 1.0}}):
        with pytest.raises(ValueError):
            ranking.check_requirement(good | change)


def test_exposure_conventions_and_catalog(spark, tmp_path):
    from touchline.functions.scalars import denominator
    from touchline.sources import json as J

    row = spark.range(1).select(denominator("elapsed_including_stoppage", F.lit(5400.0), F.lit(88.0)).alias("a"), denominator("nominal", F.lit(5400.0), F.lit(88.0)).alias("b")).first()
    assert (row.a, row.b) == (90.0, 88.0)
    with pytest.raises(ValueError):
        denominator("guess", F.lit(1.0), F.lit(1.0))
    one = '{"competition_id": 37, "season_id": %d}'
    (tmp_path / "a.json").write_text("[" + one % 1 + "," + one % 2 + "]")
    assert J.competitions(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.json").write_text("[" + one % 2 + "]")
    with pytest.raises(ValueError, match="37/2"):
        J.competitions(spark, str(tmp_path))


def test_cell_keeps_the_nearest_with_ties_in_order_of_ids():
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(3)
    for n, peers, k in ((40, 300, 10), (5, 3, 10), (30, 200, 1)):
        y = g.integers(0, 3, (peers, 2)).astype(float)
        y[0] = np.nan  # sorted last
        x, ids, own = g.integers(0, 3, (n, 2)).astype(float), g.permutation(peers), g.integers(0, peers, n)
        asks = pa.table({"scenario": ["s"] * n, "role": ["r"] * n, "player_id": own, "team_id": [0] * n, "x": x.tolist(), "s": [[i % 3 / 2, 2.0] for i in range(n)]})
        got = Sim._nearest(k, 2)(asks, pa.table({"player_id": ids, "team_id": [0] * peers, "x": y.tolist()}))
        want = []
        for i in range(n):
            on = [1] if i % 3 == 0 else [0, 1]  # a scale of zero is left out
            d = [(np.inf if p == own[i] else np.sqrt((((x[i] - v)[on] / np.array([i % 3 / 2, 2.0])[on]) ** 2).sum()), p) for v, p in zip(y, ids, strict=True)]
            want += [(own[i], p) for _, p in sorted(d, key=lambda t: (np.isnan(t[0]), t))[:k] if p != own[i]]
        assert list(zip(got["player_id"].to_pylist(), got["peer_id"].to_pylist(), strict=True)) == want


def test_cell_of_several_scenarios_is_compared_in_tiles(monkeypatch):
    """One row for an entity and all its scenarios, one list for a query: equal to a sort of all pairs."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(Sim, "BLOCK", 7)
    g = np.random.default_rng(8)
    x, y = g.integers(0, 4, (30, 2)).astype(float), g.integers(0, 4, (50, 2)).astype(float)
    scale = {"a": [1.0, 2.0], "b": [3.0, 0.0]}
    has = [["a", "b"] if i % 3 else ["b"] for i in range(50)]
    asks = pa.table({"role": ["r"] * 30, "player_id": range(30), "team_id": [0] * 30, "x": x.tolist(), "each": [[{"scenario": n, "s": s} for n, s in scale.items() if i % 5 or n == "a"] for i in range(30)]})
    peers = pa.table({"role": ["r"] * 50, "player_id": range(50), "team_id": [0] * 50, "x": y.tolist(), "scenarios": has})
    got = {(r["scenario"], r["player_id"]): [(n["distance"], n["peer_id"]) for n in r["near"]] for r in Sim._cell(6, 2)(asks, peers).to_pylist()}
    want = {}
    for n, s in scale.items():
        for i in (i for i in range(30) if i % 5 or n == "a"):
            on = [k for k in range(2) if s[k] > 0]
            d = sorted((float(np.sqrt((((x[i] - y[j])[on] / np.array(s)[on]) ** 2).sum())), j) for j in range(50) if j != i and n in has[j])
            want[n, i] = d[:6]
    assert got.keys() == want.keys() and all([j for _, j in got[k]] == [j for _, j in want[k]] for k in want)
    assert Sim._cell(6, 2)(asks.slice(0, 0), peers).num_rows == Sim._cell(6, 2)(asks, peers.slice(0, 0)).num_rows == 0


def test_scenarios_share_their_cells(spark, monkeypatch):
    """What is shuffled to a cell is not multiplied by scenarios: the keys of cells have none."""
    plans, old = [], Sim.materialised

    def kept(df, name, **options):
        plans.append(df._jdf.queryExecution().analyzed().toString() if name == "near" else "")
        return old(df, name, **options)

    monkeypatch.setattr(Sim, "materialised", kept)
    rows = Sim.plain_rows(spark.createDataFrame(population(4, 60), SCHEMA), FEATS).drop("scenario").withColumn("scenario", F.explode(F.array(F.lit("a"), F.lit("b"))))
    found = Sim.search(rows, FEATS)
    a, b = (found.near.where(F.col("scenario") == n).drop("scenario") for n in "ab")
    assert a.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    (line,) = [x for x in plans[-1].splitlines() if "FlatMapCoGroupsInArrow" in x]
    assert "scenario" not in line[: line.index("cell(")]
