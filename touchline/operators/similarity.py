"""Nearest neighbours within a role, with a scaler fitted without the query's own entity.

A search has any number of scenarios, which are rows of a table: each has its own flags (who may ask, who is in the
reference) and its own features. All scenarios are one plan:

1. Scales follow from aggregates of the reference of (scenario, role, feature): mean and squares or, for robust scenarios,
   order statistics around the quartiles. What one member's absence changes is computed from these, without pairs.
2. Queries and peers of a role are dealt into blocks, in which an entity is one row for all scenarios that it has the same
   vector in. A cell (query block, peer block) holds at most QUERIES and PEERS entities, compares BLOCK x BLOCK vectors at a
   time as arrays, and gives one list of the nearest top_k for each query; lists of a query are merged. So no key is a whole
   role. Pairs are quadratic in a role, as in every exact search; what is shuffled is a row for each query and peer block and
   for each peer and query block, so blocks are as large as a task can hold.

Features are arrays in a fixed order; a feature that a scenario or a role does not have is NULL there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..sources.shared import materialised
from .order import order_statistics

NO_PEERS = "INSUFFICIENT_PEERS"
#: Vectors that are compared with as many at a time.
BLOCK = 1024
#: Entities that ask, and peers, of one cell at most; and into how many cells the queries of a role are dealt if they are more than so many.
QUERIES, PEERS = 1 << 14, 1 << 16
SPREAD, FEW = 16, 64
GROUP = ["scenario", "role"]
ENTITY = [*GROUP, "player_id", "team_id"]


def wide_values(long: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """One row per spell with a column per feature."""
    return long.where(F.col("metric").isin(features)).groupBy(*keys).pivot("metric", features).agg(F.first("v"))


def configured(features: list[str]) -> Column:
    """Array of booleans: does the role have the feature? Keepers are compared on features of their own."""
    keeper = F.coalesce(F.col("role") == "GK", F.lit(False))
    return F.array(*[~keeper | F.lit(m in S.KEEPER_FEATURES) for m in features])


def vectors(wide: DataFrame, features: list[str], chosen: Column | None = None) -> DataFrame:
    """wide with x (feature values) and used (is the feature compared?); others are NULL in x.

    chosen: array of the names that the scenario of a row compares, all by default. `applies` tells whether the choice
    leaves something and, where it is a choice, leaves something out.
    """
    has = configured(features)
    names = F.array(*map(F.lit, features))
    picked = has if chosen is None else F.zip_with(names, has, lambda m, h: h & F.array_contains(chosen, m))
    some, all_of = (F.size(F.filter(a, lambda b: b)) for a in (picked, has))
    applies = some > 0 if chosen is None else (some > 0) & ((some < all_of) | (F.size(chosen) == len(features)))
    x = F.zip_with(F.array(*[F.col(m) for m in features]), F.col("used"), lambda v, u: F.when(u, v))
    return wide.withColumns({"used": picked, "applies": applies}).withColumn("x", x)


def _whole() -> Column:
    """No compared feature is missing."""
    return F.forall(F.arrays_zip("x", "used"), lambda p: ~p["used"] | p["x"].isNotNull())


def _ranks(n: Column) -> Column:
    """Ranks around the quartiles of n values, and of n without any one of them."""
    floor = lambda m, q: F.floor((m - 1) * q).cast("long")
    parts = [floor(m, q) + d for q in (0.25, 0.5, 0.75) for m, ds in ((n, (0, 1)), (n - 1, (0, 1, 2))) for d in map(F.lit, ds)]
    return F.array_distinct(F.array(*[F.greatest(p, F.lit(0)) for p in parts]))


def scalers(members: DataFrame, width: int) -> DataFrame:
    """Per (scenario, role): n members and fit, an array of the aggregates of each feature.

    From these the scale without any one member follows. members: scenario, role, robust, x, used.
    """
    long = members.select(*GROUP, "robust", F.posexplode(F.arrays_zip("x", "used")).alias("f", "p")).where("p.used").select(*GROUP, "robust", "f", F.col("p.x").alias("v"))
    keys = [*GROUP, "f"]
    first = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a row for each scenario, role and feature
    base = long.join(F.broadcast(first), keys)
    d = F.col("v") - F.col("c")
    second = base.groupBy(*keys).agg(
        F.sum(d * d).alias("q"), F.count_if(F.col("v") == F.col("lo")).alias("nlo"), F.count_if(F.col("v") == F.col("hi")).alias("nhi"),
        # what is left next to the ends tells whether the others are constant
        F.min(F.when(F.col("v") > F.col("lo"), F.col("v"))).alias("lo2"), F.max(F.when(F.col("v") < F.col("hi"), F.col("v"))).alias("hi2"),
    )
    at = order_statistics(long.where("robust"), keys, "v", _ranks).drop("n")
    fit = first.join(second, keys).join(at, keys, "left")
    parts = F.map_from_entries(F.collect_list(F.struct("f", F.struct("n", "c", "q", "lo", "hi", "nlo", "nhi", "lo2", "hi2", "at"))))
    each = fit.groupBy(*GROUP).agg(F.max("n").alias("n"), parts.alias("m"))
    return each.select(*GROUP, "n", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at("m", i)).alias("fit"))


def _quantile(fit: Column, own: Column, p: float) -> Column:
    """Quantile of a feature without the own value (NULL: with all), interpolated."""
    inside = own.isNotNull()
    size = fit["n"] - F.when(inside, 1).otherwise(0)
    place = (size - 1) * F.lit(p)
    low = F.floor(place).cast("int")

    def value(i: Column) -> Column:
        # the own value is taken out of its place: later values move up by one
        first = F.try_element_at(fit["at"], i)
        return F.when(inside & (first >= own), F.try_element_at(fit["at"], i + 1)).otherwise(first)

    part = place - low
    return F.when(part == 0, value(low)).otherwise(value(low) + (value(low + 1) - value(low)) * part)


def centre(fit: Column, own: Column, robust: Column) -> Column:
    mean = F.when(own.isNotNull(), fit["c"] - (own - fit["c"]) / (fit["n"] - 1)).otherwise(fit["c"])
    return F.when(robust, _quantile(fit, own, 0.5)).otherwise(mean)


def scale(fit: Column, own: Column, robust: Column) -> Column:
    """Scale of a feature without the query's own value (NULL when it is no member); 0 when constant."""
    n, q, inside = fit["n"], fit["q"], own.isNotNull()
    d = own - fit["c"]
    var = F.when(inside, (q - d * d) / (n - 1) - (d / (n - 1)) * (d / (n - 1))).otherwise(q / n)
    lo, hi = fit["lo"], fit["hi"]
    left = inside & (((own == lo) & (fit["nlo"] == 1) & (fit["lo2"] == hi)) | ((own == hi) & (fit["nhi"] == 1) & (fit["hi2"] == lo)))
    standard = F.when((lo == hi) | F.coalesce(left, F.lit(False)), F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return F.when(robust, _quantile(fit, own, 0.75) - _quantile(fit, own, 0.25)).otherwise(standard)


def _nearest(top_k: int, width: int):
    """The top_k nearest peers of each query of a cell."""
    names = ["scenario", "role", "player_id", "team_id", "peer_id", "peer_team", "distance"]

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def cell(asks: pa.Table, peers: pa.Table) -> pa.Table:
        if not asks.num_rows or not peers.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, [pa.string()] * 2 + [pa.int64()] * 4 + [pa.float64()], strict=True)})
        peers = peers.sort_by([("player_id", "ascending"), ("team_id", "ascending")])
        x, s, y = matrix(asks, "x"), matrix(asks, "s"), matrix(peers, "x")
        square = np.zeros((len(x), len(y)))
        columns = np.ascontiguousarray(y.T)
        # a few queries at a time, whose differences stay in the processor's cache
        for i in range(0, len(x), 32):
            part = slice(i, i + 32)
            z = np.empty_like(square[part])
            for f in range(width):
                on = s[part, f] > 0
                if on.all():
                    np.subtract(x[part, f, None], columns[f], out=z)
                    z /= s[part, f, None]
                    z *= z
                    square[part] += z
                elif on.any():
                    d = (x[part][on, f, None] - columns[f]) / s[part][on, f, None]
                    square[part][on] += d * d
        distance = np.sqrt(square, out=square)
        own = asks.column("player_id").to_numpy()[:, None] == peers.column("player_id").to_numpy()[None, :]
        distance[own] = np.inf
        # all peers up to the distance of the last wanted one are sorted, no others; they are in order of their ids, which breaks ties
        last = np.partition(distance, min(top_k, len(y)) - 1, axis=1)[:, min(top_k, len(y)) - 1]
        row, column = np.nonzero(~(distance > last[:, None]))
        got = distance[row, column]
        order = np.lexsort((column, got, row))
        row, column, got = row[order], column[order], got[order]
        some = (np.arange(len(row)) - np.searchsorted(row, row) < top_k) & ~own[row, column]
        row, column, got = row[some], column[some], got[some]
        values = [asks.column(k).take(pa.array(row)) for k in names[:4]] + [peers.column(k).take(pa.array(column)) for k in ("player_id", "team_id")]
        return pa.table([*values, pa.array(got)], names=names)

    return cell


def _cell(top_k: int, width: int):
    """The top_k nearest peers of each query and scenario of a cell, as one list; compared a BLOCK at a time."""
    nearest = _nearest(top_k, width)
    kind = pa.list_(pa.struct([("distance", pa.float64()), ("peer_id", pa.int64()), ("peer_team", pa.int64())]))

    def merged(parts: list[pa.Table]) -> pa.Table:
        """The first top_k of each query, in order."""
        rows = pa.concat_tables(parts)
        who = [rows.column(k).to_numpy() for k in ("player_id", "team_id")]
        order = np.lexsort([rows.column(k).to_numpy() for k in ("peer_team", "peer_id", "distance", "team_id", "player_id")])
        new = np.concatenate(([True], np.logical_or(*[np.diff(w[order]) != 0 for w in who])))[: len(order)]
        place = np.arange(len(order))
        return rows.take(pa.array(order[place - np.maximum.accumulate(np.where(new, place, 0)) < top_k]))

    def listed(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        who = [rows.column(k).to_numpy() for k in ("player_id", "team_id")]
        head = np.flatnonzero(np.concatenate(([True], np.logical_or(*[np.diff(w) != 0 for w in who])))[: len(rows)])
        flat = pa.StructArray.from_arrays([rows.column(k).combine_chunks() for k in ("distance", "peer_id", "peer_team")], names=["distance", "peer_id", "peer_team"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(rows)).astype(np.int32)), flat)
        return pa.table([*[rows.column(k).combine_chunks().take(pa.array(head)) for k in ENTITY], lists], names=[*ENTITY, "near"])

    def cell(asks: pa.Table, peers: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and peers.num_rows:
            asks, peers = asks.combine_chunks(), peers.combine_chunks()
            each, has = (t.column(k).combine_chunks() for t, k in ((asks, "each"), (peers, "scenarios")))
            of, member = pc.list_parent_indices(each), pc.list_parent_indices(has)
            each, has = each.flatten(), has.flatten()
            for scenario in each.field("scenario").unique():
                on = pc.equal(each.field("scenario"), scenario)
                mine, at = each.filter(on), of.filter(on)
                a = pa.table([mine.field("scenario"), *[asks.column(k).take(at) for k in ("role", "player_id", "team_id", "x")], mine.field("s")], names=[*ENTITY, "x", "s"])
                p = peers.take(member.filter(pc.equal(has, scenario)))
                for i in range(0, len(a), BLOCK):
                    best: list[pa.Table] = []
                    for j in range(0, len(p), BLOCK):
                        best = [merged([*best, nearest(a.slice(i, BLOCK), p.slice(j, BLOCK))])]
                    out += [listed(x) for x in best if len(x)]
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in zip([*ENTITY, "near"], [pa.string()] * 2 + [pa.int64()] * 2 + [kind], strict=True)})

    return cell


@dataclass
class Search:
    """queries: a row for each spell and scenario with status, counts, x and scales s; near: ranked neighbours; members: the reference."""

    queries: DataFrame
    near: DataFrame
    members: DataFrame
    features: list[str]

    def explained(self) -> DataFrame:
        """A row per neighbour and active feature: differences, squared contribution and its share."""
        q = self.queries.where("status = 'AVAILABLE'").select(*ENTITY, "x", "s")
        p = self.members.select(*GROUP, F.col("player_id").alias("peer_id"), F.col("team_id").alias("peer_team"), F.col("x").alias("y"))
        rows = self.near.join(q, ENTITY).join(p, [*GROUP, "peer_id", "peer_team"])
        rows = rows.withColumn("metric", F.array(*map(F.lit, self.features)))
        rows = rows.select(*ENTITY, "peer_id", "peer_team", "rank", "distance", F.explode(F.arrays_zip("metric", "x", "y", "s")).alias("f"))
        rows = rows.select("*", F.col("f.metric").alias("metric"), F.col("f.x").alias("query_value"), F.col("f.y").alias("peer_value"), F.col("f.s").alias("scale")).drop("f").where("scale > 0")
        z = (F.col("query_value") - F.col("peer_value")) / F.col("scale")
        rows = rows.withColumns({"raw_difference": F.col("query_value") - F.col("peer_value"), "standardized": z, "contribution": z * z})
        total = F.col("distance") * F.col("distance")
        return rows.withColumn("share", F.when(total > 0, F.col("contribution") / total).otherwise(0.0))

    def scaler(self) -> DataFrame:
        """A row per query with enough peers and compared feature: centre, scale and status of the scale."""
        rows = self.queries.where("status in ('AVAILABLE', 'NO_VARIABLE_FEATURES')").withColumn("metric", F.array(*map(F.lit, self.features)))
        rows = rows.select(*ENTITY, F.explode(F.arrays_zip("metric", "used", "c", "s")).alias("f")).where("f.used")
        return rows.select(*ENTITY, "f.metric", F.col("f.c").alias("centre"), F.col("f.s").alias("scale"), F.when(F.col("f.s") > 0, "ACTIVE").otherwise("ZERO_SCALE").alias("status"))


def search(rows: DataFrame, features: list[str], *, top_k: int = S.TOP_K, min_peers: int = S.MIN_PEERS, block: int | None = None) -> Search:
    """Neighbours of every row that may ask, in every scenario.

    rows: scenario, robust, player_id, team_id, role, minutes, eligible, is_ref, x, used, applies (see `vectors`).
    block: entities of a side of a cell, by default as many as a task can hold.
    """
    width = len(features)
    rows = rows.withColumn("whole", _whole())
    refs = rows.where(F.col("is_ref") & F.col("applies") & F.col("role").isNotNull())
    members = refs.where("whole").select(*GROUP, "player_id", "team_id", "robust", "x", "used")
    counts = refs.groupBy(*GROUP).agg(F.count("*").alias("refs"))
    fit = counts.join(scalers(members, width), GROUP, "left")
    own = refs.select(*GROUP, "player_id", F.col("whole").alias("member"), F.when(F.col("whole"), F.col("x")).alias("own"))
    # a row for each scenario and role
    q = rows.join(own, [*GROUP, "player_id"], "left").join(F.broadcast(fit), GROUP, "left")
    asks = F.col("eligible") & F.col("whole") & F.col("applies")
    peers = F.coalesce("n", F.lit(0)) - F.when(F.col("member"), 1).otherwise(0)
    others = F.coalesce("refs", F.lit(0)) - F.when(F.col("member").isNotNull(), 1).otherwise(0)
    place = F.sequence(F.lit(0), F.lit(width - 1))
    of = lambda f, i: f(F.get("fit", i), F.get("own", i), F.col("robust"))
    enough = asks & (peers >= min_peers)
    q = q.withColumns({
        "peer_count": F.when(asks, peers).otherwise(0).cast("long"),
        "incomplete": F.when(asks, others - peers).otherwise(0).cast("long"),
        "s": F.when(enough, F.transform(place, lambda i: F.when(F.get("used", i), of(scale, i)))),
        "c": F.when(enough, F.transform(place, lambda i: F.when(F.get("used", i), of(centre, i)))),
    })
    active = F.coalesce(F.size(F.filter("s", lambda v: v > 0)), F.lit(0))
    compared = F.size(F.filter("used", lambda u: u))
    status = (
        F.when(~F.col("eligible"), "INELIGIBLE_QUERY")
        .when(~F.col("applies"), "NOT_APPLICABLE")
        .when(~F.col("whole"), "MISSING_QUERY_FEATURES")
        .when(F.col("peer_count") < min_peers, NO_PEERS)
        .when(active <= 0, "NO_VARIABLE_FEATURES")
        .otherwise("AVAILABLE")
    )
    q = q.withColumns({"active": F.greatest(active, F.lit(0)), "compared": compared}).withColumn("status", status)
    good = F.col("status") == "AVAILABLE"
    warnings = F.array_compact(F.array(
        F.when(F.col("status").isin("AVAILABLE", "NO_VARIABLE_FEATURES") & (F.col("active") < F.col("compared")), F.lit("ZERO_SCALE_FEATURES_OMITTED")),
        F.when(good & (F.col("peer_count") < top_k), F.lit("FEWER_NEIGHBORS_THAN_REQUESTED")),
    ))
    q = q.withColumn("warnings", warnings)
    q = materialised(q.select(*ENTITY, "minutes", "status", "peer_count", "incomplete", "active", "warnings", "robust", "used", "x", "s", "c"), "queries")
    members = materialised(members.select(*GROUP, "player_id", "team_id", "x"), "members")
    # cells: a row for each role says how many blocks there are, so that one has so many entities of any scenario
    sizes = q.where("status = 'AVAILABLE'").groupBy(*GROUP).agg(F.count("*").alias("nq"), F.max("peer_count").alias("np")).groupBy("role").agg(F.max("nq").alias("nq"), F.max("np").alias("np"))
    parts = lambda n, size: F.ceil(n / size).cast("int")
    spread = parts(F.col("nq"), block or QUERIES) if block else F.greatest(parts(F.col("nq"), QUERIES), F.least(F.lit(SPREAD), parts(F.col("nq"), FEW)))
    sizes = sizes.select("role", spread.alias("qs"), parts(F.col("np") + 1, block or PEERS).alias("ps"))
    deal = lambda n: F.pmod(F.xxhash64("player_id", "team_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # an entity's vector is the same in most scenarios, and crosses the shuffle once for them
    who = ["role", "player_id", "team_id", "x"]
    a = q.where("status = 'AVAILABLE'").groupBy(*who).agg(F.collect_list(F.struct("scenario", "s")).alias("each"))
    a = a.join(F.broadcast(sizes), "role").withColumn("i", deal(F.col("qs"))).withColumn("j", each(F.col("ps"))).select(*who, "i", "j", "each")
    p = members.groupBy(*who).agg(F.collect_list("scenario").alias("scenarios"))
    p = p.join(F.broadcast(sizes), "role").withColumn("j", deal(F.col("ps"))).withColumn("i", each(F.col("qs"))).select(*who, "i", "j", "scenarios")
    cell = ["role", "i", "j"]
    schema = "scenario string, role string, player_id long, team_id long, near array<struct<distance:double,peer_id:long,peer_team:long>>"
    found = a.groupBy(*cell).cogroup(p.groupBy(*cell)).applyInArrow(_cell(top_k, width), schema)
    # at most top_k entries from each peer block
    near = found.groupBy(*ENTITY).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, top_k).alias("near"))
    near = near.select(*ENTITY, F.posexplode("near").alias("place", "n")).select(*ENTITY, "n.peer_id", "n.peer_team", "n.distance", (F.col("place") + 1).alias("rank"))
    return Search(q, materialised(near, "near"), members, features)


def plain_rows(wide: DataFrame, features: list[str], robust: bool = False, keep: Column | None = None) -> DataFrame:
    """Rows of one scenario without a name. keep restricts the reference entities."""
    rows = vectors(wide, features).withColumns({"scenario": F.lit(""), "robust": F.lit(robust)})
    return rows if keep is None else rows.withColumn("is_ref", F.col("is_ref") & keep)


def neighbours(wide: DataFrame, features: list[str], *, robust: bool = False, top_k: int = S.TOP_K, min_peers: int = S.MIN_PEERS, keep: Column | None = None) -> Search:
    """Search of every spell of wide (player_id, team_id, role, minutes, eligible, is_ref and the features)."""
    return search(plain_rows(wide, features, robust, keep), features, top_k=top_k, min_peers=min_peers)


def find_similar(wide: DataFrame, player_id: int, team_id: int, *, role: str | None = None, top_k: int = S.TOP_K, features: list[str] | None = None, scaling: str = "standard", min_peers: int = S.MIN_PEERS) -> DataFrame:
    """One row: the search of one spell, with its scaler, warnings and neighbours.

    Arguments that cannot be meant are errors: top_k outside 1 to 50, an unknown scaling, features that are none, repeated
    or not configured for the role, an unknown or repeated spell, another role than the spell has.
    """
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 50:
        raise ValueError("top_k must be an integer from 1 to 50")
    if scaling not in ("standard", "robust"):
        raise ValueError("scaling is standard or robust")
    if wide.groupBy("player_id", "team_id").count().where("count > 1").limit(1).count():
        raise ValueError("a spell has two profiles")
    own = wide.where((F.col("player_id") == player_id) & (F.col("team_id") == team_id)).select("role").first()
    if own is None:
        raise ValueError("there is no such spell")
    if role is not None and role != own["role"]:
        raise ValueError("the spell has another role")
    every = [m for m in S.FEATURES if own["role"] != "GK" or m in S.KEEPER_FEATURES] if own["role"] else []
    chosen = every if features is None else list(features)
    if features is not None and (not chosen or len(set(chosen)) < len(chosen) or not set(chosen) <= set(every)):
        raise ValueError("features must be a nonempty subset of those of the role")
    rows = vectors(wide, S.FEATURES, F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<string>")).withColumn("applies", F.lit(True))
    me = (F.col("player_id") == player_id) & (F.col("team_id") == team_id)
    # only this spell asks; without a role it has no peers
    rows = rows.where(me | (F.col("is_ref") & F.col("role").eqNullSafe(F.lit(own["role"])))).withColumn("eligible", me & F.col("eligible"))
    rows = rows.withColumns({"scenario": F.lit(""), "robust": F.lit(scaling == "robust"), "role": F.coalesce("role", F.lit("-"))})
    found = search(rows, S.FEATURES, top_k=top_k, min_peers=min_peers)
    near = found.explained().where(me).groupBy("peer_id", "peer_team", "rank", "distance").agg(F.array_sort(F.collect_list(F.struct("metric", "query_value", "peer_value", "raw_difference", "standardized", "contribution", "share"))).alias("differences"))
    by = lambda sign: F.slice(F.transform(F.array_sort(F.transform("differences", lambda d: F.struct((sign * F.abs(d["standardized"])).alias("z"), d["metric"].alias("metric")))), lambda d: d["metric"]), 1, 3)
    near = near.select("rank", "peer_id", "peer_team", "distance", (100 / (1 + F.col("distance"))).alias("score"), "differences", by(1).alias("key_similarities"), by(-1).alias("key_differences"))
    # at most top_k neighbours
    near = near.agg(F.array_sort(F.collect_list(F.struct(*near.columns))).alias("neighbours"))
    scales = found.scaler().where(me).agg(F.array_sort(F.collect_list(F.struct("metric", "centre", "scale", "status"))).alias("scaler"))
    one = found.queries.where(me).select("player_id", "team_id", F.lit(own["role"]).alias("role"), "status", "peer_count", "incomplete", "warnings")
    return one.join(scales).join(near)
