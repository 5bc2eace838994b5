"""Queries of similarity, ranking, sensitivity and stability, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalars import eligibility_at, hash_bucket, point, retained
from ..operators import audits as Au
from ..operators import profiles as P
from ..operators import ranking as R
from ..operators import similarity as Sim
from ..operators.order import order_statistics
from ..sources.shared import materialised
from .cohort import SPELL, Cohort, cohort_sql

QUERIES, ORACLE = {}, {}
FEATS = S.FEATURES
INFO = ["player_id", "team_id", "role", "minutes", "eligible", "is_ref"]
_PIVOT = ", ".join(f"max(case when metric = '{m}' then v end) as {m}" for m in FEATS)
WIDE_SQL = f""",
wide as (select p.player_id, p.team_id, p.role, p.minutes, p.eligible, p.is_ref, {_PIVOT} from spells p join season s on p.player_id = s.player_id and p.team_id = s.team_id group by all)"""


def similarity_sql(name: str, feats: list[str] = FEATS, robust: bool = False, keep: str = "true", wide: str = "wide", k: int = S.TOP_K) -> str:
    """CTEs <name>_q (status of each spell) and <name> (neighbours)."""
    whole = lambda t: " and ".join(f"{t}.{m} is not null" for m in feats)
    spread = (lambda m: f"quantile_cont(p.{m}, 0.75) - quantile_cont(p.{m}, 0.25)") if robust else (lambda m: f"stddev_pop(p.{m})")
    scale = ", ".join(f"case when min(p.{m}) = max(p.{m}) then 0 else {spread(m)} end as {m}_s" for m in feats)
    active = " + ".join(f"case when {m}_s > 0 then 1 else 0 end" for m in feats)
    square = " + ".join(f"case when {m}_s > 0 then pow((q.{m} - p.{m}) / {m}_s, 2) else 0 end" for m in feats)
    return f""",
{name}_p as (select * from {wide} p where is_ref and {whole("p")} and {keep}),
{name}_fit as (select q.role, q.player_id, q.team_id, count(*) as n, {scale} from {wide} q join {name}_p p on p.role = q.role and p.player_id <> q.player_id where q.eligible and {whole("q")} group by all),
{name}_q as (
  select q.player_id, q.team_id, q.role, q.minutes, coalesce(n, 0) as peer_count, {active} as active,
    case when not q.eligible then 'INELIGIBLE_QUERY' when not ({whole("q")}) then 'MISSING_QUERY_FEATURES' when coalesce(n, 0) < {S.MIN_PEERS} then 'INSUFFICIENT_PEERS'
      when {active} = 0 then 'NO_VARIABLE_FEATURES' else 'AVAILABLE' end as status
  from {wide} q left join {name}_fit f on q.role = f.role and q.player_id = f.player_id and q.team_id = f.team_id),
{name} as (
  select * from (
    select *, row_number() over (partition by role, player_id, team_id order by distance, peer_id, peer_team) as rank from (
      select q.role, q.player_id, q.team_id, s.minutes, p.player_id as peer_id, p.team_id as peer_team, sqrt({square}) as distance,
        {", ".join(f"q.{m} as {m}, p.{m} as {m}_p, {m}_s" for m in feats)}
      from {name}_q s join {wide} q on s.role = q.role and s.player_id = q.player_id and s.team_id = q.team_id and s.status = 'AVAILABLE'
        join {name}_fit f on q.role = f.role and q.player_id = f.player_id and q.team_id = f.team_id
        join {name}_p p on p.role = q.role and p.player_id <> q.player_id) x) y where rank <= {k})"""


BASE = cohort_sql() + WIDE_SQL
SIM = BASE + similarity_sql("near")


def query(sql: str, prefix: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Cohort(spark, sf_dir))
        ORACLE[f.__name__] = prefix + "\n" + sql
        return f

    return add


def _wide(c: Cohort):
    return materialised(Sim.wide_values(c.long, FEATS, INFO), "wide")


@query("select role, metric, round(avg(v), 6) as centre, round(stddev_pop(v), 6) as scale from long where is_ref and v is not null group by all", BASE)
def scaler_standard(c):
    rows = c.long.where("is_ref and v is not null")
    return rows.groupBy("role", "metric").agg(point(F.avg("v")).alias("centre"), point(F.stddev_pop("v")).alias("scale"))


@query("select role, metric, round(quantile_cont(v, 0.5), 6) as centre, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) as scale from long where is_ref and v is not null group by all", BASE)
def scaler_robust(c):
    """Quartiles by selection: only the buckets of values that hold them are sorted."""
    rows = c.long.where("is_ref and v is not null and role is not null")
    floor = lambda n, q, d: F.least(F.floor((n - 1) * q).cast("long") + d, n - 1)
    got = order_statistics(rows, ["role", "metric"], "v", lambda n: F.array_distinct(F.array(*[floor(n, q, d) for q in (0.25, 0.5, 0.75) for d in (0, 1)])))

    def quantile(q):
        low = floor(F.col("n"), q, 0).cast("int")
        a, b = F.element_at("at", low), F.element_at("at", F.least(low + 1, F.col("n") - 1).cast("int"))
        return a + (b - a) * ((F.col("n") - 1) * q - low)

    return got.select("role", "metric", point(quantile(0.5)).alias("centre"), point(quantile(0.75) - quantile(0.25)).alias("scale"))


@query("select q.player_id, q.team_id, count(*) as peers from wide q join wide p on p.role = q.role and p.is_ref and p.player_id <> q.player_id where q.eligible group by all", BASE)
def peer_pairs(c):
    """Peers of a query: its role's reference without its own entity, counted without making the pairs."""
    s = c.spells
    n = s.where("is_ref").groupBy("role").agg(F.count("*").alias("n"))
    own = s.where("is_ref").select("role", "player_id", F.lit(1).alias("own"))
    rows = s.where("eligible").join(n, "role").join(own, ["role", "player_id"], "left")
    return rows.withColumn("peers", F.col("n") - F.coalesce("own", F.lit(0))).where("peers > 0").select(*SPELL, "peers")


@query("select player_id, team_id, rank, peer_id, peer_team, round(distance, 6) as distance, round(100 / (1 + distance), 6) as score from near", SIM)
def neighbors(c):
    near = Sim.neighbours(_wide(c), FEATS).near
    return near.select(*SPELL, "rank", "peer_id", "peer_team", point(F.col("distance")).alias("distance"), point(100 / (1 + F.col("distance"))).alias("score"))


@query("select player_id, team_id, status, case when status in ('AVAILABLE', 'INSUFFICIENT_PEERS', 'NO_VARIABLE_FEATURES') then peer_count else 0 end as peer_count from near_q", SIM)
def similarity_status(c):
    return Sim.neighbours(_wide(c), FEATS).queries.select(*SPELL, "status", "peer_count")


@query(f"""select q.player_id, q.team_id, q.status, q.peer_count, q.incomplete,
  concat_ws(',', case when q.status in ('AVAILABLE', 'NO_VARIABLE_FEATURES') and active < {len(FEATS)} then 'ZERO_SCALE_FEATURES_OMITTED' end, case when q.status = 'AVAILABLE' and q.peer_count < {S.TOP_K} then 'FEWER_NEIGHBORS_THAN_REQUESTED' end) as warnings
from (select q.*, case when q.status in ('INELIGIBLE_QUERY', 'MISSING_QUERY_FEATURES') then 0 else (select count(*) from wide r where r.is_ref and r.role = q.role and r.player_id <> q.player_id) - peer_count end as incomplete from (
  select * exclude (peer_count), case when status in ('INELIGIBLE_QUERY', 'MISSING_QUERY_FEATURES') then 0 else peer_count end as peer_count from near_q) q) q""", SIM)
def similarity_report(c):
    """Peers used and left out, and the warnings, of every search."""
    return Sim.neighbours(_wide(c), FEATS).queries.select(*SPELL, "status", "peer_count", "incomplete", F.array_join("warnings", ",").alias("warnings"))


def _scaler_sql(robust: bool) -> str:
    rows = []
    for m in FEATS:
        centre, spread = (f"median(p.{m})", f"quantile_cont(p.{m}, 0.75) - quantile_cont(p.{m}, 0.25)") if robust else (f"avg(p.{m})", f"stddev_pop(p.{m})")
        rows.append(f"select q.player_id, q.team_id, '{m}' as metric, round({centre}, 6) as centre, round(case when min(p.{m}) = max(p.{m}) then 0 else {spread} end, 6) as scale from near_q q join near_p p on p.role = q.role and p.player_id <> q.player_id where q.status in ('AVAILABLE', 'NO_VARIABLE_FEATURES') group by all")
    return f"select *, case when scale > 0 then 'ACTIVE' else 'ZERO_SCALE' end as status from ({' union all '.join(rows)}) x"


@query(_scaler_sql(False), SIM)
def search_scaler(c):
    """The scaler of every search, fitted without its own entity."""
    return Sim.neighbours(_wide(c), FEATS).scaler().select(*SPELL, "metric", point(F.col("centre")).alias("centre"), point(F.col("scale")).alias("scale"), "status")


@query(_scaler_sql(True), SIM)
def search_scaler_robust(c):
    return Sim.neighbours(_wide(c), FEATS, robust=True).scaler().select(*SPELL, "metric", point(F.col("centre")).alias("centre"), point(F.col("scale")).alias("scale"), "status")


@query("""select q.player_id, q.team_id, q.status, count(n.rank) as returned, max(n.peer_id) filter (where n.rank = 1) as closest
from near_q q left join near n on q.player_id = n.player_id and q.team_id = n.team_id group by all""", SIM)
def similarity_batch(c):
    found = Sim.neighbours(_wide(c), FEATS)
    q, near = found.queries, found.near
    each = near.groupBy(*SPELL).agg(F.count("*").alias("returned"), F.max(F.when(F.col("rank") == 1, F.col("peer_id"))).alias("closest"))
    return q.join(each, SPELL, "left").select(*SPELL, "status", F.coalesce("returned", F.lit(0)).alias("returned"), "closest")


_EXPLODE = " union all ".join(f"select role, player_id, team_id, peer_id, rank, distance, '{m}' as metric, {m} - {m}_p as raw, ({m} - {m}_p) / {m}_s as z from near where {m}_s > 0" for m in FEATS)


@query(f"""select player_id, team_id, peer_id, rank, metric, round(raw, 6) as raw_difference, round(z, 6) as standardized, round(case when distance > 0 then z * z / (distance * distance) else 0 end, 6) as share,
  row_number() over (partition by player_id, team_id, rank order by round(abs(z), 9), metric) as similar_rank from ({_EXPLODE}) x where rank <= 2""", SIM)
def neighbor_explain(c):
    rows = Sim.neighbours(_wide(c), FEATS).explained().where("rank <= 2")
    w = Window.partitionBy(*SPELL, "rank").orderBy(point(F.abs(F.col("standardized")), 9), "metric")
    rows = rows.withColumn("similar_rank", F.row_number().over(w))
    return rows.select(*SPELL, "peer_id", "rank", "metric", point(F.col("raw_difference")).alias("raw_difference"), point(F.col("standardized")).alias("standardized"), point(F.col("share")).alias("share"), "similar_rank")


@query(f"""select player_id, team_id, peer_id, rank, metric, round(raw, 6) as raw_difference, round(z, 6) as standardized, similar_rank, different_rank from (
  select *, row_number() over (partition by player_id, team_id, rank order by round(abs(z), 9), metric) as similar_rank,
    row_number() over (partition by player_id, team_id, rank order by round(abs(z), 9) desc, metric) as different_rank from ({_EXPLODE}) x) y where similar_rank <= 3 or different_rank <= 3""", SIM)
def neighbor_highlights(c):
    """Key similarities and key differences of every neighbour."""
    size = point(F.abs(F.col("standardized")), 9)
    w = Window.partitionBy(*SPELL, "rank")
    rows = Sim.neighbours(_wide(c), FEATS).explained().withColumns({"similar_rank": F.row_number().over(w.orderBy(size, "metric")), "different_rank": F.row_number().over(w.orderBy(size.desc(), "metric"))})
    rows = rows.where("similar_rank <= 3 or different_rank <= 3")
    return rows.select(*SPELL, "peer_id", "rank", "metric", point(F.col("raw_difference")).alias("raw_difference"), point(F.col("standardized")).alias("standardized"), "similar_rank", "different_rank")


@query("""select role, player_id, team_id, peer_id from (
  select *, row_number() over (partition by role order by minutes desc, player_id desc) as rn from near where rank = 1) x where rn = 1""", SIM)
def sanity_cases(c):
    found = Sim.neighbours(_wide(c), FEATS)
    q, near = found.queries, found.near
    best = q.where("status = 'AVAILABLE'").groupBy("role").agg(F.max_by(F.struct(*SPELL), F.struct("minutes", "player_id")).alias("b")).select("role", "b.*")
    return best.join(near.where("rank = 1").select("role", *SPELL, "peer_id"), ["role", *SPELL])


@query("""select a, b from (select *, row_number() over (order by minutes desc, player_id, team_id) as place from (
  select *, row_number() over (partition by least(player_id, peer_id), greatest(player_id, peer_id) order by minutes desc, player_id, team_id) as rn, least(player_id, peer_id) as a, greatest(player_id, peer_id) as b
  from near where rank = 1) x where rn = 1) y where place <= 5""", SIM)
def pair_sample(c):
    found = Sim.neighbours(_wide(c), FEATS)
    q, near = found.queries, found.near
    rows = near.where("rank = 1").join(q.select(*SPELL, "minutes"), SPELL)
    rows = rows.withColumns({"a": F.least("player_id", "peer_id"), "b": F.greatest("player_id", "peer_id")})
    first = P.top_of_each(rows, ["a", "b"], [F.desc("minutes"), F.col("player_id"), F.col("team_id")], 1, "rn")
    return first.orderBy(F.desc("minutes"), "player_id", "team_id").limit(5).select("a", "b")


@query("select player_id, team_id, role, round(minutes, 6) as minutes, (select count(distinct coalesce(role, '-')) > 1 from spells where player_id in (1, 2, 3)) as roles_differ from spells where player_id in (1, 2, 3)", BASE)
def compare_entities(c):
    keys = c.spark.createDataFrame([(1,), (2,), (3,)], "player_id long")
    rows = c.spells.join(F.broadcast(keys), "player_id")
    mixed = rows.agg((F.count_distinct(F.coalesce("role", F.lit("-"))) > 1).alias("roles_differ"))
    # one row of a fixed query of three entities
    return rows.join(mixed).select(*SPELL, "role", point(F.col("minutes")).alias("minutes"), "roles_differ")


# --- similarity scenarios ------------------------------------------------------------------------------


#: (name, robust scaling, minutes from which a spell is eligible, features left out, reference thinned)
SCENARIOS = [
    ("baseline", False, None, [], False),
    ("robust_scaling", True, None, [], False),
    *[(f"minimum_minutes_{int(m)}", False, m, [], False) for m in (300.0, 600.0)],
    *[(name, False, None, gone, False) for name, gone in S.ABLATIONS.items()],
    ("reference_subsample_80_percent", False, None, [], True),
]


def _scenario_rows(c: Cohort, scenarios):
    """Every spell under every scenario: its flags and features there."""
    wide = _wide(c).join(c.spells.select(*SPELL, "reasons"), SPELL)
    chosen = lambda gone: F.array(*[F.lit(m) for m in FEATS if m not in gone])
    each = [F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("robust"), F.lit(m).cast("double").alias("limit"), chosen(g).alias("chosen"), F.lit(t).alias("thinned")) for n, r, m, g, t in scenarios]
    rows = wide.drop("eligible", "is_ref").withColumn("sc", F.explode(F.array(*each))).select("*", "sc.*").drop("sc")
    reasons = F.when(F.col("limit").isNull(), F.col("reasons")).otherwise(eligibility_at(F.col("reasons"), F.col("minutes"), F.col("limit")))
    rows = P.longest_spell(rows.withColumn("eligible", F.size(reasons) == 0), ("scenario",))
    kept = ~F.col("thinned") | (hash_bucket(F.col("player_id").cast("string"), 5) != 0)
    return Sim.vectors(rows.withColumn("is_ref", F.col("is_ref") & kept), FEATS, F.col("chosen"))


def _overlaps(found, base: str = "baseline"):
    """A row per scenario and query that the baseline answers: status there, and the share of its first five kept (NULL where not available)."""
    five = found.near.where("rank <= 5").groupBy("scenario", "role", *SPELL).agg(F.collect_set("peer_id").alias("five"))
    old = five.where(F.col("scenario") == base).select(*SPELL, F.col("five").alias("old"))
    rows = found.queries.where(F.col("scenario") != base).select("scenario", "role", *SPELL, "status").join(old, SPELL)
    rows = rows.join(five.where(F.col("scenario") != base), ["scenario", "role", *SPELL], "left")
    return rows.withColumn("overlap", F.when(F.col("status") == "AVAILABLE", F.size(F.array_intersect("old", "five")) / F.size("old")))


def _distribution(column: str, name: str):
    return [point(f(column)).alias(f"{p}_{name}") for p, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]


_KEPT5 = "cast(('0x' || substr(sha256(cast(p.player_id as varchar)), 1, 8)) as bigint) % 5 <> 0"


def _wide_at(name: str, limit: float) -> str:
    return f""",
{name} as (select * exclude (eligible, is_ref), ok as eligible, ok and row_number() over (partition by role, player_id order by ok desc, minutes desc, team_id) = 1 as is_ref from (
  select w.*, not (w.minutes < {limit} or p.partial or p.role is null) as ok from wide w join spells p on w.player_id = p.player_id and w.team_id = p.team_id) x)"""


_VARIANTS = {
    "robust_scaling": similarity_sql("v_robust", robust=True),
    "minimum_minutes_300": _wide_at("wide_300", 300) + similarity_sql("v_300", wide="wide_300"),
    "minimum_minutes_600": _wide_at("wide_600", 600) + similarity_sql("v_600", wide="wide_600"),
    **{n: similarity_sql(f"v_{n}", [m for m in FEATS if m not in g]) for n, g in S.ABLATIONS.items()},
    "reference_subsample_80_percent": similarity_sql("v_sample", keep=_KEPT5),
}
_TABLES = {"robust_scaling": "v_robust", "minimum_minutes_300": "v_300", "minimum_minutes_600": "v_600", "reference_subsample_80_percent": "v_sample", **{n: f"v_{n}" for n in S.ABLATIONS}}


def _overlap_sql(base: str, variant: str, keys: str = "player_id, team_id") -> str:
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""select {", ".join("a." + k.strip() for k in keys.split(","))}, len(list_intersect(a.l, b.l))::double / len(a.l) as overlap from
  (select {keys}, list(distinct peer_id) as l from {base} where rank <= 5 group by all) a join (select {keys}, list(distinct peer_id) as l from {variant} where rank <= 5 group by all) b on {on}"""


def _summary_sql(name: str, table: str) -> str:
    """Ablations do not apply to keepers: theirs leave nothing, or all of their features."""
    out = "role = 'GK'" if name in S.ABLATIONS else "false"
    return f"""select '{name}' as scenario, (select count(*) from near_q where status = 'AVAILABLE' and not coalesce({out}, false)) as evaluated,
  (select count(*) from near_q where status = 'AVAILABLE' and coalesce({out}, false)) as not_applicable,
  count(*) as available, round(avg(overlap), 6) as mean_overlap, round(min(overlap), 6) as min_overlap, round(max(overlap), 6) as max_overlap from ({_overlap_sql('near', table)}) x"""


@query(" union all ".join(_summary_sql(n, t) for n, t in _TABLES.items()), SIM + "".join(_VARIANTS.values()))
def similarity_sensitivity(c):
    """All scenarios in one plan."""
    rows = _overlaps(Sim.search(_scenario_rows(c, SCENARIOS), FEATS)).groupBy("scenario")
    other = F.col("status") == "NOT_APPLICABLE"
    return rows.agg(F.count_if(~other).alias("evaluated"), F.count_if(other).alias("not_applicable"), F.count("overlap").alias("available"), *_distribution("overlap", "overlap"))


@query(f"select player_id, team_id, round(overlap, 6) as overlap from ({_overlap_sql('near', 'v_robust')}) x", SIM + similarity_sql("v_robust", robust=True))
def topk_overlap(c):
    found = Sim.search(_scenario_rows(c, SCENARIOS[:2]), FEATS)
    return _overlaps(found).where("overlap is not null").select(*SPELL, point(F.col("overlap")).alias("overlap"))


#: Replicates of `ranking_stability`.
REPLICATES = 3
#: Replicates of the whole study.
WHOLE_REPLICATES = 20


def _replicated(frame, count: int):
    """A copy of each row for each replicate, in one job; the role carries the replicate."""
    return frame.withColumn("rep", F.explode(F.array(*map(F.lit, range(count))))).withColumn("kept", retained(F.col("player_id"), F.col("rep")))


_REP = f"(select unnest(range({REPLICATES})) as rep)"
_WHOLE_REP = f"(select unnest(range({WHOLE_REPLICATES})) as rep)"
_KEPT = "cast(('0x' || substr(sha256('evaluation-0.8.0:' || rep || ':' || player_id), 1, 8)) as bigint) % 100 < 80"
_WIDE_REP = f""",
wide_rep as (select * exclude (role, is_ref), role || '#' || rep as role, is_ref and {_KEPT} as is_ref from wide, {_WHOLE_REP} r where role is not null)"""


@query(f"""select split_part(b.role, '#', 1) as role, cast(split_part(b.role, '#', 2) as int) as rep, count(*) as available, {", ".join(f"round({f}(len(list_intersect(a.l, b.l))::double / len(a.l)), 6) as {n}_overlap" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))}
from (select player_id, team_id, list(distinct peer_id) as l from near where rank <= 5 group by all) a
join (select role, player_id, team_id, list(distinct peer_id) as l from near_rep where rank <= 5 group by all) b on a.player_id = b.player_id and a.team_id = b.team_id group by all""",
       SIM + _WIDE_REP + similarity_sql("near_rep", wide="wide_rep"))
def similarity_stability(c):
    """The whole study: all replicates."""
    return _similarity_stability(c, WHOLE_REPLICATES)


def _similarity_stability(c, count: int):
    """The whole reference and every thinned one, as scenarios of one search."""
    wide = _wide(c).where("role is not null").withColumn("rep", F.explode(F.array(F.lit(None).cast("int"), *map(F.lit, range(count)))))
    kept = F.col("rep").isNull() | retained(F.col("player_id"), F.col("rep"))
    rows = Sim.vectors(wide.withColumn("is_ref", F.col("is_ref") & kept), FEATS)
    rows = rows.withColumns({"scenario": F.coalesce(F.col("rep").cast("string"), F.lit("baseline")), "robust": F.lit(False)})
    # the study is of the first five
    rows = _overlaps(Sim.search(rows, FEATS, top_k=5)).where("overlap is not null")
    return rows.groupBy("role", F.col("scenario").cast("int").alias("rep")).agg(F.count("*").alias("available"), *_distribution("overlap", "overlap"))


@query(ORACLE["similarity_stability"], "")
def similarity_stability_20(c):
    return _similarity_stability(c, WHOLE_REPLICATES)


# --- rankings --------------------------------------------------------------------------------------------


def _requirements(**change):
    return [R.requirement_rows(n, role, w, **change) for n, (role, w) in S.REQUIREMENTS.items()]


def requirement_sql(name: str, rows: list[list[tuple]]) -> str:
    flat = ", ".join(f"('{s}', '{role}', '{m}', {w!r}::double, {place}, {parts}, {mm}, {k}, {ex if ex else '[]'}::bigint[])" for r in rows for s, role, m, w, place, parts, mm, k, ex in r)
    return f""",
{name}(set_, set_role, metric, weight, place, parts, min_minutes, top_k, excluded) as (values {flat})"""


def ranking_sql(name: str, req: str, long: str = "long", spells: str = "spells") -> str:
    """CTEs <name>_parts, <name>_status and <name> (ranked candidates)."""
    return f""",
{name}_rows as (select l.player_id, l.team_id, l.role, l.minutes, r.*, l.v, count(l.v) over (partition by set_, l.player_id, l.team_id) = parts as complete
  from {long} l join {req} r on l.metric = r.metric and l.role = r.set_role where l.is_ref),
{name}_mid as (select a.set_, a.player_id, a.team_id, a.metric,
    case when min(b.v) < max(b.v) then (count(*) filter (where b.v < a.v) + 0.5 * count(*) filter (where b.v = a.v)) * 100 / count(b.v) end as pct0
  from {name}_rows a join {name}_rows b on a.set_ = b.set_ and a.metric = b.metric and b.complete where a.v is not null group by all),
{name}_parts as (select r.*, case when r.metric in ('miscontrols', 'dispossessions') then 100 - pct0 else pct0 end as percentile
  from {name}_rows r left join {name}_mid m on r.set_ = m.set_ and r.player_id = m.player_id and r.team_id = m.team_id and r.metric = m.metric),
{name}_each as (select set_, player_id, team_id, any_value(minutes) as minutes, bool_and(complete) as complete, count(percentile) as known, any_value(parts) as parts,
    sum(weight * percentile order by place) as score, any_value(top_k) as top_k, bool_and(complete and minutes >= min_minutes and not list_contains(excluded, team_id)) as candidate from {name}_parts group by set_, player_id, team_id),
{name}_status as (select *, case when status = 'AVAILABLE' then passing else 0 end as candidate_count from (
  select d.set_, d.set_role as role, d.top_k, coalesce(peer_count, 0) as peer_count, coalesce(passing, 0) as passing,
    case when coalesce(peer_count, 0) < {S.MIN_PEERS} then 'INSUFFICIENT_PEERS' when unranked > 0 then 'CONSTANT_COMPONENT' when passing > 0 then 'AVAILABLE' else 'NO_CANDIDATES' end as status
  from (select distinct set_, set_role, top_k from {req}) d left join (
    select set_, count(*) filter (where complete) as peer_count, count(*) filter (where complete and known < parts) as unranked, count(*) filter (where candidate) as passing from {name}_each group by set_) e on d.set_ = e.set_) x),
{name} as (select e.*, row_number() over (partition by e.set_ order by score desc, player_id, team_id) as rank from {name}_each e join {name}_status s on e.set_ = s.set_ and s.status = 'AVAILABLE' where candidate)"""


_REQ = requirement_sql("req", _requirements())
RANK = cohort_sql() + _REQ + ranking_sql("ranked", "req")


def _ranked(c, rows=None, long=None, cut=False):
    return R.ranked(c.long if long is None else long, R.requirement_table(c.spark, rows or _requirements()), cut=cut)


@query("select set_ as requirement, player_id, team_id, rank, round(score, 6) as score from ranked where rank <= top_k", RANK)
def requirement_ranking(c):
    return _ranked(c, cut=True)[1].select(F.col("set").alias("requirement"), *SPELL, "rank", point(F.col("score")).alias("score"))


@query("select set_ as requirement, role, status, peer_count, candidate_count from ranked_status", RANK)
def ranking_status(c):
    return _ranked(c)[0].select(F.col("set").alias("requirement"), "role", "status", "peer_count", "candidate_count")


@query("select set_ as requirement, status, case when status in ('AVAILABLE', 'NO_CANDIDATES') and candidate_count < top_k then 'FEWER_CANDIDATES_THAN_REQUESTED' else '' end as warnings from ranked_status", RANK)
def ranking_warnings(c):
    return _ranked(c)[0].select(F.col("set").alias("requirement"), "status", F.array_join("warnings", ",").alias("warnings"))


@query("""select s.set_ as requirement, s.status, least(candidate_count, s.top_k) as returned, candidate_count < s.top_k and s.status = 'AVAILABLE' as fewer, max(player_id) filter (where rank = 1) as first
from ranked_status s left join ranked r on s.set_ = r.set_ group by all""", RANK)
def requirement_batch(c):
    status, rows = _ranked(c)
    first = rows.where("rank = 1").select("set", F.col("player_id").alias("first"))
    fewer = (F.col("candidate_count") < F.col("top_k")) & (F.col("status") == "AVAILABLE")
    return status.join(first, "set", "left").select(F.col("set").alias("requirement"), "status", F.least("candidate_count", "top_k").alias("returned"), fewer.alias("fewer"), "first")


_LOWER = ", ".join(f"'{m}'" for m in S.LOWER_IS_BETTER)
_UNITS = f"case when p.metric in ({', '.join(repr(m) for m in S.PERCENTAGES)}) then 'percent' when p.metric in ({', '.join(repr(m) for m in S.MEANS)}) then 'mean' else 'per90' end"


@query(f"""select set_ as requirement, p.player_id, p.team_id, p.metric, round(p.v, 6) as v, {_UNITS} as unit, case when p.metric in ({_LOWER}) then 'lower' else 'higher' end as direction, round(s.coverage, 6) as coverage,
  round(percentile, 6) as percentile, round(weight, 9) as weight, round(weight * percentile, 6) as contribution
from ranked_parts p join season s on s.player_id = p.player_id and s.team_id = p.team_id and s.metric = p.metric where complete""", RANK)
def ranking_components(c):
    rows = R.components(c.long, R.requirement_table(c.spark, _requirements())).where("complete")
    unit = F.when(F.col("metric").isin(S.PERCENTAGES), "percent").when(F.col("metric").isin(S.MEANS), "mean").otherwise("per90")
    rows = rows.withColumns({"unit": unit, "direction": F.when(F.col("metric").isin(S.LOWER_IS_BETTER), "lower").otherwise("higher"), "coverage": point(F.col("coverage"))})
    return rows.select("unit", "direction", "coverage", F.col("set").alias("requirement"), *SPELL, "metric", point(F.col("v")).alias("v"), point(F.col("percentile")).alias("percentile"), point(F.col("weight"), 9).alias("weight"), point(F.col("contribution")).alias("contribution"))


@query("""select set_ as requirement, player_id, team_id, metric, reason_rank, weak_rank from (
  select *, row_number() over (partition by set_, player_id, team_id order by round(weight * percentile, 9) desc, metric) as reason_rank,
    row_number() over (partition by set_, player_id, team_id order by percentile, metric) as weak_rank from ranked_parts where complete) x where reason_rank <= 3 or weak_rank <= 3""", RANK)
def ranking_reasons(c):
    rows = R.components(c.long, R.requirement_table(c.spark, _requirements())).where("complete")
    w = Window.partitionBy("set", *SPELL)
    rows = rows.withColumns({"reason_rank": F.row_number().over(w.orderBy(F.desc(point(F.col("contribution"), 9)), "metric")), "weak_rank": F.row_number().over(w.orderBy("percentile", "metric"))})
    return rows.where("reason_rank <= 3 or weak_rank <= 3").select(F.col("set").alias("requirement"), *SPELL, "metric", "reason_rank", "weak_rank")


_REQ_EX = requirement_sql("req", _requirements(min_minutes=20000.0, excluded=(3, 5)))


@query("""select set_ as requirement, player_id, team_id, array_to_string(why, ',') as reasons, array_to_string(shown, ',') as missing_metrics from (
  select *, case when not coalesce(role = set_role, false) then ['NOT_REQUESTED_POSITION'] when not eligible then reasons when not is_ref then ['SHORTER_OR_TIED_TEAM_SPELL'] when miss is not null then ['MISSING_REQUIRED_METRICS']
    else list_filter([case when minutes < min_minutes then 'BELOW_REQUIREMENT_MINUTES' end, case when list_contains(ex_teams, team_id) then 'EXCLUDED_TEAM' end], lambda x: x is not null) end as why,
    case when coalesce(role = set_role, false) and eligible and is_ref then miss end as shown from (
    select p.*, d.*, m.miss from spells p cross join (select distinct set_, set_role, min_minutes, excluded as ex_teams from req) d left join (
      select set_, player_id as pid, team_id as tid, list_sort(list(distinct r.metric)) as miss from long l join req r on l.metric = r.metric and l.role = r.set_role where is_ref and v is null group by all) m
      on m.set_ = d.set_ and m.pid = p.player_id and m.tid = p.team_id) x) y where len(why) > 0""", cohort_sql() + _REQ_EX)
def ranking_exclusions(c):
    req = R.requirement_table(c.spark, _requirements(min_minutes=20000.0, excluded=(3, 5)))
    return R.exclusions(c.spells, c.long, req).withColumnRenamed("set", "requirement")


def _variant_rows():
    out = []
    for n, (role, w) in S.REQUIREMENTS.items():
        out.append((n, "minimum_minutes_600", R.requirement_rows(f"{n}|minimum_minutes_600", role, w, min_minutes=600.0)))
        for m in w:
            out.append((n, f"weight_x1.5:{m}", R.requirement_rows(f"{n}|weight_x1.5:{m}", role, w | {m: w[m] * 1.5})))
    return out


@query("""select a.set_ as requirement, split_part(b.set_, '|', 2) as scenario, count(*) as common, round(count(*)::double / max(a.n), 6) as overlap, round(avg(abs(a.rank - b.rank)), 6) as mean_shift
from (select *, count(*) over (partition by set_) as n from ranked where rank <= 5) a
join (select * from varied where rank <= 5) b on split_part(b.set_, '|', 1) = a.set_ and a.player_id = b.player_id group by all""",
       RANK + requirement_sql("req2", [r for _, _, r in _variant_rows()]) + ranking_sql("varied", "req2"))
def weight_sensitivity(c):
    base = _ranked(c, cut=True)[1].where("rank <= 5").select("set", "player_id", "rank", F.count("*").over(Window.partitionBy("set")).alias("n"))
    varied = _ranked(c, [r for _, _, r in _variant_rows()], cut=True)[1].where("rank <= 5")
    name = F.split("set", r"\|")
    varied = varied.select(F.get(name, F.lit(0)).alias("set"), F.get(name, F.lit(1)).alias("scenario"), "player_id", F.col("rank").alias("other"))
    both = base.join(varied, ["set", "player_id"]).groupBy("set", "scenario")
    out = both.agg(F.count("*").alias("common"), point(F.count("*") / F.max("n")).alias("overlap"), point(F.avg(F.abs(F.col("rank") - F.col("other")))).alias("mean_shift"))
    return out.withColumnRenamed("set", "requirement")


_THREE = [
    R.requirement_rows("minutes_900", "DM", S.REQUIREMENTS["DM_ball_winning_activity"][1], min_minutes=900.0, top_k=100),
    R.requirement_rows("minutes_20000", "DM", S.REQUIREMENTS["DM_ball_winning_activity"][1], min_minutes=20000.0, top_k=100),
    R.requirement_rows("more_tackles", "DM", S.REQUIREMENTS["DM_ball_winning_activity"][1] | {"tackles": 4.0}, top_k=100, excluded=(1,)),
]


@query("select set_ as variant, player_id, team_id, rank from varied where rank <= top_k", cohort_sql() + requirement_sql("req3", _THREE) + ranking_sql("varied", "req3"))
def requirement_variants(c):
    return _ranked(c, _THREE, cut=True)[1].select(F.col("set").alias("variant"), *SPELL, "rank")


_LONG_REP = f""",
long_rep as (select * exclude (role), role || '#' || rep as role from long, {_REP} r where role is not null and {_KEPT})"""


def _rep_rows(count: int):
    return [[(f"{s}#{i}", f"{role}#{i}", *rest) for s, role, *rest in rows] for rows in _requirements() for i in range(count)]


_REP_ROWS = _rep_rows(REPLICATES)


@query(f"""select a.set_ as requirement, cast(split_part(b.set_, '#', 2) as int) as rep, count(*) filter (where b.rank <= 5) as common, count(*) as surviving
from ranked a join (select r.set_ || '#' || rep as key, rep, r.player_id from ranked r, {_REP} x where r.rank <= 5 and {_KEPT.replace('player_id', 'r.player_id')}) k on split_part(k.key, '#', 1) = a.set_ and k.player_id = a.player_id and a.rank <= 5
join thin b on b.set_ = k.key and b.player_id = a.player_id group by all""",
       RANK + _LONG_REP + requirement_sql("req_rep", _REP_ROWS) + ranking_sql("thin", "req_rep", "long_rep"))
def ranking_stability(c):
    return _ranking_stability(c, REPLICATES)


def _thinned(c, count: int):
    """Reference rows of the metrics that a requirement of their role has, in each replicate that keeps their entity; the role carries the replicate."""
    asked = c.spark.createDataFrame([(role, m) for role, w in S.REQUIREMENTS.values() for m in w], "role string, metric string")
    rows = c.long.where("is_ref").join(F.broadcast(asked), ["role", "metric"], "left_semi").select(*SPELL, "role", "metric", "v", "minutes", "is_ref")
    return materialised(_replicated(rows, count).where("kept").withColumn("role", F.concat_ws("#", "role", "rep")).drop("rep", "kept"), "thinned")


def _ranking_stability(c, count: int):
    base = _ranked(c, cut=True)[1].where("rank <= 5").select("set", "player_id")
    thin = _ranked(c, _rep_rows(count), _thinned(c, count))[1]
    part = F.split("set", "#")
    thin = thin.select(F.get(part, F.lit(0)).alias("set"), F.get(part, F.lit(1)).cast("int").alias("rep"), "player_id", "rank")
    both = thin.join(base, ["set", "player_id"]).groupBy("set", "rep").agg(F.count_if(F.col("rank") <= 5).alias("common"), F.count("*").alias("surviving"))
    return both.withColumnRenamed("set", "requirement")


@query(ORACLE["ranking_stability"].replace(_REP, _WHOLE_REP).replace(requirement_sql("req_rep", _REP_ROWS), requirement_sql("req_rep", _rep_rows(WHOLE_REPLICATES))), "")
def ranking_stability_20(c):
    return _ranking_stability(c, WHOLE_REPLICATES)


_SPREAD = lambda column: ", ".join(f"round({f}({column}), 6) as {f.replace('avg', 'mean')}_{column}" for f in ("avg", "min", "max"))


@query(f"""select requirement, count(*) as attempts, count(overlap) as available, {_SPREAD("overlap")}, count(recovery) as recovered, {_SPREAD("recovery")} from (
  select s.set_ as requirement, r.rep, case when s.status = 'AVAILABLE' and t.status = 'AVAILABLE' then both_::double / n end as overlap, case when s.status = 'AVAILABLE' and t.status = 'AVAILABLE' and survive > 0 then kept_::double / survive end as recovery
  from ranked_status s, {_WHOLE_REP} r join thin_status t on t.set_ = s.set_ || '#' || r.rep left join (
    select o.set_, x.rep, count(*) as n, count(b.player_id) as both_, count(*) filter (where {_KEPT.replace("player_id", "o.player_id").replace("rep", "x.rep")}) as survive, count(b.player_id) filter (where {_KEPT.replace("player_id", "o.player_id").replace("rep", "x.rep")}) as kept_
    from ranked o, {_WHOLE_REP} x left join (select distinct set_, player_id from thin where rank <= 5) b on b.set_ = o.set_ || '#' || x.rep and b.player_id = o.player_id where o.rank <= 5 group by all) m on m.set_ = s.set_ and m.rep = r.rep) y group by requirement""",
       RANK + _LONG_REP.replace(_REP, _WHOLE_REP) + requirement_sql("req_rep", _rep_rows(WHOLE_REPLICATES)) + ranking_sql("thin", "req_rep", "long_rep"))
def ranking_stability_summary(c):
    """The whole study by requirement: overlap with the baseline's first five, and how many of those that survive thinning stay."""
    status, rows = _ranked(c, cut=True)
    thin_status, thin = _ranked(c, _rep_rows(WHOLE_REPLICATES), _thinned(c, WHOLE_REPLICATES), cut=True)
    part = F.split("set", "#")
    parted = lambda df, *more: df.select(F.get(part, F.lit(0)).alias("set"), F.get(part, F.lit(1)).cast("int").alias("rep"), *more)
    old = rows.where("rank <= 5").groupBy("set").agg(F.collect_set("player_id").alias("old"))
    new = parted(thin.where("rank <= 5"), "player_id").groupBy("set", "rep").agg(F.collect_set("player_id").alias("new"))
    both = parted(thin_status, "status").join(status.select("set", F.col("status").alias("base")), "set").join(old, "set", "left").join(new, ["set", "rep"], "left")
    good = (F.col("status") == "AVAILABLE") & (F.col("base") == "AVAILABLE")
    stay = F.filter("old", lambda x: retained(x, F.col("rep")))
    share = lambda a: F.size(F.array_intersect(a, F.coalesce("new", F.array().cast("array<long>")))) / F.size(a)
    both = both.withColumn("stay", stay).withColumns({"overlap": F.when(good, share(F.col("old"))), "recovery": F.when(good & (F.size("stay") > 0), share(F.col("stay")))})
    return both.groupBy(F.col("set").alias("requirement")).agg(F.count("*").alias("attempts"), F.count("overlap").alias("available"), *_distribution("overlap", "overlap"), F.count("recovery").alias("recovered"), *_distribution("recovery", "recovery"))


#: Column of `result_audit` by the rule of `audits.neighbours`, and of `audits.rankings`.
NEIGHBOUR_RULES = {"rows": "neighbours", "DUPLICATE_NEIGHBOUR": "repeated_neighbours", "ORDER": "neighbour_order", "COHORT": "neighbour_cohort", "SELF": "self_neighbours", "INCOMPLETE": "incomplete_neighbours", "CONTRIBUTIONS": "distance_sums"}
RANKING_RULES = {"rows": "candidates", "DUPLICATE_CANDIDATE": "repeated_candidates", "ORDER": "score_order", "COHORT": "candidate_cohort", "MINUTES": "candidate_minutes", "EXCLUDED_TEAM": "excluded_teams", "COMPONENTS": "candidate_components", "CONTRIBUTIONS": "score_sums", "WEIGHTS": "weight_sums"}

_SQUARES = " + ".join(f"case when {m}_s > 0 then pow(({m} - {m}_p) / {m}_s, 2) else 0 end" for m in FEATS)
_HOLES = " or ".join(f"{m}_p is null" for m in FEATS)


@query(f"""select (select count(*) from near) as neighbours, (select count(*) from near where peer_id = player_id) as self_neighbours, (select count(*) from near where {_HOLES}) as incomplete_neighbours,
  (select count(*) from (select count(*) over (partition by role, player_id, team_id, peer_id) as n from near) x where n > 1) as repeated_neighbours,
  (select count(*) from (select rank, distance, lag(distance) over w as last, row_number() over w as place from near window w as (partition by role, player_id, team_id order by rank)) x where distance < last or rank <> place) as neighbour_order,
  (select count(*) from near n left join spells p on p.player_id = n.peer_id and p.team_id = n.peer_team where not coalesce(p.eligible and p.role = n.role, false)) as neighbour_cohort,
  (select count(*) from (select distance * distance as square, {_SQUARES} as parts from near) x where abs(parts - square) > 1e-12 + 1e-9 * square) as distance_sums,
  (select count(*) from shown) as candidates, (select count(*) from ranked where score < 0 or score > 100) as outside,
  (select count(*) from (select set_, player_id, team_id from ranked group by all having count(*) > 1) x) as repeated,
  (select count(*) from (select count(*) over (partition by set_, player_id) as n from shown) x where n > 1) as repeated_candidates,
  (select count(*) from (select rank, score, lag(score) over w as last, row_number() over w as place from shown window w as (partition by set_ order by rank)) x where score > last or rank <> place) as score_order,
  (select count(*) from shown s left join asked a on a.set_ = s.set_ left join spells p on p.player_id = s.player_id and p.team_id = s.team_id where not coalesce(p.eligible and p.role = a.set_role, false)) as candidate_cohort,
  (select count(*) from shown s join asked a on a.set_ = s.set_ where s.minutes < a.least) as candidate_minutes, (select count(*) from shown s join asked a on a.set_ = s.set_ where list_contains(a.excluded, s.team_id)) as excluded_teams,
  (select count(*) from shown s join asked a on a.set_ = s.set_ left join made m on m.set_ = s.set_ and m.player_id = s.player_id and m.team_id = s.team_id where coalesce(m.metrics, 0) <> a.wanted) as candidate_components,
  (select count(*) from shown s join made m on m.set_ = s.set_ and m.player_id = s.player_id and m.team_id = s.team_id where abs(m.parts_sum - s.score) > 1e-9) as score_sums,
  (select count(*) from shown s join made m on m.set_ = s.set_ and m.player_id = s.player_id and m.team_id = s.team_id where abs(m.weights - 1) > 1e-9) as weight_sums""",
       SIM + _REQ + ranking_sql("ranked", "req") + """,
shown as (select * from ranked where rank <= top_k),
asked as (select set_, any_value(set_role) as set_role, any_value(min_minutes) as least, any_value(excluded) as excluded, count(distinct metric) as wanted from req group by set_),
made as (select set_, player_id, team_id, sum(weight * percentile) as parts_sum, sum(weight) as weights, count(distinct metric) as metrics from ranked_parts where complete group by set_, player_id, team_id)""")
def result_audit(c):
    """All rules of the result audit in one row: rows checked and violations. Scores outside 0 to 100 and repeated rows are counted over whole rankings, all else over the rows shown."""
    wanted = R.requirement_table(c.spark, _requirements())
    rows = materialised(R.ranked(c.long, wanted)[1], "ranked")
    parts = R.components(c.long, wanted).where("complete").select("set", *SPELL, "metric", "weight", "contribution")
    (near,), (shown,) = Au.neighbours(Sim.neighbours(_wide(c), FEATS), c.spells), Au.rankings(rows, parts, wanted, c.spells)
    told = {name: a.counts[code] for a, rules in ((near, NEIGHBOUR_RULES), (shown, RANKING_RULES)) for code, name in rules.items()}
    a = c.spark.createDataFrame([tuple(told.values())], ", ".join(f"{name} long" for name in told))
    b = rows.agg(F.count_if((F.col("score") < 0) | (F.col("score") > 100)).alias("outside"))
    d = rows.groupBy("set", *SPELL).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return a.join(b).join(d)
