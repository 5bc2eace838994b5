"""URL filter by per-host path-template trees.

Rules (host and all its subdomains, beginning of the path) decide first, the longest one wins; the
pages that they decide are the labelled examples of the rest. A page's path becomes a template: runs
of digits in a segment are '#', and a segment whose parent has many different children, most of them
seen once, is the wildcard '*'. Templates are leaves of a tree per host. Sibling leaves of
statistically like labels (the same tenth of smoothed purity, or all with too few labels) are merged. A
merged template with enough labelled pages is rejected when its purity, smoothed towards its host's and
the host's towards that of all, reaches the threshold.

With `by_host` two steps go further. A page whose template has too few labels is judged by its smoothed
purity all the same when its host has enough labels; and a segment is variable by its distinct paths, so
repeated rows and larger tables give the same wildcards.

Pages are pre-aggregated to (host, shape) counts before any further step, so a host or shape with a
third of all rows is one row of the tree. Pages meet their template again in one join on (host, shape).

Defined cases: a null url, or one without ://, has an empty host and path and follows the method;
equal rules count once; repeated rows are judged alike; other columns are dropped by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, beginning of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEPTH = 3
MIN_CHILDREN, MIN_NEW_SHARE = 20, 0.5
MIN_LABELLED = 5
HOST_WEIGHT, TEMPLATE_WEIGHT = 2.0, 4.0
MIN_PURITY = 0.7


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text of the longest rule that fits or null, its verdict or null)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _segments(shape: Column) -> Column:
    return F.split(shape, "/")


def templates(leaves: DataFrame) -> DataFrame:
    """leaves (host, shape, n, labelled, blocked) with their template after wildcards."""
    parts = leaves.withColumn("part", _segments(F.col("shape"))).withColumn("template", F.get("part", F.lit(0)))
    for d in range(1, DEPTH + 1):
        own = F.get("part", F.lit(d))
        child = parts.where(own.isNotNull()).groupBy("host", "template", own.alias("own")).agg(F.sum("n").alias("n"))
        wild = child.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        wild = wild.where((F.col("k") >= MIN_CHILDREN) & (F.col("k") >= MIN_NEW_SHARE * F.col("n"))).select("host", "template", F.lit(True).alias("wild"))
        parts = parts.join(wild, ["host", "template"], "left")
        step = F.when(F.col("wild"), F.lit("*")).otherwise(own)
        parts = parts.withColumn("template", F.when(own.isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", step))).drop("wild")
    rest = F.slice("part", DEPTH + 2, F.greatest(F.size("part"), F.lit(1)))
    return parts.withColumn("template", F.when(F.size("part") > DEPTH + 1, F.concat_ws("/", "template", F.array_join(rest, "/"))).otherwise(F.col("template"))).drop("part")


def purity(leaves: DataFrame) -> DataFrame:
    """host, shape, template, purity and labelled of the merged template of each leaf, and labelled of its host."""
    t = templates(leaves)
    total = t.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    share = float(((total["b"] or 0) + 1) / ((total["l"] or 0) + 2))
    leaf = t.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    parent = F.regexp_extract("template", "^(.*)/[^/]*$", 1)
    tenth = F.when(F.col("l") >= MIN_LABELLED, F.floor(10 * (F.col("b") + 1) / (F.col("l") + 2))).otherwise(F.lit(-1)).cast("int")
    leaf = leaf.withColumn("parent", parent).withColumn("tenth", tenth)
    merged = leaf.groupBy("host", "parent", "tenth").agg(F.sum("b").alias("mb"), F.sum("l").alias("ml"))
    host = leaf.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("l").alias("hl"))
    rate = (F.col("hb") + F.lit(HOST_WEIGHT * share)) / (F.col("hl") + F.lit(HOST_WEIGHT))
    smooth = (F.col("mb") + TEMPLATE_WEIGHT * rate) / (F.col("ml") + F.lit(TEMPLATE_WEIGHT))
    judged = leaf.join(merged, ["host", "parent", "tenth"]).join(host, "host").select("host", "template", smooth.alias("purity"), F.col("ml").alias("labelled"), F.col("hl").alias("host_labelled"))
    return t.select("host", "shape", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, by_host: bool = False) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.regexp_replace("path", "[0-9]+", "#").alias("shape"))
    leaves = base.groupBy("host", "shape").agg(
        (F.count_distinct("path") if by_host else F.count("*")).alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked")
    )
    known = purity(leaves).select("host", "shape", "purity", "labelled", "host_labelled")
    # rules have decided most pages; only the others need their template
    enough = F.col("labelled") >= MIN_LABELLED
    own = ((enough | (F.col("host_labelled") >= MIN_LABELLED)) if by_host else enough) & (F.col("purity") >= MIN_PURITY)
    out = base.join(known, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(own, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
