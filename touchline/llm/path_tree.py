"""URL filter by a tree of path templates for each host, of any depth.

Rules (host and all its subdomains, beginning of the path) decide first, the longest one wins; the
pages that they decide are the labelled examples of the rest.

1. Paths are counted by (host, shape): the path with '#' for runs of digits. Counts, also of labels, are of
   distinct paths, so that repeated rows change nothing, and a host or shape with a third of all rows is
   one row of the tree.
2. From the root down, the children of a node become one wildcard '*' when there are at least
   MIN_CHILDREN of them and they are at least MIN_NEW_SHARE of the paths below it: most are seen once.
3. Each node has the labelled paths below it and how many of them are blocked. Down the tree a node is
   merged with its parent when its share is no further from the parent's than Z standard errors of a
   binomial share; a node without labels always is. Else it stands for itself, with its share smoothed
   by WEIGHT paths of the parent's. A host starts from the share of all hosts in the same way.
4. A page goes by the lowest node of its template that stands for itself, and is blocked when that has
   at least MIN_LABELLED labelled paths and a smoothed share of MIN_PURITY or more.

So a template without labels goes by its siblings under one parent, and by the host when these have
none. A level is a Spark job only while some node on it has MIN_CHILDREN leaves below it, however deep single
paths are; the shares of one template are folded in one expression over its own nodes.

Defined cases: a null url, or one without ://, has an empty host and path and follows the method;
equal rules count once; repeated rows are judged alike, and so are rows of one id each by its own url;
a very long path is a deep branch; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import shared_table
from .url_templates import RULES, host_of, path_of, rule_of

MIN_CHILDREN, MIN_NEW_SHARE = 20, 0.5
Z, WEIGHT = 1.645, 4.0
MIN_LABELLED, MIN_PURITY = 5, 0.7
KEYS = ["host", "shape"]


def ruled(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, said (the rule's verdict or null), shape."""
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.regexp_replace("path", "[0-9]+", "#").alias("shape"))


def leaves(pages: DataFrame) -> DataFrame:
    """host, shape, n (distinct paths), labelled, blocked of pages as `ruled` gives them."""
    # a rule says the same of all pages of a path
    paths = pages.groupBy(*KEYS, "path").agg(F.max("said").alias("said"))
    return paths.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))


def templates(leaf: DataFrame) -> DataFrame:
    """leaf (a written table) with nodes: the numbers of the prefixes of its template from the first level down.

    A node's number is a hash of its parent's number and its own segment, so a deep path needs a number for each level
    and no text. A node with fewer than MIN_CHILDREN leaves below it can have no wildcard there, so its leaves are done:
    their remaining levels are folded at once. Only leaves below larger nodes go on to the next level.
    """
    part = F.split("shape", "/")
    rows = leaf.withColumns({"part": part, "node": F.xxhash64(F.lit(0), F.get(part, F.lit(0))), "d": F.lit(1)}).withColumn("nodes", F.array("node"))
    done = None
    while True:
        own = F.get("part", F.col("d"))
        child = rows.where(own.isNotNull()).groupBy("host", "node", own.alias("own")).agg(F.sum("n").alias("n"), F.count("*").alias("leaves"))
        large = child.groupBy("host", "node").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("leaves").alias("leaves")).where(F.col("leaves") >= MIN_CHILDREN)
        wild = (F.col("k") >= MIN_CHILDREN) & (F.col("k") >= MIN_NEW_SHARE * F.col("n"))
        rows = rows.join(large.select("host", "node", F.when(wild, "*").otherwise("").alias("wild")), ["host", "node"], "left")
        rows = shared_table(rows.withColumn("wild", F.when(own.isNotNull(), F.col("wild"))), "level")
        rest = rows.where("wild is null").drop("wild")
        done = rest if done is None else done.unionByName(rest)
        rows = rows.where("wild is not null")
        if rows.isEmpty():
            break
        node = F.xxhash64("node", F.when(F.col("wild") == "*", F.lit("*")).otherwise(own))
        rows = rows.withColumn("node", node).withColumns({"nodes": F.concat("nodes", F.array("node")), "d": F.col("d") + 1}).drop("wild")
    below = F.slice("part", F.col("d") + 1, F.greatest(F.size("part") - F.col("d"), F.lit(0)))
    nodes = F.aggregate(below, F.col("nodes"), lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x))))
    return done.withColumn("nodes", nodes).drop("part", "node", "d")


def _share(base: Column, labelled: Column, blocked: Column) -> Column:
    return (blocked + WEIGHT * base) / (labelled + F.lit(WEIGHT))


def judged(leaf: DataFrame) -> DataFrame:
    """host, shape, share, labelled of the node that decides each leaf."""
    rows = shared_table(templates(leaf), "templates")
    total = rows.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    base = ((F.coalesce("b", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + 2)).alias("base")
    host = rows.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    each = rows.select("host", "labelled", "blocked", F.explode("nodes").alias("node"))
    node = each.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    # a template's own nodes, as many as its levels
    way = rows.select("host", F.element_at("nodes", -1).alias("template"), "nodes").distinct()
    way = way.select("host", "template", F.posexplode("nodes").alias("d", "node")).join(node, ["host", "node"])
    way = way.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("d", "l", "b"))).alias("way"))
    # one row of totals
    way = way.join(host, "host").crossJoin(F.broadcast(total.select(base)))

    def step(at: Column, x: Column) -> Column:
        error = F.sqrt(at["share"] * (1 - at["share"]) / F.greatest(x["l"], F.lit(1)))
        apart = (x["l"] > 0) & (F.abs(x["b"] / F.greatest(x["l"], F.lit(1)) - at["share"]) > Z * error)
        return F.when(apart, F.struct(_share(at["share"], x["l"], x["b"]).alias("share"), x["l"].alias("l"))).otherwise(at)

    start = F.struct(_share(F.col("base"), F.col("hl"), F.col("hb")).alias("share"), F.col("hl").alias("l"))
    end = way.select("host", "template", F.aggregate("way", start, step).alias("at")).select("host", "template", "at.share", F.col("at.l").alias("labelled"))
    return rows.select(*KEYS, F.element_at("nodes", -1).alias("template")).join(end, ["host", "template"]).select(*KEYS, "share", "labelled")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    base = ruled(pages, page_id, url, rules)
    known = judged(shared_table(leaves(base), "leaves")).where((F.col("labelled") >= MIN_LABELLED) & (F.col("share") >= MIN_PURITY))
    known = shared_table(known.select(*KEYS, F.lit("block").alias("own")), "blocked")
    # only pages that no rule decides need their template
    free = base.where("said is null").join(known, KEYS, "left").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    return base.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict")).unionByName(free)
