"""URL filter with a path-template tree, built from DataFrame operations alone.

Every host has a tree over the segments of its paths, as deep as they go. A segment that is a number or a long hexadecimal
id becomes a wildcard by its shape, and the children of a node become one wildcard if they are many of which few repeat;
this goes level by level until no node has enough urls for it. From the leaves up, a node whose labelled rate does not
differ from its parent's is merged into it, as far as that goes on. What is left are templates; a template is rejected if
its labelled block rate, smoothed towards the rate of the same path over all hosts and that towards the overall rate,
reaches one half.

Labels are the verdicts of the rule list: a url under a rule is a labelled one. Rules themselves always win; they are
joined by host, so a list of any length is no longer an expression. All trees are sums over (host, segments), added up
before they are shuffled, so one host may hold any part of the rows. Marks hold a "#", which no path does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.session import cut_lineage

# (action, host, path prefix); the longest rule that fits decides.
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
MANY = 20  # children of a node beyond which they may become a wildcard
Z2 = 4  # squared deviation, in variances, up to which a node counts as similar to its parent
PRIOR = 4  # labelled urls that the prior is worth
WILD, MERGED, NUMBER, HEX = "#*", "#~", "#n", "#h"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules) -> DataFrame:
    """Per host with a rule for it or a domain above it: host, rules (text, path, action), the longest first; equally long
    ones by their text, backwards."""
    spark = hosts.sparkSession
    listed = spark.createDataFrame([(h, len(h + p), h + p, p, a) for a, h, p in rules], "above string, size int, rule string, path string, action string")
    parts = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    met = hosts.select("host", F.explode(above).alias("above")).join(listed, "above")
    return met.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("size", "rule", "path", "action")), False).alias("rules"))


def marked_path(path: Column) -> Column:
    """The path with hexadecimal ids of 8 and more characters, and other runs of digits, made wildcards."""
    segments = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    marked = F.transform(
        segments, lambda s: F.when(s.rlike("^[0-9a-f]{8,}$"), F.lit(HEX)).otherwise(F.regexp_replace(s, "[0-9]+", NUMBER))
    )
    return F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(marked, "/")))


def segments_of(marked: Column) -> Column:
    return F.slice(F.split(marked, "/", -1), 2, F.size(F.split(marked, "/", -1)))


def generalise(trees: DataFrame) -> DataFrame:
    """Replace, level by level, the children of nodes that have many children of which few repeat by one wildcard.

    Ends where no node of a level has more than MANY urls, as none below it then has.
    """
    level = 0
    while True:
        node = F.slice("s", 1, level)
        deeper = trees.where(F.size("s") > level).select("host", node.alias("node"), F.get("s", F.lit(level)).alias("child"), "n")
        children = deeper.groupBy("host", "node", "child").agg(F.sum("n").alias("n"))
        nodes = cut_lineage(
            children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("urls")).where(f"urls > {MANY}"), "nodes"
        )
        if nodes.isEmpty():
            return trees
        wild = nodes.where(f"kinds > {MANY} and 2 * kinds > urls").select("host", "node", F.lit(True).alias("wild"))
        if not wild.isEmpty():
            joined = trees.withColumn("node", F.when(F.size("s") > level, node)).join(wild, ["host", "node"], "left")
            changed = F.concat(node, F.array(F.lit(WILD)), F.slice("s", level + 2, F.greatest(F.size("s") - level - 1, F.lit(0))))
            trees = joined.withColumn("s", F.when(F.col("wild"), changed).otherwise(F.col("s"))).drop("node", "wild")
            trees = cut_lineage(trees, "trees")
        level += 1


def similar(bad: str, seen: str, all_bad: str, all_seen: str) -> Column:
    """Whether bad / seen deviates from all_bad / all_seen by at most sqrt(Z2) standard errors; in whole numbers."""
    return F.expr(
        f"power({bad} * {all_seen} - {all_bad} * {seen}, 2) <= {Z2} * {all_bad} * ({all_seen} - {all_bad}) * {seen}"
    )


def sums(df: DataFrame, keys: list[str], bad: str, seen: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("bad").cast("double").alias(bad), F.sum("seen").cast("double").alias(seen))


def spelled(segments: Column) -> Column:
    """A path of segments; the root itself is an empty path."""
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise(F.lit(""))


def template_verdicts(trees: DataFrame) -> DataFrame:
    """Per (host, marked path): template, purity, method. `trees`: host, marked, s (its segments), n, seen, bad."""
    trees = generalise(trees)
    leaves = cut_lineage(trees.groupBy("host", "s").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")), "leaves")
    # a node is known by the digest of its path, so that deep paths do not travel once for each of their nodes
    digest = lambda k: F.md5(F.concat(k.cast("string"), F.lit("/"), F.array_join(F.slice("s", 1, k), "/")))
    chain = F.transform(
        F.sequence(F.lit(0), F.size("s")), lambda k: F.struct(k.alias("depth"), digest(k).alias("node"), F.when(k > 0, digest(k - 1)).alias("parent"))
    )
    leaves = leaves.withColumn("leaf", digest(F.size("s")))
    met = leaves.select("host", "leaf", "bad", "seen", F.explode(chain).alias("c")).select("host", "leaf", "bad", "seen", "c.*")
    nodes = cut_lineage(met.groupBy("host", "node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("bad").cast("double").alias("bad"), F.sum("seen").cast("double").alias("seen")
    ), "nodes")
    parents = nodes.select("host", F.col("node").alias("parent"), F.col("bad").alias("all_bad"), F.col("seen").alias("all_seen"))
    apart = nodes.join(parents, ["host", "parent"]).where(~similar("bad", "seen", "all_bad", "all_seen")).select("host", "node")
    # the lowest node on the way up that is unlike its parent; all below it are merged into it
    kept = met.select("host", "leaf", "node", "depth").join(apart, ["host", "node"]).groupBy("host", "leaf").agg(F.max("depth").alias("kept"))
    judged = leaves.join(kept, ["host", "leaf"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    judged = judged.withColumn("template", F.when(F.col("kept") == F.size("s"), spelled(F.col("s"))).otherwise(
        F.concat(spelled(F.slice("s", 1, F.col("kept"))), F.lit(f"/{MERGED}"))
    ))
    judged = cut_lineage(judged.drop("leaf", "kept"), "judged")
    pooled = sums(judged, ["host", "template"], "pool_bad", "pool_seen")
    shapes = sums(leaves, ["s"], "shape_bad", "shape_seen")
    overall = leaves.agg(F.sum("bad").cast("double").alias("all_bad"), F.sum("seen").cast("double").alias("all_seen"))
    purity = F.expr(
        f"(pool_bad + {PRIOR} * ((shape_bad + {PRIOR} * CASE WHEN all_seen > 0 THEN all_bad / all_seen ELSE 0.0D END)"
        f" / (shape_seen + {PRIOR}))) / (pool_seen + {PRIOR})"
    )
    scored = (
        judged.join(pooled, ["host", "template"]).join(shapes, "s").join(F.broadcast(overall))  # one row
        .withColumn("purity", purity)
        .select("host", "s", "template", "purity", F.when(F.col("purity") >= 0.5, "block").otherwise("allow").alias("method"))
    )
    return trees.select("host", "marked", "s").join(scored, ["host", "s"]).drop("s")


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, purity.

    Urls that are null or lack "://" have an empty host and path and are judged like any other template. Repeated urls
    each count. Without any rule that fits, nothing is labelled and everything is allowed. Long urls and paths of many
    segments are taken whole.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = cut_lineage(host_rules(rows.select("host").distinct(), rules), "rules")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    rows = rows.join(known, "host", "left").withColumn("first", first).select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"), F.col("first.action").alias("action"),
        marked_path(F.col("path")).alias("marked"),
    )
    trees = rows.groupBy("host", "marked").agg(
        F.count(F.lit(1)).alias("n"), F.count("action").alias("seen"),
        F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("bad"),
    ).withColumn("s", segments_of(F.col("marked")))
    verdicts = template_verdicts(cut_lineage(trees, "trees"))
    return rows.join(verdicts, ["host", "marked"]).select(
        "page_id", "host", "path", "rule", F.coalesce("action", "method").alias("verdict"), "template", "purity",
    )
