"""URL filter by a tree of path templates, with DataFrame operations only.

Per host, paths are walked level by level, until no node has as many rows as a child needs to stand alone.  At a
node whose children are variable (many, and few rows to each) all children become one wildcard; elsewhere rare
children do.  The children left are put in the order of their shares of bad labels, and neighbours whose shares a
two-proportion test at ``Z`` standard errors does not tell apart become one merged branch.  A template's purity is
its share of bad labels, smoothed towards its host's, which is smoothed towards the table's; templates at ``REJECT``
or more are blocked.  Rules for hosts and path starts come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values: (host, path start, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Children above which a node can be variable, and rows a child it then has less than; rows
#: that a child needs to stand alone; standard errors; pseudo-counts; the purity that blocks.
MANY, DENSE, RARE, Z, PSEUDO, REJECT = 8, 4, 5, 2.0, 5.0, 0.4
WILD, MERGED = "*", "~"
#: Steps of smoothed shares in which a node's children are ordered, so that no node has more of them to sort.
STEPS = 64
#: Rows and characters of a lookup table that is broadcast; a larger one is joined by a key with so many salts.
SMALL, SMALL_CHARS, SALTS = 1 << 16, 1 << 24, 16


def host_of(url: Column) -> Column:
    found = F.locate("://", url) > 0
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(found, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)).otherwise("")


def path_of(url: Column) -> Column:
    found = F.locate("://", url) > 0
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(found, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, h + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _looked_up(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the saved table ``found``, whose keys are distinct; a key may have any share of the rows."""
    many, chars = found.agg(F.count("*"), F.sum(sum((F.length(k) for k in keys), F.lit(0)))).first()
    if many <= SMALL and (chars or 0) <= SMALL_CHARS:
        return rows.join(F.broadcast(found), keys, "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "salt"], "left").drop("salt")


def _branches(scratch: Scratch, child: DataFrame, tag: str) -> DataFrame:
    """(host, template, seg, token) of the children that do not go into the wildcard; saved.

    ``child`` has n rows, b bad ones of l labelled ones for each host, template and seg.
    """
    node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("l").alias("all_l"))
    node = scratch.save(node.where(~((F.col("kids") > MANY) & (F.col("all_n") < DENSE * F.col("kids")))), f"{tag}_nodes")
    share = (F.col("b") + PSEUDO * (F.col("all_b") + 1) / (F.col("all_l") + 2)) / (F.col("l") + PSEUDO)
    kept = child.where(F.col("n") >= RARE).join(node, ["host", "template"])
    kept = scratch.save(kept.select("host", "template", "seg", "b", "l", F.floor(share * STEPS).alias("step")), f"{tag}_kept")
    step = kept.groupBy("host", "template", "step").agg(F.count("*").alias("kids"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    order = Window.partitionBy("host", "template").orderBy("step")
    b0, l0 = F.lag("b").over(order), F.lag("l").over(order)
    p = (F.col("b") + b0 + 1) / (F.col("l") + l0 + 2)
    # the test in a form without a division: of a branch without labels nothing is told apart
    apart = F.abs(F.col("b") * l0 - b0 * F.col("l")) > Z * F.sqrt(p * (1 - p) * (F.col("l") + l0) * F.col("l") * l0)
    merged = step.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("branch", F.sum("apart").over(order))
    merged = merged.withColumn("members", F.sum("kids").over(Window.partitionBy("host", "template", "branch"))).select("host", "template", "step", "branch", "members")
    token = F.when(F.col("members") > 1, F.concat(F.lit(MERGED), F.col("branch").cast("string"))).otherwise(F.col("seg"))
    return scratch.save(kept.join(scratch.save(merged, f"{tag}_steps"), ["host", "template", "step"]).select("host", "template", "seg", token.alias("token")), f"{tag}_tokens")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """A row for each row of ``pages`` (page_id, url): host, path, rule, verdict, template, purity.

    ``labels`` has page_id and bad (0 or 1); a page with several labels has the worst.  A template is written as its
    segments: ``*`` for a wildcard, ``~n`` for the n-th merged branch.  Cases: a url that is null or has no ``://``
    has empty host and path, and is judged like any other host; paths of any length and depth are walked whole;
    null page_ids have no label; repeated rows are judged each; of equally long rules that fit, the one that sorts
    last wins; other columns are ignored; with no labels at all ``allow`` is given; no rows give no rows.
    """
    scratch = Scratch(pages.sparkSession)
    url = F.col("url")
    rows = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    marks = scratch.save(labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad")), "marks")
    # rows without an id have no label, and are not sent to one task to find that out
    rows = rows.where("page_id is not null").join(marks, "page_id", "left").unionByName(rows.where("page_id is null").withColumn("bad", F.lit(None).cast("long")))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = rows.withColumns({"parts": F.when(F.length("path") > 0, parts).otherwise(F.array().cast("array<string>")), "template": F.lit(""), "labelled": F.col("bad").isNotNull().cast("long")})
    rows = scratch.save(rows.fillna({"bad": 0}), "level_0")
    depth = 0
    # below a node with fewer than RARE rows every segment is a wildcard
    while not rows.where(F.size("parts") > depth).groupBy("host", "template").count().where(F.col("count") >= RARE).isEmpty():
        seg = F.get("parts", F.lit(depth))
        inside = rows.where(seg.isNotNull()).select("host", "template", seg.alias("seg"), "bad", "labelled")
        child = scratch.save(inside.groupBy("host", "template", "seg").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), F.sum("labelled").alias("l")), f"children_{depth}")
        rows = _looked_up(rows.withColumn("seg", seg), _branches(scratch, child, f"branches_{depth}"), ["host", "template", "seg"])
        step = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("token", F.lit(WILD))))
        rows = scratch.save(rows.withColumn("template", step).drop("seg", "token"), f"level_{depth + 1}")
        scratch.drop(f"level_{depth}")
        depth += 1
    rows = rows.withColumn("template", F.concat("template", F.repeat(F.lit("/" + WILD), F.greatest(F.size("parts") - depth, F.lit(0)))))
    per = scratch.save(rows.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")), "templates")
    hosts = scratch.save(per.groupBy("host").agg(F.sum("b").alias("host_b"), F.sum("l").alias("host_l")), "hosts")
    all_b, all_l = hosts.agg(F.coalesce(F.sum("host_b"), F.lit(0)), F.coalesce(F.sum("host_l"), F.lit(0))).first()
    prior = (all_b + 1) / (all_l + 2)
    of_host = (F.col("host_b") + PSEUDO * prior) / (F.col("host_l") + PSEUDO)
    purity = scratch.save(per.join(hosts, "host").select("host", "template", ((F.col("b") + PSEUDO * of_host) / (F.col("l") + PSEUDO)).alias("purity")), "purity")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("purity") >= REJECT) & F.lit(all_l > 0), "block").otherwise("allow")
    return _looked_up(rows, purity, ["host", "template"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
