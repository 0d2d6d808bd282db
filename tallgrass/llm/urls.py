"""URL filtering by rules and, where no rule fits, by a path-template tree per host.

Tree: the segments of each path are walked from the root. Under one node of one host, a segment becomes the wildcard
``*`` if it holds digits and little else, or if the node has many children of which this one has a small share
(variable segments), or if its labelled purity does not differ statistically from its siblings' (two-proportion
z-test), so that such branches merge. Urls judged by a rule are the labels. A template is rejected if its purity
(share of blocked urls, smoothed towards the same template on all hosts, and that towards the share over all urls)
is above the threshold.

All work is on distinct (host, shape) rows with counts, made by a partial aggregate, so a host with a third of all
urls is small after one step; results return to the urls by an equi-join that adaptive execution may split.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import written

#: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def numeric(segment: Column) -> Column:
    """At least half of the segment is digits."""
    return segment.rlike("[0-9]") & (F.length(F.regexp_replace(segment, "[0-9]", "")) * 2 <= F.length(segment))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def template_verdicts(urls: DataFrame, fanout: int = 12, share: float = 0.05, z: float = 1.64, weight: float = 4.0, threshold: float = 0.5) -> DataFrame:
    """(host, segs, n, labelled, blocked) -> (host, segs, template, purity, rejected).

    urls: host, segs (array of path segments), n (urls), labelled and blocked (of them). Each round goes one segment
    down, as deep as the paths are; where a node holds one path alone, the rest of that path is taken at once, as no
    sibling can change it.
    """
    node = urls.groupBy("host", "segs").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    now, d = written(node.select("*", F.lit("").alias("template"), F.lit(False).alias("done")), "templates"), 0
    while (now.filter("not done").agg(F.max(F.size("segs"))).first()[0] or 0) > d:
        going = (F.size("segs") > d) & ~F.col("done")
        here = now.filter(going).withColumn("seg", F.get("segs", F.lit(d)))
        child = here.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("paths"))
        parent = child.groupBy("host", "template").agg(F.count("*").alias("fan"), F.sum("paths").alias("alone"), F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        c = child.join(parent, ["host", "template"])
        variable = numeric(F.col("seg")) | (F.col("fan") > fanout) & (F.col("n") < share * F.col("pn"))
        rest_l, rest_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        pooled = F.col("pb") / F.nullif("pl", F.lit(0))
        gap = F.abs(F.col("b") / F.nullif("l", F.lit(0)) - rest_b / F.nullif(rest_l, F.lit(0)))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif("l", F.lit(0)) + 1 / F.nullif(rest_l, F.lit(0))))
        similar = F.coalesce(gap <= z * spread, F.lit(False))
        step = c.select("host", "template", "seg", F.when(variable | similar, "*").otherwise(F.col("seg")).alias("step"), (F.col("alone") == 1).alias("alone"))
        rest = F.transform(F.slice("segs", d + 2, F.greatest(F.size("segs"), F.lit(1))), lambda s: F.concat(F.lit("/"), F.when(numeric(s), "*").otherwise(s)))
        longer = F.concat("template", F.lit("/"), "step", F.when(F.col("alone"), F.array_join(rest, "")).otherwise(""))
        grown = here.join(step, ["host", "template", "seg"]).withColumns({"template": longer, "done": F.col("alone")}).select(now.columns)
        now, d = written(grown.unionByName(now.filter(~going)), "templates"), d + 1
    own = now.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    anywhere = own.groupBy("template").agg(F.sum("l").alias("gl"), F.sum("b").alias("gb"))
    base = own.agg((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("l"), F.lit(0)) + 2)).first()[0]
    prior = (F.col("gb") + weight * base) / (F.col("gl") + weight)
    purity = own.join(anywhere, "template").select("host", "template", ((F.col("b") + weight * prior) / (F.col("l") + weight)).alias("purity"))
    return now.select("host", "segs", "template").join(purity, ["host", "template"]).withColumn("rejected", F.col("purity") > threshold)


def filter_urls(pages: DataFrame, rules=RULES, **tree) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, template, purity.

    A url without ``://`` (or a null one) has an empty host and path, which fit no rule; it is judged as the empty
    template. Repeated rows are judged alike and kept; an empty table gives no rows; other columns are ignored.
    """
    url = F.col("url")
    p = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # segments of digits are wildcards wherever they stand, so the shapes that are counted are few, even of a hot host
    segs = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(numeric(s), "*").otherwise(s))
    p = p.select("*", name.alias("rule"), verdict.alias("ruled"), segs.alias("segs"))
    counted = p.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    judged = template_verdicts(counted, **tree)
    found = p.join(judged, ["host", "segs"], "left")
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
