"""Named queries of the file-level operators: sources, rules, audits, health, gates, bundles and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import bundle, docs, health, merge, rules
from tallgrass.plans.catalog import entities, query, rounded
from tallgrass.session import table
from tallgrass.sources import files, parsers

# ---- sources --------------------------------------------------------------------------------------------------------


def paths(spark, sf) -> DataFrame:
    """Documents as files: source/doc<id>.<ext by language>."""
    d = table(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "rs").when(F.col("lang") == "fr", "min.js").otherwise("md")
    return d.select("doc_id", F.concat("source", F.lit("/doc"), F.col("doc_id"), F.lit("."), ext).alias("path"), F.col("n_chars").alias("size"), "text")


PATHS = "pa AS (SELECT doc_id, source || '/doc' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'rs' WHEN 'fr' THEN 'min.js' ELSE 'md' END AS path, n_chars AS size, text FROM documents)"


@query(f"WITH {PATHS} SELECT doc_id, path FROM pa WHERE regexp_matches(path, '\\.(py|rs|js)$') AND size <= 5000 AND NOT regexp_matches(path, '(^|/)src1[0-9]/') AND NOT regexp_matches(path, '\\.min\\.js$')")
def discovery_filter(spark, sf):
    return files.selected(paths(spark, sf), ["py", "rs", "js"], 5000, exclude=["src1?/**", "**/*.min.js"]).select("doc_id", "path")


@query(f"WITH {PATHS} SELECT doc_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'txt' END AS language FROM pa")
def language_of(spark, sf):
    return paths(spark, sf).select("doc_id", T.language(F.col("path")).alias("language"))


@query("SELECT source || '.info' AS path, doc_id AS line, (n_chars % 4)::BIGINT AS hits, n_chars % 4 > 0 AS covered FROM documents")
def lcov_parse(spark, sf):
    """Each source's LCOV report, written and parsed again."""
    d = table(spark, sf, "documents")
    line = F.concat(F.lit("DA:"), F.col("doc_id"), F.lit(","), F.col("n_chars") % 4)
    reports = d.groupBy("source").agg(F.array_sort(F.collect_list(line)).alias("l")).select(F.concat(F.lit("SF:"), "source", F.lit(".info\n"), F.array_join("l", "\n"), F.lit("\nend_of_record\n")).alias("content"))
    return parsers.lcov(reports).select("path", "line", "hits", "covered")


@query("SELECT page_id, regexp_matches(substr(html, 1, 4096), 'webpack|__require__|parcelRequire') AS bundled FROM pages")
def bundled_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.bundled(F.col("html"), ["webpack", "__require__", "parcelRequire"]).alias("bundled"))


# ---- rules ----------------------------------------------------------------------------------------------------------

@query("SELECT doc_id AS id, round(least(n_chars / 100 / 8 + len(string_split(text, chr(10))) / 2, 10), 6) AS impact, round(4 + least(n_chars / 100 / 70, 4), 6) AS effort, round(greatest(least(n_chars / 100 / 8 + len(string_split(text, chr(10))) / 2, 10) / (4 + least(n_chars / 100 / 70, 4)), 0.1), 6) AS priority FROM documents WHERE n_chars / 100 >= 50")
def long_rules(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 100).alias("loc"), F.size(F.split("text", "\n")).cast("double").alias("cyclomatic"))
    return rounded(rules.long_functions(d))


@query("WITH d AS (SELECT doc_id AS id, source AS file, md5(text) AS fp FROM documents) SELECT id, file, members, first FROM (SELECT id, file, count(*) OVER w AS members, min(id) OVER w AS first FROM d WINDOW w AS (PARTITION BY file, fp)) WHERE members >= 2")
def duplicate_rule(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.md5("text").alias("fp"))
    return rules.duplicates(d)


RANGES = "a AS (SELECT l_orderkey AS file, l_linenumber AS id, min(l_shipdate::DATE - DATE '1992-01-01') AS s, min(l_shipdate::DATE - DATE '1992-01-01') + max(l_quantity)::BIGINT AS e FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {RANGES} SELECT x.file, x.id AS a, y.id AS b FROM a x JOIN a y ON x.file = y.file AND x.id < y.id AND x.s <= y.e AND y.s <= x.e")
def overlap_join(spark, sf):
    li = table(spark, sf, "lineitem")
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    r = li.groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("id")).agg(F.min(day).alias("s"), F.max("l_quantity").cast("long").alias("q"))
    return rules.overlaps(r.select("file", "id", "s", (F.col("s") + F.col("q")).alias("e")))


# ---- documentation --------------------------------------------------------------------------------------------------

@query("SELECT doc_id, text IS NULL OR trim(text) = '' OR regexp_matches(text, '(?i)TODO|FIXME|TBD') AS todo FROM documents")
def todo_markers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", docs.incomplete(F.col("text")).alias("todo"))


@query("SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 8 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_readme_anti(spark, sf):
    o = table(spark, sf, "orders")
    return docs.missing(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 8)


@query("WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1) SELECT e.user_id, count(*) FILTER (mark IS NULL OR ts > mark) AS since FROM events e LEFT JOIN m USING (user_id) GROUP BY 1")
def asof_count(spark, sf):
    e = table(spark, sf, "events")
    kind = e.agg(F.min("event_type").alias("kind"))  # one row
    marks = e.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).select("user_id", "ts")
    return docs.changes_since(e.select("user_id", "ts"), marks, "user_id")


@query("WITH g AS (SELECT doc_id, length(text) - length(replace(text, '|', '')) AS gaps FROM documents) SELECT doc_id, CASE WHEN gaps = 0 THEN 100 ELSE round(100 * (1 - log10(gaps + 1) / log10((SELECT max(gaps) FROM g) + 1)), 6) END AS score FROM g")
def doc_log_score(spark, sf):
    g = table(spark, sf, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).alias("gaps"))
    return rounded(docs.log_scores(g))


# ---- health and gates -----------------------------------------------------------------------------------------------

HEALTH = "(0.28 * mi + 0.25 * 100 + 0.18 * (100 - cx) + 0.19 * (100 - debt) + 0.10 * 100)"


@query(f"SELECT grp, file, count(*) AS n, round(avg({HEALTH}), 4) AS health FROM (SELECT n_regionkey AS grp, c_nationkey AS file, least(100, greatest(0, 50 + c_acctbal / 200)) AS mi, c_custkey % 100 AS cx, c_custkey % 37 AS debt FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY GROUPING SETS ((grp), (grp, file))")
def health_grouping_sets(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mi = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + F.col("c_acctbal") / 200))
    half = F.col("c_custkey") % 100 / 4
    m = c.select(F.col("n_regionkey").alias("dir"), F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("id"), mi.alias("maintainability"), half.alias("cyclomatic"), half.alias("cognitive"), (F.col("c_custkey") % 37).alias("debt"))
    return health.levels(m).filter("level <> 'entity'").select(F.col("dir").alias("grp"), "file", "n", F.round("health", 4).alias("health"))


@query("WITH m AS (SELECT avg(n_chars) / 100 AS complexity, 100.0::DOUBLE * count(DISTINCT source) / count(*) AS structure, max(n_chars) AS largest FROM documents), g(rule, metric, op, threshold) AS (VALUES ('complexity', 'complexity', '>', 20.0::DOUBLE), ('structure', 'structure', '<', 5.0::DOUBLE), ('largest', 'largest', '>', 1000000.0::DOUBLE)), v AS (SELECT rule, op, threshold, CASE metric WHEN 'complexity' THEN complexity WHEN 'structure' THEN structure ELSE largest END AS value FROM g, m) SELECT rule, round(value, 4) AS value, threshold, CASE op WHEN '>' THEN value > threshold ELSE value < threshold END AS violated FROM v")
def quality_gates(spark, sf):
    d = table(spark, sf, "documents")
    m = d.agg((F.avg("n_chars") / 100).alias("complexity"), (100.0 * F.countDistinct("source") / F.count("*")).alias("structure"), F.max("n_chars").cast("double").alias("largest"))
    gates = spark.createDataFrame([("complexity", "complexity", ">", 20.0), ("structure", "structure", "<", 5.0), ("largest", "largest", ">", 1e6)], "rule string, metric string, op string, threshold double")
    return health.gates(m, gates).withColumn("value", F.round("value", 4))


# ---- bundles and merges ---------------------------------------------------------------------------------------------

@query("WITH o AS (SELECT source, doc_id, n_chars // 4 AS tokens, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS upto FROM documents) SELECT source, doc_id, tokens, upto::BIGINT AS upto FROM o WHERE upto <= 3000")
def budget_prefix(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("priority"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return bundle.prefix(d, "source", "doc_id", 3000).select("source", "doc_id", "tokens", "upto")


@query()
def budget_greedy(spark, sf):
    """Greedy fill: an item that does not fit is passed over (order-dependent, so SQL has no plain form)."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("priority"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return bundle.greedy(d, "source", "doc_id", 3000)


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT s_suppkey % 50 AS k FROM supplier) s WHERE p_name LIKE '%' || s.k OR p_partkey % 50 = s.k AND p_size > 25)")
def semi_suffix(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 50).alias("k"), "p_size")
    return bundle.ending_in(parts, table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("k")).distinct())


@query("SELECT c_mktsegment, sum(n)::BIGINT AS n, round(CASE WHEN sum(n) = 0 THEN avg(m) ELSE sum(m * n) / sum(n) END, 4) AS mean, round(max(x), 4) AS most FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(c_acctbal / 3) AS m, max(c_acctbal) AS x FROM customer GROUP BY 1, 2) GROUP BY 1")
def weighted_merge(spark, sf):
    part = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.avg(F.col("c_acctbal") / 3).alias("mean"), F.max("c_acctbal").alias("most"))
    return rounded(merge.weighted(part, "c_mktsegment"), 4)


@query("SELECT source || ':' || quality AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def keyed_sum(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return merge.summed(d.select(F.concat_ws(":", "source", "quality").alias("k"), F.lit(1).cast("long").alias("n")))


@query("WITH i AS (SELECT doc_id, n_chars, CASE WHEN n_chars > 8000 THEN 'High' WHEN n_chars > 5000 THEN 'Medium' ELSE 'Low' END AS severity FROM documents WHERE n_chars > 2000) SELECT doc_id, severity, CASE severity WHEN 'High' THEN 'MAJOR' WHEN 'Medium' THEN 'MINOR' ELSE 'INFO' END AS sonar FROM i")
def sonar_issues(spark, sf):
    from tallgrass.sources.sinks import sonar_severity

    d = table(spark, sf, "documents").filter("n_chars > 2000")
    sev = F.when(F.col("n_chars") > 8000, "High").when(F.col("n_chars") > 5000, "Medium").otherwise("Low")
    return d.select("doc_id", sev.alias("severity")).withColumn("sonar", sonar_severity(F.col("severity")))
