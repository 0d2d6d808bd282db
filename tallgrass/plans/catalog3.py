"""Named queries of complexity, refactoring rules, fixed scoring, health and gates.

Orders stand for entities: a customer is a file, an order's lines run from its day on, as many as its price pays for;
order lines are decision points and tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators import complexity, health, rules
from tallgrass.plans.catalog import query, rounded
from tallgrass.session import table


def day(c: str):
    return F.datediff(F.col(c), F.lit("1992-01-01").cast("date")).cast("long")


def units(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"), day("o_orderdate").alias("s"), F.floor(F.col("o_totalprice") / 2000).cast("long").alias("size"))
    return o.select("id", "file", "name", "s", (F.col("s") + F.col("size")).alias("e"), F.greatest("size", F.lit(1)).alias("loc"))


def points(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file"))
    li = table(spark, sf, "lineitem").join(o, "l_orderkey")
    return li.select("file", day("l_shipdate").alias("s"), (day("l_shipdate") + F.col("l_linenumber") - 1).alias("e"), ((F.col("l_linenumber") - 1) % 4).cast("long").alias("nesting"))


def token_counts(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    t = li.select(F.col("l_orderkey").alias("id"), F.explode(F.array(F.concat(F.lit("op:"), "l_returnflag", "l_linestatus"), F.col("l_partkey").cast("string"))).alias("token"))
    return complexity.halstead_counts(t, F.col("token").startswith("op:"))


def measured(spark, sf) -> DataFrame:
    """Entities with all metrics, their severity, and the number of their issues."""
    e = complexity.of_entities(units(spark, sf), points(spark, sf)).join(token_counts(spark, sf), "id", "left").fillna(0, ["n1", "n2", "all1", "all2"])
    h = complexity.halstead(F.col("n1"), F.col("n2"), F.col("all1"), F.col("all2"))
    m = e.select("id", "file", "name", "s", "e", "loc", "cyclomatic", "cognitive", "nesting", F.col("all1").alias("operators"), F.col("n2").alias("members"), h["volume"].alias("volume"))
    debt = complexity.debt(F.col("cyclomatic"), F.col("cognitive"), F.col("loc"))
    issues = sum((F.col(c) > complexity.THRESHOLDS[c][2]).cast("long") for c in ("cyclomatic", "cognitive", "nesting"))
    return m.withColumns({"debt": debt, "maintainability": complexity.maintainability(F.col("volume"), F.col("cyclomatic"), F.col("loc")), "severity": complexity.severity(F.col("cyclomatic"), F.col("cognitive")), "issues": issues})


UNITS = "un AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderpriority AS name, (o_orderdate::DATE - DATE '1992-01-01')::BIGINT AS s, (o_orderdate::DATE - DATE '1992-01-01')::BIGINT + floor(o_totalprice / 2000)::BIGINT AS e, greatest(floor(o_totalprice / 2000)::BIGINT, 1) AS loc FROM orders)"
POINTS = "po AS (SELECT o_custkey AS file, (l_shipdate::DATE - DATE '1992-01-01')::BIGINT AS s, (l_shipdate::DATE - DATE '1992-01-01')::BIGINT + l_linenumber - 1 AS e, ((l_linenumber - 1) % 4)::BIGINT AS nesting FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
INSIDE = f"{UNITS}, {POINTS}, pin AS (SELECT un.id, count(*) AS n, sum(1 + nesting)::BIGINT AS c, max(nesting) AS d FROM un JOIN po ON po.file = un.file AND po.s >= un.s AND po.e <= un.e GROUP BY 1), cx AS (SELECT un.*, 1 + coalesce(n, 0) AS cyclomatic, coalesce(c, 0) AS cognitive, coalesce(d, 0) AS nesting FROM un LEFT JOIN pin USING (id))"
COUNTS = "hc AS (SELECT l_orderkey AS id, count(DISTINCT l_returnflag || l_linestatus) AS n1, count(DISTINCT l_partkey) AS n2, count(*) AS all1, count(*) AS all2 FROM lineitem GROUP BY 1)"
VOLUME = "CASE WHEN n1 + n2 > 0 AND all1 + all2 > 0 THEN (all1 + all2) * log2(n1 + n2) ELSE 0 END"
DEBT = "100 * (0.4::DOUBLE * least(cyclomatic / 20, 1) + 0.4::DOUBLE * least(cognitive / 50, 1) + 0.2::DOUBLE * least(loc / 100, 1))"
MEASURED = f"""{INSIDE}, {COUNTS}, mv AS (SELECT cx.*, coalesce(all1, 0) AS operators, coalesce(n2, 0) AS members, coalesce({VOLUME}, 0) AS volume FROM cx LEFT JOIN hc USING (id)),
me AS (SELECT *, {DEBT} AS debt, greatest(0, least(100, 171 - 5.2::DOUBLE * ln(CASE WHEN volume <= 0 THEN 1 ELSE volume END) - 0.23::DOUBLE * cyclomatic - 16.2::DOUBLE * ln(loc))) AS maintainability, CASE greatest(CASE WHEN cyclomatic >= 25 THEN 3 WHEN cyclomatic >= 15 THEN 2 WHEN cyclomatic >= 10 THEN 1 ELSE 0 END, CASE WHEN cognitive >= 50 THEN 3 WHEN cognitive >= 25 THEN 2 WHEN cognitive >= 15 THEN 1 ELSE 0 END) WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Moderate' ELSE 'Low' END AS severity, (cyclomatic > 15)::BIGINT + (cognitive > 25)::BIGINT + (nesting > 6)::BIGINT AS issues FROM mv)"""

# ---- complexity -----------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT file, 1 + count(*) AS cyclomatic, sum(1 + nesting)::BIGINT AS cognitive, max(nesting) AS nesting FROM po GROUP BY 1")
def file_complexity(spark, sf):
    return complexity.of_files(points(spark, sf))


@query(f"WITH {INSIDE} SELECT id, cyclomatic, cognitive, nesting FROM cx")
def entity_complexity(spark, sf):
    return complexity.of_entities(units(spark, sf), points(spark, sf)).select("id", "cyclomatic", "cognitive", "nesting")


@query(f"WITH {COUNTS} SELECT id, n1, n2, all1, all2 FROM hc")
def halstead_counts(spark, sf):
    return token_counts(spark, sf)


@query(f"WITH {COUNTS}, v AS (SELECT *, n1 + n2 AS vocabulary, all1 + all2 AS length, {VOLUME} AS volume, CASE WHEN n2 > 0 THEN n1 / 2 * (all2 / greatest(n2, 1)) ELSE 0 END AS difficulty FROM hc) SELECT id, vocabulary, length, round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(difficulty * volume, 4) AS effort, round(difficulty * volume / 18, 5) AS time, round(volume / 3000, 8) AS bugs, round(CASE WHEN n1 > 0 THEN n1 * log2(n1) ELSE 0 END + CASE WHEN n2 > 0 THEN n2 * log2(n2) ELSE 0 END, 6) AS estimated FROM v")
def halstead_measures(spark, sf):
    h = complexity.halstead(*[F.col(c) for c in ("n1", "n2", "all1", "all2")])
    digits = {"effort": 4, "time": 5, "bugs": 8}
    return token_counts(spark, sf).select("id", *[v.alias(k) if k in ("vocabulary", "length") else F.round(v, digits.get(k, 6)).alias(k) for k, v in h.items()])


@query(f"WITH {MEASURED} SELECT id, round(debt, 6) AS debt, round(maintainability, 6) AS maintainability, severity FROM me")
def debt_maintainability(spark, sf):
    return rounded(measured(spark, sf).select("id", "debt", "maintainability", "severity"))


@query(f"WITH {MEASURED}, lo AS (SELECT id, unnest(['cyclomatic', 'cognitive', 'nesting']) AS metric, unnest([cyclomatic, cognitive, nesting])::DOUBLE AS value FROM me), th(metric, high, very_high) AS (VALUES ('cyclomatic', 15, 25), ('cognitive', 25, 50), ('nesting', 6, 10)) SELECT id, metric, value, CASE WHEN value >= very_high THEN 'Critical' ELSE 'High' END AS severity FROM lo JOIN th USING (metric) WHERE value > high")
def complexity_issues(spark, sf):
    return complexity.issues(measured(spark, sf), complexity.thresholds(spark))


@query("SELECT doc_id AS file, len(string_split(text, chr(10)))::INT AS lines, 'large_file' AS kind FROM documents WHERE len(string_split(text, chr(10))) > 20")
def large_files(spark, sf):
    return complexity.large_files(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n")).alias("lines")), 20)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 15 THEN 'Low' WHEN l_quantity <= 30 THEN 'Medium' WHEN l_quantity <= 40 THEN 'High' WHEN l_quantity <= 45 THEN 'VeryHigh' ELSE 'Critical' END AS grade FROM lineitem")
def grade_ladder(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", complexity.grade(F.col("l_quantity"), F.lit(15), F.lit(30), F.lit(40), F.lit(45)).alias("grade"))


@query(f"WITH {MEASURED} SELECT round(avg(cyclomatic), 6) AS mean_cyclomatic, round(avg(cognitive), 6) AS mean_cognitive, round(avg(debt), 6) AS mean_debt, round(avg(maintainability), 6) AS mean_maintainability, count(*) AS entities FROM me")
def complexity_averages(spark, sf):
    return rounded(complexity.averages(measured(spark, sf)))


#: Results of another run: every third order under a number of its own, and all under shifted ranges.
RESULTS = "rs AS (SELECT CASE WHEN id % 3 = 0 THEN id ELSE -id END AS id, CASE WHEN id % 5 = 0 THEN name ELSE '' END AS name, file, s + 100 AS s, e + 50 AS e, cyclomatic, cognitive FROM cx WHERE e + 50 >= s + 100)"


@query(f"WITH {INSIDE}, {RESULTS}, ma AS (SELECT un.id, rs.cyclomatic, rs.cognitive FROM un JOIN rs ON rs.id = un.id UNION ALL SELECT un.id, rs.cyclomatic, rs.cognitive FROM un JOIN rs ON rs.name = un.name AND rs.file = un.file UNION ALL SELECT un.id, rs.cyclomatic, rs.cognitive FROM un JOIN rs ON rs.file = un.file AND un.s <= rs.e AND rs.s <= un.e), be AS (SELECT id, max(cyclomatic) AS cyc, max(cognitive) AS cog FROM ma GROUP BY 1), wo AS (SELECT file, cyclomatic, cognitive FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY cyclomatic DESC, cognitive DESC) AS k FROM rs) WHERE k = 1) SELECT un.id, coalesce(cyc, wo.cyclomatic) AS cyclomatic, coalesce(cog, wo.cognitive) AS cognitive, cyc IS NULL AS fallback FROM un LEFT JOIN be USING (id) LEFT JOIN wo ON wo.file = un.file")
def or_join_fallback(spark, sf):
    cx = complexity.of_entities(units(spark, sf), points(spark, sf))
    r = cx.select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"), F.when(F.col("id") % 5 == 0, F.col("name")).otherwise("").alias("name"), "file", (F.col("s") + 100).alias("s"), (F.col("e") + 50).alias("e"), "cyclomatic", "cognitive").filter("e >= s")
    return complexity.matched(units(spark, sf), r)


@query("SELECT source AS file, greatest(1, count(*) FILTER (lang IN ('en', 'de')) + 2 * count(*) FILTER (lang = 'fr')) AS blocks FROM documents GROUP BY 1")
def block_estimate(spark, sf):
    return complexity.blocks(table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("lang").alias("kind")), ["en", "de"], ["fr"])


# ---- fixed scoring --------------------------------------------------------------------------------------------------

FIXED = f"""{MEASURED}, cl AS (SELECT *, least(100, cyclomatic / 10 * 40) AS c1, least(100, cognitive / 15 * 30) AS c2, least(100, nesting * 6) AS c3, least(100, greatest(0, debt)) AS c4, least(100, greatest(0, 100 - maintainability)) AS c5 FROM me), ov AS (SELECT *, least(100, 0.30::DOUBLE * c1 + 0.25::DOUBLE * c2 + 0.15::DOUBLE * c3 + 0.20::DOUBLE * c4 + 0.10::DOUBLE * c5) AS overall FROM cl),
fx AS (SELECT id, file, overall, CASE WHEN issues = 0 THEN CASE WHEN overall >= 70 THEN 'Critical' WHEN overall >= 55 THEN 'High' WHEN overall >= 35 THEN 'Medium' WHEN overall >= 20 THEN 'Low' ELSE 'None' END ELSE CASE severity WHEN 'Critical' THEN 'Critical' WHEN 'High' THEN 'High' WHEN 'Moderate' THEN 'Medium' ELSE 'Low' END END AS priority, CASE WHEN loc >= 30 THEN 0.95::DOUBLE WHEN loc >= 15 THEN 0.85::DOUBLE WHEN loc >= 5 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM ov)"""


@query(f"WITH {FIXED} SELECT id, round(overall, 6) AS overall, priority, confidence FROM fx")
def fixed_scores(spark, sf):
    return rounded(complexity.scored(measured(spark, sf)))


@query(f"WITH {MEASURED} SELECT id, unnest(['cyclomatic', 'cognitive', 'nesting', 'loc', 'debt', 'maintainability']) AS feature, round(unnest([least(cyclomatic / 10, 1), least(cognitive / 15, 1), least(nesting / 5, 1), least(loc / 100, 1), debt / 100, maintainability / 100]), 6) AS value FROM me")
def metric_features(spark, sf):
    return rounded(complexity.features(measured(spark, sf)))


# ---- refactoring rules ----------------------------------------------------------------------------------------------

def rated(spark, sf) -> DataFrame:
    m = measured(spark, sf)
    return m.select("id", "file", "name", "s", "e", "loc", "cyclomatic", "cognitive", (F.col("cyclomatic") - 1).alias("points"), "operators", "members", F.concat_ws(":", "loc", "members").alias("fp"))


RATED = f"{MEASURED}, ra AS (SELECT id, file, s, e, loc, cyclomatic, cognitive, cyclomatic - 1 AS points, operators, members, loc || ':' || members AS fp FROM me)"
FOUND = f"""{RATED}, du AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY file, fp) AS same FROM ra WHERE loc >= 4) WHERE same >= 2),
r0 AS (SELECT id, file, s, e, least(loc / 8 + cyclomatic / 2, 10) AS impact, 4 + least(loc / 70, 4) AS effort, 'extract_method' AS kind FROM ra WHERE loc >= 50 UNION ALL SELECT id, file, s, e, greatest(5, least(10, 1.5::DOUBLE * cognitive)), 3.5::DOUBLE, 'simplify_conditionals' FROM ra WHERE greatest(points, operators) >= 4 UNION ALL SELECT id, file, s, e, greatest(6, least(10, loc / 8)), 5.5::DOUBLE, 'eliminate_duplication' FROM du UNION ALL SELECT id, file, s, e, greatest(5, least(10, loc / 20 + 0.5::DOUBLE * members)), 7.5::DOUBLE, 'extract_class' FROM ra WHERE loc >= 200 OR members >= 12),
rf AS (SELECT *, greatest(impact / effort, 0.1::DOUBLE) AS priority FROM r0 WHERE impact >= 5)"""


def _rule(kind: str, where: str) -> str:
    return f"WITH {FOUND}, r1 AS (SELECT id, impact, effort, greatest(impact / effort, 0.1::DOUBLE) AS priority FROM r0 WHERE kind = '{kind}') SELECT id, round(impact, 6) AS impact, round(effort, 6) AS effort, round(priority, 6) AS priority FROM r1"


@query(_rule("simplify_conditionals", ""))
def condition_rules(spark, sf):
    return rounded(rules.complex_conditions(rated(spark, sf)))


@query(_rule("eliminate_duplication", ""))
def duplication_rules(spark, sf):
    return rounded(rules.duplicated(rated(spark, sf)))


@query(_rule("extract_class", ""))
def type_rules(spark, sf):
    return rounded(rules.large_types(rated(spark, sf)))


@query(f"WITH {FOUND} SELECT id, file, s, e, kind, round(impact, 6) AS impact, round(effort, 6) AS effort, round(priority, 6) AS priority FROM rf")
def refactoring_recommendations(spark, sf):
    return rounded(rules.recommendations(rated(spark, sf)))


@query(f"WITH {FOUND}, li AS (SELECT file, sum(loc)::BIGINT AS lines FROM ra GROUP BY 1) SELECT file, round(least(120 * coalesce((SELECT sum(impact) FROM rf WHERE rf.file = li.file), 0) / greatest(lines, 1), 100), 6) AS score FROM li")
def refactoring_file_score(spark, sf):
    r = rated(spark, sf)
    return rounded(rules.file_scores(rules.recommendations(r), r.groupBy("file").agg(F.sum("loc").alias("lines"))))


@query(f"WITH {FOUND}, fe AS (SELECT un.id, count(*) AS n, sum(impact) AS total_impact, avg(impact) AS mean_impact, avg(priority) AS mean_priority, max(priority) AS max_priority, count(*) FILTER (kind = 'extract_method') AS n_method, count(*) FILTER (kind = 'extract_class') AS n_class, count(*) FILTER (kind = 'eliminate_duplication') AS n_duplicate, count(*) FILTER (kind = 'simplify_conditionals') AS n_conditional FROM un JOIN rf ON rf.file = un.file AND un.s <= rf.e AND rf.s <= un.e GROUP BY 1) SELECT un.id, coalesce(n, 0) AS n, round(coalesce(total_impact, 0), 6) AS total_impact, round(coalesce(mean_impact, 0), 6) AS mean_impact, round(coalesce(mean_priority, 0), 6) AS mean_priority, round(coalesce(max_priority, 0), 6) AS max_priority, coalesce(n_method, 0) AS n_method, coalesce(n_class, 0) AS n_class, coalesce(n_duplicate, 0) AS n_duplicate, coalesce(n_conditional, 0) AS n_conditional FROM un LEFT JOIN fe USING (id)")
def refactoring_features(spark, sf):
    return rounded(rules.entity_features(units(spark, sf), rules.recommendations(rated(spark, sf))))


@query(f"WITH {UNITS}, na AS (SELECT name, s AS line, min(id) AS other FROM un GROUP BY 1, 2), wa AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey + 1 AS id, o_orderpriority AS name, (o_orderdate::DATE - DATE '1992-01-01')::BIGINT AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT key, coalesce(un.id, other) AS found FROM wa LEFT JOIN un USING (id) LEFT JOIN na ON na.name = wa.name AND na.line = wa.line")
def locate_entity(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("name"), day("o_orderdate").alias("line"))
    w = table(spark, sf, "lineitem").join(o, "l_orderkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_orderkey") + 1).alias("id"), "name", "line")
    return rules.located(units(spark, sf), w)


@query("SELECT o_custkey AS id, count(*) AS members FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL GROUP BY 1")
def child_members(spark, sf):
    return rules.children(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("parent")), ["1-URGENT", "2-HIGH"])


# ---- health and gates -----------------------------------------------------------------------------------------------

def placed(spark, sf) -> DataFrame:
    """Measured entities with the folder (nation) of their file."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("dir"))
    return measured(spark, sf).join(c, "file")


PLACED = f"{MEASURED}, pl AS (SELECT me.*, c_nationkey AS dir FROM me JOIN customer ON c_custkey = file)"
MEANS = "avg(maintainability) AS mi, least(4 * (avg(cyclomatic) + avg(cognitive)) / 2, 100) AS cx, avg(debt) AS db"
HEALTH = "greatest(0, least(100, 0.28::DOUBLE * mi + 0.25::DOUBLE * 100 + 0.18::DOUBLE * (100 - cx) + 0.19::DOUBLE * (100 - db) + 0.10::DOUBLE * 100))"


@query(f"WITH {PLACED}, lv AS (SELECT dir, file, id, GROUPING(dir, file, id) AS gid, count(*) AS n, {MEANS} FROM pl GROUP BY GROUPING SETS ((dir), (dir, file), (dir, file, id))) SELECT dir, file, id, CASE gid WHEN 0 THEN 'entity' WHEN 1 THEN 'file' ELSE 'dir' END AS level, n, round({HEALTH}, 5) AS health FROM lv")
def health_levels(spark, sf):
    return health.levels(placed(spark, sf)).withColumn("health", F.round("health", 5))


PROJECT = f"{MEASURED}, pm AS (SELECT {MEANS} FROM me), st AS (SELECT greatest(100 - 5.0::DOUBLE * (SELECT count(*) FROM part WHERE p_size > 49), 0) AS structure), pj AS (SELECT cx AS complexity, db AS debt, mi AS maintainability, structure, 90.0::DOUBLE AS docs, greatest(0, least(100, 0.28::DOUBLE * mi + 0.25::DOUBLE * structure + 0.18::DOUBLE * (100 - cx) + 0.19::DOUBLE * (100 - db) + 0.10::DOUBLE * 90)) AS health FROM pm, st)"


def _project(spark, sf):
    bad = table(spark, sf, "part").filter("p_size > 49").count()
    return health.project(measured(spark, sf), F.lit(float(bad)), F.lit(90.0))


@query(f"WITH {PROJECT} SELECT round(complexity, 5) AS complexity, round(debt, 5) AS debt, round(maintainability, 5) AS maintainability, round(structure, 5) AS structure, docs, round(health, 5) AS health FROM pj")
def project_health(spark, sf):
    return rounded(_project(spark, sf), 5)


@query(f"WITH {PROJECT}, al AS (SELECT round(health, 5) AS health, round(complexity, 5) AS complexity, round(debt, 5) AS debt, round(maintainability, 5) AS maintainability, (SELECT sum(issues) FROM me)::DOUBLE AS issues, (SELECT count(*) FILTER (severity = 'Critical') FROM me)::DOUBLE AS critical FROM pj), lo AS (SELECT unnest(['health', 'complexity', 'debt', 'maintainability', 'issues', 'critical']) AS rule, unnest([health, complexity, debt, maintainability, issues, critical]) AS value, unnest(['<', '>', '>', '<', '>', '>']) AS op, unnest([60.0::DOUBLE, 70, 50, 20, 5, 0]) AS threshold FROM al) SELECT rule, value, threshold, CASE op WHEN '>' THEN value > threshold ELSE value < threshold END AS violated FROM lo")
def six_gates(spark, sf):
    m = measured(spark, sf).agg(F.sum("issues").cast("double").alias("issues"), F.count_if(F.col("severity") == "Critical").cast("double").alias("critical"))
    one = rounded(_project(spark, sf).select("health", "complexity", "debt", "maintainability"), 5).crossJoin(F.broadcast(m))  # one row
    return health.gates(one, spark.createDataFrame(health.GATES, "rule string, metric string, op string, threshold double"))


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice - 150000) / 150000 >= 1 THEN 'Critical' WHEN abs(o_totalprice - 150000) / 150000 >= 0.5 THEN 'High' ELSE 'Medium' END AS severity FROM orders WHERE o_totalprice > 150000")
def gate_severities(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 150000")
    return o.select("o_orderkey", health.gate_severity(F.col("o_totalprice"), F.lit(150000.0)).alias("severity"))


@query(f"WITH {FIXED}, w AS (SELECT file, max((CASE priority WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END, round(overall, 6))) AS t FROM fx GROUP BY 1) SELECT file, t[1]::INT AS rank, t[2] AS overall FROM w ORDER BY rank DESC, overall DESC, file LIMIT 5")
def worst_files(spark, sf):
    """The five worst files (a report)."""
    rank = F.when(F.col("priority") == "Critical", 4).when(F.col("priority") == "High", 3).when(F.col("priority") == "Medium", 2).when(F.col("priority") == "Low", 1).otherwise(0)
    s = complexity.scored(measured(spark, sf)).join(units(spark, sf).select("id", "file"), "id")
    return health.worst_files(s.select("file", rank.alias("rank"), F.round("overall", 6).alias("overall")))


@query(f"WITH {FIXED}, a AS (SELECT avg(abs(overall)) / 20 AS a FROM fx) SELECT round(greatest(0, 100 - 18 * a), 5) AS maintainability, round(least(100, 25 * a), 5) AS debt, round(least(100, 30 * a), 5) AS complexity, round(greatest(0, 100 - 12 * a), 5) AS structure FROM a")
def health_from_scores(spark, sf):
    s = complexity.scored(measured(spark, sf)).select((F.col("overall") / 20).alias("overall"))
    return rounded(health.from_scores(s), 5)


TREE_FILES = "tf AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/' || c_mktsegment || '/c' || c_custkey AS path, least(1, greatest(0, 0.5::DOUBLE + c_acctbal / 30000)) AS health FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def tree_files(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/"), "c_mktsegment", F.lit("/c"), "c_custkey")
    return c.select(path.alias("path"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("c_acctbal") / 30000)).alias("health"))


@query(f"WITH {TREE_FILES}, di AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, count(*) AS files, avg(health) AS h, count(*) FILTER (health < 0.8) AS needing FROM tf GROUP BY 1), al AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS dir FROM (SELECT string_split(path, '/') AS p FROM tf), LATERAL (SELECT unnest(generate_series(0, len(p) - 1)) AS n)) SELECT al.dir, CASE WHEN al.dir <> '' THEN regexp_replace(al.dir, '/?[^/]*$', '') END AS parent, coalesce(files, 0) AS files, round(CASE WHEN al.dir = '' THEN (SELECT avg(health) FROM tf) ELSE coalesce(h, 0) END, 6) AS health, coalesce(needing, 0) AS needing FROM al LEFT JOIN di USING (dir)")
def health_tree(spark, sf):
    return rounded(health.tree(tree_files(spark, sf)))


@query(f"WITH {FIXED} SELECT file AS path, round(greatest(0, least(1, (100 - avg(overall)) / 100)), 6) AS health FROM fx GROUP BY 1")
def health_of_candidates(spark, sf):
    s = complexity.scored(measured(spark, sf)).join(units(spark, sf).select("id", F.col("file").alias("path")), "id")
    return rounded(health.from_candidates(s))


@query(f"WITH {TREE_FILES}, nw AS (SELECT path, 1 - health AS new FROM tf WHERE path LIKE 'r1/%'), ou AS (SELECT tf.path, coalesce(new, health) AS health FROM tf LEFT JOIN nw USING (path)) SELECT path, round(health, 6) AS health, round((SELECT avg(health) FROM ou), 6) AS mean FROM ou")
def health_overlay(spark, sf):
    f = tree_files(spark, sf)
    return rounded(health.overlaid(f, f.filter("path like 'r1/%'").select("path", (1 - F.col("health")).alias("health"))))


@query(f"WITH {MEASURED}, i AS (SELECT severity FROM me WHERE issues > 0) SELECT (SELECT count(*) FROM me) AS entities, (SELECT sum(loc)::BIGINT FROM me) AS lines, (SELECT count(*) FROM documents) AS files, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents)) AS languages, (SELECT count(*) FROM i) AS issues, (SELECT count(*) FROM i WHERE severity = 'Critical') AS critical, (SELECT count(*) FROM i WHERE severity IN ('Critical', 'High')) AS high, round(1 - least((SELECT count(*) FROM i) / (SELECT count(*) FROM me), 1), 6) AS health")
def analysis_summary(spark, sf):
    m = measured(spark, sf)
    return rounded(health.summary(m, table(spark, sf, "documents").select(F.col("lang").alias("language")), m.filter("issues > 0").select("severity")))
