"""Named queries of call edges, coverage gaps, folders, similarity, cohesion states and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.operators import cohesion, dependency, gaps, graph, layout, lsh, summaries, textstats
from tallgrass.plans import catalog as C
from tallgrass.plans.catalog import query, rounded
from tallgrass.plans.catalog3 import FIXED, TREE_FILES, UNITS, measured, tree_files, units
from tallgrass.session import spread, table, written

# ---- calls ----------------------------------------------------------------------------------------------------------


def functions(spark, sf):
    """Parts as functions: named by size, in the namespace of type and brand."""
    return spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("uid"), F.concat(F.lit("f"), "p_size").alias("name"), F.array("p_type", "p_brand").alias("namespace"), F.concat_ws("/", "p_type", "p_brand").alias("file"), (F.col("p_partkey") % 400).alias("line"))


def calls(spark, sf):
    k = (F.col("p_partkey") * 7) % 50 + 1
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("self."), "p_brand", F.lit("::f"), k, F.lit("(x.y)"))).otherwise(F.concat(F.lit("f"), k, F.lit("(z)")))
    return spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("uid"), raw.alias("raw"))


CALLS = """fn AS (SELECT p_partkey AS uid, 'f' || p_size AS name, lower(p_type) AS t, lower(p_brand) AS b, p_type || '/' || p_brand AS file, p_partkey % 400 AS line FROM part),
ix AS (SELECT uid AS dst, name AS d_name, t AS d_t, b AS d_b, file AS d_file, line AS d_line, unnest([t || '::' || b || '::' || name, b || '::' || name, name]) AS key FROM fn),
cb AS (SELECT fn.uid, fn.t, fn.b, fn.file, fn.line, 'f' || ((fn.uid * 7) % 50 + 1) AS base, fn.uid % 2 = 0 AS q FROM fn),
cq AS (SELECT *, b || '::' || base AS key, 0 AS rank FROM cb WHERE q UNION ALL SELECT *, base, CASE WHEN q THEN 1 ELSE 0 END FROM cb),
cs AS (SELECT uid, dst, rank, d_file, d_line, CASE WHEN uid = dst THEN 120 ELSE 0 END + CASE WHEN q AND d_b = b AND d_name = base THEN 75 WHEN NOT q AND d_name = base THEN 75 WHEN d_name = base THEN 40 ELSE 0 END + CASE WHEN q AND d_b = b THEN 50 ELSE 0 END + CASE WHEN file = d_file THEN 20 ELSE 0 END + CASE WHEN t = d_t AND b = d_b THEN 15 WHEN b = d_b THEN 8 ELSE 0 END + 15 - floor(least(abs(line - d_line), 400) / 25) AS score FROM cq JOIN ix USING (key) WHERE uid <> dst OR base = d_name),
ce AS (SELECT DISTINCT uid AS src, dst FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rank, score DESC, d_file DESC, d_line DESC, dst DESC) AS k FROM cs) WHERE k = 1)"""


@query(f"WITH {CALLS} SELECT src, dst FROM ce")
def call_edges(spark, sf):
    return dependency.call_edges(functions(spark, sf), calls(spark, sf))


CALL_DEGREES = f"{CALLS}, cf AS (SELECT src AS node, count(*) AS o FROM ce GROUP BY 1), cg AS (SELECT dst AS node, count(*) AS i FROM ce GROUP BY 1), cd AS (SELECT uid AS node, file AS path, coalesce(o, 0) * coalesce(i, 0) AS choke, EXISTS (SELECT 1 FROM ce WHERE src = uid AND dst = uid) AS cyclic FROM fn LEFT JOIN cf ON cf.node = uid LEFT JOIN cg ON cg.node = uid)"


@query(f"WITH {CALL_DEGREES}, ef AS (SELECT a.file AS sp, b.file AS dp FROM ce JOIN fn a ON a.uid = src JOIN fn b ON b.uid = dst) SELECT path, count(*) AS functions, max(choke) AS max_choke, bool_or(cyclic) AS cyclic, (SELECT count(*) FROM ef WHERE dp = path) AS fan_in, (SELECT count(*) FROM ef WHERE sp = path) AS fan_out FROM cd GROUP BY path")
def module_rollup(spark, sf):
    """Files of the functions: their greatest choke point, loops, and edges in and out."""
    f = functions(spark, sf)
    e = written(dependency.call_edges(f, calls(spark, sf)), "calls")
    loops = e.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    n = f.select(F.col("uid").alias("node"), F.col("file").alias("path")).join(graph.degrees(e).select("node", "choke").hint("merge"), "node", "left").join(loops.hint("merge"), "node", "left")
    return dependency.modules(e, n.select("node", "path", F.coalesce("choke", F.lit(0).cast("long")).alias("choke"), F.coalesce("loop", F.lit(False)).alias("cyclic")))


@query(f"WITH {CALLS} SELECT a.p_type AS slice, count(*) FILTER (a.p_type <> b.p_type) AS crossing, count(*) AS edges FROM ce JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst GROUP BY 1")
def slice_crossings(spark, sf):
    e = dependency.call_edges(functions(spark, sf), calls(spark, sf))
    return dependency.crossing(e, table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("slice")))


@query("SELECT source || '/' || doc_id AS path, strlen(text) // 4 AS tokens FROM documents")
def file_tokens(spark, sf):
    return dependency.import_tokens(table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text"))


@query(f"WITH {TREE_FILES}, im AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/' || c_mktsegment || '/c' || c_custkey AS path, c_custkey, list_sort(list_distinct(coalesce((SELECT list(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), []))) AS imports FROM customer JOIN nation ON n_nationkey = c_nationkey), pr AS (SELECT a.c_custkey AS a, b.c_custkey AS b, string_split(a.path, '/') AS x, string_split(b.path, '/') AS y, a.imports AS i, b.imports AS j FROM im a JOIN im b ON b.c_custkey = a.c_custkey + 1), co AS (SELECT *, CASE WHEN x[1] <> y[1] THEN 0 WHEN x[2] <> y[2] THEN 1 WHEN x[3] <> y[3] THEN 2 WHEN x[4] <> y[4] THEN 3 ELSE 4 END AS common, len(list_distinct(list_concat(i, j))) AS u, len(list_intersect(i, j)) AS s FROM pr) SELECT a, b, round(2 * common / 4 + CASE WHEN u > 0 THEN s / u ELSE 0 END, 6) AS affinity FROM co")
def slice_affinity(spark, sf):
    """Affinity of neighbouring customers' files: common folders, and order priorities as imports."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/"), "c_mktsegment", F.lit("/c"), "c_custkey")
    im = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("imports"))  # five at most
    f = c.select("c_custkey", path.alias("path")).join(im, "c_custkey", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
    y = f.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_custkey").alias("b"), F.col("path").alias("path_b"), F.col("imports").alias("imports_b"))
    return rounded(dependency.affinity(f.select("c_custkey", F.col("c_custkey").alias("a"), F.col("path").alias("path_a"), F.col("imports").alias("imports_a")).join(y, "c_custkey")))


# ---- coverage gaps --------------------------------------------------------------------------------------------------

def doc_gaps(spark, sf):
    """Runs of three and more lines of a document that are uncovered: whose length does not divide by three."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "x"))
    from tallgrass.operators import coverage

    return coverage.spans(d.select("path", (F.col("i") + 1).cast("long").alias("line"), (F.length("x") % 3 == 0).alias("covered")))


GAPS = "dl AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents), dr AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM dl WHERE length(x) % 3 <> 0), dg AS (SELECT path, min(line) AS start, max(line) AS stop FROM dr GROUP BY path, run HAVING max(line) - min(line) + 1 >= 3)"


@query(f"WITH {GAPS}, bo AS (SELECT path, line FROM dl WHERE regexp_matches(x, '^[A-D]')), st AS (SELECT path, start, stop, start AS pos FROM dg UNION SELECT dg.path, start, stop, line FROM dg JOIN bo ON bo.path = dg.path AND line > start AND line <= stop), cu AS (SELECT path, pos AS start, coalesce(lead(pos) OVER (PARTITION BY path, start, stop ORDER BY pos) - 1, stop) AS stop FROM st) SELECT path, start, stop FROM cu WHERE stop - start + 1 >= 3")
def gap_cuts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return gaps.cut(doc_gaps(spark, sf), d.filter(F.col("x").rlike("^[A-D]")).select("path", (F.col("i") + 1).cast("long").alias("line")))


DESCRIBED = f"{GAPS}, de AS (SELECT dg.path, start, stop, bool_or(regexp_matches(x, '^The ')) AS exported, bool_or(regexp_matches(x, '\\|')) AS commented, count(*) FILTER (regexp_matches(x, 'token|@')) / count(*) AS failing, sum(length(x) - length(replace(x, ',', '')))::INT + 1 AS surface FROM dg JOIN dl ON dl.path = dg.path AND line BETWEEN start AND stop GROUP BY 1, 2, 3)"


def _described(spark, sf):
    return gaps.described(doc_gaps(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), "^The ", r"\|", "token|@")


@query(f"WITH {DESCRIBED} SELECT path, start, stop, exported, commented, round(failing, 6) AS failing, surface FROM de")
def gap_descriptions(spark, sf):
    return rounded(_described(spark, sf))


SCORED_GAPS = f"{DESCRIBED}, sg AS (SELECT path, stop - start + 1 AS loc, surface AS cyclomatic, surface * 2 AS cognitive, path % 9 AS fan_in, exported, commented, 0.5::DOUBLE AS central, start FROM de)"


def _scored_gaps(spark, sf):
    d = _described(spark, sf)
    return d.select("path", "start", (F.col("stop") - F.col("start") + 1).alias("loc"), F.col("surface").alias("cyclomatic"), (F.col("surface") * 2).alias("cognitive"), (F.col("path") % 9).alias("fan_in"), "exported", "commented", gaps.central(F.col("path").cast("string")).alias("central"))


@query(f"WITH {SCORED_GAPS} SELECT path, start, round(least(1, 0.4::DOUBLE * (1 - exp(-loc / 20)) + 0.2::DOUBLE * (1 - exp(-(cyclomatic + cognitive) / 10)) + 0.15::DOUBLE * (fan_in / (fan_in + 5)) + 0.1::DOUBLE * exported::INT + 0.1::DOUBLE * central + 0.05::DOUBLE * (NOT commented)::INT), 6) AS score FROM sg")
def gap_scores_full(spark, sf):
    return rounded(gaps.scores(_scored_gaps(spark, sf)).select("path", "start", "score"))


@query(f"WITH {SCORED_GAPS} SELECT path, sum(loc)::BIGINT AS gap_loc, round(avg(cyclomatic + cognitive), 6) AS mean_complexity, count(*) AS gaps FROM sg GROUP BY 1")
def gap_file_metrics(spark, sf):
    return rounded(gaps.by_file(_scored_gaps(spark, sf)))


@query(f"WITH {GAPS}, u AS (SELECT path, sum(stop - start + 1)::BIGINT AS uncovered, count(*) AS n, (SELECT count(*) FROM dl WHERE dl.path = dg.path) AS loc FROM dg GROUP BY 1), p AS (SELECT *, 1 - uncovered / loc AS before FROM u), q AS (SELECT *, least(1, before + uncovered / loc) AS after FROM p), r AS (SELECT *, greatest(after - before, 0) AS gain, greatest(n, uncovered // 5, 1) AS tests FROM q) SELECT path, uncovered, round(before, 6) AS before, round(after, 6) AS after, round(gain, 6) AS gain, round(gain * loc / 10000, 8) AS repo_gain, tests, round(gain * loc / 10000 / (tests + 1), 9) AS value FROM r")
def coverage_packs(spark, sf):
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.size(F.split("text", "\n")).alias("loc"))
    p = gaps.packs(doc_gaps(spark, sf).select("path", (F.col("stop") - F.col("start") + 1).alias("loc")), f)
    return p.select("path", "uncovered", *[F.round(c, 6).alias(c) for c in ("before", "after", "gain")], F.round("repo_gain", 8).alias("repo_gain"), "tests", F.round("value", 9).alias("value"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN greatest(n_chars // 2, 1) WHEN 'de' THEN n_chars % 7 ELSE 0 END AS gaps FROM documents")
def gap_estimates(spark, sf):
    form = F.when(F.col("lang") == "en", "xml").when(F.col("lang") == "de", "lcov").otherwise("json")
    return table(spark, sf, "documents").select("doc_id", gaps.estimated(F.col("n_chars"), F.col("n_chars") % 7, form).alias("gaps"))


@query(f"WITH {UNITS}, gp AS (SELECT file, s + 3 AS s2, s + 20 AS e2 FROM un) SELECT un.id, round(min(100 * (1 - (least(e, e2) - greatest(s, s2) + 1) / (e - s + 1))), 6) AS percent FROM un JOIN gp ON gp.file = un.file AND s <= e2 AND s2 <= e GROUP BY 1")
def entity_coverage(spark, sf):
    u = units(spark, sf).select("id", "file", "s", "e")
    return rounded(gaps.entity_coverage(u, u.select("file", (F.col("s") + 3).alias("s2"), (F.col("s") + 20).alias("e2"))))


@query(f"WITH {GAPS}, n AS (SELECT path, max(line) AS n FROM dl GROUP BY 1) SELECT dg.path, start, stop, md5(string_agg(line || ': ' || x, chr(10) ORDER BY line)) AS shown FROM dg JOIN n ON n.path = dg.path JOIN dl ON dl.path = dg.path AND line BETWEEN greatest(start - 2, 1) AND least(stop + 2, n) GROUP BY 1, 2, 3")
def gap_context(spark, sf):
    g = gaps.context(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), doc_gaps(spark, sf))
    return g.withColumn("shown", F.md5("shown"))


# ---- folders --------------------------------------------------------------------------------------------------------

LOC_FILES = f"{TREE_FILES}, lf AS (SELECT path, 1 + floor(abs(health) * 300)::BIGINT AS loc FROM tf), pa AS (SELECT path, loc, regexp_replace(path, '/?[^/]*$', '') AS dir FROM lf), an AS (SELECT path, array_to_string(p[1:n], '/') AS dir FROM (SELECT path, string_split(path, '/') AS p FROM lf), LATERAL (SELECT unnest(generate_series(0, len(p) - 1)) AS n)), ad AS (SELECT DISTINCT dir FROM an), ch AS (SELECT ad.dir, (SELECT count(*) FROM pa WHERE pa.dir = ad.dir) AS files, (SELECT count(*) FROM ad x WHERE x.dir <> '' AND regexp_replace(x.dir, '/?[^/]*$', '') = ad.dir) AS dirs, coalesce((SELECT sum(loc) FROM pa WHERE pa.dir = ad.dir), 0)::BIGINT AS loc FROM ad)"


def loc_files(spark, sf):
    return tree_files(spark, sf).select("path", (1 + F.floor(F.abs("health") * 300)).cast("long").alias("loc"))


@query(f"WITH {LOC_FILES} SELECT dir, files, dirs, loc FROM ch")
def folder_children(spark, sf):
    return layout.children(loc_files(spark, sf))


@query(f"WITH {LOC_FILES} SELECT dir FROM ad WHERE dir <> '' AND NOT regexp_matches(dir, 'MACHINERY')")
def folder_listing(spark, sf):
    return layout.folders(loc_files(spark, sf), "MACHINERY")


IMBALANCE = f"{LOC_FILES}, gi AS (SELECT dir, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(0, 2 * sum(i * loc) / (count(*) * sum(loc)) - (count(*) + 1) / count(*)) END AS gini FROM (SELECT dir, loc, row_number() OVER (PARTITION BY dir ORDER BY loc, path) AS i FROM pa) GROUP BY 1), en AS (SELECT dir, -sum(p * log2(p)) AS entropy FROM (SELECT dir, loc / sum(loc) OVER (PARTITION BY dir) AS p FROM pa) GROUP BY 1), im AS (SELECT ch.*, CASE WHEN files > 1 THEN greatest(gini, 1 - entropy / log2(files)) ELSE 0 END AS dispersion FROM ch JOIN gi USING (dir) JOIN en USING (dir) WHERE files > 0), ib AS (SELECT *, (0.25::DOUBLE * least(1, files / 25) + 0.15::DOUBLE * least(1, dirs / 10) + 0.2::DOUBLE * least(1, loc / 2000) + 0.1::DOUBLE * dispersion + 0.2::DOUBLE * (1 - exp(-((files - 7) / 2) * ((files - 7) / 2) / 2)) + 0.1::DOUBLE * (1 - exp(-((dirs - 3) / 1.5::DOUBLE) * ((dirs - 3) / 1.5::DOUBLE) / 2))) * (1 + 0.5::DOUBLE * tanh((ln(1 + files / 10) / ln(10) + ln(1 + loc / 1000) / ln(1000)) / 2)) AS imbalance FROM im)"


@query(f"WITH {IMBALANCE} SELECT dir, files, dirs, loc, round(dispersion, 6) AS dispersion, round(imbalance, 6) AS imbalance FROM ib")
def folder_imbalance(spark, sf):
    return rounded(layout.imbalance(loc_files(spark, sf)))


@query(f"WITH {IMBALANCE} SELECT dir, files, round(imbalance, 6) AS imbalance FROM ib WHERE imbalance >= 0.3 AND (files > 25 OR loc > 2000 OR dispersion >= 0.05) AND NOT (files <= 1 AND loc <= 50)")
def crowded_folders(spark, sf):
    return rounded(layout.crowded(layout.imbalance(loc_files(spark, sf)), least=0.3, spread=0.05, small=(1, 50)).select("dir", "files", "imbalance"))


@query(f"WITH {LOC_FILES}, i AS (SELECT path AS source, dir, regexp_extract(lead(path) OVER (PARTITION BY dir ORDER BY path), '[^/]+$') AS name FROM pa) SELECT source, pa.path AS target, count(*) AS weight FROM i JOIN pa ON pa.dir = i.dir AND pa.path = i.dir || '/' || name WHERE source <> pa.path GROUP BY 1, 2")
def local_imports(spark, sf):
    """Each file imports the next of its folder."""
    f = loc_files(spark, sf)
    after = F.lead("path").over(Window.partitionBy(layout.parent(F.col("path"))).orderBy("path"))
    i = f.select("path", after.alias("next")).filter("next is not null")
    return layout.local_imports(i.select("path", F.regexp_extract("next", "[^/]+$", 0).alias("name")), f)


@query(f"WITH {LOC_FILES} SELECT dir, count(*) + (SELECT count(*) FROM ad x WHERE x.dir <> '' AND x.dir <> an.dir AND (an.dir = '' OR starts_with(x.dir, an.dir || '/'))) AS complexity FROM an GROUP BY dir")
def folder_complexity(spark, sf):
    return layout.totals(loc_files(spark, sf))


WORDS = f"{C.DOC_TOKENS}, ws AS (SELECT source AS file, doc_id AS id, coalesce(list(DISTINCT token) FILTER (token IS NOT NULL), []) AS words FROM documents LEFT JOIN bt ON doc_id = id GROUP BY 1, 2), we AS (SELECT file, id, unnest(words) AS word, len(words) AS n FROM ws), wp AS (SELECT a.file, a.id, b.id AS other, count(*) AS shared, count(*) / (max(a.n) + max(b.n) - count(*)) AS similarity FROM we a JOIN we b ON b.file = a.file AND b.word = a.word AND a.id < b.id GROUP BY 1, 2, 3 UNION ALL SELECT a.file, a.id, b.id, 0, 1 FROM ws a JOIN ws b ON b.file = a.file AND a.id < b.id WHERE len(a.words) = 0 AND len(b.words) = 0)"


def words(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    t = C.doc_tokens(spark, sf).groupBy("id").agg(F.collect_set("token").alias("words"))
    return d.join(t, "id", "left").select("file", "id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


@query(f"WITH {WORDS} SELECT file, id, other, shared, round(similarity, 6) AS similarity FROM wp WHERE similarity > 0.1")
def identifier_pairs(spark, sf):
    return rounded(layout.identifier_pairs(words(spark, sf)))


@query(f"WITH {WORDS} SELECT file, round(CASE WHEN count(*) > 1 THEN (SELECT count(*) FROM wp WHERE wp.file = ws.file AND similarity >= 0.75 AND shared >= 3) / (count(*) * (count(*) - 1) / 2) ELSE 0 END, 6) AS factor FROM ws GROUP BY file")
def clone_factors(spark, sf):
    return rounded(layout.clone_factor(words(spark, sf)))


@query("SELECT p_partkey, round(0.6::DOUBLE * least(p_retailprice / 800, 1) + 0.3::DOUBLE * CASE WHEN p_size > 0 THEN (p_size % 5) / p_size ELSE 0 END + 0.1::DOUBLE * (p_partkey % 3) / 3, 6) AS value FROM part")
def split_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(layout.split_value(F.col("p_retailprice"), F.col("p_size") % 5, F.col("p_size"), (F.col("p_partkey") % 3) / 3), 6).alias("value"))


# ---- similarity and cohesion ----------------------------------------------------------------------------------------

@query("SELECT vec_id, round(CASE WHEN len(embedding) > 0 THEN len(list_filter(embedding, lambda x: abs(x) < 1e-6)) / len(embedding) ELSE 0 END, 6) AS similarity FROM embeddings")
def weighted_similarity(spark, sf):
    """Each vector compared slot by slot with zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(lsh.weighted_similarity(v, F.transform(v, lambda x: F.lit(0.0))), 6).alias("similarity"))


@query(f"WITH {C._PAIRS} SELECT o_orderkey AS key, max(similarity) AS similarity FROM orders LEFT JOIN pairs ON a = o_orderkey AND b = o_custkey GROUP BY 1")
def pair_lookup(spark, sf):
    """The similarity of a given pair of ids, null where they are no pair."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return asked.join(C._pairs(spark, sf), ["a", "b"], "left").groupBy("key").agg(F.max("similarity").alias("similarity"))


STATES = f"{C.UNITS}, w AS (SELECT grp, max(n) AS n, list(x ORDER BY i) AS s FROM ss GROUP BY 1), k AS (SELECT grp % 3 AS key, i, sum(ln(1 + n) * x) AS x FROM ss GROUP BY 1, 2), t AS (SELECT grp % 3 AS key, sum(ln(1 + n)) AS weight, sum(n)::BIGINT AS n FROM w GROUP BY 1)"


@query(f"WITH {STATES} SELECT key, max(t.n) AS n, round(max(weight), 6) AS weight, round(CASE WHEN max(weight) < 2 THEN 1 ELSE least(1, sqrt(sum(x * x)) / max(weight)) END, 6) AS cohesion FROM k JOIN t USING (key) GROUP BY 1")
def merged_cohesion(spark, sf):
    """Groups' states added with the logarithm of their sizes as weights."""
    s = cohesion.sums(C.vectors(spark, sf)).withColumn("key", F.col("grp") % 3)
    return rounded(cohesion.merged_cohesion(cohesion.weighted_sums(s, F.log1p("n"))))


@query(f"WITH {C.UNITS} SELECT id, round(greatest(0, similarity), 6) AS alignment FROM si")
def centroid_alignment(spark, sf):
    v = C.vectors(spark, sf)
    c = cohesion.centroids(v).select("grp", "centroid")
    return rounded(v.join(c, "grp").select("id", F.round(cohesion.alignment(F.col("v"), F.col("centroid")), 9).alias("alignment")))


COHESIVE = f"{C.UNITS}, ff AS (SELECT grp, n, least(1, sqrt(list_dot_product(s, s)) / n) AS cohesion, (grp % 5) / 6 AS doc FROM ce)"


def _files(spark, sf):
    return cohesion.cohesion(C.vectors(spark, sf)).withColumn("doc", F.col("grp") % 5 / 6)


@query(f"WITH {COHESIVE} SELECT grp, id::VARCHAR AS what, 'COH004' AS code FROM si WHERE similarity < 0.2 UNION ALL SELECT grp, '', 'COH006' FROM ff WHERE cohesion < 0.3 AND n >= 5 UNION ALL SELECT grp, '', 'COH001' FROM ff WHERE doc < 0.4")
def cohesion_issues(spark, sf):
    s = cohesion.similarities(C.vectors(spark, sf)).withColumn("similarity", F.round("similarity", 9))
    return cohesion.issues(_files(spark, sf), s)


@query(f"WITH {COHESIVE} SELECT round(avg(cohesion), 6) AS cohesion, round(avg(doc), 6) AS doc FROM ff")
def cohesion_overview(spark, sf):
    return rounded(cohesion.overview(_files(spark, sf)))


# ---- reports --------------------------------------------------------------------------------------------------------

@query("WITH f AS (SELECT source AS path, sum(n_chars)::DOUBLE / 1000 AS a, count(*)::DOUBLE AS b, count(DISTINCT lang)::DOUBLE AS c, (count(*) % 10)::DOUBLE AS d FROM documents GROUP BY 1), l AS (SELECT path, unnest(['lines_of_code', 'functions_per_file', 'classes_per_file', 'files_per_directory']) AS feature, unnest([a, b, c, d]) AS value FROM f) SELECT path, feature, value, round(1 / (1 + exp(-(value - CASE feature WHEN 'lines_of_code' THEN 300 WHEN 'functions_per_file' THEN 12 WHEN 'classes_per_file' THEN 2 ELSE 7 END) / CASE feature WHEN 'lines_of_code' THEN 75 WHEN 'functions_per_file' THEN 4 WHEN 'classes_per_file' THEN 1 ELSE 2 END)), 6) AS norm FROM l")
def file_features(spark, sf):
    f = table(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg((F.sum("n_chars") / 1000).alias("lines_of_code"), F.count("*").alias("functions_per_file"), F.countDistinct("lang").alias("classes_per_file"), (F.count("*") % 10).alias("files_per_directory"))
    return summaries.file_features(f).withColumn("norm", F.round("norm", 6))


@query(f"WITH {C.STATS}, {C.CONFIDENCE}, kw AS (SELECT feature, CASE confidence WHEN 'High' THEN 0.9::DOUBLE WHEN 'Medium' THEN 0.7::DOUBLE WHEN 'Low' THEN 0.5::DOUBLE WHEN 'VeryLow' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS weight FROM k) SELECT entity_id AS id, round(least(count(*) / 10, 1) * avg(weight), 6) AS confidence FROM f JOIN kw USING (feature) GROUP BY 1")
def score_confidence(spark, sf):
    from tallgrass.operators import stats

    f = C.features(spark, sf)
    known = stats.confidence(stats.moments(f)).select("feature", F.col("confidence_weight").alias("weight"))
    return rounded(summaries.confidence(f.withColumnRenamed("entity_id", "id"), known))


@query(f"WITH {FIXED} SELECT count(*) FILTER (priority <> 'None') AS refactor, count(*) AS entities, round(avg(overall) / 100, 6) AS mean, round(greatest(0, least(1, 1 - count(*) FILTER (priority <> 'None') / count(*) - least(abs(avg(overall) / 100 / 2), 0.3))), 6) AS health FROM fx")
def code_health(spark, sf):
    from tallgrass.operators import complexity

    s = complexity.scored(measured(spark, sf))
    return rounded(summaries.code_health(s.agg(F.count_if(F.col("priority") != "None").alias("refactor"), F.count("*").alias("entities"), (F.avg("overall") / 100).alias("mean"))))


@query(f"WITH {FIXED} SELECT priority AS category, count(*) AS n FROM fx GROUP BY 1 ORDER BY n DESC, category LIMIT 3")
def top_categories(spark, sf):
    """The three most frequent priorities (a report)."""
    from tallgrass.operators import complexity

    return summaries.top_categories(complexity.scored(measured(spark, sf)).select(F.col("priority").alias("category")), 3)


DICTIONARY = [(1, "exact", "ECONOMY", "ECO"), (2, "starts", "SM", "SMALL"), (3, "contains", "E", "HASE"), (4, "contains", "A", "HASA")]


@query("WITH d(rank, how, part, code) AS (VALUES (1, 'exact', 'ECONOMY', 'ECO'), (2, 'starts', 'SM', 'SMALL'), (3, 'contains', 'E', 'HASE'), (4, 'contains', 'A', 'HASA')) SELECT kind, arg_min(code, rank) AS code FROM (SELECT DISTINCT p_type AS kind FROM part) JOIN d ON CASE how WHEN 'exact' THEN kind = part WHEN 'starts' THEN starts_with(kind, part) ELSE contains(kind, part) END GROUP BY 1")
def dictionary_codes(spark, sf):
    d = spark.createDataFrame(DICTIONARY, "rank int, how string, part string, code string")
    return summaries.codes(table(spark, sf, "part").select(F.col("p_type").alias("kind")).distinct(), d)


@query("WITH r(rank, part, code) AS (VALUES (1, 'ring', 'CUT'), (2, 'red', 'PAINT'), (3, 'r', 'LAST')) SELECT id, code, feature FROM (SELECT p_brand AS id, code, p_name AS feature, row_number() OVER (PARTITION BY p_brand, code ORDER BY rank, p_name) AS k FROM part JOIN r ON contains(p_name, r.part)) WHERE k = 1")
def feature_suggestions(spark, sf):
    r = spark.createDataFrame([(1, "ring", "CUT"), (2, "red", "PAINT"), (3, "r", "LAST")], "rank int, part string, code string")
    return summaries.suggestions(table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("feature")), r)


@query("WITH t AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1.5 END * CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1 ELSE 0.75 END * CASE WHEN p_size > 25 THEN 1.5 ELSE 1 END AS score FROM part), o AS (SELECT row_number() OVER (ORDER BY score DESC, id)::INT AS number, id, score::DOUBLE AS score FROM t) SELECT * FROM o WHERE number <= 20")
def task_order(spark, sf):
    """The twenty tasks of greatest score (a report)."""
    impact = F.when(F.col("p_size") % 4 == 0, "I3").when(F.col("p_size") % 4 == 1, "medium").when(F.col("p_size") % 4 == 2, "I1")
    effort = F.when(F.col("p_partkey") % 3 == 0, "E3").when(F.col("p_partkey") % 3 == 1, "low")
    return summaries.tasks(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), impact.alias("impact"), effort.alias("effort"), (F.col("p_size") > 25).alias("required")), 20)


@query("SELECT p_partkey, round((1 + CASE WHEN contains(p_name, 'red') THEN 3 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 2 ELSE 0 END + CASE WHEN contains(p_name, 'b') THEN 1.5 ELSE 0 END + CASE p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END) * CASE WHEN p_size * 1100 > 50000 THEN 0.5 WHEN p_size * 1100 > 20000 THEN 0.7 ELSE 1 END * CASE WHEN p_size * 1100 < 1000 THEN 1.2 ELSE 1 END * CASE WHEN contains(p_name, 'small') THEN 0.3 ELSE 1 END * CASE WHEN contains(p_name, 'bolt') THEN 0.1 ELSE 1 END, 6)::DOUBLE AS priority FROM part")
def file_priorities(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(summaries.file_priority(F.col("p_name"), F.col("p_type"), F.col("p_size") * 1100, ["red"], ["ring"], ["b"], {"ECONOMY": 1.0}, ["small"], ["bolt"]), 6).alias("priority"))


@query("SELECT user_id AS key, coalesce(arg_max(value, event_id) FILTER (event_type = 'click'), arg_max(value, event_id)) AS value FROM events GROUP BY 1")
def merged_settings(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("run"), (F.col("event_type") == "click").alias("enabled"))
    return summaries.settings(e)


@query("SELECT l_suppkey, sum(l_linenumber)::BIGINT AS pairs, round(sum(l_discount / 3 * l_linenumber) / sum(l_linenumber), 6) AS mean, max(l_tax) AS most FROM lineitem GROUP BY 1")
def merged_clones(spark, sf):
    p = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("long").alias("pairs"), (F.col("l_discount") / 3).alias("mean"), F.col("l_tax").alias("most"))
    return summaries.merged_clones(p, "l_suppkey").withColumn("mean", F.round("mean", 6))


@query("SELECT id, string_split(id, ':')[1] AS path, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS name FROM (SELECT *, p_brand || ':' || p_type || ':' || CASE WHEN p_size % 2 = 0 THEN p_name || ':' ELSE '' END || p_size AS id FROM part)")
def id_names(spark, sf):
    i = F.concat(F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit(":"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(":"))).otherwise(""), F.col("p_size"))
    return table(spark, sf, "part").select(i.alias("id")).select("id", *[v.alias(k) for k, v in summaries.id_parts(F.col("id")).items()])


@query(f"WITH {TREE_FILES} SELECT path FROM tf WHERE NOT regexp_matches(path, 'n1[0-9]/') AND regexp_matches(path, '^r[0-2]/')")
def included_paths(spark, sf):
    f = tree_files(spark, sf)
    return f.filter(summaries.included(F.col("path"), "^r[0-2]/", "n1[0-9]/")).select("path")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_type || ':' || p_name END AS key FROM part")
def node_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", summaries.node_key(F.col("p_type"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(" ")).alias("key"))


@query("SELECT doc_id, md5(array_to_string(list_concat(l[1:2], l[6:]), chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def lines_outside(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(summaries.outside(F.split("text", "\n"), F.lit(3), F.lit(5)), "\n")).alias("digest"))


ELIGIBLE = "fi AS (SELECT source AS dir, n_chars % 4 AS gaps, n_chars // 20 AS lines FROM documents), el AS (SELECT dir, count(*) AS eligible, sum(gaps) AS gaps FROM fi WHERE gaps > 0 AND lines >= 50 GROUP BY 1), ds AS (SELECT dir, coalesce(eligible, 0) AS eligible, CASE WHEN coalesce(eligible, 0) < 5 THEN 100 ELSE greatest(0, least(100, 100 * (1 - el.gaps / eligible))) END AS score FROM (SELECT DISTINCT dir FROM fi) LEFT JOIN el USING (dir))"


def _eligible(spark, sf):
    return summaries.eligible_documentation(table(spark, sf, "documents").select(F.col("source").alias("dir"), (F.col("n_chars") % 4).alias("gaps"), F.floor(F.col("n_chars") / 20).alias("lines")))


@query(f"WITH {ELIGIBLE} SELECT dir, eligible, round(score, 6) AS score FROM ds")
def folder_documentation(spark, sf):
    return rounded(_eligible(spark, sf))


@query(f"WITH {ELIGIBLE} SELECT round(avg(score), 6) AS score FROM ds")
def documentation_health(spark, sf):
    return rounded(summaries.documentation(_eligible(spark, sf), 50.0))


@query(f"WITH {C.TOKENS}, w AS (SELECT DISTINCT id, unnest(t) AS word FROM e), d AS (SELECT word, count(*) AS df FROM w GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS symbols, round(avg(df), 6) AS mean_df FROM d")
def corpus_statistics(spark, sf):
    e = C.entities(spark, sf)
    d = textstats.document_frequency(e, 1)
    return rounded(d.agg(F.count("*").alias("symbols"), F.avg("df").alias("mean_df")).select(F.lit(e.count()).alias("documents"), "symbols", "mean_df"))


@query("SELECT page_id, unnest(['loops', 'branches', 'calls', 'assigns']) AS motif, unnest([len(string_split(html, 'for')) - 1, len(string_split(html, 'if')) - 1, len(string_split(html, '(')) - 1, len(string_split(html, '=')) - 1])::INT AS n FROM pages")
def text_motifs(spark, sf):
    """How often each of a few patterns is contained in a page."""
    parts = {"loops": "for", "branches": "if", "calls": "\\(", "assigns": "="}
    wide = table(spark, sf, "pages").select("page_id", *[(F.size(F.split("html", p, -1)) - 1).alias(k) for k, p in parts.items()])
    return wide.unpivot("page_id", list(parts), "motif", "n")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS k FROM documents) WHERE n <= 1500 AND k >= 40")
def eligible_entities(spark, sf):
    """Entities of at least 40 tokens, in files of at most 1,500 entities."""
    from tallgrass.functions import text as T

    d = table(spark, sf, "documents")
    n = d.groupBy("source").agg(F.count("*").alias("n")).filter("n <= 1500").select("source")
    return d.filter(F.size(T.tokens(F.col("text"))) >= 40).join(n, "source").select("doc_id", "source")


@query("WITH r AS (SELECT event_type, user_id, count(*) AS support FROM events GROUP BY 1, 2), p AS (SELECT *, cume_dist() OVER (PARTITION BY event_type ORDER BY support) AS pct, (SELECT count(*) FROM events) AS n FROM r) SELECT event_type, user_id, support, round(pct, 6) AS pct FROM p WHERE pct >= 0.9 AND support >= 3 AND ln(n / support) >= 0.1")
def frequent_patterns(spark, sf):
    """Patterns of each type at or above the 90th percentile of support, with three and more occurrences."""
    e = table(spark, sf, "events")
    n = e.count()
    r = e.groupBy("event_type", "user_id").agg(F.count("*").alias("support"))
    by = r.groupBy("event_type", "support").agg(F.count("*").alias("c"))  # a row for each support
    w = Window.partitionBy("event_type")
    upto = by.select("event_type", "support", (F.sum("c").over(w.orderBy("support")) / F.sum("c").over(w)).alias("pct"))
    return rounded(r.join(upto, ["event_type", "support"]).filter((F.col("pct") >= 0.9) & (F.col("support") >= 3) & (F.ln(F.lit(n) / F.col("support")) >= 0.1)).select("event_type", "user_id", "support", "pct"))
