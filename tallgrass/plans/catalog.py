"""The named queries of the analysis operators, each with SQL that another engine can run on the same tables.

Relations: documents stand for entities (source is their group), orders and their lines for features, customers and
suppliers for a dependency graph, embeddings for vectors, order lines for coverage lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import scores as S
from tallgrass.functions import text as T
from tallgrass.operators import cohesion, coverage, graph, lsh, scoring, stats, structure, textstats
from tallgrass.session import by_key, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- features, normalisation, scores ------------------------------------------------------------------------------

def features(spark: SparkSession, sf: str) -> DataFrame:
    """(entity_id, feature, value): four features of each order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    o = by_key(li, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"), F.max("l_extendedprice").alias("p"), F.min("l_discount").alias("d"))
    # exploded, as unpivot would forget that an order's rows are together
    four = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).alias("value")) for k, c in (("cyclomatic", "q"), ("fan_in", "n"), ("lines_of_code", "p"), ("style_issues", "d"))])
    return o.select(F.col("l_orderkey").alias("entity_id"), F.explode(four).alias("f")).select("entity_id", "f.feature", "f.value")


FEATURES = """f AS (SELECT l_orderkey AS entity_id, unnest(['cyclomatic', 'fan_in', 'lines_of_code', 'style_issues']) AS feature, unnest([sum(l_quantity), count(*)::DOUBLE, max(l_extendedprice), min(l_discount)]) AS value FROM lineitem GROUP BY l_orderkey)"""
STATS = f"""{FEATURES}, s AS (SELECT feature, count(*) AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS variance, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, median(value) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, mad(value) AS mad FROM f GROUP BY feature)"""
NORMS = f"""{STATS}, z AS (SELECT entity_id, feature, greatest(-10, least(10, CASE WHEN variance < 1e-12 THEN 0 ELSE (value - mean) / nullif(std, 0) END)) AS norm FROM f JOIN s USING (feature))"""
CONTRIBUTIONS = f"""{NORMS}, c AS (SELECT *, CASE feature WHEN 'cyclomatic' THEN 'complexity' WHEN 'fan_in' THEN 'graph' WHEN 'lines_of_code' THEN 'structure' ELSE 'style' END AS category, CASE feature WHEN 'cyclomatic' THEN 1.0::DOUBLE WHEN 'fan_in' THEN 0.8::DOUBLE WHEN 'lines_of_code' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM z), d AS (SELECT *, norm * weight AS contribution FROM c)"""
SCORES = f"""{CONTRIBUTIONS}, o AS (SELECT entity_id, sum(contribution) / sum(weight) AS overall, count(*) AS n_features FROM d GROUP BY 1), p AS (SELECT *, CASE WHEN abs(overall) >= 2 THEN 'Critical' WHEN abs(overall) >= 1.5 THEN 'High' WHEN abs(overall) >= 1 THEN 'Medium' WHEN abs(overall) >= 0.5 THEN 'Low' ELSE 'None' END AS priority FROM o)"""


@query(f"WITH {STATS} SELECT feature, n, round(mean, 6) AS mean, round(variance, 4) AS variance, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(mad, 6) AS mad FROM s")
def feature_stats(spark, sf):
    return rounded(stats.fit(features(spark, sf)).withColumn("variance", F.round("variance", 4)))


def normalized(spark, sf, scheme):
    f = features(spark, sf)
    return stats.normalize(f, stats.fit(f) if scheme == "robust" else stats.moments(f), scheme)


@query(f"WITH {NORMS} SELECT entity_id, feature, round(norm, 6) AS norm FROM z")
def zscore_norm(spark, sf):
    return rounded(normalized(spark, sf, "zscore").select("entity_id", "feature", "norm"))


@query(f"WITH {STATS} SELECT entity_id, feature, round(CASE WHEN max - min < 1e-12 THEN 0.5 ELSE (value - min) / (max - min) END, 6) AS norm FROM f JOIN s USING (feature)")
def minmax_norm(spark, sf):
    return rounded(normalized(spark, sf, "minmax").select("entity_id", "feature", "norm"))


@query(f"WITH {STATS} SELECT entity_id, feature, round(greatest(-10, least(10, CASE WHEN mad > 1e-12 THEN (value - median) / (1.4826 * mad) WHEN q3 - q1 > 1e-12 THEN (value - median) / (q3 - q1) ELSE 0 END)), 6) AS norm FROM f JOIN s USING (feature)")
def robust_norm(spark, sf):
    return rounded(normalized(spark, sf, "robust").select("entity_id", "feature", "norm"))


CONFIDENCE = """k AS (SELECT *, CASE WHEN n < 2 OR variance < 1e-12 THEN 'Insufficient' WHEN n >= 50 AND variance > 0.1 THEN 'High' WHEN n >= 10 AND variance > 0.05 THEN 'Medium' WHEN n >= 5 AND variance > 0.01 THEN 'Low' ELSE 'VeryLow' END AS confidence FROM s)"""


@query(f"WITH {STATS}, {CONFIDENCE} SELECT feature, n, confidence, CASE confidence WHEN 'High' THEN 0.9::DOUBLE WHEN 'Medium' THEN 0.7::DOUBLE WHEN 'Low' THEN 0.5::DOUBLE WHEN 'VeryLow' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS confidence_weight FROM k")
def bayes_confidence(spark, sf):
    return stats.confidence(stats.moments(features(spark, sf))).select("feature", "n", "confidence", "confidence_weight")


def _posterior(spark, sf):
    groups = {"cyclomatic": "complexity", "fan_in": "centrality"}
    priors = spark.createDataFrame([(f, *stats.PRIOR_GROUPS[g]) for f, g in groups.items()], "feature string, alpha double, beta double")
    return stats.posterior(stats.confidence(stats.moments(features(spark, sf))), priors)


POSTERIOR = f"""{STATS}, {CONFIDENCE}, a AS (SELECT *, CASE feature WHEN 'cyclomatic' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE feature WHEN 'cyclomatic' THEN 5.0::DOUBLE WHEN 'fan_in' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM k), b AS (SELECT *, a / (a + b) AS prior_mean, a * b / ((a + b) * (a + b) * (a + b + 1)) AS prior_variance FROM a), g AS (SELECT *, 1 / (1 / prior_variance + n / greatest(variance, 1e-12)) AS posterior_variance FROM b), h AS (SELECT *, posterior_variance * (prior_mean / prior_variance + n * mean / greatest(variance, 1e-12)) AS posterior_mean, greatest(0.05, least(0.95, CASE confidence WHEN 'High' THEN 0.1 WHEN 'Medium' THEN 0.3 WHEN 'Low' THEN 0.5 WHEN 'VeryLow' THEN 0.7 ELSE 0.9 END / (1 + ln(n)))) AS prior_weight FROM g)"""


@query(f"WITH {POSTERIOR} SELECT feature, round(prior_mean, 6) AS prior_mean, round(prior_variance, 6) AS prior_variance, round(posterior_mean, 5) AS posterior_mean, round(posterior_variance, 6) AS posterior_variance, round(prior_weight, 6) AS prior_weight FROM h")
def bayes_posterior(spark, sf):
    return rounded(_posterior(spark, sf).select("feature", "prior_mean", "prior_variance", F.round("posterior_mean", 5).alias("posterior_mean"), "posterior_variance", "prior_weight"))


@query(f"WITH {POSTERIOR} SELECT entity_id, feature, round(greatest(-10, least(10, (value - posterior_mean) / sqrt(posterior_variance))), 4) AS norm FROM f JOIN h USING (feature)")
def bayes_norm(spark, sf):
    p = _posterior(spark, sf).select("feature", "posterior_mean", "posterior_variance")
    z = (F.col("value") - F.col("posterior_mean")) / F.sqrt("posterior_variance")
    return features(spark, sf).join(p, "feature").select("entity_id", "feature", F.round(S.clamp(S.finite(z), -10.0, 10.0), 4).alias("norm"))


@query(f"WITH {POSTERIOR} SELECT confidence, count(*) AS n, round(avg(prior_weight), 6) AS mean_prior_weight FROM h GROUP BY 1")
def norm_diagnostics(spark, sf):
    return rounded(_posterior(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"), F.avg("prior_weight").alias("mean_prior_weight")))


@query(f"WITH {FEATURES} SELECT entity_id, feature, round(greatest(low, least(high, value)), 6) AS clamped FROM f JOIN (VALUES ('cyclomatic', 1.0::DOUBLE, 100.0::DOUBLE), ('fan_in', 0.0::DOUBLE, 5.0::DOUBLE), ('lines_of_code', 0.0::DOUBLE, 50000.0::DOUBLE), ('style_issues', 0.01::DOUBLE, 1.0::DOUBLE)) t(feature, low, high) USING (feature)")
def feature_clamp(spark, sf):
    defs = spark.createDataFrame([("cyclomatic", 1.0, 100.0, 1.0), ("fan_in", 0.0, 5.0, 0.0), ("lines_of_code", 0.0, 50000.0, 0.0), ("style_issues", 0.01, 1.0, 0.01)], "feature string, low double, high double, default double")
    return rounded(stats.clamped(features(spark, sf), defs).select("entity_id", "feature", "clamped"))


@query(f"WITH {FEATURES} SELECT entity_id, round(sqrt(sum(value * value)), 4) AS norm FROM f GROUP BY 1")
def feature_l2_norm(spark, sf):
    return stats.norms(features(spark, sf)).select("entity_id", F.round("norm", 4).alias("norm"))


@query(f"WITH {NORMS}, q AS (SELECT * FROM z WHERE entity_id % 100 = 1), n AS (SELECT entity_id, sqrt(sum(norm * norm)) AS l FROM z GROUP BY 1) SELECT a.entity_id AS a, o.o_custkey AS custkey, round(sum(a.norm * b.norm) / nullif(max(na.l) * max(nb.l), 0), 6) AS cosine FROM z a JOIN orders o ON o.o_orderkey = a.entity_id JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) r ON r.o_custkey = o.o_custkey JOIN z b ON b.entity_id = r.k AND b.feature = a.feature JOIN n na ON na.entity_id = a.entity_id JOIN n nb ON nb.entity_id = b.entity_id GROUP BY 1, 2")
def feature_cosine(spark, sf):
    """Cosine of each order's features with those of its customer's first order."""
    z = normalized(spark, sf, "zscore").select("entity_id", "feature", "norm")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("custkey"))
    first = o.groupBy("custkey").agg(F.min("entity_id").alias("first"))
    a = z.join(o, "entity_id").join(first, "custkey")
    b = z.select(F.col("entity_id").alias("first"), "feature", F.col("norm").alias("other"))
    square = z.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("l"))
    dots = a.join(b, ["first", "feature"]).groupBy("entity_id", "custkey", "first").agg(F.sum(F.col("norm") * F.col("other")).alias("d"))
    x = dots.join(square, "entity_id").join(square.select(F.col("entity_id").alias("first"), F.col("l").alias("l2")), "first")
    return x.select(F.col("entity_id").alias("a"), "custkey", F.round(F.col("d") / F.nullif(F.col("l") * F.col("l2"), F.lit(0.0)), 6).alias("cosine"))


@query("SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 150000) / 40000)), 6) AS pressure FROM orders")
def logistic_norm(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(S.logistic(F.col("o_totalprice"), 150000.0, 40000.0), 6).alias("pressure"))


def scored(spark, sf):
    return scoring.scores(normalized(spark, sf, "zscore"))


@query(f"WITH {SCORES} SELECT entity_id, round(overall, 6) AS overall, n_features, priority FROM p")
def feature_score_priority(spark, sf):
    return rounded(scored(spark, sf))


@query(f"WITH {CONTRIBUTIONS} SELECT entity_id, category, round(sum(contribution) / max(weight), 6) AS score FROM d GROUP BY 1, 2")
def category_scores(spark, sf):
    return rounded(scoring.category_scores(normalized(spark, sf, "zscore")))


@query(f"WITH {CONTRIBUTIONS}, r AS (SELECT entity_id, feature, contribution, row_number() OVER (PARTITION BY entity_id ORDER BY contribution DESC, feature) AS rank FROM d) SELECT entity_id, feature, round(contribution, 6) AS contribution, rank FROM r WHERE rank <= 2")
def top_contributors(spark, sf):
    return rounded(scoring.top_contributors(normalized(spark, sf, "zscore"), 2))


@query(f"WITH {CONTRIBUTIONS}, r AS (SELECT entity_id, category, sum(contribution) / max(weight) AS score FROM d GROUP BY 1, 2) SELECT entity_id, arg_max(category, score) AS category, round(max(score), 6) AS score FROM r GROUP BY 1")
def dominant_category(spark, sf):
    return rounded(scoring.dominant_category(normalized(spark, sf, "zscore")))


@query(f"WITH {SCORES} SELECT priority, count(*) AS n FROM p GROUP BY 1")
def priority_histogram(spark, sf):
    return scoring.priority_histogram(scored(spark, sf))


@query(f"WITH {SCORES} SELECT o_custkey, count(*) AS candidates, round(avg(overall), 6) AS mean_score, round(max(abs(overall)), 6) AS max_score FROM p JOIN orders ON o_orderkey = entity_id WHERE priority <> 'None' GROUP BY 1")
def file_groups(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"), "o_custkey")
    return rounded(scoring.by_group(scored(spark, sf).join(o, "entity_id"), "o_custkey"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 'Critical' WHEN l_quantity >= 15 THEN 'High' WHEN l_quantity >= 10 THEN 'Moderate' ELSE 'Low' END AS severity FROM lineitem")
def severity_ladder(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.ladder(F.col("l_quantity"), S.COMPLEXITY, "Low").alias("severity"))


# ---- texts ----------------------------------------------------------------------------------------------------------

def entities(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("grp")))


NORMALIZED = r"regexp_replace(lower(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#')), ' ')), '\s+', ' ', 'g')"
TOKENS = f"e AS (SELECT doc_id AS id, source AS grp, list_filter(regexp_split_to_array({NORMALIZED}, '\\s+'), lambda t: t <> '') AS t FROM documents)"
SHINGLES = f"{TOKENS}, g AS (SELECT id, unnest(list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram FROM e WHERE len(t) >= 3)"


@query(f"SELECT doc_id AS id, md5({NORMALIZED}) AS digest FROM documents")
def text_normalize(spark, sf):
    return entities(spark, sf).select("id", F.md5(T.normalized(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))::INT AS n FROM documents")
def token_count(spark, sf):
    return entities(spark, sf).select("id", F.size(T.tokens(F.col("text"))).alias("n"))


@query(f"WITH {TOKENS} SELECT id, greatest(len(t) - 2, 0)::INT AS n FROM e")
def shingle_count(spark, sf):
    t = entities(spark, sf).select("id", T.tokens(T.normalized(F.col("text"))).alias("t"))
    return t.select("id", F.size(T.shingles(F.col("t"), 3)).alias("n"))


@query("SELECT doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '/*') AND NOT starts_with(trim(x), '*')))::INT AS loc1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '#')))::INT AS loc2, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//')))::INT AS loc3 FROM documents")
def loc_variants(spark, sf):
    t = F.col("text")
    return entities(spark, sf).select("id", T.loc(t).alias("loc1"), T.loc(t, ("//", "#")).alias("loc2"), T.loc(t, ("//",)).alias("loc3"))


@query(f"WITH {SHINGLES} SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY 1")
def doc_freq(spark, sf):
    return textstats.document_frequency(entities(spark, sf), 3)


@query(f"WITH {SHINGLES}, d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY 1) SELECT gram, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM d")
def idf_weights(spark, sf):
    return rounded(textstats.idf(entities(spark, sf), 3))


@query(f"WITH {SHINGLES}, d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY 1), w AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2) SELECT id, count(*) AS grams, round(sum(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1)), 4) AS weight FROM w JOIN d USING (gram) GROUP BY 1")
def weighted_bag(spark, sf):
    return textstats.weighted_bag(entities(spark, sf), 3).groupBy("id").agg(F.count("*").alias("grams"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"WITH {SHINGLES}, d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY 1), r AS (SELECT df, row_number() OVER (ORDER BY df DESC, gram) AS k, count(*) OVER () AS n FROM d) SELECT max(n) AS n_grams, sum(df)::BIGINT AS total_df, round(100 * sum(df) FILTER (k <= ceil(n * 0.01::DOUBLE)) / sum(df), 6) AS top_share FROM r")
def top1pct_share(spark, sf):
    return rounded(textstats.top_share(textstats.document_frequency(entities(spark, sf), 3)))


@query(f"""WITH {TOKENS}, w AS (SELECT id, unnest(t) AS word FROM e), tf AS (SELECT id, word, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT id, word, round((1 + ln(tf)) * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 9) AS weight FROM tf JOIN df USING (word)),
r AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(weight) OVER (PARTITION BY id ORDER BY weight DESC, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY id) AS s, count(*) OVER (PARTITION BY id) AS m FROM x WINDOW o AS (PARTITION BY id ORDER BY weight DESC, word))
SELECT id, word, round(weight, 6) AS weight, rank::INT AS rank FROM r WHERE s = 0 OR (rank <= least(40, greatest(5, ceil(3 * sqrt(m)))) AND before < 0.8::DOUBLE * s - 1e-6)""")
def tfidf_select(spark, sf):
    return rounded(textstats.select_words(entities(spark, sf)))


@query(f"""WITH {TOKENS}, k AS (SELECT id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'INT_LIT' WHEN regexp_matches(x, '^[0-9]+\\.[0-9]+$') THEN 'FLOAT_LIT' WHEN regexp_matches(x, '^["''].*["'']$') THEN 'STR_LIT' WHEN length(x) <= 3 AND regexp_matches(x, '[a-z]') THEN 'LOCAL_VAR' ELSE x END) AS t FROM e),
tk AS (SELECT id, unnest(generate_series(1, len(t))) AS i, unnest(t) AS x FROM k WHERE len(t) >= 9),
g AS (SELECT concat_ws(' ', x, {', '.join(f'lead(x, {j}) OVER o' for j in range(1, 9))}) AS gram FROM tk WINDOW o AS (PARTITION BY id ORDER BY i) QUALIFY lead(x, 8) OVER o IS NOT NULL),
c AS MATERIALIZED (SELECT gram, count(*) AS support FROM g GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY support DESC) AS k, count(*) OVER () AS n FROM c)
SELECT gram, support, round(ln((SELECT count(*) FROM documents) / support), 6) AS idf FROM c WHERE support >= (SELECT min(support) FROM r WHERE k <= greatest(1, ceil(n * 0.5::DOUBLE / 100)))""")
def stop_motifs(spark, sf):
    return rounded(textstats.stop_motifs(entities(spark, sf)))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: length(w) > 1), ',') AS words FROM part")
def tokenize_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.name_tokens(F.concat_ws(" ", "p_name", "p_type")), ",").alias("words"))


# ---- near-duplicates ------------------------------------------------------------------------------------------------

HASH = "('0x' || substr(md5(gram), 1, 15))::BIGINT"


@query(f"WITH d AS (SELECT doc_id AS id, md5({NORMALIZED}) AS fp FROM documents) SELECT id, min(id) OVER (PARTITION BY fp) AS rep, count(*) OVER (PARTITION BY fp) AS size FROM d")
def exact_dup_groups(spark, sf):
    return lsh.exact_groups(entities(spark, sf))


MASKS = f"[{', '.join(str(lsh.mask(i)) for i in range(lsh.SLOTS))}]"
SIGNATURES = f"{SHINGLES}, hh AS (SELECT id, list(DISTINCT {HASH}) AS hs FROM g GROUP BY id), sig AS (SELECT id, list_transform({MASKS}, lambda m: list_min(list_transform(hs, lambda h: xor(h, m::BIGINT)))) AS sig FROM hh)"


@query(f"WITH {SIGNATURES} SELECT id, md5(array_to_string(sig, ',')) AS digest FROM sig")
def minhash_sig(spark, sf):
    return lsh.signatures(entities(spark, sf)).select("id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("digest"))


@query(f"WITH {SIGNATURES}, b AS (SELECT id, unnest(generate_series(0, 7)) AS band, sig FROM sig) SELECT id, band::INT AS band, md5(array_to_string(sig[band * 16 + 1:band * 16 + 16], ',')) AS bucket FROM b")
def lsh_bands(spark, sf):
    return lsh.bands(lsh.signatures(entities(spark, sf)), 8, 16)


_PAIRS = f"""{SIGNATURES}, md AS (SELECT id, sig, min(id) OVER (PARTITION BY sig) AS rep FROM sig), rs AS (SELECT id, sig FROM md WHERE id = rep), b AS (SELECT id, band, md5(array_to_string(sig[band * 16 + 1:band * 16 + 16], ',')) AS bucket FROM (SELECT id, sig, unnest(generate_series(0, 7)) AS band FROM rs)), m AS (SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.band = y.band AND x.bucket = y.bucket AND x.id < y.id), pr AS (SELECT a, b, len(list_filter(generate_series(1, 128), lambda i: s.sig[i] = t.sig[i])) / 128.0::DOUBLE AS similarity FROM m JOIN rs s ON s.id = a JOIN rs t ON t.id = b), pairs AS (SELECT * FROM pr WHERE similarity >= 0.7), ways AS (SELECT a AS id, b AS other, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)"""


def _pairs(spark, sf):
    return lsh.pairs(lsh.signatures(entities(spark, sf)))


@query(f"WITH {_PAIRS} SELECT id, rep FROM md")
def lsh_members(spark, sf):
    """Which representative stands for each entity in the pairs."""
    return lsh.signature_groups(lsh.signatures(entities(spark, sf)))


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def lsh_pairs(spark, sf):
    return rounded(_pairs(spark, sf))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM ways) SELECT id, other, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3")
def lsh_topk(spark, sf):
    return rounded(lsh.top_k(_pairs(spark, sf), 3))


@query(f"WITH {_PAIRS} SELECT id, round(max(similarity), 6) AS max_sim, round(avg(similarity), 6) AS mean_sim, count(*) FILTER (similarity > 0.8) AS n_high, CASE WHEN max(similarity) > 0.8 THEN round(max(similarity), 6) ELSE 0 END AS clone_mass FROM ways GROUP BY 1")
def sim_summary(spark, sf):
    return rounded(lsh.summary(_pairs(spark, sf)))


@query(f"WITH {SHINGLES}, d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY 1), w AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), hw AS (SELECT id, {HASH} AS h, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM w JOIN d USING (gram)), wl AS (SELECT id, list({{'h': h, 'w': greatest(w, 1e-8)}}) AS xs FROM hw GROUP BY 1), ws AS (SELECT id, unnest(generate_series(0, 127)) AS slot, unnest(list_transform({MASKS}, lambda m: list_min(list_transform(xs, lambda x: xor(x.h, m::BIGINT) / x.w)))) AS v FROM wl) SELECT id, slot::INT AS slot, round(log2(1 + v), 6) AS v FROM ws")
def weighted_minhash_sig(spark, sf):
    s = lsh.weighted_signatures(textstats.weighted_bag(entities(spark, sf), 3))
    return s.select("id", F.posexplode("sig").alias("slot", "v")).select("id", "slot", F.round(F.log2(1 + F.col("v")), 6).alias("v"))


# ---- graphs ---------------------------------------------------------------------------------------------------------

def dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers to the suppliers of their order lines."""
    li, o = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return li.join(o, "l_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


EDGES = "ee AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
DEGREES = f"{EDGES}, fo AS (SELECT src AS node, count(*) AS fan_out FROM ee GROUP BY 1), fi AS (SELECT dst AS node, count(*) AS fan_in FROM ee GROUP BY 1), dg AS (SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) * coalesce(fan_out, 0) AS choke FROM fo FULL JOIN fi USING (node))"


@query(f"WITH {DEGREES} SELECT * FROM dg")
def degree_metrics(spark, sf):
    return graph.degrees(dependency_edges(spark, sf))


def part_edges(spark, sf):
    """Parts to the part on the next line of an order, where that is a smaller one or the order is returned: cycles and long chains."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_returnflag", "l_quantity")
    return e.filter("dst is not null and (dst > src or l_returnflag = 'R' and l_quantity < 3)").select("src", "dst")


PART_EDGES = "pe AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS dst, l_returnflag, l_quantity FROM lineitem), vv AS (SELECT DISTINCT src, dst FROM pe WHERE dst IS NOT NULL AND (dst > src OR l_returnflag = 'R' AND l_quantity < 3))"
REACH = f"{PART_EDGES}, re AS (SELECT src, dst FROM vv UNION SELECT re.src, v.dst FROM re JOIN vv v ON v.src = re.dst), sc AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM re a JOIN re b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src), nn AS (SELECT src AS node FROM vv UNION SELECT dst FROM vv), co AS (SELECT node, coalesce(component, node) AS component, component IS NOT NULL AS cyclic FROM nn LEFT JOIN sc USING (node))"


@query(f"WITH {PART_EDGES}, a AS (SELECT src AS node, count(*) AS o FROM vv GROUP BY 1), b AS (SELECT dst AS node, count(*) AS i FROM vv GROUP BY 1) SELECT node, i * o AS choke FROM a JOIN b USING (node) WHERE i * o > 0 ORDER BY choke DESC, node LIMIT 10")
def chokepoints(spark, sf):
    """The ten nodes with the greatest product of degrees (a report)."""
    return graph.degrees(part_edges(spark, sf)).filter("choke > 0").orderBy(F.desc("choke"), "node").limit(10).select("node", "choke")


@query(f"WITH RECURSIVE {REACH} SELECT node FROM co WHERE cyclic")
def cycle_members(spark, sf):
    return graph.cycle_members(part_edges(spark, sf))


@query(f"WITH RECURSIVE {REACH} SELECT node, component, cyclic FROM co")
def strong_components(spark, sf):
    return graph.strong_components(part_edges(spark, sf))


@query("SELECT a.r AS a, b.r AS b, count(*) AS weight FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) e JOIN (SELECT c_custkey, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) a ON a.c_custkey = o_custkey JOIN (SELECT s_suppkey, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey) b ON b.s_suppkey = l_suppkey GROUP BY 1, 2")
def module_graph(spark, sf):
    li, o = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("n_regionkey").alias("grp"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("n_regionkey").alias("grp"))
    e = li.join(o, "l_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.rolled_up(e, c.unionAll(s))


#: Words of programming languages that tell nothing of an entity.
STOP = "fn function def let var const class struct impl interface return true false null none self this int float string bool public private protected static async await match loop while for if else elif case switch".split()
DOC_TOKENS = f"""rn AS (SELECT doc_id AS id, unnest(r) AS w, unnest(generate_series(1, len(r))) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), lambda w: trim(substr(w, 1, 64), '_')) AS r FROM documents)), fi AS (SELECT id, w, min(i) AS i FROM rn WHERE length(w) >= 3 AND w NOT IN ('{"', '".join(STOP)}') GROUP BY 1, 2), bt AS (SELECT id, w AS token FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM fi) WHERE k <= 128)"""


def doc_tokens(spark, sf):
    """The first 128 distinct identifiers of each document, as the operator has it."""
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return b.select("id", F.explode(T.identifiers(F.col("text"), STOP)).alias("token"))


TOKEN_EDGES = f"{DOC_TOKENS}, ok AS (SELECT token FROM bt GROUP BY 1 HAVING count(*) BETWEEN 2 AND 256), sh AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM bt x JOIN ok USING (token) JOIN bt y ON y.token = x.token AND x.id < y.id GROUP BY 1, 2), sz AS (SELECT id, count(*) AS n FROM bt GROUP BY 1), je AS (SELECT a, b, shared, shared / (p.n + q.n - shared)::DOUBLE AS jaccard FROM sh JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE shared >= 2), ke AS MATERIALIZED (SELECT * FROM je WHERE jaccard >= 0.2)"


@query(f"WITH {TOKEN_EDGES} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM ke")
def token_pairs_capped(spark, sf):
    return rounded(graph.jaccard_edges(doc_tokens(spark, sf)))


def token_edges(spark, sf):
    return graph.jaccard_edges(doc_tokens(spark, sf)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


CC = f"""{TOKEN_EDGES}, cc AS MATERIALIZED (SELECT a AS id, b AS other FROM ke UNION SELECT b, a FROM ke), w(id, reach) AS (SELECT DISTINCT id, id FROM cc UNION SELECT w.id, cc.other FROM w JOIN cc ON cc.id = w.reach), lab AS (SELECT id, min(reach) AS component FROM w GROUP BY 1)"""


@query(f"WITH RECURSIVE {CC} SELECT id, component FROM lab")
def similarity_components(spark, sf):
    return graph.components(token_edges(spark, sf))


@query(f"WITH RECURSIVE {CC}, ch AS (SELECT id, component, (row_number() OVER (PARTITION BY component ORDER BY id) - 1) // 48 AS chunk FROM lab) SELECT id, component, chunk::BIGINT AS chunk, size FROM ch JOIN (SELECT component, chunk, count(*) AS size FROM ch GROUP BY 1, 2 HAVING count(*) > 1) USING (component, chunk)")
def component_chunks(spark, sf):
    return graph.chunks(similarity_components(spark, sf), 48).select("id", "component", F.col("chunk").cast("long").alias("chunk"), "size")


@query(f"WITH RECURSIVE {TOKEN_EDGES}, u AS MATERIALIZED (SELECT a AS x, b AS y FROM ke UNION SELECT b, a FROM ke), bfs(node, other, d) AS (SELECT x, y, 1 FROM u UNION SELECT node, y, d + 1 FROM bfs JOIN u ON x = other WHERE y <> node AND d < 12), sp AS (SELECT node, other, min(d) AS d FROM bfs GROUP BY 1, 2) SELECT node, round(count(*) / sum(d), 6) AS closeness FROM sp GROUP BY 1")
def closeness(spark, sf):
    return rounded(graph.closeness(token_edges(spark, sf)))


# ---- structure ------------------------------------------------------------------------------------------------------

GINI = "x AS (SELECT source, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents), gi AS (SELECT source, count(*) AS n, CASE WHEN count(*) <= 1 OR sum(v) = 0 THEN 0 ELSE greatest(0, 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)) END AS gini FROM x GROUP BY 1), en AS (SELECT source, -sum(p * log2(p)) AS entropy FROM (SELECT source, v / sum(v) OVER (PARTITION BY source) AS p FROM x WHERE v > 0) GROUP BY 1)"


def sizes(spark, sf):
    return table(spark, sf, "documents").select("source", "n_chars")


@query(f"WITH {GINI} SELECT source, n, round(gini, 6) AS gini FROM gi")
def gini_by_group(spark, sf):
    return rounded(structure.gini(sizes(spark, sf), "source", "n_chars"))


@query(f"WITH {GINI} SELECT source, round(entropy, 6) AS entropy FROM en")
def entropy_by_group(spark, sf):
    return rounded(structure.entropy(sizes(spark, sf), "source", "n_chars"))


@query(f"WITH {GINI}, t AS (SELECT source, n AS files, (SELECT sum(v) FROM x WHERE x.source = gi.source) AS total, CASE WHEN n > 1 THEN greatest(gini, 1 - entropy / log2(n)) ELSE 0 END AS dispersion FROM gi JOIN en USING (source)) SELECT source, files, total, round(dispersion, 6) AS dispersion, round((0.25 * least(1, files / 25) + 0.2 * least(1, total / 2000) + 0.1 * dispersion) * (1 + 0.5 * tanh((ln(1 + files / 10) / ln(10) + ln(1 + total / 1000) / ln(1000)) / 2)), 6) AS imbalance FROM t")
def dir_imbalance(spark, sf):
    return rounded(structure.imbalance(sizes(spark, sf), "source", "n_chars"))


_MU, _SIGMA = S.lognormal_parameters(800.0, 6000.0)
_T = f"(1 / (1 + 0.3275911 * abs((ln(n_chars) - {_MU!r}) / ({_SIGMA!r} * sqrt(2)))))"
_Z = f"((ln(n_chars) - {_MU!r}) / ({_SIGMA!r} * sqrt(2)))"


@query(f"SELECT doc_id, round(CASE WHEN n_chars <= 0 THEN 1 ELSE 1 - 0.5 * (1 + sign({_Z}) * (1 - ((((1.061405429 * {_T} - 1.453152027) * {_T} + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-{_Z} * {_Z}))) END, 6) AS health FROM documents")
def lognormal_health(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(S.lognormal_health(F.col("n_chars").cast("double"), 800.0, 6000.0), 6).alias("health"))


@query("SELECT source, round(sum(n_chars * h) / sum(n_chars), 6) AS mean_health, round(min(h), 6) AS min_health FROM (SELECT source, n_chars, 1 - 1 / (1 + exp(-(least(n_chars, 10000) / 10000 - 0.9) / 0.05)) AS h FROM documents) GROUP BY 1")
def weighted_health(spark, sf):
    h = 1 - S.logistic(F.least(F.col("n_chars"), F.lit(10000)) / 10000, 0.9, 0.05)
    return rounded(structure.weighted_health(table(spark, sf, "documents").withColumn("h", h), "source", "n_chars", "h"))


# ---- cohesion -------------------------------------------------------------------------------------------------------

def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))


UNITS = "dv AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS v FROM embeddings), uv AS (SELECT id, grp, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM dv), el AS (SELECT id, grp, unnest(generate_series(1, len(u))) AS i, unnest(u) AS x FROM uv), ss AS (SELECT grp, i, sum(x) AS x, count(*) AS n FROM el GROUP BY 1, 2), ce AS (SELECT grp, max(n) AS n, list(x ORDER BY i) AS s FROM ss GROUP BY 1), si AS (SELECT id, uv.grp, n, round(list_cosine_similarity(u, s), 9) AS similarity FROM uv JOIN ce ON ce.grp = uv.grp)"


@query(f"WITH {UNITS} SELECT grp, n, round(least(1, sqrt(list_dot_product(s, s)) / n), 6) AS cohesion FROM ce")
def cohesion_score(spark, sf):
    return rounded(cohesion.cohesion(vectors(spark, sf)))


@query(f"WITH {UNITS} SELECT grp, n, round(s[1] / sqrt(list_dot_product(s, s)), 6) AS first, round(s[len(s)] / sqrt(list_dot_product(s, s)), 6) AS last FROM ce")
def unit_centroid(spark, sf):
    c = cohesion.centroids(vectors(spark, sf))
    return rounded(c.select("grp", "n", F.element_at("centroid", 1).alias("first"), F.element_at("centroid", -1).alias("last")))


@query(f"WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY similarity, id) - 1 AS k FROM si WHERE n >= 3), e AS (SELECT grp, greatest(similarity, 0) AS edge FROM r WHERE k = floor(n * 0.1::DOUBLE)) SELECT id, r.grp, round(similarity, 6) AS similarity FROM r JOIN e ON e.grp = r.grp WHERE similarity < edge")
def cohesion_outliers(spark, sf):
    return rounded(cohesion.outliers(vectors(spark, sf)))


@query(f"WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY similarity, id) AS k FROM si), kp AS (SELECT id FROM r WHERE k > least(ceil(n * 0.15::DOUBLE), n - 1)), s2 AS (SELECT grp, i, sum(x) AS x, count(*) AS n FROM el JOIN kp USING (id) GROUP BY 1, 2), c2 AS (SELECT grp, max(n) AS n, list(x ORDER BY i) AS s FROM s2 GROUP BY 1) SELECT grp, n, round(least(1, sqrt(list_dot_product(s, s)) / n), 6) AS cohesion FROM c2")
def robust_centroid(spark, sf):
    return rounded(cohesion.cohesion(cohesion.trimmed(vectors(spark, sf))))


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def ancestor_rollup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


# ---- coverage -------------------------------------------------------------------------------------------------------

def coverage_lines(spark, sf):
    """Lines 1, 2, ... of each part's file: its order lines in key order, covered unless returned or new."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("path"), F.row_number().over(w).cast("long").alias("line"), F.col("l_quantity").cast("long").alias("hits"), (F.col("l_returnflag") == "R").alias("covered"))


LINES = "ln AS (SELECT l_partkey AS path, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS line, l_quantity::BIGINT AS hits, l_returnflag = 'R' AS covered FROM lineitem), ru AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM ln WHERE NOT covered), sp AS (SELECT path, min(line) AS start, max(line) AS stop FROM ru GROUP BY path, run HAVING max(line) - min(line) + 1 >= 3)"


@query(f"WITH {LINES} SELECT path, start, stop FROM sp")
def uncovered_spans(spark, sf):
    return coverage.spans(coverage_lines(spark, sf))


@query(f"WITH {LINES}, fl AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS new FROM sp), isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start, stop) AS k FROM fl) SELECT path, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM isl GROUP BY path, k")
def merged_spans(spark, sf):
    return coverage.merged(coverage.spans(coverage_lines(spark, sf)))


@query(f"WITH {LINES} SELECT path, count(*) AS lines, round(100 * avg(covered::INT), 6) AS percent FROM ln GROUP BY 1")
def coverage_pct(spark, sf):
    return rounded(coverage.percent(coverage_lines(spark, sf)))


@query(f"WITH {LINES} SELECT path, tens AS line, max(hits) AS hits, bool_or(covered) AS covered FROM (SELECT *, line % 10 AS tens FROM ln) GROUP BY path, tens")
def coverage_upsert(spark, sf):
    return coverage.upsert(coverage_lines(spark, sf).withColumn("line", F.col("line") % 10))


def _contained(spark, sf):
    points = coverage_lines(spark, sf).select("path", "line", (F.col("hits") % 3).alias("nesting"))
    return coverage.contained(coverage.spans(coverage_lines(spark, sf)), points)


CONTAINED = f"{LINES}, co AS (SELECT sp.path, start, stop, count(line) AS n, coalesce(sum(1 + hits % 3), 0)::BIGINT AS cognitive FROM sp LEFT JOIN ln p ON p.path = sp.path AND line BETWEEN start AND stop GROUP BY 1, 2, 3)"


@query(f"WITH {CONTAINED} SELECT path, start, stop, CASE WHEN n > 0 THEN 1 + n ELSE 0 END AS cyclomatic, cognitive FROM co")
def containment_metrics(spark, sf):
    return _contained(spark, sf)


@query(f"WITH {CONTAINED} SELECT path, start, stop, round(least(1, 0.4 * (1 - exp(-(stop - start + 1) / 20)) + 0.2 * (1 - exp(-cognitive / 10)) + 0.15 * (path % 7 / (path % 7 + 5)) + 0.05 * (path % 2)), 6) AS score FROM co")
def gap_scores(spark, sf):
    g = _contained(spark, sf).withColumn("loc", F.col("stop") - F.col("start") + 1).withColumn("fan_in", F.col("path") % 7).withColumn("undocumented", F.col("path") % 2 == 1)
    return rounded(coverage.gap_scores(g).select("path", "start", "stop", "score"))


@query(f"""WITH {LINES}, en AS (SELECT path * 100 + k AS id, path, k * 5 + 1 AS start, k * 5 + 5 AS stop FROM (SELECT DISTINCT path FROM ln) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)), ex AS (SELECT *, round(100.0::DOUBLE * (start % 7) / 7, 6) AS percent FROM sp), fp AS (SELECT path, round(100 * avg(covered::INT), 6) AS percent FROM ln GROUP BY 1),
ow AS (SELECT en.*, ex.percent AS own FROM en LEFT JOIN ex USING (path, start, stop)), ne AS (SELECT id, min(ex.percent) AS near FROM en JOIN ex ON ex.path = en.path AND en.start <= ex.stop AND ex.start <= en.stop WHERE 2 * (least(en.stop, ex.stop) - greatest(en.start, ex.start) + 1) >= en.stop - en.start + 1 GROUP BY 1)
SELECT id, coalesce(own, near, percent) AS percent, CASE WHEN own IS NOT NULL THEN 'range' WHEN near IS NOT NULL THEN 'overlap' WHEN percent IS NOT NULL THEN 'file' ELSE 'none' END AS level FROM ow LEFT JOIN ne USING (id) LEFT JOIN fp USING (path)""")
def fallback_join(spark, sf):
    ln = coverage_lines(spark, sf)
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    e = ln.select("path").distinct().select("path", k).select((F.col("path") * 100 + F.col("k")).alias("id"), "path", (F.col("k") * 5 + 1).cast("long").alias("start"), (F.col("k") * 5 + 5).cast("long").alias("stop"))
    exact = coverage.spans(ln).withColumn("percent", F.round(100.0 * (F.col("start") % 7) / 7, 6))
    return coverage.with_fallback(e, exact, rounded(coverage.percent(ln)))
