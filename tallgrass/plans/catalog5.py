"""Named queries of trees, divided folders and files, imports, documentation, reports and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import scores
from tallgrass.operators import dependency, division, docscan, gaps, health, imports, layout, lsh, trees
from tallgrass.plans.catalog import query, rounded
from tallgrass.plans.catalog4 import GAPS, doc_gaps
from tallgrass.session import by_key, spread, table, written
from tallgrass.sources import files, reports

# ---- trees ----------------------------------------------------------------------------------------------------------


def page_tags(spark, sf):
    return trees.tags(spread(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))))


@query(r"""WITH t AS (SELECT page_id AS id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '<(/?[A-Za-z][A-Za-z0-9]*[^>]*)>', 1) AS ts FROM pages),
u AS (SELECT id, unnest(generate_series(1, len(ts))) AS pos, unnest(ts) AS tag FROM t),
v AS (SELECT id, pos, lower(regexp_extract(tag, '^/?([A-Za-z0-9]+)', 1)) AS label, starts_with(tag, '/') AS fin, ends_with(tag, '/') AS own FROM u),
w AS (SELECT *, label IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') AS void FROM v),
y AS (SELECT id, pos, label, CASE WHEN fin THEN -1 WHEN own OR void THEN 0 ELSE 1 END AS up FROM w WHERE NOT (fin AND void)),
z AS (SELECT *, sum(up) OVER o AS after, count(*) FILTER (up >= 0) OVER o AS begun, count(*) FILTER (up >= 0) OVER (PARTITION BY id) AS n FROM y WINDOW o AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, after - (up > 0)::INT AS level, least(min(after) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS least FROM z),
b AS (SELECT *, CASE WHEN up = 0 THEN begun ELSE lead(begun) OVER (PARTITION BY id, level ORDER BY pos) END AS fin FROM a),
c AS (SELECT id, label, begun - 1 AS pre, least(coalesce(fin, n), 4000) - begun + 1 AS size, level - least AS above, n FROM b WHERE up >= 0 AND begun <= 4000),
d AS (SELECT *, pre + size - 1 - above AS post FROM c)
SELECT id, count(*) AS n, string_agg(label, ' ' ORDER BY post) AS labels, string_agg(cast(post - size + 1 AS BIGINT), ' ' ORDER BY post) AS lows, max(n) > 4000 AS truncated FROM d GROUP BY id""")
def tree_encoding(spark, sf):
    """Each page as an ordered tree: labels and leftmost leaves in post-order."""
    t = trees.trees(page_tags(spark, sf))
    return t.select("id", F.col("n").cast("long").alias("n"), F.array_join("labels", " ").alias("labels"), F.array_join(F.col("lows").cast("array<string>"), " ").alias("lows"), "truncated")


@query()
def tree_similarity(spark, sf):
    """Pages whose texts share a bucket, verified by their trees' edit distance: all of those of ten nodes and more."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    found = lsh.pairs(lsh.signatures(spread(p)), b=32, rows=4, least=0.4)
    t = written(trees.trees(page_tags(spark, sf)), "trees")
    return rounded(trees.large_enough(trees.verified(found.select("a", "b", F.col("similarity").alias("score")), t), 10))


# ---- divided folders and files --------------------------------------------------------------------------------------


def order_files(spark, sf):
    """Each order as a folder of its lines."""
    li = by_key(table(spark, sf, "lineitem"), "l_orderkey", each=16)
    nodes = li.groupBy(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("node")).agg(F.sum("l_quantity").cast("long").alias("loc"))
    to = [F.struct((F.col("l_linenumber") + 1).alias("dst"), (F.col("l_partkey") % 7 + 1).alias("w")), F.struct((F.col("l_linenumber") - 2).alias("dst"), (F.col("l_suppkey") % 3 + 1).alias("w"))]
    e = li.select(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("src"), F.explode(F.array(*to)).alias("t"))
    return nodes, e.select("dir", "src", F.col("t.dst").alias("dst"), F.col("t.w").cast("long").alias("weight"))


@query("""WITH nd AS (SELECT l_orderkey AS dir, l_linenumber AS node, sum(l_quantity)::BIGINT AS loc FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY dir) AS c, sum(loc) OVER (PARTITION BY dir) AS total FROM nd),
e AS (SELECT l_orderkey AS dir, l_linenumber AS src, l_linenumber + 1 AS dst, l_partkey % 7 + 1 AS w FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber - 2, l_suppkey % 3 + 1 FROM lineitem),
f AS (SELECT e.dir, a.i, b.i AS j, sum(w) AS w FROM e JOIN n a ON a.dir = e.dir AND a.node = src JOIN n b ON b.dir = e.dir AND b.node = dst GROUP BY 1, 2, 3),
m AS (SELECT dir, c, unnest(range(1, (1::BIGINT << c::INT) - 1)) AS mask FROM (SELECT DISTINCT dir, c FROM n WHERE c BETWEEN 2 AND 8)),
s AS (SELECT m.dir, mask, abs(coalesce(sum(loc) FILTER ((mask >> i::INT) & 1 = 1), 0) / max(total)::DOUBLE - 0.5) AS uneven FROM m JOIN n ON n.dir = m.dir GROUP BY 1, 2),
k AS (SELECT m.dir, mask, sum(w) FILTER ((mask >> i::INT) & 1 = 1 AND (mask >> j::INT) & 1 = 0) AS cut FROM m JOIN f ON f.dir = m.dir GROUP BY 1, 2),
b AS (SELECT s.dir, mask, row_number() OVER (PARTITION BY s.dir ORDER BY coalesce(cut, 0), uneven, mask) AS r FROM s LEFT JOIN k USING (dir, mask) WHERE uneven <= 0.25)
SELECT n.dir, n.node, CASE WHEN (coalesce(b.mask, (1 << (c // 2)::INT) - 1) >> i::INT) & 1 = 1 THEN 0 ELSE 1 END AS part FROM n LEFT JOIN b ON b.dir = n.dir AND b.r = 1 WHERE c BETWEEN 2 AND 8""")
def folder_bipartition(spark, sf):
    """Each order's lines in two parts with the lightest edges between them."""
    return division.bipartitions(*order_files(spark, sf))


def customer_files(spark, sf):
    """Forty customers to a folder, importing each other by a rule."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    base = k - k % 40
    d = F.concat(F.lit("d"), base)
    name = lambda x: F.concat(d, F.lit("/f"), x)
    nodes = c.select(d.alias("dir"), name(k).alias("node"), F.floor(F.abs("c_acctbal") / 200).cast("long").alias("loc"))
    to = F.array(*[F.struct(name(base + x).alias("dst"), w.cast("long").alias("w")) for x, w in (((k * 7 + 3) % 40, k % 5 + 1), ((k * k) % 40, F.lit(1)), (k % 8, k % 3 + 1))])
    e = c.select(d.alias("dir"), name(k).alias("src"), F.explode(to).alias("t"))
    return nodes, e.select("dir", "src", F.col("t.dst").alias("dst"), F.col("t.w").alias("weight"))


@query()
def folder_division(spark, sf):
    """Folders of customers divided by votes and moves: names, files and lines of the parts, and what the division costs."""
    nodes, edges = customer_files(spark, sf)
    parts = written(division.divided(nodes, edges), "divided")
    return division.named(parts, nodes).join(division.crossing_edges(parts, edges), "dir")


def buyers(spark, sf):
    """Customers as entities of their nation's file, with the priorities and years of their orders as words; some have none."""
    w = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.concat_ws("-", "o_orderpriority", F.year("o_orderdate"))).alias("words"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("file"), F.col("c_custkey").alias("id"), F.concat_ws("_", F.element_at(F.array(*[F.lit(x) for x in ("read", "api", "tool", "core")]), (F.col("c_custkey") % 4 + 1).cast("int")), "c_mktsegment").alias("name"), F.floor(F.abs("c_acctbal") / 100).cast("long").alias("loc"))
    return c.join(w, "id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


BUYERS = """ws AS (SELECT 'n' || c_nationkey AS file, c_custkey AS id, coalesce(list(DISTINCT o_orderpriority || '-' || year(o_orderdate)) FILTER (o_orderkey IS NOT NULL), []) AS words FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), we AS (SELECT file, id, unnest(words) AS word, len(words) AS n FROM ws),
wp AS (SELECT a.file, a.id, b.id AS other, count(*) / (max(a.n) + max(b.n) - count(*)) AS similarity FROM we a JOIN we b ON b.file = a.file AND b.word = a.word AND a.id < b.id GROUP BY 1, 2, 3 UNION ALL SELECT a.file, a.id, b.id, 1 FROM ws a JOIN ws b ON b.file = a.file AND a.id < b.id WHERE len(a.words) = 0 AND len(b.words) = 0),
u AS (SELECT * FROM wp WHERE similarity >= 0.2), ends AS (SELECT file, id AS x, other AS y, similarity, id, other FROM u UNION ALL SELECT file, other, id, similarity, id, other FROM u),
f AS MATERIALIZED (SELECT file, x, y, similarity, id, other FROM (SELECT *, row_number() OVER (PARTITION BY file, x ORDER BY similarity DESC, id, other) AS r FROM ends) WHERE r = 1),
t AS (SELECT a.file, a.x AS root, a.x, a.similarity, a.id, a.other FROM f a JOIN f b ON b.file = a.file AND b.x = a.y AND b.y = a.x WHERE a.x < a.y UNION ALL SELECT f.file, t.root, f.x, t.similarity, t.id, t.other FROM t JOIN f ON f.file = t.file AND f.y = t.x AND f.x <> t.root),
r AS (SELECT DISTINCT t.file, root, f.similarity, f.id, f.other FROM t JOIN f ON f.file = t.file AND f.x = t.root),
c AS (SELECT r.file, r.root, row_number() OVER (PARTITION BY r.file ORDER BY r.similarity DESC, r.id, r.other) - 1 AS community FROM r JOIN (SELECT file, root FROM t GROUP BY 1, 2 HAVING count(*) >= 3) g ON g.file = r.file AND g.root = r.root),
cm AS (SELECT t.file, t.x AS id, community FROM t JOIN c ON c.file = t.file AND c.root = t.root WHERE community < 3)"""


@query(f"WITH RECURSIVE {BUYERS} SELECT * FROM cm")
def entity_communities(spark, sf):
    """Customers of a nation put together by shared words, the most similar pair first."""
    return layout.communities(layout.nearest_pairs(buyers(spark, sf).select("file", "id", "words"), 0.2))


@query(f"""WITH RECURSIVE {BUYERS}, fl AS (SELECT 'n' || c_nationkey AS file, sum(floor(abs(c_acctbal) / 100)::BIGINT) AS loc FROM customer GROUP BY 1),
ki AS (SELECT cm.file, community, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind, floor(abs(c_acctbal) / 100)::BIGINT AS loc FROM cm JOIN customer ON c_custkey = cm.id),
kc AS (SELECT file, community, kind, count(*) AS c, sum(loc) AS loc FROM ki GROUP BY 1, 2, 3), kp AS (SELECT file, community, arg_max(kind, c * 10 + kind) AS kind, sum(c) AS members, sum(loc) AS loc FROM kc GROUP BY 1, 2)
SELECT kp.file, community, kp.file || ['_io', '_api', '_util', '_core'][kind + 1] || '.py' AS name, members::BIGINT AS members, kp.loc::BIGINT AS loc FROM kp JOIN fl USING (file) WHERE fl.loc >= 800 AND file IN (SELECT file FROM kp GROUP BY 1 HAVING count(*) >= 2)""")
def file_splits(spark, sf):
    """The parts that nations of 800 lines and more are divided into."""
    e = written(buyers(spark, sf), "buyers")
    files = e.groupBy("file").agg(F.sum("loc").alias("loc")).select("file", F.concat(F.lit("src/"), F.col("file"), F.lit(".py")).alias("path"), "loc", F.lit(0).cast("long").alias("bytes"))
    return layout.splits(layout.communities(layout.nearest_pairs(e.select("file", "id", "words"), 0.2)), e.select("file", "id", "name", "loc"), files)


# ---- imports and documentation --------------------------------------------------------------------------------------


def part_files(spark, sf):
    k = F.col("p_partkey")
    at = F.concat(F.lit("src/"), F.regexp_replace("p_type", "[^A-Za-z0-9]", ""), F.lit("/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    return table(spark, sf, "part").select(k.alias("k"), F.concat(at, F.lit("/"), F.when(k % 50 == 0, F.concat(F.lit("s"), k, F.lit("/mod.rs"))).otherwise(F.concat(F.lit("m"), k, F.element_at(F.array(*[F.lit(x) for x in (".rs", ".py", ".ts", ".go")]), (k % 4 + 1).cast("int"))))).alias("path"))


def part_imports(spark, sf):
    """Seven imports of each file, of the file of another part in the forms of several languages."""
    f = part_files(spark, sf)
    last_key = f.agg(F.max("k")).first()[0] or 1
    asked = f.select("path", ((F.col("k") * 7) % last_key + 1).alias("k"))
    to = asked.join(f.select("k", F.col("path").alias("p")).hint("merge"), "k").withColumn("m", F.regexp_replace("p", r"^src/|(/mod)?\.[a-z]+$", ""))
    last, dots = F.regexp_extract("m", "[^/]+$", 0), F.replace("m", F.lit("/"), F.lit("."))
    forms = F.array(F.concat(F.lit("crate::"), F.replace("m", F.lit("/"), F.lit("::")), F.lit("::Item")), dots, F.concat(F.lit("src."), dots), F.concat(F.lit("./"), "m"), F.concat(F.lit("self::"), last), F.concat(F.lit("super::x::"), last), F.concat(F.lit("nowhere."), F.lit("q"), "k"))
    return to.select("path", F.explode(forms).alias("name"))


@query(r"""WITH pf AS (SELECT p_partkey AS k, 'src/' || regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') || '/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '/' || CASE WHEN p_partkey % 50 = 0 THEN 's' || p_partkey || '/mod.rs' ELSE 'm' || p_partkey || ['.rs', '.py', '.ts', '.go'][p_partkey % 4 + 1] END AS path FROM part),
ask AS (SELECT path, (k * 7) % (SELECT max(p_partkey) FROM part) + 1 AS k FROM pf), t AS (SELECT ask.path, ask.k, regexp_replace(pf.path, '^src/|(/mod)?\.[a-z]+$', '', 'g') AS m FROM ask JOIN pf USING (k)),
im AS (SELECT DISTINCT path, unnest(['crate::' || replace(m, '/', '::') || '::Item', replace(m, '/', '.'), 'src.' || replace(m, '/', '.'), './' || m, 'self::' || regexp_extract(m, '[^/]+$'), 'super::x::' || regexp_extract(m, '[^/]+$'), 'nowhere.q' || k]) AS name FROM t),
x AS (SELECT path, regexp_replace(path, '\.(rs|py|js|ts|tsx|jsx|go)$', '') AS bare, regexp_replace(path, '/?[^/]*$', '') AS up, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS stem FROM pf),
md AS (SELECT path, replace(regexp_replace(bare, '^src/', ''), '/', '::') AS m FROM x UNION ALL SELECT path, replace(regexp_replace(up, '^src/', ''), '/', '::') FROM x WHERE ends_with(path, 'mod.rs')),
ke AS (SELECT path, unnest([m, replace(m, '::', '.'), 'crate::' || m, 'crate.' || replace(m, '::', '.')]) AS key FROM md UNION ALL SELECT path, stem FROM x WHERE stem NOT IN ('mod', 'lib', 'main') UNION ALL SELECT path, './' || regexp_replace(bare, '^src/', '') FROM x WHERE ends_with(path, '.ts') UNION ALL SELECT path, replace(bare, '/', '.') FROM x WHERE ends_with(path, '.py') UNION ALL SELECT path, up FROM x WHERE ends_with(path, '.go')),
kt AS (SELECT key, min(path) AS target FROM ke GROUP BY 1),
q AS (SELECT path, name, regexp_replace(path, '/?[^/]*$', '') AS up FROM im),
r AS (SELECT *, ltrim(replace(replace(CASE WHEN starts_with(name, 'super::') AND up <> '' THEN replace(regexp_replace(regexp_replace(up, '/?[^/]*$', ''), '^src/', ''), '/', '::') || '::' || substr(name, 8) WHEN starts_with(name, 'self::') THEN replace(regexp_replace(up, '^src/', ''), '/', '::') || '::' || substr(name, 7) ELSE name END, '::', '.'), '/', '.'), '.') AS nm FROM q),
s AS (SELECT *, string_split(nm, '.') AS ps FROM r),
pre AS (SELECT path, name, ps, unnest(range(len(ps))) AS i FROM s),
c AS (SELECT path, name, array_to_string(ps[1:len(ps) - i], '.') AS key, 2 * i AS rank FROM pre UNION ALL SELECT path, name, array_to_string(ps[1:len(ps) - i], '::'), 2 * i + 1 FROM pre
UNION ALL SELECT path, name, up || '.' || ps[1], 1000000 FROM s WHERE len(ps) = 1 UNION ALL SELECT path, name, replace(regexp_replace(up, '^src/', ''), '/', '::') || '::' || ps[1], 1000001 FROM s WHERE len(ps) = 1 UNION ALL SELECT path, name, ps[-1], 1000002 FROM s)
SELECT path, name, arg_min(target, rank) AS target, min(rank) AS rank FROM c JOIN kt USING (key) GROUP BY path, name""")
def import_resolution(spark, sf):
    """Imports of the parts' files, by the best key that a file bears."""
    return imports.resolved(part_imports(spark, sf), part_files(spark, sf))


def doc_lines(spark, sf):
    """Documents as source files: even ones with quoted texts after definitions, odd ones with comments before."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.col("i") + 1)
    w = F.coalesce(F.nullif(F.regexp_extract("line", "([A-Za-z]+)", 1), F.lit("")), F.lit("x"))
    n, line = F.col("n"), F.col("line")
    py = F.when(n % 6 == 1, F.concat(F.when(F.col("doc_id") % 3 == 0, "class ").otherwise("def "), w, F.lit("():"))).when(n % 12 == 2, F.concat(F.lit('    """'), F.substring(line, 1, 9), F.lit('"""'))).when((n % 12).isin(8, 10), "    '''").when((n % 12 == 9) & (n % 5 < 2), "    Todo").otherwise(F.concat(F.lit("    "), line))
    ts = F.when(n % 12 == 1, "/**").when(n % 12 == 7, F.concat(F.lit("/// "), line)).when(n % 12 == 2, F.concat(F.lit(" * "), F.substring(line, 1, 7))).when(n % 12 == 3, " */").when(n % 12 == 9, "///").when(n % 6 == 4, F.concat(F.lit("export function "), w, F.lit("(a) {"))).when(n % 6 == 5, "").when(n % 6 == 0, F.concat(F.lit("const "), w, F.lit(" = (x) => x"))).otherwise(line)
    path = F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".ts"))
    return d.select("doc_id", path.alias("path"), "n", F.when(F.col("doc_id") % 2 == 0, py).otherwise(ts).alias("line"))


DOC_LINES = r"""dl AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), dw AS (SELECT *, coalesce(nullif(regexp_extract(line, '([A-Za-z]+)', 1), ''), 'x') AS w FROM dl),
sl AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS path, n, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN n % 6 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'class ' ELSE 'def ' END || w || '():' WHEN n % 12 = 2 THEN '    ' || repeat('"', 3) || substr(line, 1, 9) || repeat('"', 3) WHEN n % 12 IN (8, 10) THEN '    ''''''' WHEN n % 12 = 9 AND n % 5 < 2 THEN '    Todo' ELSE '    ' || line END
ELSE CASE WHEN n % 12 = 1 THEN '/**' WHEN n % 12 = 7 THEN '/// ' || line WHEN n % 12 = 2 THEN ' * ' || substr(line, 1, 7) WHEN n % 12 = 3 THEN ' */' WHEN n % 12 = 9 THEN '///' WHEN n % 6 = 4 THEN 'export function ' || w || '(a) {' WHEN n % 6 = 5 THEN '' WHEN n % 6 = 0 THEN 'const ' || w || ' = (x) => x' ELSE line END END AS line FROM dw),
sb AS (SELECT *, regexp_replace(line, '^\s+', '') AS bare FROM sl),
qa AS (SELECT *, length(line) - length(bare) AS indent, len(regexp_extract_all(line, '"{3}|''{3}')) AS marks FROM sb WHERE doc_id % 2 = 0), qb AS (SELECT *, coalesce(sum(marks) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM qa),
qc AS (SELECT *, b % 2 = 0 AND regexp_matches(bare, '^[A-Za-z]*("{3}|''{3})') AS opens, CASE WHEN bare <> '' AND NOT starts_with(bare, '#') THEN n END AS sig FROM qb),
qd AS (SELECT *, min(sig) OVER (PARTITION BY path ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nx FROM qc),
qt AS (SELECT path, n, CASE WHEN opens THEN b + 1 ELSE b END AS block, opens, marks > opens::INT AS closes, string_split(replace(line, '''''''', repeat('"', 3)), repeat('"', 3))[CASE WHEN opens THEN 2 ELSE 1 END] AS said FROM qc WHERE opens OR b % 2 = 1),
qe AS (SELECT path, block, bool_or(regexp_matches(said, '\S')) AS has, bool_or(regexp_matches(said, '(?i)todo|fixme|tbd')) AS todo FROM qt GROUP BY 1, 2 HAVING bool_or(closes) AND bool_or(opens)),
qf AS (SELECT d.path, d.n, CASE WHEN starts_with(d.bare, 'class ') THEN 'Class' ELSE 'Function' END AS kind, regexp_extract(d.bare, '^(?:async def |def |class )([^(:\s]*)', 1) AS name, CASE WHEN e.opens AND e.indent > d.indent THEN e.b + 1 END AS block FROM qd d LEFT JOIN qc e ON e.path = d.path AND e.n = d.nx WHERE d.b % 2 = 0 AND regexp_matches(d.bare, '^(def |async def |class )')),
qg AS (SELECT path, n, kind, name, CASE WHEN has IS NULL THEN 'missing' WHEN NOT has OR todo THEN 'incomplete' ELSE 'present' END AS state FROM qf LEFT JOIN qe USING (path, block)),
ca AS (SELECT *, regexp_matches(bare, '^//[/!]') AS slash FROM sb WHERE doc_id % 2 = 1 AND bare <> '' AND NOT starts_with(bare, '#[')), cb AS (SELECT *, NOT slash AND regexp_matches(bare, '\*/\s*$') AS fin, sum((NOT slash)::INT) OVER w AS run, sum((NOT slash AND regexp_matches(bare, '/\*[*!]'))::INT) OVER w AS blk,
CASE WHEN slash THEN regexp_replace(bare, '^/+!?', '') ELSE regexp_replace(bare, '/\*[*!]|\*/|^\*', '', 'g') END AS say FROM ca WINDOW w AS (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING)),
cc AS (SELECT *, regexp_matches(say, '\S') AS h, regexp_matches(say, '(?i)todo|fixme|tbd') AS td FROM cb),
cd AS (SELECT *, CASE WHEN slash THEN bool_or(h) OVER r WHEN fin AND blk > 0 THEN bool_or(h) OVER k END AS has, CASE WHEN slash THEN bool_or(td) OVER r WHEN fin AND blk > 0 THEN bool_or(td) OVER k END AS todo FROM cc WINDOW r AS (PARTITION BY path, run, slash ORDER BY n ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY path, blk ORDER BY n ROWS UNBOUNDED PRECEDING)),
ce AS (SELECT *, lag(has) OVER (PARTITION BY path ORDER BY n) AS ph, lag(todo) OVER (PARTITION BY path ORDER BY n) AS pt, regexp_extract(bare, '(?:^|\s)function\s+(\S+)', 1) AS fu, regexp_extract(bare, '(?:^|\s)class\s+(\S+)', 1) AS cl, regexp_extract(bare, '^(?:const|let|var)\s+([A-Za-z0-9_$]+)[^=]*=.*=>', 1) AS ar FROM cd),
cg AS (SELECT path, n, CASE WHEN fu <> '' THEN 'Function' WHEN cl <> '' THEN 'Class' ELSE 'Arrow' END AS kind, regexp_replace(CASE WHEN fu <> '' THEN fu WHEN cl <> '' THEN cl ELSE ar END, '[({].*$', '') AS name, CASE WHEN ph IS NULL THEN 'missing' WHEN NOT ph OR pt THEN 'incomplete' ELSE 'present' END AS state FROM ce WHERE (fu <> '' OR cl <> '' OR ar <> '') AND NOT regexp_matches(bare, '^(//|\*|/\*)')),
ds AS (SELECT * FROM qg UNION ALL SELECT * FROM cg)"""


@query(f"WITH {DOC_LINES} SELECT * FROM ds")
def doc_scan(spark, sf):
    """Definitions of the documents' lines and whether they are documented."""
    x = doc_lines(spark, sf)
    return docscan.quoted(x.filter("doc_id % 2 = 0").drop("doc_id")).unionByName(docscan.commented(x.filter("doc_id % 2 = 1").drop("doc_id")))


@query(f"WITH {DOC_LINES} SELECT path, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'incomplete') AS incomplete, count(*) FILTER (state = 'present') AS present FROM ds GROUP BY path")
def doc_scan_gaps(spark, sf):
    return docscan.gaps(doc_scan(spark, sf))


# ---- coverage reports, discovery, report tree ------------------------------------------------------------------------


def order_reports(spark, sf):
    """Each order as a coverage report of its lines, in five formats by turns; of every fifty orders two reports are cut off."""
    li = table(spark, sf, "lineitem")
    k, n, h = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long") % 5
    q = F.concat(F.lit("p"), F.col("l_suppkey") % 7, F.lit(".py"))
    say = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    condition = F.when(n % 3 == 0, ' branch="true" condition-coverage="50% (1/2)"').otherwise("")
    part = F.when(k % 5 == 0, say("SF:src/", q, "\nDA:", n, ",", h, "\nend_of_record\n")).when(k % 5 == 1, say('<class name="k" filename="./src/', q, '"><lines><line number="', n, '" hits="', h, '"', condition, "/></lines></class>"))
    part = part.when(k % 5 == 2, say('<sourcefile name="', q, '"><line nr="', n, '" mi="', n % 2, '" ci="', h, '" mb="0" cb="0"/></sourcefile>')).when(k % 5 == 3, say('{"path":["src","', q, '"],"traces":[{"line":', n, ',"stats":{"Line":', h, "}}]}")).otherwise(say('"', n, '":{"path":"src\\\\', q, '","l":{"', n, '":', h, "}}"))
    o = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(n, part.alias("part")))).alias("parts"))  # an order has seven lines at most
    sep = F.when(k % 5 >= 3, ",").otherwise("")
    body = F.when(k % 5 >= 3, F.expr("substr(body, 1, length(body) - 1)")).otherwise(F.col("body"))
    o = o.select("l_orderkey", F.array_join(F.transform("parts", lambda p: F.concat(p["part"], sep)), "").alias("body")).select("l_orderkey", body.alias("body"))
    text = F.when(k % 5 == 0, say("TN:\n", F.col("body"))).when(k % 5 == 1, say('<?xml version="1.0"?><coverage branch-rate="1"><packages><package name="a"><classes>', F.col("body"), "</classes></package></packages></coverage>"))
    text = text.when(k % 5 == 2, say('<?xml version="1.0"?><report name="r"><package name="src">', F.col("body"), "</package></report>")).when(k % 5 == 3, say('{"files":[', F.col("body"), "]}")).otherwise(say("{", F.col("body"), "}"))
    name = F.concat(F.lit("r/"), k, F.element_at(F.array(*[F.lit(x) for x in ("/lcov.info", "/cobertura.xml", "/jacoco.xml", "/t.json", "/i.json")]), (k % 5 + 1).cast("int")))
    whole = o.select("l_orderkey", name.alias("report"), text.alias("text"))
    return whole.select("report", F.when((k % 50).isin(1, 2), F.expr("substr(text, 1, length(text) - 12)")).otherwise(F.col("text")).alias("content"))


REPORT = "'r/' || l_orderkey || ['/lcov.info', '/cobertura.xml', '/jacoco.xml', '/t.json', '/i.json'][l_orderkey % 5 + 1]"
FORMAT = "['lcov', 'cobertura', 'jacoco', 'tarpaulin', 'istanbul'][l_orderkey % 5 + 1]"


@query(f"""WITH x AS (SELECT *, trunc(l_quantity)::BIGINT % 5 AS h FROM lineitem WHERE l_orderkey % 50 NOT IN (1, 2)), y AS (SELECT {REPORT} AS report, {FORMAT} AS format, 'src/p' || l_suppkey % 7 || '.py' AS file, l_linenumber::BIGINT AS line, CASE WHEN l_orderkey % 5 = 1 AND l_linenumber % 3 = 0 THEN greatest(h, 1) ELSE h END AS hits, l_orderkey % 5 = 2 AND l_linenumber % 2 = 1 AS missed FROM x)
SELECT report, format, file, line, max(hits) AS hits, bool_or(hits > 0 AND NOT missed) AS covered FROM y GROUP BY report, format, file, line""")
def coverage_reports(spark, sf):
    """Lines of coverage reports of five formats, read from their texts."""
    return reports.lines(order_reports(spark, sf))


@query(f"SELECT DISTINCT {REPORT} AS report, {FORMAT} AS format, 'damaged' AS reason FROM lineitem WHERE l_orderkey % 50 IN (1, 2)")
def coverage_report_failures(spark, sf):
    return reports.failures(order_reports(spark, sf))


def deep_files(spark, sf):
    """Customers as files of a tree that is up to ten folders deep."""
    k = F.col("c_custkey")
    bits = F.transform(F.sequence(F.lit(1), (k % 10 + 1).cast("int")), lambda i: F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "tmp", "gen")]), ((k / F.pow(F.lit(2), i)).cast("long") % 4 + 1).cast("int")), (k / F.pow(F.lit(3), i)).cast("long") % 2))
    end = F.element_at(F.array(*[F.lit(x) for x in (".py", ".log", ".md")]), (k % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.concat(F.array_join(bits, "/"), F.lit("/f"), k, end).alias("path"), k.alias("size"))


DEEP = """df AS (SELECT c_custkey AS k, array_to_string(list_transform(generate_series(1, c_custkey % 10 + 1), lambda i: ['a', 'b', 'tmp', 'gen'][trunc(c_custkey / pow(2, i))::BIGINT % 4 + 1] || (trunc(c_custkey / pow(3, i))::BIGINT % 2)), '/') AS dir FROM customer),
fi AS (SELECT k, dir, dir || '/f' || k || ['.py', '.log', '.md'][k % 3 + 1] AS path FROM df)"""


@query(f"""WITH {DEEP}, st AS (SELECT path, string_split(path, '/') AS ps FROM fi), en AS (SELECT DISTINCT path, array_to_string(ps[1:i], '/') AS step, i < len(ps) AS folder FROM (SELECT path, ps, unnest(generate_series(1, len(ps))) AS i FROM st)),
ru AS (SELECT * FROM (VALUES ('', 1, '(?:.*/)?[^/]*\\.log', FALSE, FALSE), ('', 2, '(?:.*/)?f[^/]*5\\.log', TRUE, FALSE), ('', 3, '(?:.*/)?tmp1', FALSE, TRUE), ('', 4, 'gen0/.*', FALSE, FALSE), ('', 5, 'gen0/a0', TRUE, FALSE)) AS v(dir, n, p, allow, fo)
UNION ALL SELECT d, 1, 'tmp0', FALSE, FALSE FROM (SELECT DISTINCT dir AS d FROM fi WHERE length(dir) <= 2) UNION ALL SELECT d, 2, '(?:.*/)?[^/]*7\\.md', FALSE, FALSE FROM (SELECT DISTINCT dir AS d FROM fi WHERE length(dir) <= 2)),
hit AS (SELECT DISTINCT step, folder, dir, n, allow FROM (SELECT DISTINCT step, folder FROM en) e JOIN ru ON (dir = '' OR starts_with(step, dir || '/')) AND (NOT fo OR folder) AND regexp_full_match(CASE WHEN dir = '' THEN step ELSE substr(step, length(dir) + 2) END, p)),
ve AS (SELECT step, arg_max(allow, len(string_split(dir, '/')) * 100 * (dir <> '')::INT + n) AS allow FROM hit GROUP BY step)
SELECT path, k AS size FROM fi WHERE NOT EXISTS (SELECT 1 FROM en JOIN ve USING (step) WHERE en.path = fi.path AND NOT ve.allow)""")
def ignored_files(spark, sf):
    """Files that the ignore rules of the root and of the highest folders leave."""
    f = deep_files(spark, sf)
    high = f.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).filter("length(dir) <= 2").distinct().select("dir", F.lit("/tmp0\n*7.md\n").alias("text"))
    root = spark.createDataFrame([("", "# rules\n*.log\n!f*5.log\ntmp1/\n\n/gen0/**\n!gen0/a0\n")], "dir string, text string")
    return files.not_ignored(f, files.ignore_rules(root.unionAll(high)))


_LEVELS = ", ".join(f"t{k} AS (SELECT d.path, coalesce(d.health, s / nullif(c, 0), 0) AS health, c AS children, d.health IS NULL AS computed FROM (SELECT d.path, d.health, coalesce(sum(x.health), 0) AS s, count(x.health) AS c FROM fo d LEFT JOIN (SELECT dir, health FROM fh{'' if k == 10 else f' UNION ALL SELECT regexp_replace(path, chr(47) || chr(63) || chr(91) || chr(94) || chr(47) || chr(93) || chr(42) || chr(36), {chr(39) * 2}), health FROM t{k + 1}'}) x ON x.dir = d.path AND x.health > 0 WHERE d.depth = {k} GROUP BY 1, 2) d)" for k in range(10, 0, -1))


@query(f"""WITH {DEEP}, fh AS (SELECT dir, (k % 11) / 10 AS health FROM fi), st AS (SELECT DISTINCT string_split(dir, '/') AS ps FROM fi), fp AS (SELECT DISTINCT array_to_string(ps[1:i], '/') AS path, i AS depth FROM (SELECT ps, unnest(generate_series(1, len(ps))) AS i FROM st)),
fo AS (SELECT path, depth, CASE WHEN strlen(path) % 4 = 0 THEN (strlen(path) % 7) / 7 END AS health FROM fp), {_LEVELS}
SELECT path, round(health, 6) AS health, children, computed FROM ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(1, 11))})""")
def report_tree(spark, sf):
    """Folders of the tree with their healths, those without one worked out from the leaves."""
    f = deep_files(spark, sf)
    own = f.select("path", ((F.col("size") % 11) / 10).alias("health"))
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    d = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    n = F.length("path")
    return rounded(health.folder_tree(d.select("path", F.when(n % 4 == 0, (n % 7) / 7).alias("health")), own))


@query(f"""WITH {GAPS}, sy AS (SELECT dg.path, start, stop, regexp_extract(x, '([A-Za-z0-9_]+)', 1) AS name FROM dg JOIN dl ON dl.path = dg.path AND line BETWEEN start AND start + 1), sn AS (SELECT path, start, stop, name, count(*) AS times FROM sy WHERE name <> '' GROUP BY 1, 2, 3, 4),
wo AS (SELECT path, line, unnest(regexp_extract_all(x, '([A-Za-z0-9_]+)', 1)) AS name FROM dl), oc AS (SELECT sn.path, start, stop, sn.name, max(times) AS times, count(line) FILTER (line NOT BETWEEN start AND stop) AS rest FROM sn LEFT JOIN wo ON wo.path = sn.path AND wo.name = sn.name GROUP BY 1, 2, 3, 4)
SELECT path, start, stop, greatest(sum(times * rest), sum(times))::BIGINT AS fan_in FROM oc GROUP BY 1, 2, 3""")
def gap_fan_in(spark, sf):
    """Fan-in of gaps: how often the first words of their first two lines stand elsewhere in the document."""
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "x")).select("path", (F.col("i") + 1).cast("long").alias("line"), "x")
    g = doc_gaps(spark, sf)
    at = g.select("path", "start", "stop", F.explode(F.array("start", F.col("start") + 1)).alias("line"))
    s = at.join(x, ["path", "line"]).select("path", "start", "stop", F.regexp_extract("x", "([A-Za-z0-9_]+)", 1).alias("name")).filter("name <> ''")
    return gaps.fan_in(s, x)


# ---- small ones -----------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT c_custkey // 3 AS grp, 'r' || n_regionkey || '/n' || n_nationkey || '/' || c_mktsegment || '/c' || c_custkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 1000000 + n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey || '/' || c_mktsegment || '/c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT grp, path, string_split(path, '/') AS ps, count(*) OVER (PARTITION BY grp) AS n FROM p), x AS (SELECT grp, n, path, i, array_to_string(ps[1:i], '/') AS pre FROM (SELECT *, unnest(generate_series(1, len(ps) - 1)) AS i FROM s)),
y AS (SELECT grp, pre, i FROM x GROUP BY grp, pre, i, n HAVING count(DISTINCT path) = n) SELECT p.grp, coalesce(max(y.folder), '') AS folder FROM (SELECT DISTINCT grp FROM p) p LEFT JOIN (SELECT grp, arg_max(pre, i) AS folder FROM y GROUP BY grp) y USING (grp) GROUP BY p.grp""")
def common_folders(spark, sf):
    """The deepest folder above the files of three neighbouring customers, and of each nation's."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    path = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/"), "c_mktsegment", F.lit("/c"), "c_custkey")
    groups = F.explode(F.array(F.floor(F.col("c_custkey") / 3).cast("long"), (F.col("n_nationkey") + 1000000).cast("long")))
    return layout.common_folder(c.select(groups.alias("grp"), path.alias("path")), "grp")


_MU, _S = scores.lognormal_parameters(2000, 6000)


@query(f"SELECT doc_id, round(CASE WHEN n_chars > 0 THEN greatest(0, least(1, 2000 / n_chars * exp(-0.5::DOUBLE * (pow(ln(n_chars) - {_MU!r}::DOUBLE, 2) - {_S**4!r}::DOUBLE) / {_S * _S!r}::DOUBLE))) ELSE 0 END, 6) AS score FROM documents")
def size_density(spark, sf):
    """How near each document's size is to the best one, as the density of sizes over that at its mode."""
    return table(spark, sf, "documents").select("doc_id", F.round(scores.lognormal_density(F.col("n_chars").cast("double"), 2000, 6000), 6).alias("score"))


@query("""WITH f AS (SELECT p_partkey AS uid, p_brand AS file, 'F' || p_size AS name, p_type || '::F' || p_size AS qualified, p_partkey % 40 AS line FROM part),
a AS (SELECT uid AS k, file, CASE uid % 3 WHEN 0 THEN name WHEN 1 THEN lower(name) ELSE 'f' || (uid % 60) END AS name, CASE uid % 3 WHEN 0 THEN qualified WHEN 1 THEN lower(qualified) ELSE 'other' END AS qualified, line FROM f)
SELECT a.k, a.file, a.name, a.qualified, a.line, coalesce((SELECT min(uid) FROM f WHERE f.file = a.file AND f.name = a.name AND f.qualified = a.qualified AND f.line = a.line), (SELECT min(uid) FROM f WHERE f.file = a.file AND lower(f.qualified) = lower(a.qualified)), (SELECT min(uid) FROM f WHERE f.file = a.file AND lower(f.name) = lower(a.name))) AS uid FROM a""")
def function_lookup(spark, sf):
    """Functions looked up by all they are named by, else in their file whatever the case."""
    k = F.col("p_partkey")
    name, line = F.concat(F.lit("F"), "p_size"), (k % 40).cast("long")
    f = table(spark, sf, "part").select(k.alias("uid"), F.col("p_brand").alias("file"), name.alias("name"), F.concat("p_type", F.lit("::F"), "p_size").alias("qualified"), line.alias("line"))
    u = F.col("uid")
    by = lambda a, b, c: F.when(u % 3 == 0, a).when(u % 3 == 1, b).otherwise(c)
    asked = f.select(u.alias("k"), "file", by(F.col("name"), F.lower("name"), F.concat(F.lit("f"), u % 60)).alias("name"), by(F.col("qualified"), F.lower("qualified"), F.lit("other")).alias("qualified"), "line")
    return dependency.metrics_for(asked, f)
