"""The queries of the corpus operators, by the tables they read, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import decontam, idstore, licenses, lines, manifest, packing, pieces, pii, quality, repair, simhash, substrings, urls
from tallgrass.llm._common import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, field)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(licenses.sample_lines(docs)))
    return found.withColumn("probability", F.round("probability", 6)).withColumn("similarity", F.round("similarity", 6))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/idstore-{uuid.uuid4().hex}"
    idstore.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return idstore.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 9))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.round_trip(table(spark, sf_dir, "documents"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    found = manifest.manifest(table(spark, sf_dir, "documents"), changed=tampered)
    again = manifest.folded(F.col("other"), F.col("proof"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root"), (again == F.col("root")).alias("verified"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations"))).drop("n_repaired")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_substring_dedup, op4_packing, op5_personal_data, op6_id_store, op7_simhash_near_dedup, op8_benchmark_decontamination, op9_line_dedup, op10_url_filter, op11_piece_codec, op12_merkle_manifest, op13_conversation_repair)}
_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(v, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t FROM (SELECT unnest(range(256)) AS v))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
ORACLE_SQL: dict[str, str] = {
    # level by level; the CRC by its table of 256 entries
    "op12_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT *, cast(doc_id AS VARCHAR) AS s FROM documents),
{_CRC_TABLE},
z AS (SELECT d.*, {_CRC} % 5 = 0 AS hit FROM d, crc),
y AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM z),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS bad FROM
(SELECT *, coalesce(strlen(s) || ':' || s, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM y)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT source, 0 AS level, i, leaf AS h, n FROM p UNION ALL SELECT source, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, level, i // 16, n),
sub AS (SELECT source, h AS subroot, level AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, subroot AS h, n FROM sub UNION ALL SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, i // 16, n),
root AS (SELECT h AS root FROM u WHERE n = 1),
st AS (SELECT source, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt, n FROM t WINDOW w AS (PARTITION BY source, level, i // 16 ORDER BY i)),
su AS (SELECT level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt, n FROM u WINDOW w AS (PARTITION BY level, i // 16 ORDER BY i)),
f AS (SELECT p.doc_id, p.source, p.leaf, p.i, p.n > 1 AS inner_, 0 AS level, p.i AS at, bad AS h, '' AS sib FROM p
UNION ALL SELECT f.doc_id, f.source, f.leaf, f.i, st.n > 16, f.level + 1, f.at // 16, sha256(st.lft || f.h || st.rgt), f.sib || st.lft || st.rgt FROM f JOIN st ON st.source IS NOT DISTINCT FROM f.source AND st.level = f.level AND st.i = f.at WHERE f.inner_),
g AS (SELECT f.doc_id, f.leaf, f.i AS id, sub.subroot, sub.n > 1 AS inner_, 0 AS level, sub.i AS at, f.h, f.sib, f.source FROM f JOIN sub ON sub.source IS NOT DISTINCT FROM f.source WHERE NOT f.inner_
UNION ALL SELECT g.doc_id, g.leaf, g.id, g.subroot, su.n > 16, g.level + 1, g.at // 16, sha256(su.lft || g.h || su.rgt), g.sib || su.lft || su.rgt, g.source FROM g JOIN su ON su.level = g.level AND su.i = g.at WHERE g.inner_)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified FROM g, root WHERE NOT inner_""",
    # row by row: of each state the cheapest edits, with up to two insertions before each row and at the end
    "op13_conversation_repair": f"""WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS s FROM conversations),
k AS (SELECT o.*, {_CRC} % 20 AS k FROM o, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS two, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM n),
g AS (SELECT conv_id, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
ins AS MATERIALIZED (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 0, 1, '', []::VARCHAR[]), (2, 0, 2, '', []::VARCHAR[]), (3, 0, 3, '', []::VARCHAR[]), (0, 5, 2, 'I', ['user:']), (1, 5, 2, 'I', ['user:']), (3, 5, 2, 'I', ['user:']), (2, 5, 3, 'I', ['assistant:']),
(0, 10, 3, 'II', ['user:', 'assistant:']), (1, 10, 3, 'II', ['user:', 'assistant:']), (3, 10, 3, 'II', ['user:', 'assistant:'])) AS v(state, c, s, e, ls)),
step AS MATERIALIZED (SELECT * FROM (VALUES (0, 's', 1, 'K'), (0, 'u', 2, 'K'), (1, 'u', 2, 'K'), (2, 'a', 3, 'K'), (3, 'u', 2, 'K'), (0, NULL, 2, 'R'), (1, NULL, 2, 'R'), (3, NULL, 2, 'R'), (2, NULL, 3, 'R'), (0, NULL, 0, 'D'), (1, NULL, 1, 'D'), (2, NULL, 2, 'D'), (3, NULL, 3, 'D')) AS v(s, r, s2, e2)),
b AS (SELECT conv_id, 0 AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS ls FROM g UNION ALL
SELECT conv_id, i, state, cast(substr(best, 1, 9) AS INT), substr(best, 10), ls FROM (SELECT b.conv_id, b.i + 1 AS i, s2 AS state, min(way) AS best, arg_min(lines, way) AS ls FROM (SELECT b.conv_id, b.i, s2, lpad(cast(cost + c + CASE e2 WHEN 'D' THEN 2 ELSE (e2 = 'R')::INT + CASE fault WHEN 3 THEN 5 ELSE 0 END END AS VARCHAR), 9, '0') || audit || e || e2 AS way,
b.ls || ins.ls || CASE e2 WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END AS lines
FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN ins ON ins.state = b.state JOIN step ON step.s = ins.s AND (e2 <> 'K' OR step.r = f.r) AND (e2 = 'D' OR fault IN (0, 3))) AS b GROUP BY b.conv_id, b.i, s2)),
z AS (SELECT b.conv_id, min(lpad(cast(cost + c AS VARCHAR), 9, '0') || audit || e) AS best, arg_min(array_to_string(b.ls || ins.ls, chr(10)), lpad(cast(cost + c AS VARCHAR), 9, '0') || audit || e) AS whole
FROM b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = m JOIN ins ON ins.state = b.state AND ins.s IN (0, 3) GROUP BY b.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cast(substr(best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id""",
    # every window of 20 words by its text; a word goes if one of the 20 windows that hold it also starts earlier
    "op3_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM d),
k AS (SELECT doc_id, j, word, md5(string_agg(word, ' ') OVER o) AS g, count(*) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT g, min((doc_id, j)) AS first FROM k WHERE c = 20 GROUP BY g), h AS (SELECT k.doc_id, j, word, coalesce(c = 20 AND (k.doc_id, j) > first, FALSE) AS again FROM k LEFT JOIN f USING (g)),
r AS (SELECT doc_id, j, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM h),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)""",
    # the same join in SQL: sets of words, prefixes by rarity, exact similarity
    "op9_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct({_WORDS.format('line')})) AS ws FROM l), t AS MATERIALIZED (SELECT * FROM s WHERE len(ws) > 0),
u AS MATERIALIZED (SELECT ws, len(ws) AS n, row_number() OVER (ORDER BY first) AS id, first FROM (SELECT ws, min((doc_id, i)) AS first FROM t GROUP BY ws)),
e AS MATERIALIZED (SELECT id, n, unnest(ws) AS word FROM u), c AS (SELECT word, count(*) AS c FROM e GROUP BY 1),
p AS MATERIALIZED (SELECT id, n, word FROM (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS k FROM e JOIN c USING (word)) WHERE k <= n - (4 * n + 4) // 5 + 1),
q AS (SELECT DISTINCT a.id, b.id AS y FROM p a JOIN p b ON a.word = b.word AND a.id > b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (SELECT DISTINCT q.id FROM q JOIN u a ON a.id = q.id JOIN u b ON b.id = q.y WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
m AS (SELECT t.doc_id, t.i, (t.doc_id, t.i) <> first AS later, v.id IS NOT NULL AS near FROM t JOIN u ON u.ws = t.ws LEFT JOIN v ON v.id = u.id),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS n_equal, count(*) FILTER (near AND NOT later) AS n_near, coalesce(string_agg(i, ',' ORDER BY i) FILTER (later OR near), '') AS removed FROM m GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed FROM documents LEFT JOIN g USING (doc_id)""",
}
