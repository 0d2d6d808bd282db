"""Call edges resolved from names, and the sizes and affinities from which files are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.session import written

#: Receivers that name the own scope.
OWN = ("self", "this", "cls", "super")


def call_segments(raw: Column) -> Column:
    """Lower-case segments of a call: up to the bracket, split on what is not part of a name, without a leading own scope."""
    parts = F.filter(F.split(F.lower(F.regexp_extract(raw, r"^([^(]*)", 1)), r"[^a-z0-9_#]+"), lambda w: w != "")
    return F.when(F.get(parts, 0).isin(*OWN), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def suffixes(parts: Column) -> Column:
    """All suffixes of a list of segments, joined by ``::``, the longest first."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: i <= F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


#: Lines of a step of distance, steps after which distance counts no more.
STEP, STEPS = 25, 16
#: What a caller and a function may have in common: nothing, the last part of the namespace, all of it, each also with the file.
RELATIONS = tuple((file, space) for file in (False, True) for space in ("", "last", "all"))


def _relations(file: Column, space: Column) -> Column:
    """Array of (rel, file, space), one for each kind of relation that the place can have."""
    text, none, last = F.lit(None).cast("string"), F.array().cast("array<string>"), F.try_element_at(space, F.lit(-1))
    of = [F.struct(F.lit(k).alias("rel"), (file if f else text).alias("file"), {"": none, "last": F.array(last), "all": space}[s].alias("space")) for k, (f, s) in enumerate(RELATIONS)]
    able = [(file.isNotNull() if f else F.lit(True)) & {"": F.lit(True), "last": last.isNotNull(), "all": space.isNotNull()}[s] for f, s in RELATIONS]
    return F.filter(F.array(*[F.when(ok, x) for ok, x in zip(able, of)]), lambda x: x.isNotNull())


def _nearest(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, raw, key, dst): of each kind of relation with the functions under a call's key, the function of the least step of distance.

    index (dst, key, full, d_file, space, d_line) and asked (uid, raw, key, s_file, space, s_line). Of equal steps the last by
    file, line and dst is taken, as call_edges has it. Functions of a key are held once for each of their lines, callers
    once for each of theirs, so no call meets all functions of its name.
    """
    on = lambda x: F.struct(F.col("key"), x, "r.rel", "r.file", "r.space").alias("g")
    top = F.struct("d_file", "d_line", "dst")
    # one row for a place and line first, then one for each relation it can have, those of the whole qualified name also on their own
    held = index.groupBy("key", "full", "d_file", "space", "d_line").agg(F.max("dst").alias("dst"))
    held = held.withColumn("r", F.explode(_relations(F.col("d_file"), F.col("space")))).withColumn("whole", F.explode(F.array_distinct(F.array(F.lit(False), "full"))))
    lines = written(held.select(on(F.col("whole").alias("full")), F.col("d_line").alias("line"), top.alias("top")).groupBy("g", "line").agg(F.max("top").alias("top")), "lines")
    best = lines.groupBy("g").agg(F.max("top").alias("top"))
    wants = asked.withColumn("r", F.explode(_relations(F.col("s_file"), F.col("space")))).withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True))))
    wants = written(wants.select("uid", "raw", "key", on(F.col("whole").alias("full")), F.col("s_line").alias("line")), "wants")
    places = wants.select("g", "line").distinct().join(best.select("g").hint("merge"), "g", "left_semi").filter("line is not null")
    # the nearest lines before and after each caller's line
    both = lines.filter("line is not null").select("g", "line", F.col("line").alias("at")).unionAll(places.select("g", "line", F.lit(None).cast(dict(lines.dtypes)["line"]).alias("at")))
    tasks = 4 * index.sparkSession.sparkContext.defaultParallelism  # few bytes, but much work for each
    both = both.repartition(tasks, "g")
    w = Window.partitionBy("g")
    # both run from their first row, as a frame that ends at the last would be added up anew for each row
    up, down = w.orderBy("line").rangeBetween(Window.unboundedPreceding, 0), w.orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, 0)
    away = F.least(F.col("line") - F.max("at").over(up), F.min("at").over(down) - F.col("line"))
    steps = both.withColumn("step", F.floor(away / STEP)).filter("at is null and step is not null").select("g", "line", "step").filter(F.col("step") < STEPS)
    near, far = F.col("step") * STEP, F.col("step") * STEP + STEP - 1
    lookup = steps.select("g", F.col("line").alias("s_line"), F.explode(F.array_distinct(F.concat(F.sequence(F.col("line") - far, F.col("line") - near), F.sequence(F.col("line") + near, F.col("line") + far)))).alias("line"))
    lookup = lookup.repartition(tasks, "g", "line")
    met = lookup.join(lines.hint("merge"), ["g", "line"]).groupBy("g", F.col("s_line").alias("line")).agg(F.max("top").alias("top"))
    picked = wants.join(met.hint("merge"), ["g", "line"]).select("uid", "raw", "key", F.col("top.dst").alias("dst"))
    # where all are far away, as one whose line is not known is, the last of all
    return picked.unionAll(wants.join(best.hint("merge"), "g").select("uid", "raw", "key", F.col("top.dst").alias("dst"))).distinct()


def call_edges(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions (uid, name, namespace, file, line) and calls (uid, raw) -> distinct edges (src, dst).

    A call's keys are the suffixes of its segments; a function has its name and all suffixes of its qualified name. The
    longest key that meets a function wins, and under it the best candidate: itself 120 (only under its own name), the
    whole qualified name 100, a suffix of it 75, the name 40; namespace 50; file 20; same namespace 15, same last part 8;
    15 less one for each 25 lines, up to 400, away. Of equal ones the last by file, line and uid is taken.

    Under a key a score depends on what caller and function have in common and on their distance alone. So the nearest
    function of each kind of relation is looked up, the caller itself is added, and these few are scored. Functions whose
    name or namespace holds ``::`` are all scored. Joins are by sorting: functions and calls are made from few columns of a
    small file, so Spark takes them for smaller than they are and would broadcast them by way of the driver.
    """
    parts = F.concat(F.transform("namespace", lambda n: F.lower(n)), F.array(F.lower("name")))
    f = functions.select("uid", "name", "namespace", "file", "line", parts.alias("parts"))
    index = f.select(F.col("uid").alias("dst"), F.lower("name").alias("d_name"), F.col("namespace").alias("d_space"), F.col("file").alias("d_file"), F.col("line").alias("d_line"), F.array_join("parts", "::").alias("qualified"), F.exists("parts", lambda x: F.contains(x, F.lit("::"))).alias("odd"), F.explode(suffixes(F.col("parts"))).alias("key"))
    segs = calls.select("uid", "raw", call_segments(F.col("raw")).alias("segs")).filter(F.size("segs") > 0)
    asked = segs.select("uid", "raw", F.array_join("segs", "::").alias("whole"), F.element_at("segs", -1).alias("base"), F.slice("segs", 1, F.size("segs") - 1).alias("space"), F.posexplode(suffixes(F.col("segs"))).alias("rank", "key"))
    own = f.select("uid", F.col("namespace").alias("s_space"), F.col("file").alias("s_file"), F.col("line").alias("s_line"))
    lower = lambda c: F.transform(c, lambda n: F.lower(n))
    plain, odd = index.filter("odd is null or not odd"), index.filter("odd")
    known = asked.join(plain.select("key").distinct().hint("merge"), "key", "left_semi")
    known = known.groupBy("uid", "raw").agg(F.min_by("key", "rank").alias("key")).join(own.hint("merge"), "uid")
    found = _nearest(plain.select("dst", "key", (F.col("qualified") == F.col("key")).alias("full"), "d_file", lower("d_space").alias("space"), "d_line"), known.select("uid", "raw", "key", "s_file", lower("s_space").alias("space"), "s_line"))
    few = found.unionAll(known.join(plain.select(F.col("dst").alias("uid"), "key").hint("merge"), ["uid", "key"]).select("uid", "raw", "key", F.col("uid").alias("dst"))).distinct()
    met = asked.join(few.hint("merge"), ["uid", "raw", "key"]).join(plain.hint("merge"), ["key", "dst"]).select(*asked.columns, *[c for c in index.columns if c != "key"])
    met = met.unionAll(asked.join(odd.hint("merge"), "key").select(met.columns)).join(own.hint("merge"), "uid")
    selfcall = F.col("uid") == F.col("dst")
    ends = (F.size("space") > 0) & (F.size("space") <= F.size("d_space")) & (F.slice(lower("d_space"), F.greatest(F.size("d_space") - F.size("space") + 1, F.lit(1)), F.size("space")) == F.col("space"))
    name = F.when(F.col("qualified") == F.col("whole"), 100).when(F.endswith(F.concat(F.lit("::"), "whole"), F.concat(F.lit("::"), "qualified")), 75).when(F.col("d_name") == F.col("base"), 40).otherwise(0)
    near = F.when(lower("s_space") == lower("d_space"), 15).when(F.lower(F.element_at("s_space", -1)) == F.lower(F.element_at("d_space", -1)), 8).otherwise(0)
    away = 15 - F.floor(F.least(F.abs(F.col("s_line") - F.col("d_line")), F.lit(400)) / 25)
    score = F.when(selfcall, 120).otherwise(0) + name + F.when(ends, 50).otherwise(0) + F.when(F.col("s_file") == F.col("d_file"), 20).otherwise(0) + near + away
    scored = met.filter(~selfcall | (F.col("base") == F.col("d_name"))).select("uid", "raw", "dst", F.struct((-F.col("rank")).alias("r"), score.alias("s"), "d_file", "d_line", "dst").alias("order"))
    best = scored.groupBy("uid", "raw").agg(F.max_by("dst", "order").alias("dst"))
    return best.select(F.col("uid").alias("src"), "dst").distinct()


def import_tokens(files: DataFrame) -> DataFrame:
    """(path, text) -> path and tokens: a quarter of the bytes."""
    return files.select("path", F.floor(F.octet_length("text") / 4).cast("long").alias("tokens"))


def affinity(pairs: DataFrame) -> DataFrame:
    """(a, b, path_a, path_b, imports_a, imports_b): twice the common folders over the deeper depth, plus the imports' Jaccard similarity."""
    p = pairs.withColumns({"x": F.split("path_a", "/"), "y": F.split("path_b", "/")})
    same = F.zip_with("x", "y", lambda u, v: F.coalesce((u == v).cast("int"), F.lit(0)))
    common = F.aggregate(same, F.struct(F.lit(1).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] * e).alias("on"), (s["n"] + s["on"] * e).alias("n")), lambda s: s["n"])
    union = F.size(F.array_union("imports_a", "imports_b"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("imports_a", "imports_b")) / union).otherwise(0.0)
    return p.select("a", "b", (2 * common / F.greatest(F.size("x"), F.size("y"), F.lit(1)) + jaccard).alias("affinity"))


def crossing(edges: DataFrame, slices: DataFrame) -> DataFrame:
    """Edges (src, dst) between slices (node, slice), by slice."""
    a, b = slices.select(F.col("node").alias("src"), F.col("slice").alias("a")), slices.select(F.col("node").alias("dst"), F.col("slice").alias("b"))
    return edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").groupBy(F.col("a").alias("slice")).agg(F.count_if(F.col("a") != F.col("b")).alias("crossing"), F.count("*").alias("edges"))


def modules(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roll-up of (node, path, choke, cyclic) and edges to files: functions, greatest choke, any cycle, edges in and out (own ones too)."""
    per = nodes.groupBy("path").agg(F.count("*").alias("functions"), F.max("choke").alias("max_choke"), F.bool_or("cyclic").alias("cyclic"))
    a, b = nodes.select(F.col("node").alias("src"), F.col("path").alias("sp")), nodes.select(F.col("node").alias("dst"), F.col("path").alias("dp"))
    e = edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    out, into = e.groupBy(F.col("sp").alias("path")).agg(F.count("*").alias("fan_out")), e.groupBy(F.col("dp").alias("path")).agg(F.count("*").alias("fan_in"))
    zero = F.lit(0).cast("long")
    return per.join(out.hint("merge"), "path", "left").join(into.hint("merge"), "path", "left").select("path", "functions", "max_choke", "cyclic", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def best_rank(found: DataFrame, key: str) -> DataFrame:
    """Of several targets (key, target, rank) the one of least rank, then name."""
    w = Window.partitionBy(key).orderBy("rank", "target")
    return found.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def metrics_for(asked: DataFrame, metrics: DataFrame) -> DataFrame:
    """asked (file, name, qualified, line) with the uid of the function in metrics (uid, file, name, qualified, line) that it means; null if none.

    The function of the same file, names and line; else one of the same file whose qualified name, or else whose name, is
    equal but for case: of several the least uid. Each step is an equi-join whose right side has one row a key.
    """
    def one(columns: dict[str, Column], rank: str) -> DataFrame:
        return metrics.select(*[c.alias(f"_{k}") for k, c in columns.items()], "uid").groupBy(*[f"_{k}" for k in columns]).agg(F.min("uid").alias(rank))

    out, ranks = asked, []
    lower = {"file": F.col("file"), "qualified": F.lower("qualified")}
    for rank, columns in (("exact", {k: F.col(k) for k in ("file", "name", "qualified", "line")}), ("by_path", lower), ("by_name", {"file": F.col("file"), "name": F.lower("name")})):
        right, on = one(columns, rank), None
        for k, c in columns.items():
            hit = c == F.col(f"_{k}")
            on = hit if on is None else on & hit
        out = out.join(right, on, "left").drop(*[f"_{k}" for k in columns])
        ranks.append(F.col(rank))
    return out.select(*asked.columns, F.coalesce(*ranks).alias("uid"))
