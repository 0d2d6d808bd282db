"""Imports against a look-up in a dictionary, rule by rule."""

from tallgrass.operators import imports

FILES = ["src/core/config.rs", "src/core/mod.rs", "src/lib.rs", "src/util/io.py", "web/app.ts", "src/web/view.tsx", "pkg/db/store.go", "a.py", "src/core/sub/deep.rs", "src/core/sub/mod.rs"]


def keys():
    out = {}

    def put(k, p):
        out[k] = min(p, out.get(k, p))

    for p in FILES:
        bare = next((p[: -len(e)] for e in (".rs", ".py", ".js", ".ts", ".tsx", ".jsx", ".go") if p.endswith(e)), p)
        up = p.rpartition("/")[0]
        for m in [bare] + ([up] if p.endswith("mod.rs") else []):
            m = (m[4:] if m.startswith("src/") else m).replace("/", "::")
            for k in (m, m.replace("::", "."), "crate::" + m, "crate." + m.replace("::", ".")):
                put(k, p)
        stem = p.rpartition("/")[2].rpartition(".")[0]
        if stem not in ("mod", "lib", "main"):
            put(stem, p)
        if p.endswith((".ts", ".tsx", ".js", ".jsx")):
            put("./" + (bare[4:] if bare.startswith("src/") else bare), p)
        if p.endswith(".py"):
            put(bare.replace("/", "."), p)
        if p.endswith(".go"):
            put(up, p)
    return out


def answer(name, path, known):
    def module(x):
        return (x[4:] if x.startswith("src/") else x).replace("/", "::")

    up = path.rpartition("/")[0]
    if name.startswith("super::") and up:
        name = module(up.rpartition("/")[0]) + "::" + name[7:]
    elif name.startswith("self::"):
        name = module(up) + "::" + name[6:]
    n = name.replace("::", ".").replace("/", ".").lstrip(".")
    parts = n.split(".")
    for end in range(len(parts), 0, -1):
        for k in (".".join(parts[:end]), "::".join(parts[:end])):
            if k in known:
                return known[k]
    if len(parts) == 1:
        for k in (f"{up}.{parts[0]}", f"{module(up)}::{parts[0]}"):
            if k in known:
                return known[k]
    return known.get(parts[-1])


def test_resolved(spark):
    names = ["crate::core::config::Config", "core::config", "core.config.X", "super::config", "super::core::sub", "self::config", "self::sub::deep::f", "util.io", "src.util.io", "./web/app", "./web/view", "../web/app", "pkg/db", "config", "sub", "deep", "store", "unknown.thing", "unknown.config", "mod", "lib", "", "crate", "..config", "a"]
    asked = [(p, n) for p in FILES for n in names] + [("a.py", None), ("a.py", "config"), ("a.py", "config")]
    got = {(r.path, r.name): r.target for r in imports.resolved(spark.createDataFrame(asked, "path string, name string"), spark.createDataFrame([(f,) for f in FILES], "path string")).collect()}
    known = keys()
    want = {(p, n): answer(n, p, known) for p, n in asked if n is not None}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_edges(spark):
    e = imports.import_edges(spark.createDataFrame([("a.py", "a"), ("a.py", "util.io"), ("src/lib.rs", "core")], "path string, name string"), spark.createDataFrame([(f,) for f in FILES], "path string"))
    assert {(r.src, r.dst) for r in e.collect()} == {("a.py", "src/util/io.py"), ("src/lib.rs", "src/core/mod.rs")}
