from tallgrass.sources import reports

COB = '<?xml version="1.0"?>\n<!-- c --><coverage branch-rate="0.1"><packages><package name="a.b"><classes><class name="K" filename="k.py"><methods><method name="m"><lines><line number="7" hits="2"/></lines></method></methods><lines><line number="1" hits="0" branch="true" condition-coverage="50% (1/2)"/><line number="2" hits="0" branch="true"/><line number="2" hits="3"/><line number="x" hits="1"/></lines></class></classes></package></packages></coverage>'
PY = '<?xml version="1.0"?><coverage line-rate="1"><packages><package name="p"><classes><class filename=".\\src\\m.py"><lines><line number="4" hits="1"/></lines></class></classes></package></packages></coverage>'
JAC = '<?xml version="1.0"?><report name="r"><group name="g"><package name="x/y"><sourcefile name="Z.java"><line nr="3" mi="0" ci="2" mb="0" cb="1"/><line nr="4" mi="1" ci="2" mb="0" cb="0"/></sourcefile></package></group><package name="q.r"><sourcefile name="W.kt"><line nr="1" mi="2" ci="0" cb="0"/></sourcefile></package></report>'
LCOV = "TN:\nSF:./src/a.c\nDA:1,5\nDA:2,0\nend_of_record\nSF:src/a.c\nDA:2,1\nDA:bad\nend_of_record\n"
TAR = '{"files":[{"path":["src","lib.rs"],"traces":[{"line":3,"stats":{"Line":2}},{"line":4,"stats":{}}]},{"path":"src/one.rs","traces":[{"line":1,"stats":{"Line":0}}]}]}'
IST = '{"a.js":{"path":"a.js","statementMap":{"0":{"start":{"line":2}},"1":{"start":{"line":5}}},"s":{"0":3}},"b.js":{"file":"b.js","l":{"1":4,"2":0}},"deep":{"list":[{"url":"c.js","lines":[1,null,0]}]}}'
ROWS = [("r/cov.xml", COB), ("r/coverage.xml", PY), ("r/jac.xml", JAC), ("r/lcov.info", LCOV), ("r/t.json", TAR), ("r/i.json", IST), ("r/none", None), ("r/empty", ""), ("r/what.txt", "hello"), ("r/bad-cobertura.xml", COB[:-9]), ("r/bad.json", "{oops"), ("r/bad2.json", TAR[:-4]), ("r/odd.xml", "<?xml version='1.0'?><html/>")]


def test_reports(spark):
    df = spark.createDataFrame(ROWS, "report string, content string")
    kinds = {r.report: r.format for r in reports.sniffed(df).collect()}
    assert kinds == {"r/cov.xml": "cobertura", "r/coverage.xml": "coverage.py", "r/jac.xml": "jacoco", "r/lcov.info": "lcov", "r/t.json": "tarpaulin", "r/i.json": "istanbul", "r/none": "unknown", "r/empty": "unknown", "r/what.txt": "unknown", "r/bad-cobertura.xml": "cobertura", "r/bad.json": "istanbul", "r/bad2.json": "tarpaulin", "r/odd.xml": "unknown"}
    got = {(r.report[2:], r.file, r.line): (r.hits, r.covered) for r in reports.lines(df).collect() if "bad" not in r.report}
    assert got == {
        ("cov.xml", "a/b/k.py", 1): (1, True), ("cov.xml", "a/b/k.py", 2): (3, True), ("cov.xml", "a/b/k.py", 7): (2, True), ("coverage.xml", "./src/m.py", 4): (1, True),
        ("jac.xml", "x/y/Z.java", 3): (3, True), ("jac.xml", "x/y/Z.java", 4): (2, False), ("jac.xml", "q/r/W.kt", 1): (0, False),
        ("lcov.info", "src/a.c", 1): (5, True), ("lcov.info", "src/a.c", 2): (1, True),
        ("t.json", "src/lib.rs", 3): (2, True), ("t.json", "src/lib.rs", 4): (0, False), ("t.json", "src/one.rs", 1): (0, False),
        ("i.json", "a.js", 2): (3, True), ("i.json", "a.js", 5): (0, False), ("i.json", "b.js", 1): (4, True), ("i.json", "b.js", 2): (0, False), ("i.json", "c.js", 1): (1, True), ("i.json", "c.js", 3): (0, False),
    }
    bad = {r.report[2:]: r.reason for r in reports.failures(df).collect()}
    assert bad == {"none": "unknown format", "empty": "unknown format", "what.txt": "unknown format", "odd.xml": "unknown format", "bad-cobertura.xml": "damaged", "bad.json": "damaged", "bad2.json": "damaged"}
