from tallgrass.operators import docscan

PY = '''def a():
    """Says."""
class B(object):
    # a comment

    r\'\'\'
    \'\'\'
    def c(self):
        """First line
        todo: more
        def not_one():
        """
    async def d(self):
        return 1
    def e(self): pass
"""def f():
"""
def g():
"""not further in"""
def h():
    x = 1
    """late"""
def last():
    """never closed
'''
TS = '''/** Says. */
export function one(a) {
/**
 * TODO
 */
class Two {
/// slashed
///
const three = (x) => x;
/***/

function four() {}
// plain
let five = async () => 1
#[attr]
/** ok */
#[other]
var six = y => y
* class not { }
'''


def test_both_styles(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.ts", TS), ("c.md", PY), ("d.py", None), ("e.js", ""), ("f.py", "def x(): pass\r\nclass Y:\r\n  '''d'''")], "path string, text string")
    got = {(r.path, r.name): (r.n, r.kind, r.state) for r in docscan.scanned(files).collect()}
    want = {("a.py", "a"): (1, "Function", "present"), ("a.py", "B"): (3, "Class", "incomplete"), ("a.py", "c"): (8, "Function", "incomplete"), ("a.py", "d"): (13, "Function", "missing"), ("a.py", "e"): (15, "Function", "missing"), ("a.py", "g"): (18, "Function", "missing"), ("a.py", "h"): (20, "Function", "missing"), ("a.py", "last"): (23, "Function", "missing")}
    want |= {("b.ts", "one"): (2, "Function", "present"), ("b.ts", "Two"): (6, "Class", "incomplete"), ("b.ts", "three"): (9, "Arrow", "present"), ("b.ts", "four"): (12, "Function", "incomplete"), ("b.ts", "five"): (14, "Arrow", "missing"), ("b.ts", "six"): (18, "Arrow", "present")}
    want |= {("f.py", "x"): (1, "Function", "missing"), ("f.py", "Y"): (2, "Class", "present")}
    assert got == want
    g = {r.path: (r.missing, r.incomplete, r.present) for r in docscan.gaps(docscan.scanned(files)).collect()}
    assert g == {"a.py": (5, 2, 1), "b.ts": (1, 2, 3), "f.py": (1, 0, 1)}
