"""Documentation of definitions found in source lines, by a scanner whose state is carried along lines by windows.

Lines are (path, n, line), n ascending within a path. Everything is a window over one file's lines or an aggregate by
file and block; no file is brought together as a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Marks of an unfinished text, in any case.
UNFINISHED = r"(?i)todo|fixme|tbd"
MISSING, INCOMPLETE, PRESENT = "missing", "incomplete", "present"


def _file() -> WindowSpec:
    return Window.partitionBy("path").orderBy("n")


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lines_of(files: DataFrame) -> DataFrame:
    """(path, text) -> path, n (from 1), line. A null text has no lines."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("n"), "line")


def quoted(lines: DataFrame) -> DataFrame:
    """Definitions followed by a text in triple quotes: path, n, kind, name, state, for def, async def and class lines.

    A line is within quotes if an odd number of triple quotes stands before it in its file; definitions there are part
    of a text and passed over. A definition's text is the next line that is neither blank nor a comment, if it is further
    in than the definition and begins with triple quotes (letters may stand before them) that are closed somewhere. It
    is incomplete if it is blank or holds a mark of an unfinished text, on any of its lines.
    """
    bare = F.ltrim("line")
    mark = r"\"\"\"|'''"
    x = lines.withColumn("bare", bare).withColumn("indent", F.length("line") - F.length(bare)).withColumn("marks", F.regexp_count("line", F.lit(mark)))
    before = F.coalesce(F.sum("marks").over(_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("before", before).withColumn("within", before % 2 == 1)
    # the text that a line belongs to is numbered by the mark that opens it; of a line with several the last open one
    opens = ~F.col("within") & F.col("bare").rlike(rf"^[A-Za-z]*({mark})")
    x = x.withColumn("opens", opens).withColumn("block", F.when(opens, F.col("before") + 1).when(F.col("within"), F.col("before")))
    parts = F.split("line", mark, 3)
    said = F.when(opens, F.get(parts, 1)).when(F.col("within"), F.get(parts, 0))
    t = x.filter("block is not null").select("path", "n", "block", "opens", said.alias("said"), (F.col("marks") > F.when(F.col("opens"), 1).otherwise(0)).alias("closes"))
    block = t.groupBy("path", "block").agg(F.max(F.trim("said") != "").alias("has"), F.max(F.col("said").rlike(UNFINISHED)).alias("todo"), F.bool_or("closes").alias("closed"), F.bool_or("opens").alias("opened")).filter("closed and opened")
    significant = (F.col("bare") != "") & ~F.startswith("bare", F.lit("#"))
    following = F.first(F.when(significant, F.struct("indent", "opens", F.col("before").alias("b"))), ignorenulls=True).over(_file().rowsBetween(1, Window.unboundedFollowing))
    d = x.withColumn("next", following).filter(~F.col("within") & F.col("bare").rlike("^(def |async def |class )"))
    kind = F.when(F.startswith("bare", F.lit("class ")), "Class").otherwise("Function")
    name = F.regexp_extract("bare", r"^(?:async def |def |class )([^(:\s]*)", 1)
    own = F.when(F.col("next.opens") & (F.col("next.indent") > F.col("indent")), F.col("next.b") + 1)
    d = d.select("path", "n", kind.alias("kind"), name.alias("name"), own.alias("block")).join(block.select("path", "block", "has", "todo"), ["path", "block"], "left")
    state = F.when(F.col("has").isNull(), MISSING).when(~F.col("has") | F.col("todo"), INCOMPLETE).otherwise(PRESENT)
    return d.select("path", "n", "kind", "name", state.alias("state"))


def commented(lines: DataFrame) -> DataFrame:
    """Definitions that a comment stands before: path, n, kind, name, state, for functions, classes and arrow functions.

    The comment is what ends on the last line before the definition that is not blank (nor an attribute, ``#[``): a run of
    lines that begin with three slashes, or a block that began with ``/**``. A block is said by its lines without the
    stars and slashes around them.
    """
    bare = F.ltrim("line")
    x = lines.withColumn("bare", bare).filter((F.trim("bare") != "") & ~F.startswith("bare", F.lit("#[")))
    slash = F.col("bare").rlike("^//[/!]")
    begins, ends = F.col("bare").rlike(r"/\*[*!]"), F.rtrim("bare").endswith("*/")
    x = x.withColumns({"slash": slash, "ends": ends & ~slash, "begins": begins & ~slash})
    # a run of slashed lines is named by the number of other lines before it, a block by the number of blocks begun
    x = x.withColumn("run", F.sum((~F.col("slash")).cast("long")).over(_so_far(_file()))).withColumn("blocks", F.sum(F.col("begins").cast("long")).over(_so_far(_file())))
    # what has been said so far in the run or the block
    content = F.when(F.col("slash"), F.regexp_replace("bare", "^/+!?", "")).otherwise(F.regexp_replace("bare", r"/\*[*!]|\*/|^\*", ""))
    x = x.withColumn("has", (F.trim(content) != "").cast("int")).withColumn("todo", content.rlike(UNFINISHED).cast("int"))
    of_run = _so_far(Window.partitionBy("path", "run", "slash").orderBy("n"))
    of_block = _so_far(Window.partitionBy("path", "blocks").orderBy("n"))
    said = F.when(F.col("slash"), F.struct(F.max("has").over(of_run).alias("has"), F.max("todo").over(of_run).alias("todo"))).when(F.col("ends") & (F.col("blocks") > 0), F.struct(F.max("has").over(of_block).alias("has"), F.max("todo").over(of_block).alias("todo")))
    x = x.withColumn("said", said).withColumn("doc", F.lag("said").over(_file()))
    function = F.regexp_extract("bare", r"(?:^|\s)function\s+(\S+)", 1)
    klass = F.regexp_extract("bare", r"(?:^|\s)class\s+(\S+)", 1)
    arrow = F.regexp_extract("bare", r"^(?:const|let|var)\s+([A-Za-z0-9_$]+)[^=]*=.*=>", 1)
    kind = F.when(function != "", "Function").when(klass != "", "Class").when(arrow != "", "Arrow")
    name = F.regexp_replace(F.when(function != "", function).when(klass != "", klass).otherwise(arrow), r"[({].*$", "")
    state = F.when(F.col("doc").isNull(), MISSING).when((F.col("doc.has") == 0) | (F.col("doc.todo") == 1), INCOMPLETE).otherwise(PRESENT)
    comment = F.col("bare").rlike(r"^(//|\*|/\*)")
    return x.filter(kind.isNotNull() & ~comment).select("path", "n", kind.alias("kind"), name.alias("name"), state.alias("state"))


def scanned(files: DataFrame) -> DataFrame:
    """(path, text) -> path, n, kind, name, state of the definitions of .py files and of .ts, .tsx, .js and .jsx files; others have none."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return quoted(lines_of(files.filter(ext == "py"))).unionByName(commented(lines_of(files.filter(ext.isin("ts", "tsx", "js", "jsx")))))


def gaps(found: DataFrame) -> DataFrame:
    """path, missing, incomplete, present, of every file with a definition."""
    return found.groupBy("path").agg(*[F.count_if(F.col("state") == s).alias(s) for s in (MISSING, INCOMPLETE, PRESENT)])
