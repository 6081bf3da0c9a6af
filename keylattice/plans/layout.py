"""Layout reconstruction over word boxes: words(doc, page, text, x0, x1, top, bottom, upright)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.functions import text as T
from keylattice.sources.shared import tasks

LINE_GAP, STRIP_GAP, COLUMN_SLACK, BAND_GAP, BAND_PAD, MARK_TOLERANCE = 3.0, 5.0, 25.0, 15.0, 4.0, 7.0
HEADER_SPLIT, HEADER_GAP, LABEL_RIGHT, PROPERTY_GAP = 190.0, 20.0, 230.0, 10.0
# Fixed value: a footer's row and column ranges, with a few odd characters between its parts.
FOOTER = r"Zeile\D{0,3}(\d+)\s*-\s*(\d+)\D{1,8}Spalte\D{0,3}(\d+)\s*-\s*(\d+)"


def line_words(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """doc, page, line, top, ws (x0, text, x1, top): a word joins a line while its top is within `gap` of the line's
    first word.

    The anchor is the first word, not the last one, so ordered words are folded, those between two wide gaps of a page at a
    time. Words between two gaps that are all within `gap` of each other are one line, which needs no fold and no order.
    """
    page = Window.partitionBy("doc", "page")
    r = F.bround("top", 1)
    # Words this far apart are never in one line, whatever its anchor: a fold has a line or a few, not a page.
    apart = F.when(r - F.lag(r).over(page.orderBy(r)) > gap + 0.2, 1).otherwise(0)
    run = F.sum("_apart").over(page.orderBy(r).rowsBetween(Window.unboundedPreceding, 0))
    words = words.withColumn("_apart", apart).withColumn("_run", run)
    own = F.collect_list(F.struct("x0", "text", "x1", "top")).alias("all")
    runs = words.groupBy("doc", "page", "_run").agg(own, (F.bool_and(F.col("top").isNotNull()) & (F.max("top") - F.min("top") <= gap)).alias("flat"))
    placed = lambda w: F.struct(F.bround(w["top"], 1).alias("r"), w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text"), w["x1"].alias("x1"))
    word = lambda w: F.struct(*(w[c].alias(c) for c in ("x0", "text", "x1", "top")))
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("begins"))

    def step(acc, w):
        new = acc["anchor"].isNull() | (F.abs(w["top"] - acc["anchor"]) > gap)
        begins = F.when(new, F.array_append(acc["begins"], acc["i"])).otherwise(acc["begins"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(new, w["top"]).otherwise(acc["anchor"]).alias("anchor"), begins.alias("begins"))

    def cut(ordered):
        """The lines of ordered words."""
        begins = F.aggregate(ordered, start, step)["begins"]
        ends = F.concat(F.slice(begins, 2, F.size(ordered)), F.array(F.size(ordered)))
        return F.zip_with(begins, ends, lambda a, b: F.transform(F.slice(ordered, a + 1, b - a), word))

    # A list of one, so that the words are put in order once.
    folded = F.element_at(F.transform(F.array(F.sort_array(F.transform("all", placed))), cut), 1)
    parts = runs.select("doc", "page", "_run", F.when(F.col("flat"), F.array("all")).otherwise(folded).alias("lines"))
    before = F.coalesce(F.sum(F.size("lines")).over(page.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    each = parts.withColumn("before", before).select("doc", "page", "before", F.posexplode("lines").alias("at", "line"))
    return each.select("doc", "page", (F.col("before") + F.col("at")).alias("line"), F.array_min(F.transform("line", placed))["top"].alias("top"), F.sort_array("line").alias("ws"))


def paged(words: DataFrame, whole: bool = False) -> DataFrame:
    """doc, page, words: the words of each page as one list. Words that come so stay; with `whole`, pages of a document are dealt to one task."""
    if "words" in words.columns:
        return words
    if whole:
        words = words.repartition(tasks(words.sparkSession), "doc")
    return words.groupBy("doc", "page").agg(F.collect_list(F.struct(*(c for c in words.columns if c not in ("doc", "page")))).alias("words"))


def with_lines(pages: DataFrame, words: str = "words", gap: float = LINE_GAP) -> DataFrame:
    """`pages` with `lines`, a list of (line, top, text, ws) by the rule of `line_words`, from the list `words` of each page.

    A page is put in order and cut at wide gaps; a run that is within `gap` is one line, and only others are folded. A page is
    paper, so its words are few, and none of them is dealt out or sorted on its own.
    """
    word = lambda w: F.struct(*(w[c].alias(c) for c in ("x0", "text", "x1", "top")))
    # Whole numbers need no rounding, which goes through decimals.
    rounded = lambda x: F.when(F.rint(x) == x, x).otherwise(F.bround(x, 1))
    placed = lambda w: F.struct(rounded(w["top"]).alias("r"), w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text"), w["x1"].alias("x1"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("begins"))

    def cut(run):
        """The lines of a run that is no single line."""

        def step(acc, i):
            top = F.get(run, i)["top"]
            new = acc["anchor"].isNull() | (F.abs(top - acc["anchor"]) > gap)
            return F.struct(F.when(new, top).otherwise(acc["anchor"]).alias("anchor"), F.when(new, F.array_append(acc["begins"], i)).otherwise(acc["begins"]).alias("begins"))

        begins = F.aggregate(F.sequence(F.lit(0), F.size(run) - 1), start, step)["begins"]
        return F.element_at(F.transform(F.array(begins), lambda b: parted(run, b)), 1)

    def parted(ordered, begins):
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(ordered)))
        return F.zip_with(begins, ends, lambda a, b: F.slice(ordered, a + 1, b - a))

    # Rounding moves a word by less than 0.1 in all.
    flat = lambda run: F.coalesce(F.element_at(run, -1)["r"] - F.element_at(run, 1)["r"] <= gap - 0.2, F.lit(False))
    apart = lambda i: (i == 0) | (F.get("_o", i)["r"] - F.get("_o", i - 1)["r"] > gap + 0.2)
    out = pages.withColumn("_o", F.sort_array(F.transform(words, placed)))
    # No sequence of an empty page: it has no line.
    out = out.withColumn("_b", F.when(F.size("_o") > 0, F.filter(F.sequence(F.lit(0), F.size("_o") - 1), apart)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_runs", parted(F.col("_o"), F.col("_b")))
    folded = F.flatten(F.transform("_runs", lambda run: F.when(flat(run), F.array(run)).otherwise(cut(run))))
    out = out.withColumn("_lines", F.when(F.forall("_runs", flat), F.col("_runs")).otherwise(folded))
    held = F.transform("_lines", lambda run, i: F.struct(i.alias("line"), F.element_at(run, 1)["top"].alias("top"), F.sort_array(F.transform(run, word)).alias("ws")))
    out = out.withColumn("_held", held)
    lines = F.transform("_held", lambda v: F.struct(v["line"].alias("line"), v["top"].alias("top"), F.trim(joined(v["ws"])).alias("text"), v["ws"].alias("ws")))
    return out.withColumn("lines", lines).drop("_o", "_b", "_runs", "_lines", "_held")


def joined(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: w["text"]), " ")


def lines(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """doc, page, line, top, text of line_words."""
    return line_words(words, gap).select("doc", "page", "line", "top", joined(F.col("ws")).alias("text"))


def islands(df: DataFrame, keys: list[str], order: str, gap: float, name: str) -> DataFrame:
    """Numbers runs whose neighbours are at most `gap` apart, by the previous row."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def strips(words: DataFrame, gap: float = STRIP_GAP) -> DataFrame:
    """Rotated words by their x centre."""
    return islands(words.where("NOT upright").withColumn("xc", (F.col("x0") + F.col("x1")) / 2), ["doc", "page"], "xc", gap, "strip")


def column_of(x0: Column, anchors: list[float], slack: float = COLUMN_SLACK) -> Column:
    """The last column whose anchor, less some slack, is left of x0."""
    out = F.lit(0)
    for i, a in enumerate(anchors[1:], 1):
        out = F.when(x0 >= a - slack, i).otherwise(out)
    return out


def carry(rows: DataFrame, column: str) -> DataFrame:
    """Section headers hold until the next one, across pages of a document."""
    w = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def wrap(rows: DataFrame) -> DataFrame:
    """A line without a serial continues the row above; a reset line (is_break) ends it."""
    w = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.sum(F.when((F.col("serial") != "") | F.col("is_break"), 1).otherwise(0)).over(w)
    parts = rows.withColumn("row", starts).where("NOT is_break")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda s: s["text"]), " ")
    return parts.groupBy("doc", "row").agg(F.max("serial").alias("serial"), joined.alias("text")).where("serial <> ''")


def location_norm(x: Column) -> Column:
    return F.when(x.rlike(r"^[. ]*\z"), F.lit(None)).otherwise(x)


def header_id(x: Column, prefix: str = T.NUMBER_PREFIX) -> Column:
    """struct(number, name, serial) of `prefix n name / serial`, where the number, also in brackets behind any word, and the
    name may be missing."""
    pattern = rf"^\s*(?:\[\s*\S+\s+(\d+)\s*\]|(?:{prefix})\s+(\d+))?\s*(.*?)\s*/\s*(\S+)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))
    return F.struct(F.coalesce(part(1), part(2)).cast("int").alias("number"), part(3).alias("name"), part(4).alias("serial"))


def count_check(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """doc, parsed, stated, consistent."""
    n = rows.groupBy("doc").agg(F.count("*").alias("parsed"))
    return stated.join(n, "doc", "left").select("doc", F.coalesce("parsed", F.lit(0)).alias("parsed"), "stated", (F.coalesce("parsed", F.lit(0)) == F.col("stated")).alias("consistent"))


def orientation(votes: DataFrame) -> DataFrame:
    """doc, reversed from (doc, normal_ok, reversed_ok): cleanly valid reads decide; reversed wins ties."""
    return votes.groupBy("doc").agg((F.count_if("reversed_ok") >= F.count_if("normal_ok")).alias("reversed"))


def serial_band(words: DataFrame, gap: float = BAND_GAP, pad: float = BAND_PAD, keys: list[str] | None = None) -> DataFrame:
    """doc, page, low, high: the largest vertical cluster of serial-shaped words; on ties the lowest on the page."""
    keys = keys or ["doc", "page"]
    runs = islands(words, keys, "top", gap, "run").groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min("top").alias("first"), F.max("bottom").alias("last"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("first", "last"), F.struct("n", "first")).alias("b")).select(*keys, (F.col("b.first") - pad).alias("low"), (F.col("b.last") + pad).alias("high"))


def nearest_strip(marks: DataFrame, centres: DataFrame, tolerance: float = MARK_TOLERANCE) -> DataFrame:
    """Each mark with the nearest strip of its page, if that is within the tolerance.

    Marks and strips meet in cells of the tolerance's width, so only neighbours are compared.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    m = marks.withColumn("_c", F.explode(F.array(cell("x") - 1, cell("x"), cell("x") + 1)))
    near = m.join(centres.withColumn("_c", cell("xc")), ["doc", "page", "_c"]).where(F.abs(F.col("x") - F.col("xc")) <= tolerance)
    return near.groupBy("doc", "page", "mark").agg(F.min_by("strip", F.struct(F.abs(F.col("x") - F.col("xc")), "strip")).alias("strip"))


def footer(x: Column) -> Column:
    return F.struct(*(F.nullif(F.regexp_extract(x, FOOTER, i), F.lit("")).cast("int").alias(n) for i, n in enumerate(("row_from", "row_to", "col_from", "col_to"), 1)))


def assemble_pages(cells: DataFrame) -> DataFrame:
    """doc, index, value, conflict from (doc, page, start, i, value): the first page wins; others that differ conflict."""
    g = cells.withColumn("index", F.col("start") + F.col("i")).groupBy("doc", "index")
    return g.agg(F.min_by("value", "page").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def coverage(found: DataFrame, expected: DataFrame) -> DataFrame:
    n = found.groupBy("doc").agg(F.count_distinct("index").alias("n"))
    return expected.join(n, "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.col("expected").isNull() | (F.coalesce("n", F.lit(0)) == F.col("expected"))).alias("consistent"))


def native_columns(words: DataFrame, split: float = HEADER_SPLIT, gap: float = HEADER_GAP, widest: float = 16.0, label: str = "PERSONEN") -> DataFrame:
    """doc, page, strip, xc, raw, name of each rotated header: its words are stored backwards, from below to above.

    Above `split` stands the name. Below it stands the identifier, up to the first gap; what follows is another band.
    The strip of the axis label, and strips without name and identifier, are left out.
    """
    s = strips(words.where(F.col("x1") - F.col("x0") <= widest))
    low = s.where(F.col("top") >= split)
    w = Window.partitionBy("doc", "page", "strip").orderBy("top", "x0")
    cuts = F.sum(F.when(F.col("top") - F.lag("bottom").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = low.withColumn("_band", cuts).where("_band = 0").select("doc", "page", "strip", "top", "x0", "text")
    upward = lambda: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("up"), "x0", F.reverse("text").alias("text")))), lambda v: v["text"])
    raw = first.groupBy("doc", "page", "strip").agg(F.trim(F.array_join(upward(), "")).alias("raw"))
    name = s.where(F.col("top") < split).groupBy("doc", "page", "strip").agg(F.trim(F.array_join(upward(), " ")).alias("name"))
    out = s.groupBy("doc", "page", "strip").agg(F.avg("xc").alias("xc")).join(raw, ["doc", "page", "strip"], "left").join(name, ["doc", "page", "strip"], "left")
    out = out.withColumns({"raw": F.coalesce("raw", F.lit("")), "name": F.coalesce("name", F.lit(""))})
    return out.where(~F.upper("name").contains(label) & ((F.col("name") != "") | T.repair_serial(F.col("raw"))["valid"]))


def native_doors(words: DataFrame, left: float = LABEL_RIGHT, gap: float = PROPERTY_GAP, skip: tuple[str, ...] = ("NAME", "SCHLIESS", "Zeile", "Spalte")) -> DataFrame:
    """doc, page, line, yc, name of each row label left of `left`; a lone number behind a wide gap is another column's. Lines (with ws) stay as they are."""
    rows = (words if "ws" in words.columns else line_words(words.where("upright"))).withColumn("ws", F.filter("ws", lambda v: v["x0"] < left)).where(F.size("ws") > 0)
    last, before = F.element_at("ws", -1), F.try_element_at("ws", F.lit(-2))
    foreign = F.coalesce((F.size("ws") > 1) & last["text"].rlike(r"^\d+\z") & (last["x0"] - before["x1"] > gap), F.lit(False))
    rows = rows.withColumn("ws", F.when(foreign, F.slice("ws", 1, F.size("ws") - 1)).otherwise(F.col("ws"))).withColumn("name", F.trim(joined(F.col("ws"))))
    kept = ~F.col("name").rlike("|".join(skip)) & ~F.col("name").rlike(r"^[\d\s.]+\z") & (F.length("name") >= 3)
    centre = F.aggregate("ws", F.lit(0.0), lambda a, v: a + v["top"]) / F.size("ws")
    return rows.where(kept).select("doc", "page", "line", centre.alias("yc"), "name")


def native_bases(pages: DataFrame) -> DataFrame:
    """doc, axis, from, page, n, base of pages(doc, page, row_from, row_to, col_from, col_to, n_rows, n_cols).

    The columns of a range come from its first page that has any, the rows of a band from its leftmost page; base is
    how many stand before.
    """
    whole = pages.where("row_from IS NOT NULL AND col_from IS NOT NULL")
    cols = whole.where("n_cols > 0").groupBy("doc", F.lit("column").alias("axis"), F.col("col_from").alias("from"), F.col("col_to").alias("to")).agg(F.min_by(F.struct("page", F.col("n_cols").alias("n")), "page").alias("p"))
    rows = whole.groupBy("doc", F.lit("row").alias("axis"), F.col("row_from").alias("from"), F.col("row_to").alias("to")).agg(F.min_by(F.struct("page", F.col("n_rows").alias("n")), F.struct("col_from", "page")).alias("p"))
    w = Window.partitionBy("doc", "axis").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    out = cols.unionByName(rows).select("doc", "axis", "from", "to", "p.page", "p.n")
    return out.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))


def detect_format(words: DataFrame, list_marker: str, serial: str, least: int = 5) -> DataFrame:
    """doc, format: a list marker wins on the first page that has one; else a footer or enough rotated serials mean matrix."""
    is_list = F.bool_or(F.col("text").contains(list_marker))
    rotated = F.count_if(~F.col("upright") & F.col("text").rlike(serial))
    return words.groupBy("doc").agg(F.when(is_list, "list").when(F.bool_or(F.col("text").rlike(FOOTER)) | (rotated >= least), "matrix").otherwise("list").alias("format"))


def _words(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    x = (F.col("l_partkey") % 97).cast("double")
    return li.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.col("l_partkey").cast("string").alias("text"), x.alias("x0"), (x + 2).alias("x1"), (F.col("l_linenumber") * 2.0).alias("top"), (F.col("l_linenumber") * 2.0 + 1).alias("bottom"), (F.col("l_partkey") % 2 == 0).alias("upright"))


def _pages(spark, sf_dir) -> DataFrame:
    """Orders as documents, their lines as pages of a grid."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    at = lambda c, k, step: (F.col(c) % k * step).cast("int")
    row, col = at("p", 3, 10), at("s", 3, 20)
    return page.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), row.alias("row_from"), (row + 9).alias("row_to"), col.alias("col_from"), (col + 19).alias("col_to"), at("p", 7, 1).alias("n_rows"), at("s", 5, 1).alias("n_cols"))


_W = """WITH words AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc, 1 AS page, CAST(l_partkey AS VARCHAR) AS text, CAST(l_partkey % 97 AS DOUBLE) AS x0, l_linenumber * 2.0::DOUBLE AS top, l_partkey % 2 = 0 AS upright
FROM lineitem)\n"""

QUERIES = {
    "lay_lines": lambda s, d: lines(_words(s, d)),
    "lay_strips": lambda s, d: strips(_words(s, d)).groupBy("doc", "page", "strip").agg(F.count("*").alias("n")),
    "lay_col_of": lambda s, d: _words(s, d).select("doc", "text", column_of(F.col("x0"), [0.0, 40.0, 60.0, 90.0]).alias("col")),
    "lay_serial_band": lambda s, d: serial_band(_words(s, d), gap=2.5),
    "lay_loc_norm": lambda s, d: _words(s, d).select("doc", "text", location_norm(F.when(F.col("upright"), ". .").otherwise(F.col("text"))).alias("loc")),
    "lay_footer": lambda s, d: _words(s, d).select("text", footer(F.concat(F.lit("Zeile "), "text", F.lit("-9 ; Spalte 3-4"))).alias("f")).select("text", "f.*").distinct(),
    "lay_header_id": lambda s, d: _words(s, d).select("text", header_id(F.concat(F.lit("[K "), "text", F.lit("] Some Name / S"), "text")).alias("h")).select("text", "h.*").distinct(),
    "lay_count_check": lambda s, d: count_check(_words(s, d), _words(s, d).select("doc").distinct().withColumn("stated", F.lit(4).cast("long"))),
    "lay_pages": lambda s, d: assemble_pages(_words(s, d).select("doc", F.col("top").alias("page"), F.lit(10).alias("start"), F.floor(F.col("x0") / 50).cast("int").alias("i"), F.concat_ws("/", F.col("upright").cast("string")).alias("value")).distinct()).select("doc", "index", "conflict"),
    "j_mark_nearest": lambda s, d: nearest_strip(_words(s, d).where("upright").select("doc", "page", F.col("text").alias("mark"), F.col("x0").alias("x")), strips(_words(s, d)).groupBy("doc", "page", "strip").agg(F.avg("xc").alias("xc"))),
    "lay_native_cols": lambda s, d: native_columns(_words(s, d), split=9.0, gap=2.0).select("doc", "strip", "raw", "name"),
    "lay_native_doors": lambda s, d: native_doors(_words(s, d), left=60.0).select("doc", "line", "name"),
    "lay_native_geom": lambda s, d: native_bases(_pages(s, d)),
    "src_detect_format": lambda s, d: detect_format(_words(s, d), "77", r"^\d{3}$"),
}
ORACLE_SQL = {
    "lay_strips": _W + """SELECT doc, page, strip, count(*) AS n FROM (SELECT doc, page, sum(CASE WHEN d <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY x0 ROWS UNBOUNDED PRECEDING) - 1 AS strip FROM (
SELECT *, x0 - lag(x0) OVER (PARTITION BY doc, page ORDER BY x0) AS d FROM words WHERE NOT upright)) GROUP BY 1, 2, 3""",
    "lay_col_of": _W + "SELECT doc, text, CASE WHEN x0 >= 65 THEN 3 WHEN x0 >= 35 THEN 2 WHEN x0 >= 15 THEN 1 ELSE 0 END AS col FROM words",
    "lay_loc_norm": _W + "SELECT doc, text, CASE WHEN NOT upright THEN text END AS loc FROM words",
    "lay_footer": _W + "SELECT DISTINCT text, CAST(text AS INTEGER) AS row_from, 9 AS row_to, 3 AS col_from, 4 AS col_to FROM words",
    "lay_header_id": _W + "SELECT DISTINCT text, CAST(text AS INTEGER) AS number, 'Some Name' AS name, 'S' || text AS serial FROM words",
    "lay_count_check": _W + "SELECT doc, count(*) AS parsed, CAST(4 AS BIGINT) AS stated, count(*) = 4 AS consistent FROM words GROUP BY 1",
    "lay_pages": _W + "SELECT doc, CAST(10 + floor(x0 / 50) AS INTEGER) AS \"index\", count(DISTINCT upright) > 1 AS conflict FROM words GROUP BY 1, 2",
    "lay_native_geom": """WITH g AS (SELECT l_orderkey AS doc, l_linenumber AS page, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
k AS (SELECT doc, page, p % 3 * 10 AS r, s % 3 * 20 AS c, p % 7 AS nr, s % 5 AS nc FROM g),
o AS (SELECT doc, 'column' AS axis, c AS "from", c + 19 AS "to", min(page) AS page, arg_min(nc, page) AS n FROM k WHERE nc > 0 GROUP BY 1, 2, 3, 4
UNION ALL SELECT doc, 'row', r, r + 9, arg_min(page, (c, page)), arg_min(nr, (c, page)) FROM k GROUP BY 1, 2, 3, 4)
SELECT doc, axis, CAST("from" AS INTEGER) AS "from", CAST("to" AS INTEGER) AS "to", page, CAST(n AS INTEGER) AS n, CAST(coalesce(sum(n) OVER (PARTITION BY doc, axis ORDER BY "from", "to" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM o""",
    "src_detect_format": _W + "SELECT doc, CASE WHEN bool_or(contains(text, '77')) THEN 'list' WHEN count(*) FILTER (NOT upright AND regexp_full_match(text, '[0-9]{3}')) >= 5 THEN 'matrix' ELSE 'list' END AS format FROM words GROUP BY 1",
}
