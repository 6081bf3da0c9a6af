"""Mark classification over cells(doc, col, row, w, h, px array of grey values 0 to 255), with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Thresholds of ink and structure.
DARK, INK_NONE, CENTRE_REMOVE, INK_ACTIVE = 100, 0.06, 0.30, 0.45
EMPTY, CENTRE_X, SOLID_X, DIAGONAL_X, INK_X, DIAGONAL_THIN, FAINT, BINARY, LEAST_SIDE = 0.12, 0.45, 0.15, 0.15, 0.35, 0.05, 0.20, 128, 8
HATCHED_SHARE, FAINT_SHOWN, LINE_MERGE = 0.8, 8, 8
RULING, BLANK = 0.80, 0.02


def ink(px: Column, below: int = DARK) -> Column:
    return F.size(F.filter(px, lambda p: p < below)) / F.greatest(F.size(px), F.lit(1))


def classify_native(ink_share: Column, centre: Column, include_removed: bool = False) -> Column:
    """none, active, planned or remove from the share of ink and the ink at the centre."""
    hollow = F.lit("remove" if include_removed else "none")
    return F.when(ink_share < INK_NONE, "none").when(centre < CENTRE_REMOVE, hollow).when(ink_share >= INK_ACTIVE, "active").otherwise("planned")


def classify_cell(grey: Column, centre: Column, solid: Column, diagonal: Column, share: Column, side: Column) -> Column:
    """empty, x, faint or hatch."""
    cross = (centre >= CENTRE_X) & (solid >= SOLID_X) & ((diagonal >= DIAGONAL_X) | ((share < INK_X) & (diagonal >= DIAGONAL_THIN)))
    return F.when((side < LEAST_SIDE) | (grey < EMPTY), "empty").when(cross, "x").when(share < FAINT, "faint").otherwise("hatch")


def hatched_columns(cells: DataFrame) -> DataFrame:
    """doc, col of columns that are crossed out: at least 80 % of their cells are hatched."""
    return cells.groupBy("doc", "col").agg(F.avg((F.col("kind") == "hatch").cast("double")).alias("share")).where(F.col("share") >= HATCHED_SHARE).select("doc", "col")


def faint_report(cells: DataFrame, shown: int = FAINT_SHOWN) -> DataFrame:
    """doc, n, first: faint cells are reported, never counted as marks."""
    f = cells.where("kind = 'faint'").groupBy("doc")
    return f.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("col", "row"))), 1, shown).alias("first"))


def long_lines(projections: DataFrame, share: float = 0.5, merge: int = LINE_MERGE) -> DataFrame:
    """doc, line, low, high from (doc, band, pos, ink): positions inked in every band, merged when close."""
    full = projections.groupBy("doc", "pos").agg(F.min("ink").alias("least")).where(F.col("least") >= share)
    w = Window.partitionBy("doc").orderBy("pos")
    runs = full.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) < merge, 0).otherwise(1)).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy("doc", "line").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))


def centre_band(rows: DataFrame, ruling: float = RULING, blank: float = BLANK) -> DataFrame:
    """key, low, high from (key, h, pos, ink), the share of ink in each pixel row of a cell: rulings are taken out, and
    of the bands of inked rows the one nearest the vertical centre stays, the upper one on ties."""
    inked = rows.where((F.col("ink") < ruling) & (F.col("ink") > blank))
    w = Window.partitionBy("key").orderBy("pos")
    runs = inked.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(w) == 1, 0).otherwise(1)).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = runs.groupBy("key", "band").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.max("h").alias("h"))
    off = F.abs((F.col("low") + F.col("high")) / 2 - F.col("h") / 2)
    return bands.groupBy("key").agg(F.min_by(F.struct("low", "high"), F.struct(off, "low")).alias("b")).select("key", "b.low", "b.high")


def serial_vote(reads: DataFrame) -> DataFrame:
    """key, serial, suspect from (key, serial, valid, suspect): the most frequent valid read, clean ones first on ties."""
    valid = reads.where("valid").groupBy("key", "serial").agg(F.count("*").alias("n"), F.bool_and("suspect").alias("suspect"))
    best = valid.groupBy("key").agg(F.max_by(F.struct("serial", "suspect"), F.struct("n", ~F.col("suspect"), "serial")).alias("b"), F.count("*").alias("kinds"))
    return best.select("key", F.col("b.serial").alias("serial"), (F.col("b.suspect") | (F.col("kinds") > 1)).alias("suspect"))


def _cells(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("col"), F.col("l_partkey").alias("row"), (F.col("l_quantity") / 50).alias("ink"), (F.col("l_discount") * 10).alias("centre"), "l_tax").distinct()


_C = "WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS col, l_partkey AS row, l_quantity / 50 AS ink, l_discount * 10 AS centre, l_tax FROM lineitem)\n"
_R = "WITH r AS (SELECT l_suppkey AS key, l_partkey AS pos, max(l_quantity / 50) AS ink FROM lineitem GROUP BY 1, 2)\n"
_K = "CASE WHEN ink < 0.12 THEN 'empty' WHEN centre >= 0.45 AND ink >= 0.15 AND (l_tax >= 0.15 OR (ink < 0.35 AND l_tax >= 0.05)) THEN 'x' WHEN ink < 0.2 THEN 'faint' ELSE 'hatch' END"


def _kinds(spark, sf_dir) -> DataFrame:
    c = _cells(spark, sf_dir)
    return c.withColumn("kind", classify_cell(F.col("ink"), F.col("centre"), F.col("ink"), F.col("l_tax"), F.col("ink"), F.lit(20)))


def _pixel_rows(spark, sf_dir) -> DataFrame:
    """Suppliers as cells, part keys as pixel rows."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("pos")).agg(F.max(F.col("l_quantity") / 50).alias("ink")).withColumn("h", F.lit(200))


QUERIES = {
    "cls_native": lambda s, d: _cells(s, d).select("doc", "col", "row", "ink", "centre", "l_tax", classify_native(F.col("ink"), F.col("centre"), True).alias("state")),
    "cls_cell": lambda s, d: _kinds(s, d),
    "cls_hatched_col": lambda s, d: hatched_columns(_kinds(s, d)),
    "cls_faint": lambda s, d: faint_report(_kinds(s, d)).select("doc", "n"),
    "cls_center_band": lambda s, d: centre_band(_pixel_rows(s, d)),
    "cls_long_lines": lambda s, d: long_lines(_pixel_rows(s, d).select(F.col("key").alias("doc"), (F.col("pos") % 2).alias("band"), F.floor(F.col("pos") / 2).alias("pos"), "ink"), merge=2),
    "cls_serial_vote": lambda s, d: serial_vote(_kinds(s, d).select(F.col("doc").alias("key"), "col", F.col("kind").alias("serial"), F.lit(True).alias("valid"), (F.col("kind") == "faint").alias("suspect"))),
}
ORACLE_SQL = {
    "cls_native": _C + "SELECT *, CASE WHEN ink < 0.06 THEN 'none' WHEN centre < 0.30 THEN 'remove' WHEN ink >= 0.45 THEN 'active' ELSE 'planned' END AS state FROM c",
    "cls_cell": _C + f"SELECT *, {_K} AS kind FROM c",
    "cls_hatched_col": _C + f"SELECT doc, col FROM c GROUP BY 1, 2 HAVING avg(CASE WHEN {_K} = 'hatch' THEN 1.0 ELSE 0.0 END) >= 0.8",
    "cls_faint": _C + f"SELECT doc, count(*) AS n FROM c WHERE {_K} = 'faint' GROUP BY 1",
    "cls_center_band": _R + """, i AS (SELECT *, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS g FROM r WHERE ink < 0.8 AND ink > 0.02), b AS (SELECT key, g, min(pos) AS low, max(pos) AS high FROM i GROUP BY 1, 2)
SELECT key, low, high FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs((low + high) / 2 - 100), low) = 1""",
    "cls_long_lines": _R + """, f AS (SELECT key AS doc, pos // 2 AS pos FROM r GROUP BY 1, 2 HAVING min(ink) >= 0.5), n AS (SELECT *, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS g FROM f)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY min(pos)) - 1 AS line, min(pos) AS low, max(pos) AS high FROM n GROUP BY doc, g""",
    "cls_serial_vote": _C + f""", v AS (SELECT doc AS key, {_K} AS serial, count(*) AS n, {_K} = 'faint' AS suspect FROM c GROUP BY 1, 2, 4)
SELECT key, serial, suspect OR kinds > 1 AS suspect FROM (SELECT *, count(*) OVER (PARTITION BY key) AS kinds, row_number() OVER (PARTITION BY key ORDER BY n DESC, suspect, serial DESC) AS r FROM v) WHERE r = 1""",
}
