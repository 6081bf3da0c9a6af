"""Files as tables: format routes, and the semicolon matrix export, where a cell's place is its meaning."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.functions import text as T
from keylattice.sources.domain import Domain
from keylattice.sources.shared import hashed, places, settled, spread

# The suffixes of images, and the places in the matrix export.
IMAGES = "png jpg jpeg tif tiff bmp webp".split()
SERIAL_ROW, FIRST_DOOR, FIRST_MARK = 5, 6, 8
AREA, SERIAL, NAME, SITE, BUILDING, FLOOR, ROOM = range(1, 8)
LEAST_PREFIX = 4
#: Cells that a file's reader hands on at once.
CELLS = 50_000


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGES) + r")\z")


def route(path: Column, found: Column | None = None) -> Column:
    """image, csv, backup, matrix or list: by suffix, and for others by the format that was found in their words."""
    by_suffix = F.when(is_image(path), "image").when(F.lower(path).endswith(".csv"), "csv").when(F.lower(path).endswith(".json"), "backup")
    return by_suffix.otherwise(F.coalesce(found, F.lit("list")) if found is not None else F.lit("list"))


def collect_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of files, globs and folders; a file that several of them name is there once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "content").dropDuplicates(["path"])


def csv_cells(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """doc, r, c, text, error of every non-blank cell of UTF-16 files (path, length, content).

    A file may come in pieces, rows of one path with `first_column` and `rows`: a piece has the cells of its rows, a line each, from its first
    column on; what no piece has is blank. A file or piece that can't be read, or has more than `max_bytes` if that is given, is one row
    with an error; the others are not touched. Empty files have no row. A whole file is read twice as a stream: to its end, to know that
    it is whole, and then cell by cell.
    """
    parts = "rows" in files.columns
    chosen = files.select("path", "length", "content", *(("first_column", "rows") if parts else (F.lit(0).alias("first_column"), F.lit(None).cast("array<int>").alias("rows"))))

    def lines(content: bytes) -> Iterator[list[str]]:
        return csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-16", newline=None), delimiter=";")

    def table(path: str, rs: list, cs: list, texts: list, error: str | None = None) -> pa.RecordBatch:
        n = len(rs)
        columns = [pa.array([path] * n, pa.string()), pa.array(rs, pa.int32()), pa.array(cs, pa.int32()), pa.array(texts, pa.string()), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "r", "c", "text", "error"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for at in range(batch.num_rows):
                path, length, content, first, rows = (column[at].as_py() for column in batch.columns)
                content = content or b""
                try:
                    if max_bytes is not None and length > max_bytes:
                        raise ValueError(f"{length} bytes are more than {max_bytes}")
                    held = list(lines(content)) if content and rows is not None else []
                    if len(held) != len(rows or ()) and content:
                        raise ValueError(f"a piece of {len(rows)} rows has {len(held)} lines")
                    for _ in lines(content) if content and rows is None else ():
                        pass
                except (UnicodeError, csv.Error, ValueError) as e:
                    yield table(path, [None], [None], [None], str(e))
                    continue
                rs, cs, texts = [], [], []
                for r, line in enumerate(lines(content) if content else ()) if rows is None else zip(rows, held, strict=False):
                    for c, cell in enumerate(line, first):
                        if cell and (text := cell.strip()):
                            rs.append(r)
                            cs.append(c)
                            texts.append(text)
                    if len(rs) >= CELLS:
                        yield table(path, rs, cs, texts)
                        rs, cs, texts = [], [], []
                yield table(path, rs, cs, texts)

    return chosen.mapInArrow(read, "doc string, r int, c int, text string, error string")


def csv_matrix(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, doors, marks) of csv_cells: (doc, ci, serial), (doc, ri, serial, door_name, room_number, location,
    area) and (doc, ci, ri). Columns without a serial and rows without a name don't count, nor do files with an error in any piece."""
    n = cells.count()
    # As a table of its own, it has a size that Spark knows: few such files are broadcast, and the cells stay where they are.
    faulty = settled(cells.where("error IS NOT NULL").select("doc").distinct())
    good = cells.where("error IS NULL").join(faulty, "doc", "left_anti")
    columns = places(good.where((F.col("r") == SERIAL_ROW) & (F.col("c") >= FIRST_MARK)).select("doc", "c", F.col("text").alias("serial")), "doc", "c", "ci")
    # Rows are numbered by their names alone. A row's texts are put together where all of its cells are, so that they are put in order
    # once: `max` of texts sorts what it groups, before the shuffle too.
    body = good.where(F.col("r") >= FIRST_DOOR)
    at = places(body.where((F.col("c") == NAME) & (F.col("text") != "")).select("doc", "r").distinct(), "doc", "r", "ri")
    cell = lambda c: F.coalesce(F.max(F.when(F.col("c") == c, F.col("text"))), F.lit(""))
    meta = spread(body.where(F.col("c").between(AREA, ROOM)).select("doc", "r", "c", "text"), n, "doc", "r").join(at, ["doc", "r"])
    meta = meta.groupBy("doc", "r").agg(F.max("ri").alias("ri"), *(cell(c).alias(f"m{c}") for c in range(AREA, ROOM + 1)))
    cut = lambda c, n: F.left(T.collapse_ws(F.col(f"m{c}")), F.lit(n))
    location = F.left(T.location_concat(F.col(f"m{SITE}"), F.col(f"m{BUILDING}"), T.collapse_ws(F.col(f"m{FLOOR}"))), F.lit(64))
    named = meta.select("doc", "r", F.col(f"m{SERIAL}").alias("serial"), cut(NAME, 255).alias("door_name"), cut(ROOM, 64).alias("room_number"), location.alias("location"), cut(AREA, 64).alias("area"), "ri")
    columns, doors = settled(columns), settled(named)
    crosses = good.where((F.col("r") >= FIRST_DOOR) & (F.col("c") >= FIRST_MARK) & (F.lower("text") == "x")).select("doc", "r", "c")
    crosses = crosses.join(hashed(columns.select("doc", "c", "ci")), ["doc", "c"]).select("doc", "r", "ci")
    marks = spread(crosses, n, "doc", "r").join(doors.select("doc", "r", "ri"), ["doc", "r"]).select("doc", "ci", "ri")
    return columns.drop("c"), doors.drop("r"), marks


def align_errors(columns: DataFrame, doors: DataFrame, other_columns: DataFrame, other_doors: DataFrame) -> DataFrame:
    """doc, error: why two readings of one matrix can't be joined by position; no row for a doc means they can.

    other_columns(doc, ci, serial) and other_doors(doc, ri, door_name) are the second reading, whose names may be cut.
    """
    pairs = columns.alias("x").join(other_columns.alias("y"), ["doc", "ci"], "full")
    serials = pairs.where(~F.col("x.serial").eqNullSafe(F.col("y.serial"))).select("doc", F.lit("columns differ").alias("error"))
    a, b = doors.select("doc", "ri", "serial", T.align_key(F.col("door_name")).alias("a")), other_doors.select("doc", "ri", T.align_key(F.col("door_name")).alias("b"))
    rows = a.join(b, ["doc", "ri"], "full")
    n = F.least(F.length("a"), F.length("b"))
    count = rows.where("a IS NULL OR b IS NULL").select("doc", F.lit("row counts differ").alias("error"))
    order = rows.where((n < LEAST_PREFIX) | (F.left("a", n) != F.left("b", n))).select("doc", F.lit("rows are out of order").alias("error"))
    blank = doors.where("serial = ''").select("doc", F.lit("a row has no serial").alias("error"))
    twice = doors.where("serial <> ''").groupBy("doc", "serial").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit("a serial is there twice").alias("error"))
    return serials.union(count).union(order).union(blank).union(twice).distinct()


def positional_grants(columns: DataFrame, doors: DataFrame, marks: DataFrame, states: DataFrame, errors: DataFrame) -> DataFrame:
    """doc, principal, resource, state: the export's crosses with the state (doc, ci, ri, state) that the other
    reading has at their place: active if it has none, planned for all but active. Docs with an error are left out."""
    ok = marks.join(errors.select("doc").distinct(), "doc", "left_anti").join(states.groupBy("doc", "ci", "ri").agg(F.min("state").alias("seen")), ["doc", "ci", "ri"], "left")
    named = ok.join(columns.select("doc", "ci", F.col("serial").alias("principal")), ["doc", "ci"]).join(doors.select("doc", "ri", F.col("serial").alias("resource")), ["doc", "ri"])
    return named.select("doc", "principal", "resource", F.when(F.coalesce("seen", F.lit("active")) == "active", "active").otherwise("planned").alias("state")).distinct()


def rebuilt(domain: Domain, columns: DataFrame, doors: DataFrame, marks: DataFrame, persons: DataFrame, other_doors: DataFrame, states: DataFrame) -> tuple[Domain, DataFrame]:
    """(domain, errors) after a matrix export, the complete truth of its system, replaces all principals and resources.

    persons(doc, ci, serial, number, person_name), other_doors and states are the second reading of the same matrix. Unless
    both agree, there are errors and the domain stays as it is. Groups stay, but nobody belongs to them and they hold nothing;
    removed and desired sets are gone with the old principals.
    """
    errors = align_errors(columns, doors, persons.select("doc", "ci", "serial"), other_doors)
    wrong = errors.agg((F.count("*") > 0).alias("wrong"))  # one row

    def chosen(old: DataFrame, new: DataFrame) -> DataFrame:
        """`new`, or `old` where there are errors; both are read, so that the choice is part of the plan."""
        return old.crossJoin(wrong).where("wrong").drop("wrong").unionByName(new.crossJoin(wrong).where("NOT wrong").drop("wrong"), allowMissingColumns=True)

    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    principal = columns.select("doc", "ci", "serial").join(persons.select("doc", "ci", "number", "person_name"), ["doc", "ci"], "left").select("serial", "number", blank("person_name"))
    # A resource that several exports have is as the first one has it.
    resource = doors.groupBy("serial").agg(F.min_by(F.struct("door_name", "room_number", "location", "area"), F.struct("doc", "ri")).alias("r")).select("serial", "r.*")
    grants = positional_grants(columns, doors, marks, states, errors).select("principal", "resource", "state").distinct()
    none = lambda df: df.where(F.lit(False))
    made = Domain(chosen(domain.principal, principal), chosen(domain.resource, resource), domain.grp, chosen(domain.grants, grants), chosen(domain.membership, none(domain.membership)), chosen(domain.group_resource, none(domain.group_resource)))
    return made, errors


def outcomes(files: DataFrame) -> DataFrame:
    """path, outcome, cells, columns, doors of every export among `files` (path, length, content): read, empty, or the error of one
    that can't be read, which doesn't keep the others from being read."""
    cells = csv_cells(files)
    mark = F.lower("text") == "x"
    found = cells.groupBy(F.col("doc").alias("path")).agg(
        F.max("error").alias("error"), F.count("text").alias("cells"), F.count_if((F.col("r") == SERIAL_ROW) & (F.col("c") >= FIRST_MARK)).alias("columns"),
        F.count_distinct(F.when(F.col("r") >= FIRST_DOOR, F.col("r"))).alias("doors"), F.count_if((F.col("r") >= FIRST_DOOR) & (F.col("c") >= FIRST_MARK) & mark).alias("marks"),
    )
    n = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    outcome = F.when(F.col("error").isNotNull(), "faulty").when(F.coalesce("cells", F.lit(0)) == 0, "empty").otherwise("read")
    return files.select("path").distinct().join(found, "path", "left").select("path", outcome.alias("outcome"), "error", *map(n, ("cells", "columns", "doors", "marks")))
