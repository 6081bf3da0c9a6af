"""What must not grow faster than the tables, or end up in one task."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keylattice import registry
from keylattice.operators import reconcile as R
from keylattice.operators import resolve as E
from keylattice.plans import analysis as A
from keylattice.plans import layout as L
from keylattice.plans import parsing as X
from keylattice.plans import printouts as O
from keylattice.plans import tiles as TI
from keylattice.sources.domain import AdapterDomain, reached
from keylattice.sources.shared import places, tasks

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_few_suppliers_are_dealt_to_many_tasks(spark):
    pages = O.scanned_pages(spark, DIR)
    assert pages.rdd.getNumPartitions() >= tasks(spark)
    assert pages.selectExpr("max(size(px))", "min(size(px))", "max(y)").first() == (293, 293, 416)


def test_pairs_of_members_and_resources_are_distinct_without_a_shuffle(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("c", 3)], "principal string, grp long")
    held = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (2, "y"), (4, "z")], "grp long, resource string")
    pairs = reached(members, held)
    assert sorted(map(tuple, pairs.collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    for df in (pairs, AdapterDomain(spark, DIR).inherited(), A.access_report(AdapterDomain(spark, DIR))):
        plan = _plan(df)
        assert plan.index("Join") < plan.index("Aggregate")


def test_what_groups_hold_is_not_written_out_for_members(spark):
    d = AdapterDomain(spark, DIR)
    some = d.resource.where("room_number < '3'").select(F.col("serial").alias("resource"))
    for included in (True, False):
        plan = _plan(R.set_group_resources(d, 3, some, included)[1])
        assert "Join Inner\n" not in plan and "Join Cross" not in plan
        assert "Join Inner, (grp" not in plan
    plan = _plan(R.assign_group(d, d.principal.select(F.col("serial").alias("principal"), F.lit(2).cast("long").alias("grp")))[1])
    assert "Join Inner, (grp" not in plan


@pytest.mark.parametrize("name", ["m_crud_delete", "set_difference", "set_union", "q_import_changes"])
def test_flags_are_not_dealt_to_states_and_back(spark, name):
    assert "Generate" not in _plan(registry.QUERIES[name](spark, DIR))


def test_a_block_of_principals_is_sent_a_row_each(spark):
    assert "collect_set(at" in _plan(A.overlap(AdapterDomain(spark, DIR), "planned"))


def test_tiles_are_few_files(spark, tmp_path):
    pages = spark.range(500).select((F.col("id") % 25).cast("int").alias("tc"), F.floor(F.col("id") / 25).cast("int").alias("tr"))
    TI.write_tiles(pages, f"{tmp_path}/tiles")
    assert len([f for f in os.listdir(f"{tmp_path}/tiles") if f.startswith("part")]) <= tasks(spark)
    assert sorted(map(tuple, TI.read_tiles(spark, f"{tmp_path}/tiles", pages.schema).collect())) == sorted(map(tuple, pages.collect()))


def test_pages_without_marks_are_not_printed(spark):
    col = O._columns(spark, DIR)
    marks, door, pages = O._marked(spark, DIR, col, 3)
    shown = {(r.doc, r.page) for r in pages.collect()}
    marked = {(r.doc, r.page) for r in marks.collect()}
    assert marked <= shown and shown - marked <= {(r.doc, r.page) for r in pages.where("band = 0").collect()}
    assert door.agg(F.max("r")).first()[0] <= 3


def test_lines_of_a_page_are_folded_between_gaps(spark):
    tops = [10.0, 12.5, 13.0, 15.9, 16.2, 30.0, 33.0, 33.1, 36.1, 60.0, 60.0]
    words = spark.createDataFrame([("d", 1, str(i), float(i), i + 1.0, t) for i, t in enumerate(tops)], "doc string, page int, text string, x0 double, x1 double, top double")
    want, anchor = [], None
    for i, t in enumerate(tops):
        if anchor is None or abs(t - anchor) > L.LINE_GAP:
            anchor, _ = t, want.append([])
        want[-1].append(str(i))
    got = L.line_words(words)
    assert "_run" in _plan(got)
    assert [(r.line, [w.text for w in r.ws]) for r in got.orderBy("line").collect()] == list(enumerate(want))


@pytest.mark.parametrize("name", ["m_validate_backup", "m_merge_errors", "m_restore_replace", "m_restore_merged"])
def test_backups_are_read_once(spark, name):
    assert "MapInPandas" not in _plan(registry.QUERIES[name](spark, DIR))


def test_exports_come_in_pieces_that_grow_with_the_marks(spark):
    """A piece has a few columns and no blank line, so that an export is no single value and no dense grid."""
    files = O.export_files(spark, DIR)
    most = files.selectExpr("max(size(rows))", "count(distinct first_column)").first()
    assert most[0] <= O.EXPORT_ROWS and most[1] > 1
    marks = files.where("first_column > 0")
    blank = F.filter(F.split(F.decode("content", "UTF-16"), "\n"), lambda v: F.trim(F.translate(v, ";", "")) == "")
    assert marks.where(F.size(blank) > 0).count() == 0
    one = O.export_files(spark, DIR, O.first_export(spark, DIR)).select("path").distinct().collect()
    assert [r.path for r in one] == [files.agg(F.min("path")).first()[0]]


def test_places_are_numbered_in_runs(spark):
    rows = spark.createDataFrame([(g, k * step) for g, step in (("a", 1), ("b", 9000), ("c", 40000)) for k in range(12)], "g string, k long")
    got = sorted(map(tuple, places(rows, "g", "k", "at").collect()))
    assert [at for _, _, at in got] == [*range(12)] * 3


def test_names_of_small_blocks_have_no_keys_and_no_side_is_broadcast(spark):
    asked = spark.createDataFrame([("raum1x", "1"), ("saal22", "22")], "key string, digits string")
    known = spark.createDataFrame([("raum1", "1"), ("raum12", "1"), ("saal2", "22"), ("halle", "1")], "other string, digits string")
    pairs = E.near_names(asked, known, "digits")
    assert sorted((r.key, r.other, r.d) for r in pairs.collect()) == [("raum1x", "raum1", 1), ("raum1x", "raum12", 1), ("saal22", "saal2", 1)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_lines_within_one_gap_are_not_folded(spark):
    """Most runs of a page are one line; they are neither put in order twice nor folded, and all others are as before."""
    draw = random.Random(5)
    rows = [("d", p, f"t{i}", draw.randrange(40) / 2, 1.0, float(draw.choice((20 * draw.randrange(4) + draw.randrange(3), draw.randrange(900) / 10)))) for p in (1, 2, 3) for i in range(25 * p)]
    rows += [("e", 1, "b", 2.0, 3.0, 10.04), ("e", 1, "a", 1.0, 2.0, 10.0), ("e", 1, "c", 0.0, 1.0, 13.0), ("e", 2, "x", 0.0, 1.0, None), ("e", 2, "y", 1.0, 2.0, 5.0)]
    words = spark.createDataFrame(rows, "doc string, page int, text string, x0 double, x1 double, top double")
    want = []
    for key in sorted({r[:2] for r in rows}):
        ordered = sorted(([None if r[5] is None else round(r[5], 1), r[3], r[5], r[2], r[4]] for r in rows if r[:2] == key), key=lambda w: (w[0] is not None, w[0] or 0, w[1], w[2] or 0, w[3]))
        found, anchor = [], None
        for w in ordered:
            if anchor is None or abs(w[2] - anchor) > L.LINE_GAP:
                anchor, _ = w[2], found.append([])
            found[-1].append(w)
        want += [(*key, i, line[0][2], [(w[1], w[3]) for w in sorted(line, key=lambda w: (w[1], w[3]))]) for i, line in enumerate(found)]
    got = L.line_words(words)
    assert [(r.doc, r.page, r.line, r.top, [(w.x0, w.text) for w in r.ws]) for r in got.orderBy("doc", "page", "line").collect()] == want
    assert "CASE WHEN flat" in _plan(got)


@pytest.mark.parametrize("name", ["lay_count", "src_list_pdf"])
def test_words_of_lists_are_not_dealt_out(spark, name):
    """Orders are dealt to tasks once, and neither their words nor their lines after that."""
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan and "settled" not in plan


def test_lines_of_a_page_equal_those_of_its_words(spark):
    rng = random.Random(4)
    tops = lambda: rng.choice([float(rng.randrange(60)), rng.randrange(1200) / 20, rng.uniform(0, 60)])
    rows = [("d", p, rng.choice("abc"), float(rng.randrange(9)), 9.0, tops()) for p in range(40) for _ in range(rng.randrange(1, 40))] + [("e", 1, "x", 1.0, 2.0, None), ("e", 1, "y", 1.0, 2.0, 5.0), ("e", 1, "z", 0.0, 2.0, 6.0)]
    words = spark.createDataFrame(rows, "doc string, page int, text string, x0 double, x1 double, top double").repartition(3)
    got = L.with_lines(L.paged(words)).select("doc", "page", F.explode("lines").alias("l")).select("doc", "page", "l.line", "l.top", "l.ws")
    want = L.line_words(words).select("doc", "page", "line", "top", "ws")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_words_of_pages_are_dealt_out_once(spark):
    """Lines, footers and what tells formats apart are read from a page's row: no window over its words, and no second shuffle of them."""
    words = O.matrix_words(spark, DIR, high=O.MATRIX_ROWS).limit(1000)
    once = _plan(words).count("Repartition")
    for df in (X.page_footers(words), X.detect_format(words)):
        plan = _plan(df)
        assert plan.count("Repartition") == once + 1 and "_apart" not in plan
