"""The matrix export, backups, arriving files, seeds and toggles on small fixtures with values from the rules."""

import json

import pytest
from pyspark.sql import functions as F

from keylattice.operators import reconcile as R
from keylattice.plans import analysis as A
from keylattice.plans import layout as L
from keylattice.plans import pixels as P
from keylattice.sources import backup as B
from keylattice.sources import files as S
from keylattice.streaming.arrivals import import_arrivals
from test_algebra import domain

EXPORT = "\r\n".join(
    [*["head"] * 5, ";;;;;;;;09XY2AB;;09XY2AC", ";North;L1;Lab  12 East;S;B;2;12;x;x;X", ";;;;;;;;x", 'sys;South;L2;"Store; cold";S;;;;;;x', ";;L3;Hall"]
)


@pytest.fixture
def exports(tmp_path):
    (tmp_path / "a.csv").write_bytes(EXPORT.encode("utf-16"))
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\x00\xd8\x00")
    (tmp_path / "empty.csv").write_bytes(b"")
    return tmp_path


def test_csv_matrix(spark, exports):
    cells = S.csv_cells(S.collect_files(spark, f"{exports}/*.csv", f"{exports}/a.csv")).cache()
    assert [r.doc.rpartition("/")[2] for r in cells.where("error IS NOT NULL").collect()] == ["bad.csv"]
    columns, doors, marks = S.csv_matrix(cells)
    assert {(r.ci, r.serial) for r in columns.collect()} == {(0, "09XY2AB"), (1, "09XY2AC")}
    assert {tuple(r)[1:] for r in doors.select("doc", "ri", "serial", "door_name", "room_number", "location", "area").collect()} == {(0, "L1", "Lab 12 East", "12", "S.B.2", "North"), (1, "L2", "Store; cold", "", "S", "South"), (2, "L3", "Hall", "", "", "")}
    assert {(r.ci, r.ri) for r in marks.collect()} == {(0, 0), (1, 0), (1, 1)}

    other = doors.select("doc", "ri", F.left("door_name", F.lit(6)).alias("door_name"))
    assert S.align_errors(columns, doors, columns, other).count() == 0
    states = columns.limit(1).select("doc", F.lit(1).alias("ci"), F.lit(0).alias("ri"), F.lit("planned").alias("state"))
    none = S.align_errors(columns, doors, columns, other)
    got = {(r.principal, r.resource, r.state) for r in S.positional_grants(columns, doors, marks, states, none).collect()}
    assert got == {("09XY2AB", "L1", "active"), ("09XY2AC", "L1", "planned"), ("09XY2AC", "L2", "active")}

    short = other.where("ri < 2")
    swapped = other.withColumn("ri", 2 - F.col("ri"))
    fewer = columns.where("ci = 0")
    for args, want in [((columns, short), "row counts differ"), ((columns, swapped), "rows are out of order"), ((fewer, other), "columns differ")]:
        errors = S.align_errors(columns, doors, *args)
        assert {r.error for r in errors.collect()} == {want}
        assert S.positional_grants(columns, doors, marks, states, errors).count() == 0
    twice = doors.withColumn("serial", F.when(F.col("ri") == 2, "").otherwise("L1"))
    assert {r.error for r in S.align_errors(columns, twice, columns, other).collect()} == {"a row has no serial", "a serial is there twice"}


def test_routes(spark):
    paths = {"x/A.PNG": "image", "b.csv": "csv", "c.json": "backup", "d.pdf": "matrix", "png": "matrix"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.k for r in df.select("p", S.route(F.col("p"), F.lit("matrix")).alias("k")).collect()} == paths


def document(**change):
    person = {"serial": "P1", "number": 4, "person_name": "n", "locking_system": "", "printed_on": None, "source_file": "", "imported_at": "2024-05-01T10:00:00+00:00", "active": ["L1"], "planned": [], "removed": [], "desired": ["L1", "L2"], "groups": ["a"]}
    group = {"name": "G", "export_code": "A", "is_implicit": True, "resources": ["L2"]}
    door = {"serial": "L1", "door_name": "d", "room_number": "", "location": "", "area": ""}
    root = {"format": B.FORMAT, "version": 1, "exported_at": "2024-05-01T10:00:00Z", "resources": [door, door | {"serial": "L2"}], "groups": [group], "principals": [person]}
    for key, value in change.items():
        kind, _, field = key.partition("__")
        if field:
            root[kind][-1][field] = value
        else:
            root[kind] = value
    return root


def faults(spark, root, known=None):
    raw = root if isinstance(root, bytes) else json.dumps(root).encode()
    return [r.error for r in B.backup_errors(B.read_backups(spark.createDataFrame([("doc", bytearray(raw))], "path string, content binary")), known).collect()]


def test_backup_restores(spark):
    records = B.read_backups(spark.createDataFrame([("doc", bytearray(json.dumps(document()).encode()))], "path string, content binary"))
    assert B.backup_errors(records).count() == 0
    d = B.restore_replace(records, "doc")
    assert {tuple(r) for r in d.grants.collect()} == {("P1", "L1", "active"), ("P1", "L1", "desired"), ("P1", "L2", "desired")}
    assert [tuple(r) for r in d.membership.collect()] == [("P1", 0)]
    assert [tuple(r) for r in d.group_resource.collect()] == [(0, "L2")]
    assert [(r.serial, r.number) for r in d.principal.collect()] == [("P1", 4)]


@pytest.mark.parametrize(
    "change",
    [
        {"version": True},
        {"version": 2},
        {"extra": 1},
        {"resources__area": "x" * 65},
        {"principals__number": 2**31},
        {"principals__number": True},
        {"principals__imported_at": "2024-05-01T10:00:00"},
        {"principals__printed_on": "1.5.2024"},
        {"principals__serial": ""},
        {"principals__person_name": "\ud800"},
        {"principals__active": ["L1", "L1"]},
        {"principals__groups": ["a", "A"]},
        {"principals__desired": ["L9"]},
        {"principals__groups": ["ZZ"]},
        {"groups__export_code": "12345"},
        {"groups__is_implicit": 1},
        {"resources__serial": "L1"},
        {"principals": None},
    ],
)
def test_backup_faults(spark, change):
    assert faults(spark, document(**change))


def test_backup_faults_of_bytes_and_groups(spark):
    assert faults(spark, b"\xff{}")
    assert faults(spark, b'{"format": 1, "format": 1}')
    assert faults(spark, b" " * (B.MAX_BYTES + 1))
    group = document()["groups"][0]
    assert faults(spark, document(groups=[group, group | {"export_code": "B", "name": "H"}])) == ["several implicit groups"]
    assert faults(spark, document(groups=[group, group | {"export_code": "B", "name": "g", "is_implicit": False}])) == ["twice: group name g"]


def test_backup_may_refer_to_what_is_known(spark):
    known = domain(spark, [], resources=["L9"], groups=[(1, "Z", "ZZ", False)])
    assert faults(spark, document(principals__desired=["L9"], principals__groups=["ZZ"]), known) == []


def test_arrivals_are_handed_over_once(spark, exports, tmp_path_factory):
    at, seen = str(tmp_path_factory.mktemp("arrivals")), []
    handle = lambda files, batch: seen.extend(r.path.rpartition("/")[2] for r in files.collect())
    import_arrivals(spark, str(exports), at, handle).awaitTermination(60)
    (exports / "later.csv").write_bytes(b"\xff\xfe")
    import_arrivals(spark, str(exports), at, handle).awaitTermination(60)
    assert sorted(seen) == ["a.csv", "bad.csv", "later.csv"]  # Spark has no rows of empty files


def test_seed_groups(spark):
    d = domain(spark, [("0A", "desired", ["L4"])], principals=["0A", "B"], groups=[(1, "X", "X", True), (2, "Y", "Y", False)], members=[("0A", 2), ("B", 1)], held=[(1, "L4")])
    frame = spark.createDataFrame
    out = R.seed_groups(d, frame([(1, " l1 "), (1, "gone")], "grp long, door_name string"), frame([(2, "LOC2")], "grp long, token string"), frame([("A", 1), ("none", 1)], "raw string, grp long"))
    assert {tuple(r) for r in out.group_resource.collect()} == {(1, "L1"), (2, "L2")}
    assert {tuple(r) for r in out.membership.collect()} == {("0A", 1), ("B", 1)}
    assert {(r.principal, r.resource) for r in out.grants.collect()} == {("0A", "L1"), ("0A", "L4")}


def test_toggles_apply_in_order(spark):
    d = domain(spark, [], groups=[(1, "X", "X", False)], members=[("A", 1)])
    on = lambda kind, key, on, *r: {"kind": kind, "id": key, "on": on, "resources": list(r)}
    out = R.toggle_batch(d, [on("group", 1, True, "L1", "L2"), on("principal", "A", False, "L1"), on("principal", "A", True, "L3", "L9"), on("group", 1, False, "L2"), on("group", "x", True, "L4"), on("group", 7, True, "L4"), {"kind": "principal", "id": "A"}])
    assert {r.resource for r in out.grants.where("principal = 'A'").collect()} == {"L1", "L3"}
    assert [tuple(r) for r in out.group_resource.collect()] == [(1, "L1")]


def test_import_matrix(spark):
    d = domain(spark, [("05", "planned", ["L1"])], principals=["05"])
    frame = spark.createDataFrame
    columns = frame([("d", 1, "O5", False, 7, "new"), ("d", 2, "09XY2AB", True, None, "x"), ("d", 3, "??", False, None, "")], "doc string, column int, raw string, valid boolean, number int, person_name string")
    rows = frame([("d", 1, "L1", "", ""), ("d", 2, "Cellar", "3", "")], "doc string, row int, name string, room_number string, location string")
    marks = frame([("d", 1, 1, None), ("d", 1, 2, "planned"), ("d", 2, 1, "remove"), ("d", 3, 1, "active")], "doc string, column int, row int, state string")
    principal, resource, flags, skipped = R.import_matrix(d, columns, rows, marks)
    cellar = [r.serial for r in resource.where("door_name = 'Cellar'").collect()]
    assert len(cellar) == 1
    assert cellar[0].startswith("MX:")
    assert {tuple(r) for r in R.to_grants(flags).collect()} == {("05", "L1", "active"), ("05", cellar[0], "planned"), ("09XY2AB", "L1", "removed")}
    assert {(r.serial, r.number, r.person_name) for r in principal.collect()} == {("05", 1, "new"), ("09XY2AB", None, "x")}
    assert [r.raw for r in skipped.collect()] == ["??"]


def test_native_layout(spark):
    words = [("BA2YX90", 10.0, 12.0, 250.0, 290.0, False), ("99", 10.0, 12.0, 330.0, 340.0, False), ("nnA", 10.0, 12.0, 100.0, 120.0, False), ("NENOSREP", 2.0, 3.0, 50.0, 99.0, False)]
    words += [("Hall", 20.0, 40.0, 400.0, 410.0, True), ("1", 42.0, 44.0, 400.0, 410.0, True), ("40", 60.0, 66.0, 400.0, 410.0, True), ("12.5", 20.0, 40.0, 430.0, 440.0, True)]
    df = spark.createDataFrame([("d", 1, *w) for w in words], "doc string, page int, text string, x0 double, x1 double, top double, bottom double, upright boolean")
    assert [(r.raw, r.name) for r in L.native_columns(df).collect()] == [("09XY2AB", "Ann")]
    assert [r.name for r in L.native_doors(df).collect()] == ["Hall 1"]


def test_centre_band(spark):
    ink = [0.5, 0.9, 0.3, 0.3, 0.0, 0.2]
    df = spark.createDataFrame([("c", 6, i, v) for i, v in enumerate(ink)], "key string, h int, pos int, ink double")
    assert [(r.low, r.high) for r in P.centre_band(df).collect()] == [(2, 3)]


def test_sql_script_is_in_order(spark, tmp_path):
    d = domain(spark, [("A", "active", ["L1"])], principals=["A'"], resources=["L1"])
    A.write_sql_script(d, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [x.split(" ")[2] for x in text.splitlines()] == ["principals", "resources", "authorizations"]
    assert "'A'''" in text


def test_exports_in_pieces_read_as_whole_ones(spark, exports):
    whole = S.csv_cells(S.collect_files(spark, f"{exports}/a.csv"))
    grid = [line.split(";") for line in EXPORT.split("\r\n")]
    rows = []
    for first, last in ((0, 8), (8, 9), (9, 20)):
        own = [(r, cells) for r, line in enumerate(grid) if any(cells := line[first:last])]
        content = "\n".join(";".join(cells) for _, cells in own).encode("utf-16")
        rows.append(("a", len(content), bytearray(content), first, [r for r, _ in own]))
    schema = "path string, length long, content binary, first_column int, rows array<int>"
    # The second part of the quoted cell is a cell of its own for `split`, not for the reader.
    simple = lambda df: {(r.r, r.c, r.text) for r in df.collect() if r.r != 8}
    pieces = spark.createDataFrame(rows, schema)
    assert simple(S.csv_cells(pieces)) == simple(whole)
    assert S.outcomes(pieces).select("outcome", "columns", "marks").collect()[0][:2] == ("read", 2)

    bad = spark.createDataFrame([*rows[1:], (*rows[0][:3], 0, [0])], schema)
    assert S.csv_cells(bad).where("error IS NOT NULL").count() == 1
    assert all(df.count() == 0 for df in S.csv_matrix(S.csv_cells(bad)))
    assert tuple(S.outcomes(bad).select("outcome", "cells").first()) == ("faulty", 0)
