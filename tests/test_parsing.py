"""Printouts, rules for groups and entities, merges, rebuilds and versions on small fixtures with values from the rules."""

import json

import pytest
from pyspark.sql import functions as F

from keylattice.functions import text as T
from keylattice.operators import groups as G
from keylattice.operators import reconcile as R
from keylattice.operators.resolve import rank_rows
from keylattice.plans import analysis as A
from keylattice.plans import layout as L
from keylattice.plans import parsing as X
from keylattice.plans import raster as RA
from keylattice.sources import backup as B
from keylattice.sources import files as S
from keylattice.sources import versions as V
from test_algebra import domain

SCHEMA = "doc string, page int, text string, x0 double, x1 double, top double, bottom double, upright boolean"
PERSONS = [("No. 1 Example, One", "11XAB01"), ("No. 2", "12XCD2E"), ("Third, Person", "13XEF34")]
DOORS = [("7001 Entrance", "0.002", "EG", [0, 2]), ("7001 Meeting-room", "1.105", "1.OG", [1]), ("7001 Music room K 20", "K20", "UG", [0, 1, 2])]


def upright(doc, page, x, top, text):
    out = []
    for w in text.split():
        out.append((doc, page, w, float(x), x + 5.0 * len(w), float(top), top + 9.0, True))
        x += 5 * len(w) + 3
    return out


def rotated(doc, page, x, bottom, text, flipped=True):
    """Words from below to above; their characters are stored backwards, as usual."""
    out = []
    for w in text.split():
        top = bottom - 5.0 * len(w)
        out.append((doc, page, w[::-1] if flipped else w, x - 4.0, x + 4.0, top, float(bottom), False))
        bottom = top - 3
    return out


def matrix_page(doc, page, persons, doors=(), footer="", offset=0, flipped=True):
    out = []
    for i, (name, serial) in enumerate(persons):
        x = 300 + 10.5 * (offset + i)
        out += rotated(doc, page, x, 290, serial, flipped) + rotated(doc, page, x, 225, name, flipped)
    if doors:
        out += upright(doc, page, 40, 390, "NAME (TÜREN/SCHLIESSUNGEN)")
        for x, t in ((190, "PB"), (205, "RN"), (230, "ZB"), (250, "N"), (265, "E")):
            out += upright(doc, page, x, 390, t)
    for k, (name, room, floor, marks) in enumerate(doors):
        y = 407 + 15 * k
        out += upright(doc, page, 40, y, name) + upright(doc, page, 205, y, room) + upright(doc, page, 265, y, floor)
        for c in marks:
            out += upright(doc, page, 300 + 10.5 * (offset + c) - 2.5, y, "X")
    return out + (upright(doc, page, 30, 817, footer) if footer else [])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def of(df, doc, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.where(F.col("doc") == doc).collect())


def test_matrices(spark):
    later = [("V Safe, missing 21X5643", "21X5643")]
    rows = matrix_page("two", 1, PERSONS, DOORS, "Zeile 1-3 ; Spalte 1-3") + matrix_page("two", 2, later, [(n, r, f, [0] if 0 in m else []) for n, r, f, m in DOORS], "Zeile '1-3 ; Spalte 4-4")
    rows += matrix_page("split", 1, PERSONS, DOORS[:1], "Zeile 1-1 ; Spalte 1-3") + matrix_page("split", 2, PERSONS, DOORS[1:2], "Zeile 2-2 ; Spalte 1-3")
    rows += matrix_page("loose", 1, PERSONS[:2], [("Door One", "", "", [0]), ("Door Two", "", "", [1])]) + matrix_page("loose", 2, PERSONS[2:], [("Door Three", "", "", [0])])
    rows += matrix_page("jitter", 1, PERSONS[:2], [("Door One", "", "", [0])]) + upright("jitter", 1, 30, 817, "Zeile 1-1") + upright("jitter", 1, 75, 821.8, ";") + upright("jitter", 1, 85, 817, "Spalte 1-2")
    rows += matrix_page("native", 1, PERSONS, DOORS[:2], "Zeile 1-2 ; Spalte 1-3", flipped=False)
    rows += matrix_page("odd", 1, PERSONS, DOORS[:2], "Zeile 1-3 ; Spalte 1-4") + matrix_page("odd", 2, [PERSONS[0], PERSONS[2]], [("Other name", "", "", [])], "Zeile 1-1 ; Spalte 1-2")
    rows += upright("bare", 1, 40, 407, "Rows without any columns at all") + upright("bare", 1, 30, 817, "Zeile 1-1 ; Spalte 1-1")
    words = frame(spark, rows)
    m = X.parse_matrix(words)
    assert of(m.columns, "two", "column", "serial", "valid", "suspect", "number", "person_name") == [(1, "11XAB01", True, False, 1, "Example, One"), (2, "12XCD2E", True, False, 2, ""), (3, "13XEF34", True, False, None, "Third, Person"), (4, "21X5643", True, False, None, "V Safe, missing 21X5643")]
    assert of(m.doors, "two", "row", "name", "room_number", "floor") == [(1, "7001 Entrance", "0.002", "EG"), (2, "7001 Meeting-room", "1.105", "1.OG"), (3, "7001 Music room K 20", "K20", "UG")]
    assert of(m.marks, "two", "column", "row") == [(1, 1), (1, 3), (2, 2), (2, 3), (3, 1), (3, 3), (4, 1), (4, 3)]
    assert of(m.columns, "split", "column") == [(1,), (2,), (3,)] and of(m.doors, "split", "row") == [(1,), (2,)]
    assert of(m.marks, "split", "column", "row") == [(1, 1), (2, 2), (3, 1)]
    assert of(m.columns, "loose", "column") == [(1,), (2,), (3,)]
    assert of(m.doors, "loose", "row", "name") == [(1, "Door One"), (2, "Door Two"), (3, "Door Three")]
    assert of(m.marks, "loose", "column", "row") == [(1, 1), (2, 2), (3, 3)]
    assert of(m.doors, "jitter", "name") == [("Door One",)]
    assert of(m.columns, "native", "serial") == sorted((s,) for _, s in PERSONS)
    c = {r.doc: r for r in m.coverage.collect()}
    assert all(c[d].consistent and not c[d].scan for d in ("two", "split", "loose", "jitter", "native"))
    assert (c["two"].expected_columns, c["two"].expected_rows, c["loose"].expected_columns) == (4, 3, None)
    assert not c["odd"].consistent and not c["bare"].consistent
    warned = sorted((r.doc, r.page, r.kind, r.place, r["read"], r.known) for r in m.warnings.collect())
    assert [w[:3] for w in warned] == [("bare", 1, "columns of the page"), ("bare", 1, "rows without columns"), ("odd", 1, "columns of the page"), ("odd", 2, "column"), ("odd", 2, "row")]
    assert ("odd", 2, "column", 2, "13XEF34", "12XCD2E") in warned and ("odd", 2, "row", 1, "Other name", "7001 Entrance") in warned
    assert {r.doc: r.format for r in X.detect_format(words).collect()}["two"] == "matrix"
    assert X.parse_matrix(words.limit(0)).marks.count() == 0


def test_lists(spark):
    def page(doc, n, rows, first=True):
        out = upright(doc, n, 40, 40, "Berechtigungen für den Transponder") + upright(doc, n, 40, 60, "No. 51 Sample, Person / 15XGH67") if first else []
        for x, t in ((40, "Tür"), (200, "Raumnummer"), (300, "Seriennummer"), (420, "Bereich")):
            out += upright(doc, n, x, 100, t)
        y = 118
        for row in rows:
            if isinstance(row, str):
                out += upright(doc, n, 40, y, row)
            else:
                for x, t in zip((40, 200, 300, 420), row, strict=True):
                    out += upright(doc, n, x, y, t)
            y += 18
        return out

    one = ["Schließanlage: Main", "Standort.Gebäude.Etage: S.B.2", ("Long", "1.01", "L1", "North"), ("name", "", "", "wing"), "Standort.Gebäude.Etage: ..", ("Hall", "", "L2", ""), "Anzahl der Datensätze: 3", ("not part", "", "", "")]
    rows = page("dir/a.pdf", 1, one) + page("dir/a.pdf", 2, [("of it", "", "", ""), ("Yard", "", "L3", ""), "Ausdruck vom: 05.02.2024"], first=False)
    rows += page("dir/b.x.pdf", 1, [("Hall", "", "L2", "")], first=False) + upright("dir/c.pdf", 1, 40, 40, "Nothing of this kind")
    rows += upright("title", 1, 40, 40, "Berechtigungen für den Transponder PERSONEN") + upright("words", 1, 40, 40, "Raumnummer") + upright("words", 1, 40, 80, "Seriennummer") + upright("axis", 1, 9, 9, "NENOSREP")
    rows += [w for i in range(5) for w in rotated("serials", 1, 300 + 11 * i, 290, f"0{i}XY2AB")] + [w for i in range(4) for w in rotated("four", 1, 300 + 11 * i, 290, f"0{i}XY2AB")]
    words = frame(spark, rows)
    heads, body = X.parse_list(words)
    assert of(body, "dir/a.pdf", "row", "door_name", "room_number", "serial", "area", "location", "locking_system") == [(1, "Long name", "1.01", "L1", "North wing", "S.B.2", "Main"), (2, "Hall", "", "L2", "", None, "Main"), (3, "Yard", "", "L3", "", None, "Main")]
    h = {r.doc: r for r in heads.collect()}
    a = h["dir/a.pdf"]
    assert (a.serial, a.number, a.person_name, a.locking_system, str(a.printed_on), a.stated, a.parsed, a.consistent) == ("15XGH67", 51, "Sample, Person", "Main", "2024-02-05", 3, 3, True)
    assert (h["dir/b.x.pdf"].serial, h["dir/b.x.pdf"].parsed, h["dir/b.x.pdf"].stated, h["dir/b.x.pdf"].consistent) == ("B.X", 1, None, True)
    formats = {r.doc: r.format for r in X.detect_format(words).collect()}
    assert {d: f for d, f in formats.items() if "/" not in d} == {"title": "list", "words": "list", "axis": "matrix", "serials": "matrix", "four": "list"}
    known = domain(spark, [("15XGH67", "active", ["L9"]), ("15XGH67", "planned", ["L2"]), ("B", "active", ["L1"])], principals=("15XGH67", "B"), resources=("L1", "L9"))
    principal, resource, flags, summary = R.import_lists(known, heads.where("doc like 'dir/a%'"), body.where("doc like 'dir/a%'"))
    assert {r.serial: (r.number, r.person_name) for r in principal.collect()} == {"15XGH67": (51, "Sample, Person"), "B": (2, "")}
    assert {r.serial: (r.door_name, r.area) for r in resource.collect()} == {"L1": ("L1", "North wing"), "L2": ("Hall", ""), "L3": ("Yard", ""), "L9": ("L9", "")}
    assert {(r.principal, r.resource, r.active, r.planned) for r in flags.collect()} == {("15XGH67", "L1", True, False), ("15XGH67", "L2", True, True), ("15XGH67", "L3", True, False), ("B", "L1", True, False)}
    assert [(r.label, r.created, r.consistent) for r in summary.collect()] == [("Sample, Person", False, True)]


def test_drawn_marks(spark):
    """Rasters at 72 dpi, so that a pixel is a point."""
    persons = [("No. 7 Name", "11XAB01"), ("Other", "12XCD2E")]
    words, raster = [], []
    for page, (rows, a) in enumerate(((["First door", "Second door 40"], 1), (["Third door"], 3)), 1):
        for i, (name, serial) in enumerate(persons):
            words += rotated("d", page, 300 + 12 * i, 290, serial) + rotated("d", page, 300 + 12 * i, 180, name)
        for k, name in enumerate(rows):
            words += upright("d", page, 40, 400 + 15 * k, name)
        words += upright("d", page, 30, 800, f"Zeile {a}-{a + len(rows) - 1} ; Spalte 1-2")
        grey = [[255] * 340 for _ in range(500)]
        for k in range(len(rows)):
            for i in range(2):
                cx, cy = 300 + 12 * i, int(400 + 15 * k + X.CELL_HALF + X.CELL_DROP)
                kind = (page, k, i)
                for y in range(cy - 3, cy + 3):
                    for x in range(cx - 3, cx + 3):
                        centre = cx - 1 <= x < cx + 1 and cy - 1 <= y < cy + 1
                        if kind == (1, 0, 0) or kind == (2, 0, 0) and (centre or x == cx) or kind == (1, 1, 1) and not centre and x < cx - 1:
                            grey[y][x] = 20
        raster += [("d", page, y, px) for y, px in enumerate(grey)]
    df, px = frame(spark, words), spark.createDataFrame(raster, "doc string, page int, y int, px array<int>")
    pages = RA.runs_of(px), RA.page_sizes(px)
    m = X.parse_native(df, *pages, dpi=72)
    assert of(m.columns, "d", "column", "serial", "number", "person_name") == [(1, "11XAB01", 7, "Name"), (2, "12XCD2E", None, "Other")]
    assert of(m.doors, "d", "row", "name") == [(1, "First door"), (2, "Second door 40"), (3, "Third door")]
    assert of(m.marks, "d", "column", "row", "state") == [(1, 1, "active"), (1, 3, "planned")]
    assert of(X.parse_native(df, *pages, include_removed=True, dpi=72).marks, "d", "column", "row", "state") == [(1, 1, "active"), (1, 3, "planned"), (2, 2, "remove")]
    assert [(r.consistent, r.scan) for r in m.coverage.collect()] == [(True, True)]
    assert [r.native for r in X.is_native(df).collect()] == [True]
    assert [r.native for r in X.is_native(df.unionByName(frame(spark, upright("d", 1, 310, 400, "x")))).collect()] == [False]


def test_group_rules(spark):
    d = domain(spark, [("A", "desired", ["L1"])], groups=[(1, "Lab", "L", False), (2, "Main", "M", True)], members=[("A", 1), ("A", 2)], held=[(1, "L1"), (2, "L2")])

    def make(name, code=""):
        grp, outcome = G.create_group(d.grp, name, code)
        (o,) = outcome.collect()
        return grp.count(), o.id, o.export_code, o.error

    assert make(" Loft ") == (3, 3, "LO", None)
    assert make("Works", "ws") == (3, 3, "WS", None)
    assert make("Lab") == (2, 1, "L", None) and make("Lab", "l") == (2, 1, "L", None)
    assert make("Lab", "X") == (2, None, None, "the group has another code")
    assert make("  ")[3] == make(None)[3] == "a name is needed"
    assert make("New", "TOO-LONG")[3] == "the code is not valid" and make("New", "m")[3] == "the code is in use"
    assert make("L")[3] == "no code is left" and make("n" * 129)[3] == "the name is too long"
    empty, first = G.create_group(d.grp.limit(0), "Lab")
    assert (empty.count(), first.first().id) == (1, 1)
    grp, outcome = G.rename_group(d.grp, 1, " Room ")
    assert {r.id: (r.name, r.export_code) for r in grp.collect()} == {1: ("Room", "L"), 2: ("Main", "M")} and outcome.first().error is None
    grp, outcome = G.rename_group(d.grp, 1, "Main")
    assert {r.name for r in grp.collect()} == {"Lab", "Main"} and outcome.first().error == "the name is in use"
    assert G.rename_group(d.grp, 1, " ")[1].first().name == "Lab" and G.rename_group(d.grp, 9, "x")[1].count() == 0
    gone = G.delete_group(d, 1)
    assert (gone.grp.count(), gone.membership.count(), gone.group_resource.count(), gone.grants.count()) == (1, 1, 1, 1)
    codes = spark.createDataFrame([(i, n) for i, n in enumerate(["Lab", "lag", "LA", "l"])], "id long, name string")
    assert {r.id: r.export_code for r in G.derive_codes(codes).collect()} == {3: "L", 2: "LA", 0: "LAB", 1: "LAG"}


def test_entity_rules(spark):
    d = domain(spark, [("A", "active", ["L1", "L2"]), ("B", "active", ["L1"])], groups=[(1, "G", "G", False)], members=[("A", 1)], held=[(1, "L1")])
    asked = spark.createDataFrame([(" N1 ", "x"), ("a/b", "x"), ("NEW", "x"), ("L1", "x"), ("", "x"), (None, "x"), ("T", "x"), ("T", "y"), ("s" * 33, "x")], "serial string, door_name string")
    table, outcome = G.create_entities(d.resource, asked)
    assert {r.serial: r.error for r in outcome.collect()} == {"N1": None, "a/b": "a serial has no slash", "NEW": "the serial is reserved", "L1": "the serial is there", "": "a serial is needed", "T": "the serial is asked for twice", "s" * 33: "the serial is too long"}
    assert table.count() == 5
    table, outcome = G.edit_entities(d.resource, spark.createDataFrame([("L1", "new"), ("L9", "x")], "serial string, door_name string"))
    assert {r.serial: r.door_name for r in table.collect()}["L1"] == "new" and {r.serial: r.error for r in outcome.collect()} == {"L1": None, "L9": "the serial is unknown"}
    one = lambda v: spark.createDataFrame([(v,)], "serial string")
    gone = G.delete_principals(d, one("A"))
    assert (gone.principal.count(), gone.grants.count(), gone.membership.count(), gone.group_resource.count()) == (1, 1, 0, 1)
    gone = G.delete_resources(d, one("L1"))
    assert (gone.resource.count(), gone.grants.count(), gone.membership.count(), gone.group_resource.count()) == (3, 1, 1, 0)


def _document(**parts):
    who = {"serial": "A", "number": 7, "person_name": "new", "locking_system": "", "printed_on": None, "source_file": "", "imported_at": "2024-01-01T00:00:00Z", "active": ["N1"], "planned": [], "removed": [], "desired": ["L1"], "groups": ["NEW"]}
    root = {"format": "keylattice-backup", "version": 1, "exported_at": "2024-01-01T00:00:00Z", "resources": [{"serial": "N1", "door_name": "n", "room_number": "", "location": "", "area": ""}], "groups": [{"name": "Lab 2", "export_code": "L", "is_implicit": True, "resources": ["N1", "L2"]}, {"name": "New", "export_code": "NEW", "is_implicit": False, "resources": []}], "principals": [who]}
    return json.dumps(root | parts).encode()


def test_merge_of_a_backup(spark):
    d = domain(spark, [("A", "active", ["L1"]), ("A", "removed", ["L2"]), ("B", "active", ["L1"])], groups=[(3, "Lab", "L", False), (5, "Main", "M", True)], members=[("A", 3), ("B", 3)], held=[(3, "L1"), (5, "L4")])
    taken = [{"name": "main", "export_code": "X", "is_implicit": False, "resources": ["nope"]}]
    files = spark.createDataFrame([("good", _document()), ("bad", _document(groups=taken))], "path string, content binary")
    records = B.read_backups(files)
    errors = sorted((r.doc, r.error) for r in B.merge_errors(records, d).collect())
    assert errors == [("bad", "group name of another code: main"), ("bad", "unknown in groups: NEW"), ("bad", "unknown in resources: nope")]
    m = B.restore_merge(records, "good", d)
    assert {(r.id, r.name, r.export_code, r.is_implicit) for r in m.grp.collect()} == {(3, "Lab 2", "L", True), (5, "Main", "M", False), (7, "New", "NEW", False)}
    assert {r.serial: (r.number, r.person_name) for r in m.principal.collect()} == {"A": (7, "new"), "B": (2, "")}
    assert {r.serial for r in m.resource.collect()} == {"L1", "L2", "L3", "L4", "N1"}
    assert {tuple(r) for r in m.grants.select("principal", "resource", "state").collect()} == {("A", "N1", "active"), ("A", "L1", "desired"), ("B", "L1", "active")}
    assert {tuple(r) for r in m.membership.select("principal", "grp").collect()} == {("A", 7), ("B", 3)}
    assert {tuple(r) for r in m.group_resource.select("grp", "resource").collect()} == {(3, "N1"), (3, "L2"), (5, "L4")}


def test_rebuilt_from_an_export(spark):
    old = domain(spark, [("A", "removed", ["L1"])], groups=[(1, "G", "G", False)], members=[("A", 1)], held=[(1, "L1")])
    make = spark.createDataFrame
    columns, doors = make([("d", 0, "P0"), ("d", 1, "P1")], "doc string, ci int, serial string"), make([("d", 0, "R0", "Long name", "1", "S", "A"), ("d", 1, "R1", "Other name", "", "", "")], "doc string, ri int, serial string, door_name string, room_number string, location string, area string")
    marks, states = make([("d", 0, 0), ("d", 1, 1)], "doc string, ci int, ri int"), make([("d", 1, 1, "planned")], "doc string, ci int, ri int, state string")
    persons = make([("d", 0, "P0", 4, "who"), ("d", 1, "P1", None, None)], "doc string, ci int, serial string, number int, person_name string")
    new, errors = S.rebuilt(old, columns, doors, marks, persons, doors.select("doc", "ri", F.left("door_name", F.lit(5)).alias("door_name")), states)
    assert errors.count() == 0
    assert {tuple(r) for r in new.principal.select("serial", "number", "person_name").collect()} == {("P0", 4, "who"), ("P1", None, "")}
    assert {tuple(r) for r in new.grants.select("principal", "resource", "state").collect()} == {("P0", "R0", "active"), ("P1", "R1", "planned")}
    assert (new.resource.count(), new.grp.count(), new.membership.count(), new.group_resource.count()) == (2, 1, 0, 0)
    same, errors = S.rebuilt(old, columns, doors, marks, persons.where("ci = 0"), doors, states)
    assert errors.count() == 1 and same.principal.count() == 2 and {r.state for r in same.grants.collect()} == {"removed"} and same.membership.count() == 1


def test_versions_are_published_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/domain"
    d = domain(spark, [("A", "active", ["L1"])])
    V.publish(spark, root, V.write_version(d, root))
    after = V.change(spark, root, lambda now: G.delete_principals(now, spark.createDataFrame([("A",)], "serial string")))
    assert (after.principal.count(), after.grants.count()) == (1, 0)
    with pytest.raises(Exception, match="."):
        V.change(spark, root, lambda now: G.delete_principals(now, now.principal.select(F.raise_error(F.lit("broken")).cast("string").alias("serial"))))
    assert V.current(spark, root).principal.count() == 1


def test_metrics_of_a_matrix(spark):
    d = domain(spark, [], principals=("09XS2AB", "12XCD2E"), resources=("L1",))
    make = spark.createDataFrame
    columns = make([("m", 1, "09X52AB", True, 3, ""), ("m", 2, "12XCD2E", True, None, "Name"), ("m", 3, "SN", False, None, ""), ("m", 4, "13XEF34", True, 1, "x")], "doc string, column int, raw string, valid boolean, number int, person_name string")
    rows = make([("m", 1, "l1", "", ""), ("m", 2, "L.1", "", ""), ("m", 3, "Other", "", "")], "doc string, row int, name string, room_number string, location string")
    marks = make([("m", 1, 1, None), ("m", 1, 2, "planned"), ("m", 2, 3, "remove"), ("m", 2, 3, "remove")], "doc string, column int, row int, state string")
    (r,) = R.matrix_metrics(d, columns, rows, marks).collect()
    assert (r.persons, r.created, r.updated, r.corrected, r.skipped) == (4, 1, 1, 1, 1)
    assert (r.doors, r.doors_created, r.doors_fuzzy, r.marks, r.active, r.planned, r.removed) == (3, 1, 1, 3, 1, 1, 1)
    report = R.removed_report(make([("12XCD2E", "L1"), ("12XCD2E", "L9"), ("x", "L1")], "principal string, resource string"), d).first()
    assert (report.marks, report.principals, report.grants, report.skipped) == (3, 1, 1, 2)


def test_places_sets_and_texts(spark):
    rows = [(None, "b", "1"), (None, "a", "2"), (3, "", "0"), (3, "ab", "9"), (1, "x", "5")]
    df = spark.createDataFrame(rows, "n int, name string, serial string").repartition(3)
    got = {r.serial: r.place for r in rank_rows(df, F.asc_nulls_first("n"), "name", "serial", name="place").collect()}
    assert got == {"2": 0, "1": 1, "5": 2, "0": 3, "9": 4}
    pairs = spark.createDataFrame([("p", "a,b"), ("p", "c"), ("q", "a"), ("q", "b,c"), ("r", "c"), ("r", "a,b")], "principal string, resource string")
    assert [(r.principals, r.n_principals, r.n_items) for r in A.clones(pairs).collect()] == [("p,r", 2, 2)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert spark.sql("SELECT timestamp '2024-01-01 12:00:00Z' AS t").select(T.utc_iso(F.col("t"))).first()[0] == "2024-01-01T12:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    footers = {"Zeile 1-0 ; Spalte 1-26": (1, 0, 1, 26), "Zeile '1-0 ; Spalte 81-81": (1, 0, 81, 81), "Zeile 12-40; Spalte 27-80": (12, 40, 27, 80)}
    df = spark.createDataFrame([(t,) for t in footers], "t string").select("t", L.footer(F.col("t")).alias("f"))
    assert {r.t: tuple(r.f) for r in df.collect()} == footers
    d = domain(spark, [])
    d.principal = spark.createDataFrame([("A", 1, "late", 2), ("A", 9, "zz", 1)], "serial string, number int, person_name string, place int")
    assert "'late'" in A.sql_script(d).where("part = 1").first().statement


def test_overlap_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "OVERLAP_BLOCK", 3)
    held = {f"p{i}": {f"L{k}" for k in range(1, 9) if (i * k) % 3 != 1} for i in range(10)}
    d = domain(spark, [(p, "active", sorted(v)) for p, v in held.items()], principals=sorted(held) + ["none"])
    got = {(r.a, r.b): (r.shared, r.pct, r.is_self) for r in A.overlap(d).collect()}
    held["none"] = set()
    assert got == {(a, b): (len(x & y), round(len(x & y) / max(len(x | y), 1) * 100), a == b) for a, x in held.items() for b, y in held.items()}
