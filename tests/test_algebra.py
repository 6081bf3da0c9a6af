"""Fixtures of the authorization algebra with values that follow from its rules."""

import random

import pytest
from pyspark.sql import functions as F

from keylattice.functions import text as T
from keylattice.operators import reconcile as R
from keylattice.operators import resolve as E
from keylattice.plans import analysis as A
from keylattice.plans import layout as L
from keylattice.plans import pixels as P
from keylattice.sources.domain import Domain


def domain(spark, grants, principals=("A", "B"), resources=("L1", "L2", "L3", "L4"), groups=(), members=(), held=()):
    frame = spark.createDataFrame
    return Domain(
        frame([(p, i + 1, "") for i, p in enumerate(principals)], "serial string, number int, person_name string"),
        frame([(r, r, "", f"Loc{r[-1]}", "") for r in resources], "serial string, door_name string, room_number string, location string, area string"),
        frame(list(groups), "id long, name string, export_code string, is_implicit boolean"),
        frame([(p, r, s) for p, s, rs in grants for r in rs], "principal string, resource string, state string"),
        frame(list(members), "principal string, grp long"),
        frame(list(held), "grp long, resource string"),
    )


@pytest.mark.parametrize(("scope", "pct"), [("active", 50), ("planned", 100), ("diff", 50), ("unknown", 50)])
def test_overlap(spark, scope, pct):
    d = domain(spark, [("A", "active", ["L1", "L2"]), ("A", "planned", ["L3"]), ("B", "active", ["L1"]), ("B", "planned", ["L2", "L3"])])
    assert {r.pct for r in A.overlap(d, scope).where("a = 'A' AND b = 'B'").collect()} == {pct}


def test_overlap_of_nothing_is_zero(spark):
    d = domain(spark, [("A", "active", ["L1"])])
    assert {(r.a, r.b): r.pct for r in A.overlap(d).collect()}["B", "B"] == 0


def test_matrix_and_diff(spark):
    d = domain(spark, [("A", "active", ["L1"]), ("A", "planned", ["L2"]), ("A", "desired", ["L1", "L3"]), ("A", "removed", ["L4"])])
    assert {tuple(r) for r in A.matrix(d).collect()} == {(0, 0, 2), (0, 1, 1)}
    assert {tuple(r) for r in A.matrix(d, "planned").collect()} == {(0, 1, 1)}
    assert {tuple(r) for r in A.diff(d).collect()} == {(0, 0, 2, 1), (0, 1, 1, 0), (0, 2, 0, 1)}
    assert {(r.action, r.resource, r.note) for r in A.changes(d).collect()} == {("add", "L3", ""), ("remove", "L2", "planned")}
    assert {r["class"]: r.n for r in A.diff_counts(d).collect()} == {"ok": 1, "add": 1, "remove": 1}
    with pytest.raises(ValueError, match="scope"):
        A.matrix(d, "nothing")


def test_hide_empty_numbers_rows_anew(spark):
    d = domain(spark, [("A", "active", ["L1"]), ("A", "removed", ["L4"]), ("B", "desired", ["L4"])])
    assert {tuple(r) for r in A.diff(d, hide_empty=True).collect()} == {(0, 0, 2, 0), (1, 1, 0, 1)}


@pytest.mark.parametrize(
    ("scope", "grants", "want"),
    [
        ("soll", [("A", "desired", ["L4"]), ("A", "active", ["L4"])], {("L4", "active")}),
        ("soll", [("A", "desired", ["L4"])], {("L4", "add")}),
        ("soll", [("A", "desired", ["L4"]), ("A", "removed", ["L4"])], {("L4", "removed")}),
        ("ist", [("A", "active", ["L1", "L3"]), ("A", "planned", ["L4"])], {("L4", "planned")}),
    ],
)
def test_individual(spark, scope, grants, want):
    d = domain(spark, [("A", "desired", ["L1", "L2", "L3"]), *grants], groups=[(1, "G", "G", False)], members=[("A", 1)], held=[(1, "L1"), (1, "L2"), (1, "L3")])
    assert {(r.resource, r.state) for r in A.individual(d, scope).collect()} == want


def test_fate(spark):
    d = domain(spark, [("A", "active", ["L1"]), ("A", "desired", ["L1"]), ("B", "desired", ["L1"]), ("C", "active", ["L1"]), ("D", "planned", ["L1"]), ("E", "removed", ["L1"])], principals="ABCDE")
    got = {(r.fate, r.principal, r.badge) for r in A.fate(d).collect()}
    assert got == {("keep", "A", ""), ("remove", "C", "not desired"), ("remove", "E", "withdrawn"), ("planned", "D", "")}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("09XY2AB", ("09XY2AB", True, False)),
        ("O9XY2AB", ("09XY2AB", True, False)),
        ("0'l XY2AB", ("01XY2AB", True, False)),
        ("09tJY2At", ("09UY2AL", True, True)),
        ("091J2Ag", ("091J2A9", True, True)),
        ("SN", None),
        ("", None),
    ],
)
def test_repair_serial(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "x string").select(T.repair_serial(F.col("x")).alias("r")).first().r
    assert tuple(r) == want if want else not r.valid


@pytest.mark.parametrize(("a", "b", "same"), [("09XS2AB", "09X92AB", True), ("09XA2AB", "09X42AB", True), ("09XY2AB", "09X2YAB", False), ("09XY2AB", "09XY2A", False), ("3", "4", False)])
def test_lookalike(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.lookalike_equal(F.col("a"), F.col("b")).alias("s"), (T.lookalike_block(F.col("a")) == T.lookalike_block(F.col("b"))).alias("k")).first()
    assert row.s is same
    assert row.k or not same


def test_match_names(spark):
    known = ["Oven 1.OG", "Oven 2.OG", "Room 0321 Ost", "Room 201 O", "Room 100", "Besprechungsraum 7", "Twin A", "Twin-A"]
    k = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(known)], "serial string, door_name string")
    asked = {"oven 1.og": "s0", "Oven 1.0G": "s0", "Besprechunasraum 7": "s5", "Oven 4.OG": None, "Room 0321 West": None, "Room 201 W": None, "Room 1": None, "Room 10": None, "TwinA": None}
    q = spark.createDataFrame([(n,) for n in asked], "name string")
    assert {r.name: r.serial for r in E.match_names(q, k).collect()} == asked


def test_labels(spark):
    rows = spark.createDataFrame([("Lab 123", "12", "s"), ("Lab 12", "12", "s"), ("", "12", "s")], "d string, r string, s string")
    assert [x.l for x in rows.select(T.resource_label(F.col("d"), F.col("r"), F.col("s")).alias("l")).collect()] == ["Lab 123 (12)", "Lab 12", "s"]
    codes = lambda *used: spark.range(1).select(T.derive_code(F.lit("Lage"), F.array(*map(F.lit, used)) if used else F.array().cast("array<string>")).alias("c")).first().c
    assert (codes(), codes("L"), codes("l", "LA", "LAG", "LAGE")) == ("L", "LA", None)
    g = lambda *x: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("code"), F.lit(i).alias("implicit")) for n, c, i in x))
    one = lambda c: spark.range(1).select(T.group_label(c, "P ").alias("x")).first().x
    assert one(g(("A", "A", True))) == "P A"
    assert one(g(("z", "T", False), ("a", "A", True), ("b", "LA", False))) == "P LA-T"
    assert one(g(("b", "L", False), ("a", "T", False))) == "P TL"


@pytest.mark.parametrize(
    ("before", "mark", "after"),
    [("active", "planned", {"active"}), ("planned", "active", {"active"}), ("removed", "active", {"active"}), ("active", "remove", {"removed"}), (None, "planned", {"planned"})],
)
def test_transition_and_again(spark, before, mark, after):
    d = domain(spark, [("A", before, ["L1"])] if before else [("B", "active", ["L2"])])
    marks = spark.createDataFrame([("A", "L1", mark)], "principal string, resource string, state string")
    once = R.state_transition(d.flags(), marks)
    twice = R.state_transition(once, marks)
    for f in (once, twice):
        assert {r.state for r in R.to_grants(f).where("principal = 'A'").collect()} == after


def test_unassign_keeps_what_another_group_covers(spark):
    d = domain(spark, [("A", "desired", ["L1", "L2", "L4"])], groups=[(1, "X", "X", False), (2, "Y", "Y", False)], members=[("A", 1), ("A", 2)], held=[(1, "L1"), (1, "L2"), (2, "L2")])
    members, grants = R.unassign_group(d, spark.createDataFrame([("A", 1)], "principal string, grp long"))
    assert [tuple(r) for r in members.collect()] == [("A", 2)]
    assert {r.resource for r in grants.where("state = 'desired'").collect()} == {"L2", "L4"}


def test_lines_are_anchored(spark):
    w = spark.createDataFrame([("d", 1, t, x, x + 1, top, top + 1, True) for t, x, top in [("a", 0.0, 10.0), ("b", 1.0, 12.5), ("c", 2.0, 14.0)]], "doc string, page int, text string, x0 double, x1 double, top double, bottom double, upright boolean")
    assert [r.text for r in L.lines(w).orderBy("line").collect()] == ["a b", "c"]


def test_wrap_and_carry(spark):
    rows = spark.createDataFrame([("d", 1, 1, "s1", "a", False), ("d", 1, 2, "", "b", False), ("d", 1, 3, "", "h", True), ("d", 1, 4, "", "x", False), ("d", 2, 1, "s2", "c", False)], "doc string, page int, line int, serial string, text string, is_break boolean")
    assert {(r.serial, r.text) for r in L.wrap(rows).collect()} == {("s1", "a b"), ("s2", "c")}


def test_greedy_serials_claim_in_order(spark):
    cols = spark.createDataFrame([("d", 1, "0S"), ("d", 2, "05"), ("d", 3, "0S")], "doc string, column int, raw string")
    known = spark.createDataFrame([("05",), ("08",)], "serial string")
    assert {r.column: r.serial for r in E.greedy_serials(cols, known).collect()} == {1: "08", 2: "05", 3: None}


def test_lookalikes_meet_by_spelling_and_not_by_class(spark):
    rng = random.Random(3)
    letters = "".join(sorted({c for x in T.LOOKALIKES for c in x})) + "x3"
    known = sorted({"".join(rng.choices(letters, k=n)) for n, some in ((2, 60), (3, 60), (9, 4)) for _ in range(some)})
    near = {p for x in T.LOOKALIKES for p in (x, x[::-1])}
    swap = lambda s: "".join(rng.choice([c, *(p[1] for p in near if p[0] == c)]) for c in s)
    asked = sorted({swap(k) for k in known for _ in range(2)})
    alike = lambda a, b: len(a) == len(b) and all(x == y or x + y in near for x, y in zip(a.upper(), b.upper(), strict=True))
    q, k = spark.createDataFrame([(a,) for a in asked], "raw string"), spark.createDataFrame([(b,) for b in known], "serial string")
    got = E.lookalikes(q, k).collect()
    assert len(got) == len(set(got)) and {(r.raw, r.serial) for r in got} == {(a, b) for a in asked for b in known if alike(a, b)}
    # All digits: the class of 0, 5, 6, 8 and 9 has 125 texts of three letters, of which 8 at most look like one.
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("raw"))
    seen = [(i, c) for i in range(3) for c in "0123456789"]
    assert digits.select(F.sum(F.size(T.lookalike_spellings(F.col("raw"), seen)))).first()[0] == 14**3


def test_greedy_serials_equal_a_walk(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choices("0S589", k=3)) for _ in range(40)})
    near = {p for x in T.LOOKALIKES for p in (x, x[::-1])}
    cols = [(d, i, "".join(rng.choices("0S589", k=3))) for d in "ab" for i in range(1, 60)] + [("a", 60, None), ("b", 60, "3")]
    want = {}
    for d in "ab":
        own = sorted((c for c in cols if c[0] == d), key=lambda c: c[1])
        taken = {raw for _, _, raw in own if raw in known}
        for _, i, raw in own:
            free = [k for k in known if raw and len(k) == len(raw) and all(x == y or x + y in near for x, y in zip(raw, k, strict=True)) and k not in taken]
            want[d, i] = raw if raw in known else free[0] if len(free) == 1 else None
            taken |= {want[d, i]}
    got = E.greedy_serials(spark.createDataFrame(cols, "doc string, column int, raw string"), spark.createDataFrame([(k,) for k in known], "serial string"))
    assert {(r.doc, r.column): r.serial for r in got.collect()} == want and any(want.values())


def test_native_marks(spark):
    df = spark.createDataFrame([(0.05, 0.9), (0.5, 0.1), (0.5, 0.5), (0.2, 0.5)], "i double, c double")
    assert [r.s for r in df.select(P.classify_native(F.col("i"), F.col("c"), True).alias("s")).collect()] == ["none", "remove", "active", "planned"]


def test_empty_tables(spark):
    d = domain(spark, [])
    assert A.clones(d.flags().select("principal", "resource")).count() == 0
    assert A.changes(d).count() == 0
    assert A.individual(d).count() == 0


def test_whole_backup_and_import_metrics_are_registered(spark):
    from keylattice import registry

    rows = registry.QUERIES["q_backup_records"](spark, "/root/testdata/sf0.001").groupBy("kind").count().collect()
    sizes = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("supplier", "part")}
    assert {r.kind: r["count"] for r in rows if r.kind != "group"} == {"principal": sizes["supplier"], "resource": sizes["part"]}
    assert registry.QUERIES["q_import_changes"](spark, "/root/testdata/sf0.001").first().changed > 0
