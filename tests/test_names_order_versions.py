"""Folding, near names, tokens in places, global order, versions with several writers, and files that come in once."""

import datetime as dt
import random
import threading
import unicodedata

import pytest
from pyspark.sql import functions as F

from keylattice.functions import text as T
from keylattice.operators import groups as G
from keylattice.operators import reconcile as R
from keylattice.operators import resolve as E
from keylattice.plans import analysis as A
from keylattice.sources import files as S
from keylattice.sources import versions as V
from keylattice.sources.domain import Domain
from keylattice.streaming import arrivals


def _bare(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _norm(s):
    return "".join(c for c in _bare(s).casefold() if c.isalnum()).replace("0", "o")


def test_folding_by_unicode_rules(spark):
    odd = ["ﬁn", "Ａ１", "①", "Raum ½", "Straße", "ẞ", "İstanbul", "각한글", "é", "Ǆ", "ﷺ", "㍿", "ΣΊΣΥΦΟΣ", "\U0001d7d8\U0001d504", "٣", "፩", "plain 0.0", "", "ı", "ﬃ½①"]
    every = [chr(c) for c in range(0x80, 0x30000, 41) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(x,) for x in odd + every], "x string")
    for r in df.select("x", T.fold_marks(F.col("x")).alias("m"), T.casefold(F.col("x")).alias("f"), T.norm_door(F.col("x")).alias("n"), T.door_digits(F.col("x")).alias("d")).collect():
        assert (r.m, r.f, r.n, r.d) == (_bare(r.x), r.x.casefold(), _norm(r.x), "".join(c for c in _bare(r.x) if c.isdigit())), r.x


def test_iso_dates(spark):
    texts = "2024-01-02 20240102 2024-1-2 2024-13-01 2024-02-30 2024-W01-1 2024-W01-7 2024W012 2024-W01 2024W53 2020-W53-5 2021-W53-1 2015-W53-7 2026-W01-1 2024-W00-1 2024-W01-8 2024-W011 2024W01-1 2024-001 02.01.2024 0001-01-01".split() + ["", " 2024-01-02", "2024-01-02T00:00", "20240102\n"]

    def want(s):
        try:
            return dt.date.fromisoformat(s)
        except ValueError:
            return None

    got = {r.x: r.d for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.iso_date(F.col("x")).alias("d")).collect()}
    assert got == {t: want(t) for t in texts}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randint(0, len(s)), rng.random()
        if kind < 0.33:
            s.insert(at, rng.choice("abc"))
        elif s and kind < 0.66:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abc")
    return "".join(s)


def test_near_names_equal_all_pairs(spark):
    rng = random.Random(5)
    known = ["".join(rng.choices("abc", k=n)) for n in [1, 2, 3, 5, 8, 12, 20, 30, 31, 32, 33, 34, 35, 36, 37, 40, 60, 120] for _ in range(4)]
    asked = sorted({_edited(rng, rng.choice(known), rng.randint(0, 3)) for _ in range(150)} - {""})
    left = spark.createDataFrame([(a, i % 2) for a in asked for i in (len(a), len(a) + 1)], "key string, digits int")
    right = spark.createDataFrame([(k, i) for k in known for i in (0, 1)], "other string, digits int")
    got = {(r.key, r.other, r.digits): r.d for r in E.near_names(left, right, "digits").collect()}
    want = {(a, k, i): d for a in asked for k in set(known) for i in (0, 1) if (d := _distance(a, k)) <= 2}
    assert got == want and max(len(a) for a, _, _ in want) > 50


def test_names_without_digits_meet_by_few_candidates(spark):
    """Thousands of names in one block of equal digits and sides, all with the same beginning."""
    rng = random.Random(6)
    names = sorted({"besprechungsraum" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(4000)})
    known = spark.createDataFrame([(f"{i:05d}", n) for i, n in enumerate(names)], "serial string, door_name string")
    asked = spark.createDataFrame([(n[:18] + n[19:],) for n in names[::2]] + [(n[:20] + "xy" + n[22:],) for n in names[1::2]], "name string")
    got = {r.name: r.serial for r in E.match_names(asked, known).collect()}
    assert sum(s is not None for s in got.values()) > 0.99 * len(got)
    for i, n in enumerate(names[:200:2]):
        assert got[n[:18] + n[19:]] in (f"{2 * i:05d}", None)
    left, right = asked.select(F.col("name").alias("key")), known.select(F.col("door_name").alias("other"))
    pairs = left.withColumn("meet", F.explode(E._meeting(F.col("key"), True))).join(right.withColumn("meet", F.explode(E._meeting(F.col("other"), False))), "meet").select("key", "other").distinct().count()
    assert pairs < 3 * len(names)  # all pairs would be 16 million


def test_names_match_by_the_rule(spark):
    rng = random.Random(8)
    pool = ["Raum 201 O", "Raum 201 W", "Herd 1.OG", "Herd 2.OG", "Besprechungsraum", "Büro", "Buero", "Halle", "Halle", "Straße", "", "Küche links", "Küche rechts", "Ⅳ Raum", "1.0G", "Kopierer"]
    known = [(f"{i:03d}", n) for i, n in enumerate(pool + [_edited(rng, rng.choice(pool), 1) for _ in range(40)])]
    asked = sorted({_edited(rng, rng.choice(pool), rng.randint(0, 2)) for _ in range(120)} | {"STRASSE", "1.OG", "büro", "besprechunasraum", "halle"})
    sides = lambda s: spark_sides[s]
    texts = sorted({*asked, *(n for _, n in known)})
    spark_sides = {r.x: tuple(r.s) for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.door_sides(F.col("x")).alias("s")).collect()}
    digits = lambda s: "".join(c for c in _bare(s) if c.isdigit())

    def want(name):
        for serial, n in known:
            if n.casefold() == name.casefold():
                return serial
        key = _norm(name)
        same = [s for s, n in known if n and _norm(n) == key]
        if not key or same:
            return same[0] if key and len(same) == 1 else None
        scored = sorted((_distance(key, _norm(n)), s) for s, n in known if n and digits(n) == digits(name) and sides(n) == sides(name))
        return scored[0][1] if scored and scored[0][0] <= 2 and (len(scored) == 1 or scored[1][0] > scored[0][0]) else None

    got = {r.name: r.serial for r in E.match_names(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(known, "serial string, door_name string")).collect()}
    assert got == {a: want(a) for a in asked}


def test_tokens_in_places(spark):
    rng = random.Random(9)
    places = ["", "süd haus", "a", "ab"] + ["".join(rng.choices("abcd ", k=rng.randint(1, 20))) for _ in range(200)]
    tokens = ["", "a", "ab", "bca", "süd", "dddd", "zzz", "a b", *("".join(rng.choices("abcd ", k=rng.randint(1, 6))) for _ in range(30))]
    left = spark.createDataFrame([(p,) for p in places] + [(None,)], "place string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)] + [(99, None)], "grp int, token string")
    made = R.containing(left, "place", right)
    assert sorted((r.place, r.grp) for r in made.collect()) == sorted((p, i) for p in set(places) for i, t in enumerate(tokens) if t in p)
    assert "NestedLoop" not in made._jdf.queryExecution().toString()


def test_global_order(spark):
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(5)]), rng.choice(["", "same", "same", f"n{rng.random()}"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "number int, name string, _part int").repartition(7)
    made = E.rank_rows(df, F.asc_nulls_first("number"), "name", "_part")
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))}
    assert {(r.number, r.name, r._part): r["index"] for r in made.collect()} == want
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert E.rank_rows(df.limit(0), "name").count() == 0


def small_domain(spark, principals=("A", "B", "C", "D")):
    p = spark.createDataFrame([(s, 1, s) for s in principals], "serial string, number int, person_name string")
    r = spark.createDataFrame([("L1", "Door", "", "", "")], "serial string, door_name string, room_number string, location string, area string")
    g = spark.createDataFrame([(1, "G", "G", False)], "id long, name string, export_code string, is_implicit boolean")
    return Domain(p, r, g, spark.createDataFrame([("A", "L1", "active")], "principal string, resource string, state string"), spark.createDataFrame([("A", 1)], "principal string, grp long"), spark.createDataFrame([(1, "L1")], "grp long, resource string"))


def without(*serials):
    return lambda now: G.delete_principals(now, now.principal.sparkSession.createDataFrame([(s,) for s in serials], "serial string"))


def holding(d):
    return sorted(r.serial for r in d.principal.collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/domain"
    assert V.latest(spark, root) == 0
    V.publish(spark, root, V.write_version(small_domain(spark), root))
    pinned, tries = V.current(spark, root), []

    def slow(now):  # another writer publishes while this one works
        tries.append(1)
        if len(tries) == 1:
            V.change(spark, root, without("B"))
        return without("A")(now)

    assert holding(V.change(spark, root, slow)) == ["C", "D"] and len(tries) == 2
    assert V.latest(spark, root) == 3 and holding(pinned) == ["A", "B", "C", "D"] and holding(V.current(spark, root, 2)) == ["A", "C", "D"]
    with pytest.raises(V.Conflict):
        V.publish(spark, root, V.write_version(small_domain(spark), root), after=1)
    with pytest.raises(V.Conflict):
        V.change(spark, root, lambda now: V.change(spark, root, lambda x: x) and now, retries=2)
    assert holding(V.current(spark, root)) == ["C", "D"]


def test_many_writers_and_kept_versions(spark, tmp_path):
    root = f"file://{tmp_path}/domain"
    everyone = [f"P{i}" for i in range(6)]
    V.publish(spark, root, V.write_version(small_domain(spark, everyone), root))
    failed = []

    def work(serial):
        try:
            V.change(spark, root, without(serial), keep=3)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(s,)) for s in everyone[:3]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and holding(V.current(spark, root)) == everyone[3:] and V.latest(spark, root) == 4
    assert sorted(p.name for p in (tmp_path / "domain" / "log").iterdir() if p.name.isdigit()) == [f"{n:020d}" for n in (2, 3, 4)]
    assert len([p for p in (tmp_path / "domain").iterdir() if p.name.startswith("v-")]) == 3


def export(serials, rows):
    head = "head\n" * 5 + ";" * 8 + ";".join(serials) + "\n"
    return (head + "\n".join(";A;L;" + name + ";S;B;1;0;" + ";".join(marks) for name, marks in rows)).encode("utf-16")


def test_files_come_in_once(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/domain"
    folder.mkdir()
    V.publish(spark, root, V.write_version(small_domain(spark), root))
    (folder / "one.csv").write_bytes(export(["11XAB01"], [("Door", ["x"])]))
    (folder / "copy.csv").write_bytes(export(["11XAB01"], [("Door", ["x"])]))
    (folder / "odd.csv").write_bytes(b"\xff\xfea")

    def step(now, good):
        doc = S.csv_cells(good).where(f"r = {S.SERIAL_ROW}").select(F.col("text").alias("serial"), F.lit(9).alias("number"), F.lit("new").alias("person_name"))
        return Domain(now.principal.unionByName(doc), now.resource, now.grp, now.grants, now.membership, now.group_resource)

    judge = lambda files: S.outcomes(files).select("path", "error")

    def arrive(checkpoint):
        arrivals.import_arriving_once(spark, str(folder), root, str(tmp_path / checkpoint), judge, step, files_per_batch=10).awaitTermination()
        manifest = V.beside(spark, root, "manifest", V.latest(spark, root))
        return sorted((r.path.split("/")[-1], r.outcome == "imported") for r in manifest.collect())

    assert arrive("c1") == [("copy.csv", True), ("odd.csv", False)]
    assert holding(V.current(spark, root)) == ["11XAB01", "A", "B", "C", "D"] and V.latest(spark, root) == 2
    arrive("c2")  # all files once more, as after a lost checkpoint
    assert V.latest(spark, root) == 2
    (folder / "two.csv").write_bytes(export(["12XCD2E"], [("Door", [""])]))
    assert arrive("c2") == [("copy.csv", True), ("odd.csv", False), ("two.csv", True)]
    assert holding(V.current(spark, root)) == ["11XAB01", "12XCD2E", "A", "B", "C", "D"] and V.latest(spark, root) == 3


def test_outcomes_and_sizes_of_files(spark, monkeypatch):
    large = export([f"11XAB{i:02d}" for i in range(40)], [(f"Door {j}", ["x" if (i + j) % 3 else "" for i in range(40)]) for j in range(2000)])
    rows = [("a", export(["11XAB01", "11XAB02"], [("Door", ["x", "X"]), ("Hall", ["", "x"])])), ("b", b""), ("c", b"\xff\xfea"), ("d", large), ("e", 'head\n"open'.encode("utf-16"))]
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    got = {r.path: (r.outcome, r["columns"], r.doors, r.marks) for r in S.outcomes(files).collect()}
    assert got["a"] == ("read", 2, 2, 3) and got["b"] == ("empty", 0, 0, 0) and got["c"][0] == "faulty" and got["d"] == ("read", 40, 2000, sum((i + j) % 3 > 0 for i in range(40) for j in range(2000)))
    assert S.csv_cells(files.where("path = 'd'"), max_bytes=1000).first().error and S.csv_cells(files.where("path = 'd'")).where("error IS NOT NULL").count() == 0


def test_members_in_order(spark):
    d = small_domain(spark)
    members = spark.createDataFrame([("C", 1), ("A", 1), ("D", 1)], "principal string, grp long")
    d = Domain(d.principal.withColumn("number", F.when(F.col("serial") != "D", 4)), d.resource, d.grp, d.grants, members, d.group_resource)
    assert [(r.principal, r.place) for r in A.group_members(d, 1).orderBy("place").collect()] == [("D", 1), ("A", 2), ("C", 3)]
