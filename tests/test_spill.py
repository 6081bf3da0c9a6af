"""What a task puts in order is bounded and narrow, and odd rows give what they always gave."""

import re

import numpy as np
import pyarrow as pa
import pytest

from keylattice.plans import raster as RA
from keylattice.sources import files as S
from keylattice.sources import shared

CELLS = "doc string, r int, c int, text string, error string"


def _nodes(df):
    """(depth, text) of the operators of a plan, from the top."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(re.search(r"[A-Za-z]", line).start(), line) for line in plan.splitlines() if re.search(r"[A-Za-z]", line)]


def _above(nodes, k):
    """The operators above the k-th one."""
    depth, out = nodes[k][0], []
    for d, line in reversed(nodes[:k]):
        if d < depth:
            depth = d
            out.append(line)
    return out


def odd_cells():
    """Cells of lines that come twice, in no order, with blank and null texts, without a name, of faulty files and of no file."""
    rows = [(doc, 5, 8 + k, f"S{k}", None) for doc in ("a", "b") for k in range(3)] + [("a", 5, 11, "", None), ("a", 5, 7, "no", None)]
    for doc, n in (("a", 40), ("b", 7)):
        for r in range(6, 6 + n):
            rows += [(doc, r, c, f"{t} {r} {doc}", None) for c, t in ((0, "sys"), (1, "North"), (2, "L"), (3, "Hall  east"), (4, "S"), (5, "B"), (6, "2"), (7, "R")) if (r + c) % 5 or c == 3]
            rows += [(doc, r, 8 + k, "xX"[r % 2], None) for k in range(4) if (r + k) % 3 == 0]
    rows += [("a", 50, c, t, None) for c, t in ((3, ""), (2, "L"), (8, "x"))] + [("a", 51, 3, None, None), ("a", 51, 8, "x", None), ("a", 52, 2, "only", None), ("a", 53, 3, "only a name", None)]
    rows += [("a", 7, 3, "Zimmer", None), ("a", 7, 3, "Aula", None), ("a", 8, 8, "y", None), ("a", 2, 8, "x", None), ("a", 9, 4, "x", None), ("a", None, 3, "x", None), ("a", 6, None, "x", None)]
    rows += [("bad", 6, 3, "Hall", None), ("bad", 5, 8, "S", None), ("bad", 6, 8, "x", None), ("bad", None, None, None, "cut off"), (None, 6, 3, "Hall", None), (None, 5, 8, "S", None), (None, 6, 8, "x", None)]
    return rows + rows[:60]


def _by_hand(rows):
    good = {row[:4] for row in rows if row[0] not in (None, "bad") and row[1] is not None and row[2] is not None and row[3] is not None}
    doors = {}
    for doc in sorted({g[0] for g in good}):
        lines = {}
        for _, r, c, text in (g for g in good if g[0] == doc and g[1] >= 6 and 1 <= g[2] <= 7):
            lines.setdefault(r, [""] * 8)[c] = max(text, lines.get(r, [""] * 8)[c])
        for ri, r in enumerate(sorted(r for r, v in lines.items() if v[3])):
            v = [" ".join(t.split()) for t in lines[r]]
            doors[doc, r] = (doc, ri, lines[r][2], v[3], v[7], ".".join(t for t in (v[4], v[5], v[6]) if t), v[1])
    return good, doors


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_doors_of_odd_cells(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "TASK_ROWS", most)
    rows = odd_cells()
    _, want = _by_hand(rows)
    doors = S.csv_matrix(spark.createDataFrame(rows, CELLS).repartition(5))[1]
    assert doors.columns == ["doc", "serial", "door_name", "room_number", "location", "area", "ri"]
    got = doors.select("doc", "ri", "serial", "door_name", "room_number", "location", "area")
    assert sorted(map(tuple, got.collect())) == sorted(want.values())


def test_texts_of_doors_are_put_in_order_once(spark, monkeypatch):
    """They are dealt by line before they are grouped, to as many tasks as their number asks for."""
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    cells = shared.settled(spark.createDataFrame(odd_cells(), CELLS))
    tables = []
    monkeypatch.setattr(S, "settled", lambda df: (tables.append(_nodes(df)), shared.settled(df))[1])
    S.csv_matrix(cells)
    (nodes,) = [n for n in tables if any("SortAggregate" in line for _, line in n)]
    for k, (_, line) in enumerate(nodes):
        if "SortAggregate" in line:
            assert not any("Exchange" in x for x in _above(nodes, k))
    dealt = [int(m[1]) for _, line in nodes for m in [re.search(r"hashpartitioning\(doc#\d+, r#\d+, (\d+)\), REPARTITION_BY_NUM", line)] if m]
    assert dealt == [-(-cells.count() // 10)]


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_marks_of_odd_cells(spark, monkeypatch, most):
    """Twice as many marks for a column or a cross that comes twice, none for a line without a name, a faulty file or one without a path."""
    monkeypatch.setattr(shared, "TASK_ROWS", most)
    rows = odd_cells()
    heads = sorted((row[0], row[2]) for row in rows if row[0] in ("a", "b") and row[1] == 5 and row[2] >= 8)
    ci = [(doc, c, [x for x in heads if x[0] == doc].index((doc, c)) + k) for i, (doc, c) in enumerate(heads) for k in [i - heads.index((doc, c))]]
    _, doors = _by_hand(rows)
    want = [(doc, i, doors[doc, r][1]) for doc, r, c, text, _ in rows if text and text.lower() == "x" and (doc, r) in doors for d, at, i in ci if (d, at) == (doc, c)]
    for threshold in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = [tuple(r) for r in S.csv_matrix(spark.createDataFrame(rows, CELLS).repartition(5))[2].select("doc", "ci", "ri").collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(got) == sorted(want) and len(got) > len(set(got)) > 0


def test_crosses_are_not_put_in_order_for_their_columns(spark, monkeypatch):
    """Columns are hashed where they are not broadcast, and crosses are dealt by line to as many tasks as the cells ask for."""
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    cells = shared.settled(spark.createDataFrame(odd_cells(), CELLS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [line for _, line in _nodes(S.csv_matrix(cells)[2])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("ShuffledHashJoin [doc" in line and ", c#" in line for line in lines) == 1
    assert not any("SortMergeJoin [doc" in line and ", c#" in line for line in lines)
    dealt = [int(m[1]) for line in lines for m in [re.search(r"hashpartitioning\(doc#\d+, r#\d+, (\d+)\), REPARTITION_BY_NUM", line)] if m]
    assert dealt == [-(-cells.count() // 10)]


RASTER = "doc string, page int, y int, px array<int>"


def _hatched(seed=4, height=90, width=60):
    """A page with four vertical rulings and three horizontal ones, and hatching that is ink in many parts of a position, but not in all."""
    y, x = np.mgrid[:height, :width]
    img = np.where(((x + y) % 5 < 3) & (y > 12) & (y < height - 12) & (x > 26), 90, 255)
    img[np.random.default_rng(seed).random(img.shape) < 0.02] = 0
    img[:, [3, 25, 26, 50]] = 0
    img[[5, 40, 80]] = 0
    return img


def _rows(doc, img):
    return [(doc, 1, y, [int(v) for v in row]) for y, row in enumerate(img)]


def _found(rows, bands, gap=8):
    """Vertical rulings by hand: the ink of all rows of a page, repeated ones too, by position and part."""
    out = {}
    for doc in sorted({r[0] for r in rows if r[0] is not None}):
        own = [r for r in rows if r[0] == doc]
        height, width = max(r[2] for r in own) + 1, max(len(r[3]) for r in own if r[3] is not None)
        parts = min(height, bands)
        edge = [(2 * k * height + parts) // (2 * parts) for k in range(parts + 1)]
        ink = np.zeros((parts, width), int)
        for _, _, y, px in own:
            for x, v in enumerate(px or ()):
                ink[next(k for k in range(parts) if k * height / parts < y + 0.5 <= (k + 1) * height / parts), x] += v is not None and v < 128
        runs, lines = [], []
        for x in np.flatnonzero((510 * ink >= 279 * np.diff(edge)[:, None]).all(0)):
            runs.append([x]) if not runs or runs[-1][-1] != x - 1 else runs[-1].append(x)
        for at in (float(np.mean(r)) for r in runs):
            if lines and at - lines[-1] < gap:
                lines[-1] = (lines[-1] + at) / 2
            else:
                lines.append(at)
        if lines:
            out[doc] = lines
    return out


def _read(pages, threshold, known=True):
    spark = pages.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        whole = RA.page_sizes(pages).selectExpr("doc", "page", "0 AS x0", "0 AS y0", "width AS x1", "height AS y1", *(["rows"] if known else []))
        return {r.doc: r.lines for r in RA.rulings(pages, whole, "v", 12).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_rulings_of_odd_rows(spark, threshold):
    """Pages in one task and cut over many, rows that are missing, short, null or come twice, and pages without an id."""
    a, b = _hatched(1), _hatched(2)
    rows = _rows("a", a) + [r for r in _rows("b", b) if r[2] not in (7, 8, 30)] + [(d, p, y, px[: 30 + y]) for d, p, y, px in _rows("short", a)] + [(None, *r[1:]) for r in _rows("c", a)]
    rows += [(d, p, y, None if y == 20 else [None if x == 9 else v for x, v in enumerate(px)]) for d, p, y, px in _rows("null", b)] + _rows("one", a[:1]) + _rows("white", np.full((9, 9), 255))
    want = _found(rows, 12)
    assert len(want) >= 4 and len(want["a"]) == 3
    for pages in (spark.createDataFrame(rows, RASTER).coalesce(1), spark.createDataFrame(rows, RASTER).repartition(7)):
        assert _read(pages, threshold) == _read(pages, threshold, False) == want
    half = b.copy()
    half[:50, 12], half[50:, 40] = 0, 255
    twice = _rows("a", a) * 2 + _rows("b", b) + [(d, p, y, [int(v) for v in px]) for (d, p, y, _), px in zip(_rows("b", b), half, strict=True)]
    pages = spark.createDataFrame(twice, RASTER).coalesce(1)
    assert _read(pages, threshold) == _read(pages, threshold, False) == _found(twice, 12)


def test_of_a_page_that_is_there_whole_only_rulings_go_on():
    img = _hatched()
    n = len(img)
    sizes = {"x0": 0, "y0": 0, "x1": img.shape[1], "y1": n}
    fixed = {c: pa.array(np.full(n, v, np.int32)) for c, v in sizes.items()}
    page = {"doc": pa.array(["d"] * n), "page": pa.array(np.ones(n, np.int32)), "y": pa.array(np.arange(n, dtype=np.int32)), "px": pa.array([[int(v) for v in row] for row in img], pa.list_(pa.int32())), **fixed}
    counted = lambda rows, part: pa.Table.from_batches(RA._ink_counts(iter([pa.RecordBatch.from_pydict(page | {"rows": pa.array(np.full(n, rows, np.int64))}).slice(*part)]), "v", 12, RA.RULED))
    whole = counted(n, (0, n))
    assert sorted(set(whole.column("pos").to_pylist())) == [3, 25, 26, 50] and whole.num_rows == 4 * 12
    more, some = counted(n + 1, (0, n)), counted(n, (0, 50))
    assert more.num_rows > whole.num_rows and set(some.column("pos").to_pylist()) > {3, 25, 26, 50}


def test_rows_of_pixels_are_not_put_in_order(spark):
    pages = spark.createDataFrame(_rows("a", _hatched()), RASTER)
    whole = RA.page_sizes(pages).selectExpr("doc", "page", "0 AS x0", "0 AS y0", "width AS x1", "height AS y1", "rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [line for _, line in _nodes(RA.rulings(pages, whole, "v", 12))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("ShuffledHashJoin" in line for line in lines) and not any("SortMergeJoin" in line for line in lines)
