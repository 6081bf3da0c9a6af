"""Lexical search, shards and conversation repair against brute force and on odd tables."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keylattice.llm import conversation_repair as cr
from keylattice.llm import lexical_search as ls
from keylattice.llm import sharding as sh
from keylattice.llm.common import shared_path

DIR = "/root/testdata/sf0.001"


# --- search ---


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _ranked(docs, items, k=10):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked, found = Counter(_terms(text)), []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // words
            score = sum(times * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(heapq.nsmallest(k, found, key=lambda x: (x[0], x[1], x[2] or 0)))]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [7, 1 << 20])
def test_search_equals_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(ls, "BLOCK_POSTINGS", postings)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Straße", "é9", "日本", "x_y", "A-B"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 30)))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 340)] + [(None, docs[5][1]), (7, docs[7][1]), (500, None), (501, ""), (502, " .,"), (503, "w39 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(31, docs[5][1]), (32, docs[5][1]), (31, docs[5][1]), (None, "w1 w1 W2"), (40, None), (41, ""), (42, "zzz nothing"), (43, "w39 w39 é9")]
    left = spark.createDataFrame([(i, t, "old", 1) for i, t in docs], "doc_id long, text string, score string, n int").repartition(5)
    right = spark.createDataFrame([(i, t, "old") for i, t in items], "item_id long, text string, doc_id string")
    want = _ranked(docs, items)
    assert sorted((tuple(r) for r in ls.search(left, right).collect()), key=str) == want
    assert sorted((tuple(r) for r in ls.search(left, right, question_bytes=400).collect()), key=str) == want  # several blocks of items
    assert sorted((tuple(r) for r in ls.search(left, right, k=2).collect()), key=str) == _ranked(docs, items, 2)
    assert ls.search(left.limit(0), right).count() == ls.search(left, right.limit(0)).count() == 0


def test_search_stops_early(monkeypatch):
    """A rare word decides, so the postings of frequent ones stay untouched."""
    rng = np.random.default_rng(4)
    n = 5000
    sizes, terms, tfs = [], [], []
    for i in range(n):
        own = sorted({0, 1, 2 + int(rng.integers(20))} | ({99} if i % 500 == 0 else set()))
        sizes.append(len(own)), terms.extend(own), tfs.extend(1 if t else int(rng.integers(1, 9)) for t in own)
    df = np.bincount(terms, minlength=100)
    w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df])
    block = ls.ImpactBlock(np.arange(n), np.zeros(n, int), np.full(n, 50), np.array(sizes), np.array(terms), np.array(tfs), ls.Weights(w, n, 50 * n))
    taken = []
    at = np.add.at
    monkeypatch.setattr(ls.np, "add", type("Add", (), {"at": staticmethod(lambda a, i, x: (taken.append(len(i)), at(a, i, x))[1])}), raising=False)
    near, score = block.best(np.array([0, 1, 99]), np.array([1, 1, 3]), 10, 1, np.zeros(100, np.int64))
    assert sorted(near[score > 0].tolist()) == [i for i in range(n) if i % 500 == 0] and sum(taken) < n


# --- shards ---


def _coordinates(spark, docs):
    cols = [bin_of(c).alias(f"c{i}") for i, (c, bin_of) in enumerate(sh.DIMENSIONS.items())]
    return [tuple(r) for r in docs.select("doc_id", sh.size_of(), sh.tie(), *cols).collect()]


def _brute_tree(rows, first, shards, out):
    """Whole nodes sorted in one place: the rule of the tree without sums."""
    if shards == 1 or not rows:
        out.update({r: first for r in rows})
        return
    spread = [max(r[3 + d] for r in rows) - min(r[3 + d] for r in rows) for d in range(3)]
    d = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: (r[3 + d], r[2]))
    want, upto, cut = sum(r[1] for r in rows) * (shards // 2) / shards, 0, len(rows)
    for i, r in enumerate(rows):
        if upto + r[1] >= want:
            cut = i + round((want - upto) / r[1])
            break
        upto += r[1]
    _brute_tree(rows[:cut], first, shards // 2, out)
    _brute_tree(rows[cut:], first + shards // 2, shards - shards // 2, out)


@pytest.mark.parametrize("few", [1, 4096])
def test_shards_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(sh, "FEW", few)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("xx").alias("lang"), F.lit("one source").alias("source"), "n_chars"))
    rows = _coordinates(spark, docs)
    want = {}
    _brute_tree(rows, 0, 13, want)
    got = sh.shard_documents(docs, shared_path(spark, "shards"), shards=13).collect()
    assert {r.doc_id: r.shard for r in got} == {r[0]: s for r, s in want.items()} and len(got) == len(rows)
    for s in range(13):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text.encode()) + 16
    most = max(len(r.text.encode()) for r in got) + 16
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most


def test_shards_of_odd_tables(spark):
    rows = [(i % 7 if i % 5 else None, [None, "", "é" * 50, "z" * 100_000, "a b c"][i % 5], [None, "en"][i % 2], "s", "old", "old") for i in range(100)] + [(1, "the same row " * 20, "en", "s", "old", "old")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, tie string")
    got = sh.shard_documents(docs, shared_path(spark, "shards"), target_bytes=250_000)
    assert set(got.columns) == {*docs.columns, "slot"}
    out = got.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.lang) for r in out))) == sorted(map(str, (r[:3] for r in rows))) and {r.tie for r in out} == {"old"}
    total = sum(len((r[1] or "").encode()) + 16 for r in rows)
    assert max(r.shard for r in out) == -(-total // 250_000) - 1
    same = spark.createDataFrame([(1, "equal", "en", "s")] * 1000, "doc_id long, text string, lang string, source string")
    counts = Counter(r.shard for r in sh.shard_documents(same, shared_path(spark, "shards"), shards=4).collect())
    assert len(counts) == 4 and max(counts.values()) < 400  # rows that nothing tells apart are dealt by chance
    assert sh.shard_documents(docs.limit(0), shared_path(spark, "shards"), shards=4).count() == 0


def test_shards_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = sh.op12_kd_sharding(spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and r["size"] == len((docs[r.doc_id] or "").encode()) + 16 for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(40))


# --- conversations ---


def _all_edits(initials, faults, costs):
    """Every sequence of edits with at most two insertions in a row, by trial: least cost, then least audit."""
    best = None
    options = []
    for row, fault in zip(initials, faults, strict=True):
        own = [("D", costs.delete, "")]
        if fault not in (cr.BLANK, cr.DUPLICATE):
            more = costs.truncated if fault == cr.TRUNCATED else 0
            own += [("K", more, row), ("R", more + costs.rerole, "u"), ("R", more + costs.rerole, "a")]
        options.append(own)
    writes = [[("I" * len(w), costs.insert * len(w), "".join(w)) for k in range(3) for w in itertools.product("ua", repeat=k)]] * (len(initials) + 1)
    for edits in itertools.product(*options):
        for new in itertools.product(*writes):
            parts = [x for pair in itertools.zip_longest(new, edits, fillvalue=("", 0, "")) for x in pair]
            if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in parts)):
                found = sum(p[1] for p in parts), "".join(p[0] for p in parts)
                best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("costs", [cr.Costs(), cr.Costs(3, 4, 1, 2), cr.Costs(1, 9, 2, 3), cr.Costs(0, 1, 1, 0)])
def test_repair_equals_trial_of_all_edits(costs):
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(0, 3)
        initials, faults = "".join(rng.choice("suaux") for _ in range(n)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert cr.repair(initials, faults, costs) == _all_edits(initials, faults, costs), (initials, faults)


@pytest.mark.parametrize("costs", [cr.Costs(), cr.Costs(3, 4, 1, 2), cr.Costs(2, 9, 2, 3)])
def test_blocks_of_a_conversation_equal_one_search(costs):
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(0, 25)
        initials, faults = "".join(rng.choice("suauauax") for _ in range(n)), bytes(rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))
        whole = cr.repair(initials, faults, costs, block=1000)
        assert all(cr.repair(initials, faults, costs, block=b) == whole for b in (1, 2, 3, 7))


def test_costs_are_checked():
    for bad in ({"insert": 0}, {"rerole": -1}, {"delete": -2}):
        with pytest.raises(ValueError):
            cr.Costs(**bad)


def _repaired(rows):
    """Rows of one conversation: all result columns, by a plain walk over every state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\f\r")
        faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    best = {"": (0, "", ())}
    step = lambda s, x: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}[s].get(x)

    def offer(to, state, found):
        if state is not None and (state not in to or found < to[state]):
            to[state] = found

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s, (c, a, o) in list(out.items()):
                for role in ("user", "assistant"):
                    offer(out, step(s, role[0]), (c + 5, a + "I", (*o, f"{role}:")))
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (c, a, o) in best.items():
            offer(new, s, (c + 2, a + "D", o))
        for s, (c, a, o) in inserted(best).items() if fault not in (1, 2) else ():
            c += 5 * (fault == 3)
            offer(new, step(s, role[:1]), (c, a + "K", (*o, f"{role}:{text}")))
            for r in ("user", "assistant"):
                offer(new, step(s, r[0]), (c + 1, a + "R", (*o, f"{r}:{text}")))
        best = new
    cost, audit, out = min(x for s, x in inserted(best).items() if s in ("", "p"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), list(out))


def test_conversations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", 5)
    monkeypatch.setattr(cr, "SPOOL", 50)
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut", "cut off ", "", " \t", None, "what? \n", "日本。", "é."]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts), "old") for _ in range(150)]
    rows += [(9, t, ["user", "assistant"][t % 2], f"text {t}." * 500, "old") for t in range(300)] + [(10, None, "user", "x", "old")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    lost = spark.createDataFrame([(77,), (77,), (1,)], "conv_id long")
    got = {r.conv_id: r for r in cr.repair_conversations(frame, texts=True, lost=lost).collect()}
    assert got.keys() == {r[0] for r in rows} | {77}
    for key, r in got.items():
        want = _repaired([(t, " " if a is None else a, " " if b is None else b) for k, t, a, b, _ in rows if k == key])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[:8], key
        assert [f"{x.role}:{x.text}" for x in r.repaired] == want[8]
    assert tuple(got[77])[1:9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert cr.repair_conversations(frame.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, None if t == 5 else "assistant", None if t == 4 else "Is it? Yes.") for c in [None, *range(30)] for t in [None, *range(6)]]
    kept, lost = cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want, gone = [], []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if hit == 4 else role or " ", {1: "", 2: (text or " ").replace("?", "").replace(".", "")}.get(hit, text or " ")
        gone += [c] * (hit == 0)
        want += [(c, t, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert sorted(str(r.conv_id) for r in lost.collect()) == sorted(map(str, gone))
