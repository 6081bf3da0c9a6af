"""Repair of a conversation's structure: A* on the lattice of edits, keyed (cost + heuristic, audit).

Faults are column expressions and one window; a conversation's rows then pass a task as a sorted stream. The search sees
two bytes a row, a role's initial and a fault. Its nodes are (rows read, state of the wanted pattern `(s?(ua)+)?`); the heuristic
sums what the rows still to be read cost in any case: the deletions that are required, and the smaller of deletion and
charge of truncated rows. A long conversation is searched in blocks of BLOCK rows from each state to each state, and blocks are joined
by cost and audit, so work and memory grow with its length. Texts wait in a spooled file until the edits are known.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.llm.common import table

#: White space at the end of a text, and the marks that end a whole one; fixed values.
BLANKS, MARKS = " \t\n\x0b\f\r", ".!?"
NONE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
#: Rows of a conversation that one search takes, and bytes of its texts that stay in memory.
BLOCK, SPOOL = 256, 8 << 20

# States of the pattern: nothing yet, after the system row, after a user row, after a pair. Nothing and a pair may end it.
START, SYSTEM, USER, PAIR, END = range(5)
STEP = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": PAIR},
    PAIR: {"u": USER},
}
#: The one role that may be written next, by an insertion or a new role.
NEXT = {START: "u", SYSTEM: "u", USER: "a", PAIR: "u"}
ROLE = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """Prices of edits; keeping a row costs nothing, and `truncated` is charged for every truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert <= 0:
            raise ValueError("costs must not be negative, and insertions must cost something")


def writes(state: int) -> list[tuple[int, int]]:
    """(number of insertions, state after them): none, one or two; a third would only add a pair again."""
    out = [(0, state)]
    for n in (1, 2):
        out.append((n, STEP[out[-1][1]][NEXT[out[-1][1]]]))
    return out


WRITES = {s: writes(s) for s in STEP}


@lru_cache(maxsize=50_000)
def search(initials: str, faults: bytes, entry: int, last: bool, costs: Costs) -> dict[int, tuple[int, str]]:
    """Cheapest edits of a block of rows from state `entry`: state after it to (cost, audit), and of the last block only
    that of the END. Among equal costs the audit that is least in ASCII.

    An edge is a row's edit with the insertions before it, so no audit of a node is the beginning of another one.
    """
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        must = costs.delete if faults[i] in (BLANK, DUPLICATE) else min(costs.delete, costs.truncated) if faults[i] == TRUNCATED else 0
        rest[i] = rest[i + 1] + must
    heap, done, out = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i > n or (i == n and not last):
            out[state] = (f, audit)
            if state == END:
                break
            continue
        g = f - rest[i]
        if i == n:
            for k, s in WRITES[state]:
                if s in (START, PAIR):
                    heapq.heappush(heap, (g + k * costs.insert, audit + "I" * k, n + 1, END))
            continue
        ahead, row, fault = rest[i + 1], initials[i], faults[i]
        heapq.heappush(heap, (g + costs.delete + ahead, audit + "D", i + 1, state))
        if fault in (BLANK, DUPLICATE):
            continue
        stays = g + ahead + (costs.truncated if fault == TRUNCATED else 0)
        for k, s in WRITES[state]:
            before, paid = audit + "I" * k, stays + k * costs.insert
            if row in STEP[s]:
                heapq.heappush(heap, (paid, before + "K", i + 1, STEP[s][row]))
            heapq.heappush(heap, (paid + costs.rerole, before + "R", i + 1, STEP[s][NEXT[s]]))
    return out


def repair(initials: str, faults: bytes, costs: Costs = Costs(), block: int = BLOCK) -> tuple[int, str]:  # noqa: B008
    """Cost and audit of the cheapest edits that give the pattern, ties to the audit that is least in ASCII.

    Blocks after the first are searched from every state. Of two paths of equal cost the audit before the block decides, and then
    that in it: audits before a block have an edit for each row and end with one, so none begins another.
    """
    ends = range(block, max(len(initials), 1) + block, block)
    reached: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, and place of its audit among the others
    steps: list[dict[int, tuple[int, str]]] = []  # of each block, state after it: state before it, and audit
    for end in ends:
        mine, last = slice(end - block, end), end >= len(initials)
        found: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, place) in reached.items():
            for after, (more, audit) in search(initials[mine], faults[mine], state, last, costs).items():
                found[after] = min(found.get(after, (cost + more, place, audit, state)), (cost + more, place, audit, state))
        order = sorted(found, key=lambda s: found[s][1:3])  # noqa: B023
        reached = {s: (found[s][0], order.index(s)) for s in found}
        steps.append({s: (found[s][3], found[s][2]) for s in found})
    state, parts = END, []
    for step in reversed(steps):
        state, audit = step[state]
        parts.append(audit)
    return reached[END][0], "".join(reversed(parts))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, `seen` (place among equal rows) and `fault`, the first that holds: blank, duplicate, truncated. Null roles and texts are a space.

    One exchange by conv_id serves the window and the stream after it.
    """
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), *(c for c in rows.columns if c == "gone"))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    ended = F.rtrim("text", F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("gone"), GONE).when(ended == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(ended, F.lit(1)).isin(*MARKS), TRUNCATED).otherwise(NONE)
    return rows.withColumn("gone", gone).repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault.cast("int")).drop("gone")


class Conversation:
    """One conversation's rows as they pass, without their texts."""

    def __init__(self, key: int | None):
        self.key, self.initials, self.faults = key, [], bytearray()
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.texts = tempfile.SpooledTemporaryFile(SPOOL)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault == GONE:
            return
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        initial = role[:1]
        if self.faults:
            self.illegal += self.initials[-1] + initial not in ("su", "ua", "au")
        # An empty role has no initial, and a space fits nowhere either.
        self.initials.append(initial or " ")
        self.faults.append(fault)
        if fault not in (BLANK, DUPLICATE):
            for part in (role.encode(), text.encode()):
                self.texts.write(len(part).to_bytes(8, "little") + part)

    def rows(self, audit: str) -> Iterator[tuple[str, bytes]]:
        """Role and text of the repaired rows, in order."""
        self.texts.seek(0)
        take = lambda: self.texts.read(int.from_bytes(self.texts.read(8), "little"))
        state, faults = START, iter(self.faults)
        for edit in audit:
            if edit == "I":
                role, text = ROLE[NEXT[state]], b""
            else:
                if next(faults) in (BLANK, DUPLICATE):
                    continue
                role, text = take().decode(), take()
                if edit == "D":
                    continue
                role = ROLE[NEXT[state]] if edit == "R" else role
            state = STEP[state][role[:1]]
            yield role, text

    def close(self, costs: Costs, texts: bool) -> dict:
        cost, audit = repair("".join(self.initials), bytes(self.faults), costs)
        digest, kept = hashlib.sha256(), []
        for i, (role, text) in enumerate(self.rows(audit)):
            digest.update(b"\n" * (i > 0) + role.encode() + b":")
            digest.update(text)
            if texts:
                kept.append({"role": role, "text": text.decode()})
        self.texts.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = {name: self.faults.count(fault) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        out = {"conv_id": self.key, "gaps": gaps, **counts, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}
        return out | {"repaired": kept} if texts else out


KIND = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
TEXTS = pa.field("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))


def repair_conversations(rows: DataFrame, costs: Costs = Costs(), texts: bool = False, lost: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """One row for each conversation of `rows` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost,
    audit (initials of Delete, Insert, Keep, Rerole in order), repaired_sha256 and, on request, repaired (role, text).

    lost: conv_ids that get a row even if `rows` has none; it is all zeros, with an empty audit. Rows go by turn, null first; rows of
    one turn by role and text. Null roles and texts count as a space; a role that starts with none of s, u, a fits nowhere
    as it is. Rows with a null conv_id are one conversation; repeated rows are duplicates; blank texts are blank, long ones whole;
    other columns are not read; an empty table gives an empty result. A conversation passes one task as a stream, since one hash covers it.
    """
    all_rows = rows.select("conv_id", "turn", "role", "text").withColumn("gone", F.lit(False))
    if lost is not None:
        nothing = F.lit(None).cast("string")
        all_rows = all_rows.unionByName(lost.select("conv_id", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), F.lit(True).alias("gone")))
    schema = pa.schema([*KIND, TEXTS]) if texts else KIND
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen"]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ready = None, []
        for batch in batches:
            for key, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or key != current.key:
                    if current is not None:
                        ready.append(current.close(costs, texts))
                    current = Conversation(key)
                current.add(turn, role, text, fault)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.close(costs, texts)], schema)

    sorted_rows = with_faults(all_rows).sortWithinPartitions(*order).drop("seen")
    names = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return sorted_rows.mapInArrow(repaired, names + (", repaired array<struct<role:string,text:string>>" if texts else ""))


def damage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (conv_id, turn, role, text) with known damage, and the conv_ids of the rows that it drops.

    crc32 of `conv_id:turn` mod 20 decides: 0 drops a row, 1 empties its text, 2 takes its marks, 3 repeats it, 4 makes it a user's. A
    null is a space, also in that name.
    """

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    marked = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    kept = marked.where("hit > 0").select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))
    return kept.drop("times"), marked.where("hit = 0").select("conv_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of all `conversations` after `damage`; odd
    rows as in `repair_conversations`."""
    rows, lost = damage(table(spark, sf_dir, "conversations"))
    return repair_conversations(rows, lost=lost)


def _least(states: list[str], edits: list[tuple[str, int | str, str, str]]) -> str:
    """SQL: the least of some (state, cost, edit, written) as one struct."""
    alls = [f"{{'c': {s}.c + {c}, 'a': {s}.a || '{e}', 'o': {s}.o || {o}}}" for s, c, e, o in edits]
    return f"list_min([{', '.join([*states, *alls])}])"


def _oracle() -> str:
    """A walk over each conversation's rows with the cheapest (cost, audit, repaired) of each state, by a recursive query."""
    word = r"[^\x20\x09-\x0D]"
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"
    line = lambda role: f"(chr(10) || {role} || ':' || text)"
    new = lambda role: f"(chr(10) || '{role}:')"
    # Insertions before a row: u2 and p3 are the states after them.
    first = _least(["u"], [(s, 5, "I", new("user")) for s in ("n", "s", "p")])
    pair = _least(["p"], [("u1", 5, "I", new("assistant"))])
    again = _least(["u1"], [("p1", 5, "I", new("user"))])
    stay = "CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 5 ELSE 0 END"
    keep = lambda initial: f"({stay} + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000 END)"
    user = _least([], [("u", 2, "D", "''"), *((s, keep("u"), "K", line("role")) for s in ("n", "s", "p1")), *((s, f"({stay} + 1)", "R", line("'user'")) for s in ("n", "s", "p1"))])
    both = _least([], [("p", 2, "D", "''"), ("u2", keep("a"), "K", line("role")), ("u2", f"({stay} + 1)", "R", line("'assistant'"))])
    end = _least(["n", "p"], [("u", 5, "I", new("assistant")), ("s", 10, "II", f"({new('user')} || {new('assistant')})")])
    return f"""
    WITH RECURSIVE crcs AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
            FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS name
            FROM conversations),
    hits AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, name), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) % 20 AS hit FROM raw, crcs),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
               CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM hits, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged)),
    faults AS (SELECT *, left(role, 1) AS initial, count(*) OVER (PARTITION BY conv_id) AS n,
                      CASE WHEN NOT regexp_matches(text, '{word}') THEN 1 WHEN seen > 1 THEN 2
                           WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
    walk AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS n, {far} AS s, {far} AS u, {far} AS p FROM damaged
        UNION ALL
        SELECT conv_id, i, {_least([], [("n", 2, "D", "''")])}, {_least([], [("s", 2, "D", "''"), ("n", keep("s"), "K", line("role"))])}, {user}, {both}
        FROM (SELECT *, {again} AS u2 FROM (SELECT *, {pair} AS p1 FROM (SELECT *, {first} AS u1 FROM (
            SELECT faults.conv_id, faults.i, role, text, initial, fault, walk.n, s, u, p
            FROM walk JOIN faults ON faults.conv_id IS NOT DISTINCT FROM walk.conv_id AND faults.i = walk.i + 1))))),
    ends AS (SELECT walk.conv_id, {end} AS best FROM walk
             JOIN (SELECT conv_id, count(*) AS k FROM damaged GROUP BY conv_id) c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id AND c.k = walk.i),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                      count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE = {"op11_conversation_repair": _oracle()}
