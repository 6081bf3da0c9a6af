"""Entity resolution: fuzzy joins that block on equal keys before they compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.functions import text as T
from keylattice.sources.shared import settled

#: Names up to SHORT letters meet by what is left after deletions, names from SHORT - EDITS letters by two of PIECES pieces.
EDITS, SHORT, PIECES = 2, 34, 4
#: Known names of equal digits and sides that are all compared with a name; a name of twenty letters has about 200 keys.
FEW = 64


def _spellings(key: Column) -> Column:
    """Hashes of a short name without any one or two of its letters, and of itself: names within two edits share one."""
    n = F.length(key)
    without = lambda s, i: F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, n))
    places = F.filter(F.sequence(F.lit(-1), n - 1), lambda i: i >= 0)
    once = F.transform(places, lambda i: without(key, i))
    twice = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: without(without(key, j), i))))
    return F.array_distinct(F.transform(F.concat(F.array(key), once, twice), lambda s: F.xxhash64(F.lit("spelling"), s)))


def _pieces(key: Column, asked: bool) -> Column:
    """Hashes of two of four pieces of a long name, with its length: two edits leave two pieces whole.

    A known name has its own pieces. A name that is asked for has what stands at these places in any name that it may be, of
    any length within two letters, with each of both pieces shifted as far as two edits allow.
    """
    ways = [
        (delta, i, j, a, b)
        for delta in (range(-EDITS, EDITS + 1) if asked else (0,))
        for i in range(PIECES) for j in range(i + 1, PIECES)
        for a in range(-EDITS, EDITS + 1) for b in range(-EDITS, EDITS + 1)
        if (abs(a) + abs(b - a) + abs(delta - b) <= EDITS if asked else a == b == 0)
    ]
    table = F.expr("array(" + ", ".join("named_struct('d', {}, 'i', {}, 'j', {}, 'a', {}, 'b', {})".format(*w) for w in ways) + ")")

    def way(w: Column) -> Column:
        size = F.length(key) - w["d"]  # of the known name
        start = lambda k: F.floor(size * k / PIECES).cast("int")
        piece = lambda k, shift: F.substring(key, start(k) + shift + 1, start(k + 1) - start(k))
        inside = (start(w["i"]) + w["a"] >= 0) & (start(w["j"]) + w["b"] >= 0)
        return F.when(inside, F.xxhash64(size, w["i"], w["j"], piece(w["i"], w["a"]), piece(w["j"], w["b"])))

    return F.array_distinct(F.filter(F.transform(table, way), lambda k: k.isNotNull()))


def _meeting(key: Column, asked: bool) -> Column:
    n, none = F.length(key), F.array().cast("array<bigint>")
    return F.concat(F.when(n <= SHORT, _spellings(key)).otherwise(none), F.when(n >= SHORT - EDITS - 1, _pieces(key, asked)).otherwise(none))


def near_names(asked: DataFrame, known: DataFrame, *same: str) -> DataFrame:
    """key, other, d of all pairs of different texts of `asked` (key) and `known` (other) with equal columns `same` that are within two edits.

    In a block of at most FEW known texts each text that is asked for is compared with all. In larger ones, and where there are no columns
    `same`, pairs meet by equal keys that any two such texts share, and are verified after: no block of alike names is ever compared pair by
    pair. No side is broadcast: its compressed size says little about what it takes in memory.
    """
    left, right = asked.select("key", *same).distinct(), known.select("other", *same).distinct()
    fits = F.abs(F.length("key") - F.length("other")) <= EDITS
    meet = lambda a, b: a.withColumn("meet", F.explode(_meeting(F.col("key"), True))).join(b.withColumn("meet", F.explode(_meeting(F.col("other"), False))).hint("merge"), ["meet", *same]).where(fits).select("key", "other", *same).distinct()
    if same:
        sizes = right.groupBy(*same).agg(F.count("*").alias("_n"))
        right, left = (settled(df.join(sizes.hint("merge"), list(same))) for df in (right, left))
        small, large = F.col("_n") <= FEW, F.col("_n") > FEW
        direct = left.where(small).drop("_n").join(right.where(small).drop("_n").hint("merge"), list(same)).where(fits).select("key", "other", *same)
        pairs = direct.unionByName(meet(left.where(large).drop("_n"), right.where(large).drop("_n")))
    else:
        pairs = meet(left, right)
    return pairs.withColumn("d", T.edit_distance(F.col("key"), F.col("other"))).where(F.col("d") <= EDITS)


def match_names(queries: DataFrame, known: DataFrame) -> DataFrame:
    """name, serial: the known resource (serial, door_name, in the order of `serial`) that each distinct name means.

    An equal case-folded name wins (the first); then the only equal normalised name; then the only nearest normalised
    name within two edits among those with equal digits and sides. Ambiguity is no match. Names that the first two stages left
    meet their candidates by `near_names`.
    """
    keys = lambda c: {"low": T.casefold(F.col(c)), "key": T.norm_door(F.col(c)), "digits": T.door_digits(F.col(c)), "sides": T.door_sides(F.col(c))}
    # Keys are computed once: they carry Unicode's tables, and every stage reads them.
    q = settled(queries.select("name").where("name IS NOT NULL").distinct().withColumns(keys("name")))
    k = settled(known.select("serial", "door_name").withColumns(keys("door_name")))
    named = k.where("door_name <> ''")
    exact = k.groupBy("low").agg(F.min("serial").alias("exact"))
    same = named.groupBy("key").agg(F.min("serial").alias("same"), F.count("*").alias("same_n"))
    staged = settled(q.join(exact.hint("merge"), "low", "left").join(same.hint("merge"), "key", "left"))
    open_ = staged.where("exact IS NULL AND same_n IS NULL AND key <> ''").select("name", "key", "digits", "sides")
    # Equal normalised names stand for one candidate that is ambiguous when there are several of them.
    blocks = named.groupBy("key", "digits", "sides").agg(F.min("serial").alias("serial"), F.count("*").alias("n"))
    close = near_names(open_, blocks.withColumnRenamed("key", "other"), "digits", "sides")
    near = open_.join(close.hint("merge"), ["key", "digits", "sides"]).join(blocks.withColumnRenamed("key", "other").hint("merge"), ["other", "digits", "sides"])
    best = near.groupBy("name", "d").agg(F.sum("n").alias("n"), F.min("serial").alias("serial"))
    best = best.groupBy("name").agg(F.min_by(F.struct("n", "serial"), "d").alias("b")).select("name", F.when(F.col("b.n") == 1, F.col("b.serial")).alias("fuzzy"))
    out = staged.join(best.hint("merge"), "name", "left")
    return out.select("name", F.coalesce("exact", F.when(F.col("same_n") == 1, F.col("same")), F.when(F.col("same_n").isNull(), F.col("fuzzy"))).alias("serial"))


def lookalikes(asked: DataFrame, known: DataFrame) -> DataFrame:
    """raw, serial: all pairs of distinct `asked` (raw) and distinct `known` (serial) texts that are equal or look alike.

    A class of letters that look alike in turn (0, 9, S, 8) holds far more pairs than look alike, so each text that is asked for is
    written in all spellings that its look-alikes can have, of letters that known texts have there, and those that it meets are verified.
    """
    k = settled(known.select("serial").where("serial IS NOT NULL").distinct())
    letters = sorted({c for x in T.LOOKALIKES for c in x})
    places = F.posexplode(F.split(F.left(F.upper("serial"), F.lit(T.SPELLED)), "")).alias("place", "letter")
    seen = k.select(places).where(F.col("letter").isin(letters)).distinct().collect()  # a row for each place and letter
    q = asked.select("raw").where("raw IS NOT NULL").distinct().withColumn("key", F.explode(T.lookalike_spellings(F.col("raw"), sorted((r.place, r.letter) for r in seen))))
    met = q.join(k.withColumn("key", T.lookalike_key(F.col("serial"))).hint("merge"), "key")
    return met.where(T.lookalike_equal(F.col("raw"), F.col("serial"))).select("raw", "serial")


def match_serials(queries: DataFrame, known: DataFrame) -> DataFrame:
    """raw, serial: the known serial that is equal, else the only look-alike, else null."""
    q = queries.select("raw").where("raw IS NOT NULL").distinct()
    hits = lookalikes(q, known).groupBy("raw").agg(F.max(F.when(F.col("raw") == F.col("serial"), F.col("serial"))).alias("exact"), F.count("*").alias("n"), F.min("serial").alias("one"))
    return q.join(hits, "raw", "left").select("raw", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("serial"))


def greedy_serials(columns: DataFrame, known: DataFrame) -> DataFrame:
    """doc, column, serial: columns of a document claim known serials in order; exact reads claim first, and a
    look-alike only counts among what nobody has claimed yet.

    Columns whose reads are of different classes never want the same serial, so only the columns of a document and class that are no
    exact read are folded together.
    """
    reads = columns.select("doc", "column", "raw").distinct()
    near = lookalikes(reads, known).groupBy("raw").agg(F.array_sort(F.collect_set("serial")).alias("near"))
    wanted = reads.join(near, "raw", "left").withColumn("block", T.lookalike_block(F.col("raw")))
    wanted = settled(wanted.withColumn("near", F.coalesce("near", F.array().cast("array<string>"))))
    exact = F.array_contains("near", F.col("raw"))
    taken = wanted.where(exact).groupBy("doc", "block").agg(F.collect_set("raw").alias("taken"))
    none = F.size("near") == 0
    # What is exact or like nothing is settled by itself.
    clear = wanted.where(exact | none).select("doc", F.col("column").cast("int").alias("column"), F.when(exact, F.col("raw")).alias("serial"))
    open_ = wanted.where(~exact & ~none).join(taken, ["doc", "block"], "left")
    free = F.array_except("near", F.coalesce("taken", F.array().cast("array<string>")))
    ordered = open_.groupBy("doc", "block").agg(F.array_sort(F.collect_list(F.struct("column", "raw", free.alias("near")))).alias("cols"))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<column:int,serial:string>>").alias("out"))

    def step(acc, c):
        left = F.array_except(c["near"], acc["taken"])
        pick = F.when(F.size(left) == 1, F.get(left, F.lit(0)))
        held = F.when(pick.isNotNull(), F.array_append(acc["taken"], pick)).otherwise(acc["taken"])
        return F.struct(held.alias("taken"), F.array_append(acc["out"], F.struct(c["column"].cast("int").alias("column"), pick.alias("serial"))).alias("out"))

    folded = ordered.select("doc", F.aggregate("cols", start, step)["out"].alias("out"))
    return clear.unionByName(folded.select("doc", F.inline("out")))


def dedupe_ordered(items: DataFrame, known: DataFrame) -> DataFrame:
    """pos, id: first occurrence of each known id, in order."""
    first = items.groupBy("id").agg(F.min("pos").alias("pos"))
    return first.join(known.select("id"), "id", "left_semi").select("pos", "id")


def rank_rows(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """`df` with its dense 0-based positions in a global order (nulls first unless said otherwise); ties stand in any order.

    Rows are sorted by ranges; a row's position is its place in its range behind the sizes of the ranges before it, of which
    the driver sees one number each. No task sees more than a range.
    """
    spark = df.sparkSession
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    place, own, first = (f"_keylattice_{c}" for c in ("place", "part", "first"))
    ordered = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ordered = settled(ordered.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33).cast("int")
    before, starts = 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    sizes = F.broadcast(spark.createDataFrame(starts, f"{own} int, {first} long"))  # a row per range
    out = ordered.join(sizes, part == F.col(own))
    return out.select(*[f"`{c}`" for c in df.columns], (F.col(first) + F.col(place) - F.shiftleft(F.col(own).cast("long"), 33)).alias(name))
