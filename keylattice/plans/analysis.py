"""The read queries over a Domain. Lists come out as flat, ordered strings or arrays where a caller needs nesting."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.functions import text as T
from keylattice.operators.resolve import rank_rows
from keylattice.sources.domain import Domain, reached, weight
from keylattice.sources.shared import tasks

NUMBER_LAST = 10**9


def labelled_principals(d: Domain) -> DataFrame:
    return d.principal.withColumn("label", T.principal_label(F.col("person_name"), F.col("number"), F.col("serial")))


def labelled_resources(d: Domain) -> DataFrame:
    return d.resource.withColumn("label", T.resource_label(F.col("door_name"), F.col("room_number"), F.col("serial")))


def group_labels(d: Domain) -> DataFrame:
    """principal, group_label for principals with a group."""
    g = d.membership.join(d.grp.select(F.col("id").alias("grp"), F.struct("name", F.col("export_code").alias("code"), F.col("is_implicit").alias("implicit")).alias("g")), "grp")
    return g.groupBy("principal").agg(F.collect_list("g").alias("gs")).select("principal", T.group_label(F.col("gs")).alias("group_label"))


def principal_list(d: Domain) -> DataFrame:
    """Counts are made before the join, so it can't fan out."""
    active = d.flags().where("active").groupBy(F.col("principal").alias("serial")).agg(F.count("*").alias("n"))
    labels = group_labels(d).withColumnRenamed("principal", "serial")
    return labelled_principals(d).join(active, "serial", "left").join(labels, "serial", "left").select("serial", "number", "label", F.coalesce("n", F.lit(0)).alias("n_active"), F.coalesce("group_label", F.lit("")).alias("group_label"))


def resource_list(d: Domain) -> DataFrame:
    holders = d.flags().where("active").groupBy(F.col("resource").alias("serial")).agg(F.count("*").alias("n"))
    return labelled_resources(d).join(holders, "serial", "left").select("serial", "label", "location", F.coalesce("n", F.lit(0)).alias("n_holders"))


def dashboard_counts(d: Domain) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("value")).withColumn("metric", F.lit(name))
    return one(d.principal, "principals").unionByName(one(d.resource, "resources")).unionByName(one(d.flags().where("active"), "active_grants")).select("metric", "value")


def group_list(d: Domain) -> DataFrame:
    n_resources = d.group_resource.groupBy("grp").agg(F.count_distinct("resource").alias("n_resources"))
    n_members = d.membership.groupBy("grp").agg(F.count_distinct("principal").alias("n_members"))
    g = d.grp.withColumnRenamed("id", "grp").join(n_resources, "grp", "left").join(n_members, "grp", "left")
    return g.select("grp", "name", "export_code", "is_implicit", F.coalesce("n_resources", F.lit(0)).alias("n_resources"), F.coalesce("n_members", F.lit(0)).alias("n_members"))


def group_detail(d: Domain, group: int) -> DataFrame:
    """All resources with their section and whether the group holds them."""
    on = d.group_resource.where(F.col("grp") == group).select(F.col("resource").alias("serial"), F.lit(True).alias("on"))
    return labelled_resources(d).join(on, "serial", "left").select(section().alias("section"), "serial", "label", F.coalesce("on", F.lit(False)).alias("on"))


def group_members(d: Domain, group: int) -> DataFrame:
    """principal, label, place of a group's members, in the order of principals."""
    members = d.membership.where(F.col("grp") == group).select(F.col("principal").alias("serial")).distinct()
    ranked = rank_rows(labelled_principals(d).join(members, "serial", "left_semi"), F.asc_nulls_first("number"), "person_name", "serial", name="before")
    return ranked.select(F.col("serial").alias("principal"), "label", (F.col("before") + 1).cast("int").alias("place"))


def principal_totals(d: Domain) -> DataFrame:
    """serial and the number of its links in each state."""
    n = d.flags().groupBy(F.col("principal").alias("serial")).agg(*(F.count_if(s).alias(s) for s in ("active", "planned", "removed", "desired")))
    return d.principal.select("serial").join(n, "serial", "left").na.fill(0)


def section() -> Column:
    return F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("—"))


def sections(d: Domain) -> DataFrame:
    return labelled_resources(d).groupBy(section().alias("section")).agg(F.count("*").alias("n"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))


def text_search(d: Domain, needle: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "serial", "door_name", "room_number", "location", "area"))
    return d.resource.where(hay.contains(needle.lower())).select("serial", "door_name", "location")


def picker(d: Domain, needle: str, limit: int = 30) -> DataFrame:
    hit = F.lower("label").contains(needle.lower()) | F.lower("serial").contains(needle.lower())
    return labelled_principals(d).where(hit).orderBy(F.asc_nulls_first("number"), "person_name", "serial").limit(limit).select("serial", "label")


def _scoped(flags: DataFrame, scope: str) -> DataFrame:
    """Overlap scopes: active; planned = active or planned; diff = planned alone. Others mean active."""
    rule = {"planned": "active OR planned", "diff": "planned"}.get(scope, "active")
    return flags.where(rule).select("principal", "resource")


def overlap(d: Domain, scope: str = "active") -> DataFrame:
    """a, b, shared, pct, alpha, dark, self for every pair of principals, the dense matrix that is asked for.

    All pairs are the result itself, so principals are packed into blocks, and each pair of blocks makes its part of the
    matrix where its sets meet: no pair is ever shuffled, and a resource that all hold is one column of each block.
    """
    sets = _scoped(d.flags(), scope).withColumnRenamed("principal", "serial")
    # Pairs of blocks are the tasks: enough of them for all cores, as long as blocks aren't small.
    cores = d.principal.sparkSession.sparkContext.defaultParallelism
    n = d.principal.count()
    blocks = max(1, -(-n // OVERLAP_BLOCK), min(math.ceil(math.sqrt(2 * cores)), n // OVERLAP_LEAST))
    # A resource goes as its number, a principal with all of its numbers: that is what every block is sent.
    numbers = rank_rows(sets.select("resource").distinct(), "resource", name="at").select("resource", F.col("at").cast("int").alias("at"))
    whole = sets.join(numbers, "resource").groupBy("serial").agg(F.array_sort(F.collect_set("at")).alias("held"))
    held = d.principal.select("serial").distinct().join(whole, "serial", "left").withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(blocks)))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "serial", "held")
    return met.groupBy("low", "high").applyInArrow(_block_overlap, "a string, b string, shared long, pct int, alpha double, dark boolean, is_self boolean")


#: Principals of a block of the overlap matrix, at most and in general at least, and resources that are multiplied at a time.
OVERLAP_BLOCK, OVERLAP_LEAST, OVERLAP_CHUNK = 512, 128, 8192


def _block_overlap(rows: pa.Table) -> pa.Table:
    """The matrix, both ways, of the principals of block `low` with those of block `high`."""
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    names = rows.column("serial").combine_chunks().cast(pa.string())
    n = len(names)
    held = rows.column("held").combine_chunks()
    p = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
    known, r = np.unique(held.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    shared = np.zeros((n, n), np.float64)
    order = np.argsort(r, kind="stable")
    p_of, r_of = p[order], r[order]
    for at in range(0, len(known), OVERLAP_CHUNK):
        some = slice(*np.searchsorted(r_of, [at, at + OVERLAP_CHUNK]))
        part = np.zeros((n, OVERLAP_CHUNK), np.float32)  # counts up to the chunk's width are exact
        part[p_of[some], r_of[some] - at] = 1
        shared += part @ part.T
    block = rows.column("block").to_numpy()
    first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
    a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    if low != high:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    size, both = np.diag(shared), shared[a, b]
    jac = both / np.maximum(size[a] + size[b] - both, 1)
    cols = [names.take(pa.array(a)), names.take(pa.array(b)), both.astype(np.int64), np.rint(jac * 100).astype(np.int32), 0.08 + 0.92 * jac, jac >= 0.55, a == b]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["a", "b", "shared", "pct", "alpha", "dark", "is_self"])


def pair_panel(d: Domain, a: str, b: str, scope: str = "active") -> DataFrame:
    """Each resource of two principals: shared, or only of one."""
    sets = _scoped(d.flags(), scope).where(F.col("principal").isin(a, b))
    both = sets.groupBy("resource").agg(F.bool_or(F.col("principal") == a).alias("in_a"), F.bool_or(F.col("principal") == b).alias("in_b"))
    kind = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "only_a").otherwise("only_b")
    return both.join(labelled_resources(d).select(F.col("serial").alias("resource"), "label"), "resource").select(kind.alias("part"), "resource", "label")


def equal_sets(pairs: DataFrame, owner: str, item: str, least: int = 2) -> DataFrame:
    """Owners grouped by exactly equal non-empty item sets: items and owners (ordered arrays), counts."""
    sets = pairs.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.groupBy("items").agg(F.count("*").alias("n_owners"), F.array_sort(F.collect_list(owner)).alias("owners")).where(F.col("n_owners") >= least).withColumn("n_items", F.size("items").cast("long"))


def clones(pairs: DataFrame) -> DataFrame:
    return equal_sets(pairs, "principal", "resource").select(F.array_join("owners", ",").alias("principals"), F.col("n_owners").alias("n_principals"), "n_items")


def tiers(pairs: DataFrame, top: int = 12) -> DataFrame:
    """Resources grouped by their exact holder set; most resources first, then most holders, then smallest resource."""
    t = equal_sets(pairs, "resource", "principal", least=1).select(F.array_join("owners", ",").alias("resources"), F.col("n_owners").alias("n_resources"), F.col("n_items").alias("n_holders"))
    return t.orderBy(F.desc("n_resources"), F.desc("n_holders"), "resources").limit(top)


def combinations(d: Domain) -> DataFrame:
    """Principals by their exact set of group codes; none is a set too."""
    codes = d.membership.join(d.grp.select(F.col("id").alias("grp"), "export_code"), "grp").groupBy(F.col("principal").alias("serial")).agg(F.array_join(F.array_sort(F.collect_set("export_code")), "+").alias("key"))
    return d.principal.select("serial").join(codes, "serial", "left").groupBy(F.coalesce("key", F.lit("")).alias("key")).agg(F.count("*").alias("n_principals"), F.min("serial").alias("first_serial"))


def combination_titles(d: Domain) -> DataFrame:
    """Titles of the sets of groups; titles that several sets share get their key in brackets."""
    labels = group_labels(d).withColumnRenamed("principal", "serial")
    codes = d.membership.join(d.grp.select(F.col("id").alias("grp"), "export_code"), "grp").groupBy(F.col("principal").alias("serial")).agg(F.array_join(F.array_sort(F.collect_set("export_code")), "+").alias("key"))
    keyed = codes.join(labels, "serial").groupBy("key").agg(F.min("group_label").alias("base"), F.count("*").alias("n"))
    shared = keyed.groupBy("base").agg(F.count("*").alias("uses"))
    return keyed.join(shared, "base").select("key", F.when(F.col("uses") > 1, F.concat("base", F.lit(" ("), "key", F.lit(")"))).otherwise(F.col("base")).alias("title"), "n")


def diff_class() -> Column:
    configured = F.col("active") | F.col("planned")
    return F.when(configured & F.col("desired"), "ok").when(F.col("desired"), "add").otherwise("remove")


def diff_counts(d: Domain) -> DataFrame:
    return d.flags().where("active OR planned OR desired").groupBy(diff_class().alias("class")).agg(F.count("*").alias("n"))


def change_counts(d: Domain) -> DataFrame:
    """Adds, removes and affected principals; removed-only pairs are no change."""
    rows = d.flags().where("(active OR planned) <> desired").select("principal", "desired")
    return rows.agg(F.count_if("desired").alias("n_add"), F.count_if(~F.col("desired")).alias("n_remove"), F.count_distinct("principal").alias("n_principals"))


def changes(d: Domain) -> DataFrame:
    """principal, action, resource, location, name, note of every outstanding change."""
    rows = d.flags().where("(active OR planned) <> desired")
    place = d.resource.select(F.col("serial").alias("resource"), F.coalesce(F.nullif(F.col("location"), F.lit("")), F.col("area"), F.lit("")).alias("location"), F.coalesce(F.nullif(F.col("door_name"), F.lit("")), F.col("serial")).alias("name"))
    note = F.when(~F.col("desired") & F.col("planned") & ~F.col("active"), "planned").otherwise("")
    out = rows.join(place, "resource", "left")
    return out.select("principal", F.when(F.col("desired"), "add").otherwise("remove").alias("action"), "resource", F.coalesce("location", F.lit("")).alias("location"), F.coalesce("name", "resource").alias("name"), note.alias("note"))


def change_sheets(d: Domain) -> DataFrame:
    """A row per affected principal, with its ordered adds and removes as arrays."""
    entry = F.struct("location", "name", "resource", "note")
    return changes(d).groupBy("principal").agg(*(F.array_sort(F.collect_list(F.when(F.col("action") == a, entry))).alias(a) for a in ("add", "remove")))


def principals_indexed(d: Domain) -> DataFrame:
    """principal, ci: the places of all principals by number (none first), name and serial."""
    order = (F.asc_nulls_first("number"), "person_name", "serial")
    return rank_rows(d.principal.select("serial", "number", "person_name"), *order, name="ci").select(F.col("serial").alias("principal"), "ci")


def resources_indexed(d: Domain, used: DataFrame | None = None) -> DataFrame:
    """resource, ri: the places of all resources, or of the used ones, by location, name and serial."""
    r = d.resource if used is None else d.resource.join(used.select(F.col("resource").alias("serial")).distinct(), "serial", "left_semi")
    return rank_rows(r.select("serial", "location", "door_name"), "location", "door_name", "serial", name="ri").select(F.col("serial").alias("resource"), "ri")


def matrix(d: Domain, scope: str = "all") -> DataFrame:
    """ci, ri, weight of every non-blank cell; scope all, active or planned (alone)."""
    if scope not in ("all", "active", "planned"):
        raise ValueError(f"scope must be all, active or planned, not {scope!r}")
    cells = d.flags().withColumn("weight", weight(F.col("active"), F.col("planned"))).where("weight > 0")
    cells = cells.where({"all": "true", "active": "weight = 2", "planned": "weight = 1"}[scope])
    return cells.join(principals_indexed(d), "principal").join(resources_indexed(d), "resource").select("ci", "ri", "weight")


def diff(d: Domain, hide_empty: bool = False) -> DataFrame:
    """ci, ri, weight, wished; hide_empty drops resources without any link and numbers the rest anew."""
    flags = d.flags()
    cells = flags.where("active OR planned OR desired").select("principal", "resource", weight(F.col("active"), F.col("planned")).alias("weight"), F.col("desired").cast("int").alias("wished"))
    rows = resources_indexed(d, flags if hide_empty else None)
    return cells.join(principals_indexed(d), "principal").join(rows, "resource").select("ci", "ri", "weight", "wished")


def individual(d: Domain, scope: str = "soll") -> DataFrame:
    """principal, resource, state, n_current of what a principal holds (ist) or is to hold (soll) beyond its groups.

    n_current is the size of the basis before the groups' resources are taken off.
    """
    rule = "active OR planned OR removed" if scope == "ist" else "desired"
    basis = d.flags().where(rule).withColumn("n_current", F.count("*").over(Window.partitionBy("principal")))
    state = F.when(F.col("active"), "active").when(F.col("planned"), "planned").when(F.col("removed"), "removed").otherwise("add")
    return d.beyond_groups(basis).select("principal", "resource", state.alias("state"), "n_current")


def detail(d: Domain, principal: str) -> DataFrame:
    """State and wish marker of each of one principal's links."""
    mine = d.flags().where(F.col("principal") == principal)
    state = F.when(F.col("active"), "active").when(F.col("planned"), "planned").when(F.col("removed"), "removed").otherwise("soll_add")
    soll = F.when(F.col("active") & ~F.col("desired"), "remove").when(~F.col("active") & F.col("planned") & ~F.col("desired"), "unwished").when(~F.col("active") & ~F.col("planned") & F.col("removed") & F.col("desired"), "keep").otherwise("")
    return mine.join(labelled_resources(d).select(F.col("serial").alias("resource"), "label", section().alias("section")), "resource").select("section", "resource", "label", state.alias("state"), soll.alias("soll"))


def editor(d: Domain, principal: str) -> DataFrame:
    """Every resource with: wished, inherited, the groups it comes through, current state."""
    mine = d.flags().where(F.col("principal") == principal).drop("principal").withColumnRenamed("resource", "serial")
    via = d.membership.where(F.col("principal") == principal).join(d.group_resource, "grp").join(d.grp.select(F.col("id").alias("grp"), "name"), "grp")
    via = via.groupBy(F.col("resource").alias("serial")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("via"))
    state = F.when(F.col("active"), "active").when(F.col("planned"), "planned").otherwise("")
    return d.resource.select("serial").join(mine, "serial", "left").join(via, "serial", "left").select("serial", F.coalesce("desired", F.lit(False)).alias("on"), F.col("via").isNotNull().alias("inherited"), F.coalesce("via", F.lit("")).alias("via"), state.alias("state"))


def pending(d: Domain) -> DataFrame:
    return d.flags().where("planned").select("principal").distinct()


def fate(d: Domain) -> DataFrame:
    """resource, fate, principal, badge. A pair that is active and removed has two items."""
    kinds = (
        ("active AND desired", "keep", ""),
        ("removed AND desired", "keep", "wished"),
        ("removed AND NOT desired", "remove", "withdrawn"),
        ("active AND NOT desired", "remove", "not desired"),
        ("planned", "planned", ""),
    )
    items = F.array(*(F.when(F.expr(rule), F.struct(F.lit(name).alias("fate"), F.lit(badge).alias("badge"))) for rule, name, badge in kinds))
    f = d.flags().select("resource", "principal", F.explode(F.filter(items, lambda i: i.isNotNull())).alias("item"))
    return f.select("resource", "item.fate", "principal", "item.badge")


def fate_ordered(d: Domain, resource: str) -> DataFrame:
    """One resource's items with their place: null numbers last, but first among planned."""
    rows = fate(d).where(F.col("resource") == resource).join(d.principal.select(F.col("serial").alias("principal"), "number", "person_name"), "principal")
    key = F.when(F.col("fate") == "planned", F.coalesce("number", F.lit(-1))).otherwise(F.coalesce("number", F.lit(NUMBER_LAST)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("fate").orderBy(key, "person_name", "principal", "badge"))).select("fate", "place", "principal", "badge")


def individual_desirers(d: Domain) -> DataFrame:
    """(resource, principal) that is wished without a group of the principal that holds the resource."""
    return d.beyond_groups(d.flags().where("desired").select("principal", "resource"))


def addable(d: Domain, resource: str) -> DataFrame:
    wished = d.flags().where((F.col("resource") == resource) & F.col("desired")).select(F.col("principal").alias("serial"))
    return d.principal.select("serial").join(wished, "serial", "left_anti")


def soll_matrix(d: Domain, selected: list[str]) -> DataFrame:
    """resource, kind, id, on, inherited for all resources by groups and selected principals (a bounded list)."""
    groups = d.resource.select(F.col("serial").alias("resource")).join(d.grp.select(F.col("id").alias("grp")), how="inner")
    held = d.group_resource.withColumn("on", F.lit(True))
    part = groups.join(held, ["grp", "resource"], "left").select("resource", F.lit("group").alias("kind"), F.col("grp").cast("string").alias("id"), F.coalesce("on", F.lit(False)).alias("on"), F.lit(False).alias("inherited"))
    who = d.principal.where(F.col("serial").isin(selected)).select(F.col("serial").alias("principal"))
    cells = d.resource.select(F.col("serial").alias("resource")).join(who, how="inner")
    wished = d.flags().where(F.col("desired") & F.col("principal").isin(selected)).select("principal", "resource", F.lit(True).alias("on"))
    inh = d.inherited().where(F.col("principal").isin(selected)).withColumn("inherited", F.lit(True))
    own = cells.join(wished, ["principal", "resource"], "left").join(inh, ["principal", "resource"], "left").select("resource", F.lit("principal").alias("kind"), F.col("principal").alias("id"), F.coalesce("on", F.lit(False)).alias("on"), F.coalesce("inherited", F.lit(False)).alias("inherited"))
    return part.unionByName(own)


def location_tree(d: Domain) -> DataFrame:
    """Resources by location, else area, else 'no location' (last), ordered by folded labels."""
    name = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.nullif(F.col("area"), F.lit("")), F.lit("no location"))
    entry = F.struct(T.casefold(F.col("label")).alias("k"), T.casefold(F.col("serial")).alias("s"), "serial", "label")
    return labelled_resources(d).dropDuplicates(["serial"]).groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, 5), lambda e: e["serial"]), ",").alias("first_five"))


def report_individuals(d: Domain) -> DataFrame:
    """principal, title, n of the report's appendix: wishes beyond the groups."""
    own = individual_desirers(d).groupBy(F.col("principal").alias("serial")).agg(F.count("*").alias("n"))
    title = F.when(F.col("label") == F.col("serial"), F.col("serial")).otherwise(F.concat("serial", F.lit(" · "), "label"))
    return own.join(labelled_principals(d), "serial").select("serial", title.alias("title"), "n")


def access_report(d: Domain, labels: bool = False) -> DataFrame:
    """key, location, resource (and label) of each set of groups: the union of its groups' resources by location."""
    codes = d.membership.join(d.grp.select(F.col("id").alias("grp"), "export_code"), "grp").groupBy("principal").agg(F.array_join(F.array_sort(F.collect_set("export_code")), "+").alias("key"), F.collect_set("grp").alias("grps"))
    sets = codes.select("key", "grps").dropDuplicates(["key"])
    location = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.nullif(F.col("area"), F.lit("")), F.lit("no location"))
    places = labelled_resources(d).select(F.col("serial").alias("resource"), location.alias("location"), "label")
    held = reached(sets.select(F.col("key").alias("principal"), F.explode("grps").alias("grp")), d.group_resource, places)
    return held.select(F.col("principal").alias("key"), "location", "resource", *(["label"] if labels else []))


def backup(d: Domain) -> DataFrame:
    """kind, id, body: every record of the nested export as compact JSON, its lists ordered."""
    lists = d.flags().groupBy(F.col("principal").alias("serial")).agg(*(F.array_sort(F.collect_list(F.when(F.col(s), F.col("resource")))).alias(s) for s in ("active", "planned", "removed", "desired")))
    codes = d.membership.join(d.grp.select(F.col("id").alias("grp"), "export_code"), "grp").groupBy(F.col("principal").alias("serial")).agg(F.array_sort(F.collect_set("export_code")).alias("groups"))
    none = F.array().cast("array<string>")
    p = d.principal.join(lists, "serial", "left").join(codes, "serial", "left")
    p = p.select(F.lit("principal").alias("kind"), F.col("serial").alias("id"), F.to_json(F.struct("serial", "number", "person_name", *(F.coalesce(c, none).alias(c) for c in ("active", "planned", "removed", "desired", "groups"))), {"ignoreNullFields": "false"}).alias("body"))
    doors = d.group_resource.groupBy("grp").agg(F.array_sort(F.collect_set("resource")).alias("doors"))
    g = d.grp.withColumnRenamed("id", "grp").join(doors, "grp", "left").select(F.lit("group").alias("kind"), F.col("export_code").alias("id"), F.to_json(F.struct("name", "export_code", "is_implicit", F.coalesce("doors", none).alias("doors"))).alias("body"))
    r = d.resource.select(F.lit("resource").alias("kind"), F.col("serial").alias("id"), F.to_json(F.struct("serial", "door_name", "room_number", "location", "area")).alias("body"))
    return p.unionByName(g).unionByName(r)


def markdown(d: Domain) -> DataFrame:
    """The report's sections as lines of Markdown: section, line number, line."""
    rows = access_report(d, labels=True)
    lines = rows.repartition(tasks(d.grp.sparkSession), "key", "location").groupBy("key", "location").agg(F.array_sort(F.collect_list(F.struct(T.casefold(F.col("label")).alias("k"), "resource", T.md_escape(F.col("label")).alias("text")))).alias("items"))
    text = F.concat(F.lit("### "), T.md_escape(F.col("location")), F.lit("\n\n"), F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i["text"], F.lit(" ("), i["resource"], F.lit(")"))), "\n"), F.lit("\n"))
    return lines.select("key", "location", text.alias("markdown"))


def sql_script(d: Domain) -> DataFrame:
    """part, key, statement: an idempotent script of principals, resources and active pairs, to be written in the
    order of part and key. Of several rows of a serial the last one, by the column `place` where there is one, stays; of equal places,
    the one with the largest values."""
    lit = lambda c: T.sql_literal(F.col(c))

    def upsert(df: DataFrame, part: int, table: str, numbers: tuple[str, ...] = ()) -> DataFrame:
        names = [c for c in df.columns if c != "place"]
        rest = [c for c in names if c != "serial"]
        last = F.struct(*(["place"] if "place" in df.columns else []), *rest)
        one = df.groupBy("serial").agg(F.max(last).alias("v")).select("serial", *(f"v.{c}" for c in rest))
        values = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) if c in numbers else lit(c) for c in names]
        ends = ", ".join(f"{c}=excluded.{c}" for c in rest)
        text = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(names)}) VALUES ("), F.concat_ws(", ", *values), F.lit(f") ON CONFLICT (serial) DO UPDATE SET {ends};"))
        return one.select(F.lit(part).alias("part"), F.col("serial").alias("key"), text.alias("statement"))

    pairs = d.flags().where("active").select("principal", "resource").distinct()
    link = F.concat(F.lit("INSERT INTO authorizations (principal, resource) VALUES ("), lit("principal"), F.lit(", "), lit("resource"), F.lit(") ON CONFLICT DO NOTHING;"))
    placed: Callable[[DataFrame], list[str]] = lambda df: ["place"] if "place" in df.columns else []
    people = upsert(d.principal.select("serial", "number", "person_name", *placed(d.principal)), 1, "principals", ("number",))
    doors = upsert(d.resource.select("serial", "door_name", "room_number", "location", "area", *placed(d.resource)), 2, "resources")
    return people.union(doors).union(pairs.select(F.lit(3), F.concat_ws("/", "principal", "resource"), link))


def write_sql_script(d: Domain, path: str) -> None:
    """The script as text files whose names and lines are in order; a range sort, not one task."""
    sql_script(d).sort("part", "key").select("statement").write.text(path)
