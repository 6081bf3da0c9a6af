"""Rules for groups and entities that people make, name and delete: outcomes and new tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylattice.functions import text as T
from keylattice.sources.domain import Domain

#: Lengths of names and serials; serials that stand for something else.
NAME_LENGTH, SERIAL_LENGTH, RESERVED = 128, 32, ("new",)


def create_group(grp: DataFrame, name: str, code: str = "", prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(grp, outcome): a group of that name, with the given code or the shortest that its name gives.

    outcome, one row: id, name, export_code, error. A name that is there is no error, and nothing new, unless another code is
    asked for. Null and blank names, codes that aren't 1 to 4 letters or digits, codes in use (in any case), and names that give
    no unused code are errors, which change nothing.
    """
    spark = grp.sparkSession
    asked = spark.createDataFrame([(name, code)], "asked string, code string").select(F.trim(F.coalesce("asked", F.lit(""))).alias("asked"), F.trim(F.coalesce("code", F.lit(""))).alias("code"))
    mine = F.col("name") == F.col("asked")
    facts = asked.join(grp, how="left").groupBy("asked", "code").agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.collect_set(F.upper("export_code")).alias("used"), F.max(F.when(mine, F.struct("id", "export_code"))).alias("same"))  # one request by a row per group
    given, norm = F.col("code") != "", T.norm_code(F.col("code"))
    final = F.when(given, norm).otherwise(T.derive_code(F.col("asked"), F.col("used"), prefix))
    there = F.col("same").isNotNull()
    error = (
        F.when(F.col("asked") == "", "a name is needed")
        .when(F.length("asked") > NAME_LENGTH, "the name is too long")
        .when(given & norm.isNull(), "the code is not valid")
        .when(there & given & (norm != F.col("same.export_code")), "the group has another code")
        .when(~there & final.isNull(), "no code is left")
        .when(~there & F.array_contains("used", final), "the code is in use")
    )
    made = facts.select(F.when(there, F.col("same.id")).otherwise(F.col("last") + 1).alias("id"), F.col("asked").alias("name"), F.when(there, F.col("same.export_code")).otherwise(final).alias("export_code"), error.alias("error"), there.alias("there"))
    outcome = made.select(F.when(F.col("error").isNull(), F.col("id")).alias("id"), "name", F.when(F.col("error").isNull(), F.col("export_code")).alias("export_code"), "error")
    new = made.where("error IS NULL AND NOT there").select(F.col("id").cast("long"), "name", "export_code", F.lit(False).alias("is_implicit"))
    return grp.select("id", "name", "export_code", "is_implicit").unionByName(new), outcome


def rename_group(grp: DataFrame, target: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(grp, outcome): outcome, one row if the group is there: id, name, error. A blank name changes nothing; a name that
    another group has is an error."""
    asked = (name or "").strip()
    mine: Column = F.col("id") == target
    taken = grp.where(~mine & (F.col("name") == asked)).select(F.lit(True).alias("taken")).limit(1)
    error = F.when(F.lit(len(asked) > NAME_LENGTH), "the name is too long").when(F.col("taken") & F.lit(asked != ""), "the name is in use")
    facts = grp.where(mine).join(taken, how="left").select("id", F.col("name").alias("old"), error.alias("error"))
    new = F.when(F.col("error").isNull() & F.lit(asked != ""), F.lit(asked)).otherwise(F.col("old"))
    outcome = facts.select("id", new.alias("name"), "error")
    named = grp.join(outcome.select("id", F.col("name").alias("new")), "id", "left")
    return named.select("id", F.coalesce("new", "name").alias("name"), "export_code", "is_implicit"), outcome


def delete_group(domain: Domain, target: int) -> Domain:
    """Without the group, its memberships and its resources. Wishes stay: they don't say where they come from."""
    return Domain(domain.principal, domain.resource, domain.grp.where(F.col("id") != target), domain.grants, domain.membership.where(F.col("grp") != target), domain.group_resource.where(F.col("grp") != target))


def derive_codes(grp: DataFrame, prefix: str = "") -> DataFrame:
    """id, export_code for all groups anew, one after the other by folded name and id: the shortest prefix of 1 to 4 letters or
    digits that none before has; null where none is left. Groups are few, and the order counts, so they are folded."""
    ordered = grp.agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("low"), "id", "name"))).alias("gs"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<id:bigint,export_code:string>>").alias("out"))

    def step(acc, g):
        code = T.derive_code(g["name"], acc["used"], prefix)
        used = F.when(code.isNotNull(), F.array_append(acc["used"], code)).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.array_append(acc["out"], F.struct(g["id"].cast("long").alias("id"), code.alias("export_code"))).alias("out"))

    return ordered.select(F.inline(F.aggregate("gs", start, step)["out"]))


def checked_serials(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (serial, ...) with trimmed serials and an error where a new entity can't have them: blank, too long, with a slash,
    reserved (in any case), there already, or asked for twice."""
    trimmed = rows.withColumn("serial", F.trim(F.coalesce("serial", F.lit(""))))
    twice = trimmed.groupBy("serial").agg((F.count("*") > 1).alias("twice"))
    there = known.select("serial").distinct().withColumn("there", F.lit(True))
    error = (
        F.when(F.col("serial") == "", "a serial is needed")
        .when(F.length("serial") > SERIAL_LENGTH, "the serial is too long")
        .when(F.col("serial").contains("/"), "a serial has no slash")
        .when(F.lower("serial").isin(*RESERVED), "the serial is reserved")
        .when(F.col("there"), "the serial is there")
        .when(F.col("twice"), "the serial is asked for twice")
    )
    return trimmed.join(twice, "serial").join(there, "serial", "left").select(*rows.columns, error.alias("error"))


def create_entities(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, outcome): `rows` without an error are there too."""
    outcome = checked_serials(rows, table)
    return table.unionByName(outcome.where("error IS NULL").drop("error"), allowMissingColumns=True), outcome.select("serial", "error")


def edit_entities(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, outcome): fields of known serials are those of `rows`; the serial itself never changes. Unknown serials are errors;
    of several rows of a serial, that with the largest values counts."""
    fields = [c for c in rows.columns if c != "serial"]
    new = rows.groupBy("serial").agg(F.max(F.struct(*fields)).alias("new"))
    edited = table.join(new, "serial", "left")
    values = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns]
    known = table.select("serial").withColumn("there", F.lit(True))
    outcome = rows.select("serial").distinct().join(known, "serial", "left").select("serial", F.when(F.col("there").isNull(), "the serial is unknown").alias("error"))
    return edited.select(*values), outcome


def delete_principals(domain: Domain, serials: DataFrame) -> Domain:
    """Without these principals, their grants and their memberships."""
    gone = serials.select(F.col("serial").alias("principal")).distinct()
    kept = domain.principal.join(serials.select("serial").distinct(), "serial", "left_anti")
    return Domain(kept, domain.resource, domain.grp, domain.grants.join(gone, "principal", "left_anti"), domain.membership.join(gone, "principal", "left_anti"), domain.group_resource)


def delete_resources(domain: Domain, serials: DataFrame) -> Domain:
    """Without these resources, their grants and their places in groups."""
    gone = serials.select(F.col("serial").alias("resource")).distinct()
    kept = domain.resource.join(serials.select("serial").distinct(), "serial", "left_anti")
    return Domain(domain.principal, kept, domain.grp, domain.grants.join(gone, "resource", "left_anti"), domain.membership, domain.group_resource.join(gone, "resource", "left_anti"))
