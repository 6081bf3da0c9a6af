"""The authorization model as DataFrames, and the adapter that derives it from the TPC-H-like tables.

principal(serial, number, person_name), resource(serial, door_name, room_number, location, area),
grp(id, name, export_code, is_implicit), grants(principal, resource, state), membership(principal, grp),
group_resource(grp, resource). Active, planned and removed are not exclusive: every classifier has a precedence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.sources.shared import tasks

STATES = ("active", "planned", "removed", "desired")


@dataclass
class Domain:
    principal: DataFrame
    resource: DataFrame
    grp: DataFrame
    grants: DataFrame
    membership: DataFrame
    group_resource: DataFrame

    def flags(self) -> DataFrame:
        """principal, resource and a boolean per state: the hub of nearly every query; one shuffle on the pair."""
        return grant_flags(self.grants)

    def inherited(self) -> DataFrame:
        """Distinct (principal, resource) that some group of the principal holds."""
        return reached(self.membership, self.group_resource)

    def holders(self) -> DataFrame:
        """resource, held_by: the groups that hold each resource."""
        return self.group_resource.groupBy("resource").agg(F.collect_set("grp").alias("held_by"))

    def beyond_groups(self, pairs: DataFrame) -> DataFrame:
        """Pairs (principal, resource, ...) whose resource no group of the principal holds. Each pair meets the groups of its
        principal and those of its resource; what groups hold is never written out for every member."""
        mine = self.membership.groupBy("principal").agg(F.collect_set("grp").alias("own_groups"))
        met = pairs.join(mine, "principal", "left").join(self.holders(), "resource", "left")
        return met.where(~F.coalesce(F.arrays_overlap("own_groups", "held_by"), F.lit(False))).select(*pairs.columns)


#: Parts of what a group holds that each meet its members on their own.
SLOTS = 64


def reached(membership: DataFrame, group_resource: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Distinct (principal, resource) that some group of the principal holds, with what `about` (resource, ...) says of the resource.

    A pair is made by the first of the groups that it has in common, so the pairs, which may be far more than what they are made
    from, are distinct as they come and are never shuffled. Groups are dealt to SLOTS parts, so that a large one is no single task.
    """
    own = membership.groupBy("principal").agg(F.collect_set("grp").alias("own"))
    holders = group_resource.groupBy("resource").agg(F.collect_set("grp").alias("held"))
    holders = holders if about is None else holders.join(about, "resource")
    more = [c for c in about.columns if c != "resource"] if about is not None else []
    parts = tasks(membership.sparkSession)
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))
    who = own.withColumn("grp", F.explode("own")).withColumn("slot", slots).repartition(parts, "grp", "slot")
    what = holders.withColumn("grp", F.explode("held")).withColumn("slot", F.pmod(F.xxhash64("resource"), F.lit(SLOTS)).cast("int")).repartition(parts, "grp", "slot")
    first = (F.size("own") == 1) | (F.size("held") == 1) | (F.col("grp") == F.array_min(F.array_intersect("own", "held")))
    return who.hint("shuffle_hash").join(what, ["grp", "slot"]).where(first).select("principal", "resource", *more)


def grant_flags(grants: DataFrame) -> DataFrame:
    return grants.groupBy("principal", "resource").agg(*(F.coalesce(F.bool_or(F.col("state") == s), F.lit(False)).alias(s) for s in STATES))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class AdapterDomain(Domain):
    """Supplier as principal, part as resource, brand as group; grants from lineitem."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        s, p, li = (_table(spark, sf_dir, t) for t in ("supplier", "part", "lineitem"))
        key = F.col("s_suppkey")
        self.principal = s.select(
            key.cast("string").alias("serial"),
            F.when(key % 7 != 0, F.col("s_nationkey")).alias("number"),
            F.when(key % 5 == 0, "").otherwise(F.col("s_name")).alias("person_name"),
        )
        self.resource = p.select(
            F.col("p_partkey").cast("string").alias("serial"), F.col("p_name").alias("door_name"), F.col("p_size").cast("string").alias("room_number"), F.col("p_type").alias("location"), F.col("p_brand").alias("area")
        )
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
        self.grp = p.select(brand.alias("id")).distinct().select("id", F.concat(F.lit("Brand "), "id").alias("name"), F.concat(F.lit("B"), "id").alias("export_code"), (F.col("id") == 1).alias("is_implicit"))
        self.group_resource = p.select(brand.alias("grp"), F.col("p_partkey").cast("string").alias("resource"))
        groups = F.array_distinct(F.when(key % 2 == 0, F.array(key % 25 + 1, key * 7 % 25 + 1, F.lit(1).cast("long"))).otherwise(F.array(key % 25 + 1, key * 7 % 25 + 1)))
        self.membership = s.where(key % 11 != 0).select(key.cast("string").alias("principal"), F.explode(groups).alias("grp"))
        pair = (F.col("l_suppkey").cast("string").alias("principal"), F.col("l_partkey").cast("string").alias("resource"))
        kept = F.col("l_returnflag") != "R"
        raw = li.groupBy(*pair).agg(
            F.bool_or(kept & (F.col("l_linestatus") == "F")).alias("active"),
            F.bool_or(kept & (F.col("l_linestatus") == "O")).alias("planned"),
            F.bool_or(~kept).alias("returned"),
            F.bool_or(F.col("l_quantity") >= 25).alias("desired"),
        )
        self._flags = raw.select("principal", "resource", "active", "planned", (F.col("returned") & ~F.col("active") & ~F.col("planned")).alias("removed"), "desired").where("active OR planned OR removed OR desired")
        states = F.array(*(F.when(F.col(x), F.lit(x)) for x in STATES))
        self.grants = self._flags.select("principal", "resource", F.explode(F.filter(states, lambda x: x.isNotNull())).alias("state"))

    def flags(self) -> DataFrame:
        return self._flags


def event_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """principal (user) and resource (event type) of the small clone example: distinct pairs with a value above 100."""
    return _table(spark, sf_dir, "events").where("value > 100").select(F.col("user_id").cast("string").alias("principal"), F.col("event_type").alias("resource")).distinct()


def weight(active: Column, planned: Column) -> Column:
    return F.when(active, 2).when(planned, 1).otherwise(0)


#: The same adapter as SQL, for the oracles.
PRELUDE = """
WITH principal AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS serial, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS number, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS person_name FROM supplier
), resource AS (
  SELECT CAST(p_partkey AS VARCHAR) AS serial, p_name AS door_name, CAST(p_size AS VARCHAR) AS room_number, p_type AS location, p_brand AS area FROM part
), grp AS (
  SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS id FROM part
), grps AS (
  SELECT id, 'Brand ' || id AS name, 'B' || id AS export_code, id = 1 AS is_implicit FROM grp
), group_resource AS (
  SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS grp, CAST(p_partkey AS VARCHAR) AS resource FROM part
), membership AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS principal, s_suppkey % 25 + 1 AS grp FROM supplier WHERE s_suppkey % 11 <> 0
  UNION SELECT CAST(s_suppkey AS VARCHAR), s_suppkey * 7 % 25 + 1 FROM supplier WHERE s_suppkey % 11 <> 0
  UNION SELECT CAST(s_suppkey AS VARCHAR), 1 FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 2 = 0
), raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS principal, CAST(l_partkey AS VARCHAR) AS resource,
    bool_or(l_returnflag <> 'R' AND l_linestatus = 'F') AS active, bool_or(l_returnflag <> 'R' AND l_linestatus = 'O') AS planned,
    bool_or(l_returnflag = 'R') AS returned, bool_or(l_quantity >= 25) AS desired
  FROM lineitem GROUP BY 1, 2
), flags AS (
  SELECT * FROM (SELECT principal, resource, active, planned, returned AND NOT active AND NOT planned AS removed, desired FROM raw) WHERE active OR planned OR removed OR desired
), inherited AS (
  SELECT DISTINCT principal, resource FROM membership JOIN group_resource USING (grp)
), plabel AS (
  SELECT *, CASE WHEN person_name <> '' THEN person_name WHEN number IS NOT NULL THEN 'No. ' || number ELSE serial END AS label FROM principal
), rlabel AS (
  SELECT *, CASE WHEN door_name = '' THEN serial WHEN room_number <> '' AND NOT list_contains(string_split_regex(trim(door_name), '\\s+'), trim(room_number)) THEN door_name || ' (' || room_number || ')' ELSE door_name END AS label FROM resource
), glabel AS (
  SELECT principal, CASE WHEN longest = 1 THEN string_agg(export_code, '' ORDER BY lower(name), export_code) ELSE string_agg(export_code, '-' ORDER BY lower(name), export_code) END AS codes FROM (
    SELECT *, max(length(export_code)) OVER (PARTITION BY principal) AS longest FROM (
      SELECT m.principal, g.*, count(*) OVER (PARTITION BY m.principal) AS n FROM membership m JOIN grps g ON m.grp = g.id
    ) WHERE n = 1 OR NOT is_implicit
  ) GROUP BY principal, longest
)
"""
