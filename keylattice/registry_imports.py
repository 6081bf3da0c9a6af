"""Queries over printouts, exports and backups that are made from the test tables, and over write rules; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.functions import text as T
from keylattice.operators import groups as G
from keylattice.operators import reconcile as R
from keylattice.operators import resolve as E
from keylattice.plans import analysis as A
from keylattice.plans import layout as L
from keylattice.plans import parsing as X
from keylattice.plans import pixels as P
from keylattice.plans import printouts as O
from keylattice.plans import raster as RA
from keylattice.plans import tiles as TI
from keylattice.registry import _INDEX, ORACLE_SQL, query, simple
from keylattice.sources import backup as B
from keylattice.sources import files as S
from keylattice.sources import versions as V
from keylattice.sources.domain import AdapterDomain, Domain
from keylattice.sources.shared import settled, tasks

# -- list printouts -------------------------------------------------------------------------------------------------
_LIST = """, item AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_suppkey) AS s, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p) AS k FROM item)\n"""
_WITH_LIST = "WITH " + _LIST.lstrip(", ")


@query(_WITH_LIST + """SELECT CAST(o AS VARCHAR) AS doc, CAST(k AS INTEGER) AS "row", 'Door ' || p || CASE WHEN p % 3 = 0 THEN ' cont' ELSE '' END AS door_name, CAST(s % 90 AS VARCHAR) AS room_number, p || '-' || s AS serial,
f || CASE WHEN p % 3 = 0 THEN ' more' ELSE '' END AS area, CASE WHEN o % 5 <> 0 THEN 'L.' || o % 7 END AS location, 'Sys ' || o % 10 AS locking_system FROM placed""", prelude=False)
def src_list_pdf(spark, sf_dir):
    return X.parse_list(O.list_pages(spark, sf_dir))[1]


@query(_WITH_LIST + """SELECT CAST(o AS VARCHAR) AS doc, 'S' || o AS serial, CAST(CASE WHEN o % 4 <> 0 THEN o % 1000 END AS INTEGER) AS number, 'Name' || o AS person_name, 'Sys ' || o % 10 AS locking_system, DATE '2024-01-02' AS printed_on,
CAST(count(*) + CASE WHEN o % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS stated, CAST(count(*) AS INTEGER) AS parsed, o % 6 <> 0 AS consistent FROM placed GROUP BY o""", prelude=False)
def lay_count(spark, sf_dir):
    """Identity, system, print date, stated and parsed counts of list printouts."""
    return X.parse_list(O.list_pages(spark, sf_dir))[0]


def _listed(spark: SparkSession, sf_dir: str):
    """The adapter's domain, and list printouts whose principals are the orders' suppliers."""
    d = AdapterDomain(spark, sf_dir)
    heads, rows = X.parse_list(O.list_pages(spark, sf_dir))
    rows = rows.withColumn("serial", F.split("serial", "-")[0])
    heads = heads.withColumn("serial", (F.col("doc").cast("long") % 150).cast("string"))
    return d, heads, rows


_LISTED = _LIST + """, last AS (SELECT CAST(o % 150 AS VARCHAR) AS serial, max(CAST(o AS VARCHAR)) AS doc FROM placed GROUP BY 1),
lists AS (SELECT serial AS principal, CAST(p AS VARCHAR) AS resource FROM last JOIN placed ON CAST(o AS VARCHAR) = doc)\n"""


@query(_LISTED + """SELECT * FROM (SELECT principal, resource, CASE WHEN principal IN (SELECT serial FROM last) THEN l.p IS NOT NULL ELSE coalesce(active, false) END AS active, coalesce(planned, false) AS planned, coalesce(removed, false) AS removed, coalesce(desired, false) AS desired
FROM flags FULL JOIN (SELECT *, principal AS p FROM lists) l USING (principal, resource)) WHERE active OR planned OR removed OR desired""")
def m_import_list_flags(spark, sf_dir):
    return R.import_lists(*_listed(spark, sf_dir))[2]


@query(_LISTED + """SELECT coalesce(p.serial, l.serial) AS serial, CASE WHEN l.serial IS NULL THEN p.number WHEN CAST(doc AS BIGINT) % 4 <> 0 THEN CAST(CAST(doc AS BIGINT) % 1000 AS INTEGER) END AS number, CASE WHEN l.serial IS NULL THEN p.person_name ELSE 'Name' || doc END AS person_name
FROM principal p FULL JOIN last l ON p.serial = l.serial""")
def m_import_list_principals(spark, sf_dir):
    return R.import_lists(*_listed(spark, sf_dir))[0]


@query(_LIST + """, d AS (SELECT o, CAST(o % 150 AS VARCHAR) AS serial, count(*) AS n FROM placed GROUP BY 1)
SELECT CAST(o AS VARCHAR) AS doc, serial, 'Name' || o AS label, CAST(n AS INTEGER) AS parsed, CAST(n + CASE WHEN o % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS stated, serial NOT IN (SELECT serial FROM principal) AS created, o % 6 <> 0 AS consistent FROM d""")
def m_import_list_summary(spark, sf_dir):
    return R.import_lists(*_listed(spark, sf_dir))[3]


@query(_LIST + """, new AS (SELECT p, min_by('Door ' || p || CASE WHEN p % 3 = 0 THEN ' cont' ELSE '' END, CAST(o AS VARCHAR)) AS door_name, min_by(CAST(s % 90 AS VARCHAR), CAST(o AS VARCHAR)) AS room, min_by('L.' || o % 7, CAST(o AS VARCHAR)) FILTER (o % 5 <> 0) AS location,
min_by(f || CASE WHEN p % 3 = 0 THEN ' more' ELSE '' END, CAST(o AS VARCHAR)) AS area FROM placed GROUP BY 1)
SELECT serial, CASE WHEN CAST(serial AS INTEGER) % 2 = 0 THEN door_name ELSE coalesce(n.door_name_, '') END AS door_name, CASE WHEN CAST(serial AS INTEGER) % 3 = 0 THEN room_number ELSE coalesce(n.room, '') END AS room_number, coalesce(n.location_, '') AS location, resource.area
FROM resource LEFT JOIN (SELECT p, door_name AS door_name_, room, location AS location_ FROM new) n ON CAST(n.p AS VARCHAR) = serial""")
def m_import_list_resources(spark, sf_dir):
    """Resources with blank fields take the printouts' values; others keep theirs."""
    d, heads, rows = _listed(spark, sf_dir)
    key = F.col("serial").cast("long")
    blank = d.resource.withColumns({"door_name": F.when(key % 2 == 0, F.col("door_name")).otherwise(""), "room_number": F.when(key % 3 == 0, F.col("room_number")).otherwise(""), "location": F.lit("")})
    return R.import_lists(Domain(d.principal, blank, d.grp, d.grants, d.membership, d.group_resource), heads, rows)[1]


# -- matrix printouts -----------------------------------------------------------------------------------------------
_MATRIX = """WITH col AS (SELECT CAST(s_nationkey AS VARCHAR) AS doc, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS c FROM supplier),
sold AS (SELECT DISTINCT doc, s, c, l_partkey AS p FROM lineitem JOIN col ON l_suppkey = s), door AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY p) AS r FROM (SELECT DISTINCT doc, p FROM sold))\n"""
_SERIAL = "lpad(CAST(s % 100 AS VARCHAR), 2, '0') || 'X' || lpad(CAST(s // 100 AS VARCHAR), 4, 'A')"


def _matrix(spark: SparkSession, sf_dir: str) -> X.Matrix:
    return X.parse_matrix(O.matrix_words(spark, sf_dir, high=O.MATRIX_ROWS))


@query(_MATRIX + f"""SELECT doc, CAST(c AS INTEGER) AS "column", {_SERIAL} AS serial, true AS valid, false AS suspect, CAST(CASE WHEN s % 7 <> 0 THEN s % 1000 END AS INTEGER) AS number, 'Supplier' || s AS person_name FROM col""", prelude=False)
def lay_persons(spark, sf_dir):
    return _matrix(spark, sf_dir).columns.drop("raw")


@query(_MATRIX + """SELECT doc, CAST(r AS INTEGER) AS "row", 'Room ' || p AS name, CASE WHEN p % 50 <> 0 THEN CAST(p % 50 AS VARCHAR) ELSE '' END AS room_number, 'E' || p % 9 AS floor FROM door""", prelude=False)
def lay_doors(spark, sf_dir):
    return _matrix(spark, sf_dir).doors


@query(_MATRIX + """SELECT doc, CAST(c AS INTEGER) AS "column", CAST(r AS INTEGER) AS "row", 'active' AS state FROM sold JOIN door USING (doc, p)""", prelude=False)
def src_matrix_pdf(spark, sf_dir):
    return _matrix(spark, sf_dir).marks


@query(_MATRIX + """SELECT doc, CAST(max(c) AS INTEGER) AS "columns", CAST(max(c) AS INTEGER) AS expected_columns, CAST(max(r) AS INTEGER) AS "rows", CAST(max(r) AS INTEGER) AS expected_rows, false AS scan, true AS consistent FROM col JOIN door USING (doc) GROUP BY 1""", prelude=False)
def lay_coverage(spark, sf_dir):
    return _matrix(spark, sf_dir).coverage


@query(_MATRIX + """SELECT doc, CAST(doc AS INTEGER) % 2 = 1 AS native FROM col JOIN door USING (doc) GROUP BY 1""", prelude=False)
def src_is_native(spark, sf_dir):
    return X.is_native(O.matrix_words(spark, sf_dir, F.col("doc").cast("int") % 2 == 0, O.MATRIX_ROWS))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'list' AS format FROM lineitem GROUP BY 1 UNION ALL SELECT 'm' || s_nationkey, 'matrix' FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) GROUP BY 1""", prelude=False)
def src_dispatch(spark, sf_dir):
    """The format of list and matrix printouts, from their words."""
    matrix = O.matrix_words(spark, sf_dir, high=O.MATRIX_ROWS).withColumn("doc", F.concat(F.lit("m"), "doc"))
    matrix = L.paged(matrix.repartition(tasks(spark), "doc", "page"))
    return X.detect_format(O.list_pages(spark, sf_dir).unionByName(matrix))


def _imported(spark: SparkSession, sf_dir: str):
    """The adapter's domain and the matrices of `matrix_words`, whose columns read as suppliers' keys in part."""
    d = AdapterDomain(spark, sf_dir)
    m = _matrix(spark, sf_dir)
    key = F.regexp_extract("person_name", r"(\d+)", 1)
    columns = m.columns.withColumns({"raw": F.when(key.cast("int") % 3 == 0, F.col("raw")).otherwise(key), "valid": key.cast("int") % 2 == 0})
    return d, columns, m.doors, m.marks


@query(_MATRIX.replace("WITH ", ", ", 1) + """, n AS (SELECT *, CASE WHEN s % 3 <> 0 THEN CAST(s AS VARCHAR) END AS known, s % 3 = 0 AND s % 2 = 0 AS made FROM col),
one AS (SELECT doc, count(*) AS persons, count(*) FILTER (made) AS created, count(*) FILTER (known IS NOT NULL AND (s % 5 = 0 OR (number IS NULL AND s % 7 <> 0))) AS updated, count(*) FILTER (known IS NULL AND NOT made) AS skipped FROM n LEFT JOIN principal ON serial = known GROUP BY 1),
two AS (SELECT doc, count(*) AS doors FROM door GROUP BY 1), three AS (SELECT doc, count(*) AS marks FROM sold GROUP BY 1)
SELECT doc, persons, created, updated, CAST(0 AS BIGINT) AS corrected, skipped, doors, doors AS doors_created, CAST(0 AS BIGINT) AS doors_fuzzy, marks, marks AS active, CAST(0 AS BIGINT) AS planned, CAST(0 AS BIGINT) AS removed FROM one JOIN two USING (doc) JOIN three USING (doc)""")
def q_matrix_metrics(spark, sf_dir):
    return R.matrix_metrics(*_imported(spark, sf_dir))


# -- exports and backups --------------------------------------------------------------------------------------------
@query(_MATRIX + """SELECT 'nation-' || doc || '.csv' AS doc, CAST(c - 1 AS INTEGER) AS ci, CAST(r - 1 AS INTEGER) AS ri FROM sold JOIN door USING (doc, p)""", prelude=False)
def src_csv_matrix(spark, sf_dir):
    return S.csv_matrix(settled(S.csv_cells(O.export_files(spark, sf_dir))))[2]


@query(_MATRIX + """SELECT 'nation-' || doc || '.csv' AS doc, CAST(r - 1 AS INTEGER) AS ri, 'L' || p AS serial, p_name || ' ' || p AS door_name, CAST(p_size AS VARCHAR) AS room_number, p_type || '.2' AS location, p_brand AS area FROM door JOIN part ON p = p_partkey""", prelude=False)
def src_csv_doors(spark, sf_dir):
    return S.csv_matrix(settled(S.csv_cells(O.export_files(spark, sf_dir))))[1]


def _readings(spark: SparkSession, sf_dir: str):
    """An export's columns, doors and marks, and a second reading of them: cut names, and a state for marks of even rows. Every
    seventh document's second reading has its rows in another order."""
    columns, doors, marks = S.csv_matrix(settled(S.csv_cells(O.export_files(spark, sf_dir))))
    marks = settled(marks)
    odd = F.regexp_extract("doc", r"(\d+)", 1).cast("int") % 7 == 3
    last = F.max("ri").over(Window.partitionBy("doc"))
    other = doors.select("doc", F.when(odd, last - F.col("ri")).otherwise(F.col("ri")).alias("ri"), F.left("door_name", F.lit(12)).alias("door_name"))
    states = marks.where("ri % 2 = 0").select("doc", "ci", "ri", F.when(F.col("ri") % 4 == 0, "planned").otherwise("active").alias("state"))
    return columns, doors, marks, other, states


@query(_MATRIX + f"""SELECT 'nation-' || doc || '.csv' AS doc, {_SERIAL} AS principal, 'L' || p AS resource, CASE WHEN (r - 1) % 4 = 0 THEN 'planned' ELSE 'active' END AS state FROM sold JOIN door USING (doc, p) WHERE CAST(doc AS INTEGER) % 7 <> 3""", prelude=False)
def j_positional(spark, sf_dir):
    columns, doors, marks, other, states = _readings(spark, sf_dir)
    return S.positional_grants(columns, doors, marks, states, S.align_errors(columns, doors, columns, other))


@query("""SELECT 'supplier-' || s AS doc, kind, count(*) AS n, bool_or(error IS NOT NULL) AS odd FROM (SELECT l_suppkey AS s, unnest(CASE WHEN l_suppkey % 5 = 3 THEN ['none'] ELSE ['resources', 'resources', 'groups', 'principals'] END) AS kind, CASE WHEN l_suppkey % 5 = 3 THEN 'x' END AS error
FROM lineitem GROUP BY 1 HAVING min(l_partkey) < max(l_partkey)) GROUP BY 1, 2""", prelude=False)
def src_backup_json(spark, sf_dir):
    records = B.read_backups(O.backup_files(spark, sf_dir))
    return records.groupBy("doc", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.bool_or(F.col("error").isNotNull()).alias("odd"))


@query("""SELECT 'supplier-' || s AS doc, CASE s % 5 WHEN 1 THEN 'twice: resources L' || a WHEN 2 THEN 'unknown in resources: Lnone' ELSE 'resources, fields or version' END AS error FROM (SELECT l_suppkey AS s, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1) WHERE a < b AND s % 5 IN (1, 2, 3)""", prelude=False)
def m_validate_backup(spark, sf_dir):
    """Faults of the documents; those of their shape by one text."""
    errors = B.backup_errors(B.read_backups(O.backup_files(spark, sf_dir)))
    relational = F.col("error").startswith("twice") | F.col("error").startswith("unknown in")
    return errors.select("doc", F.when(relational, F.col("error")).otherwise("resources, fields or version").alias("error"))


def _domain_rows(d: Domain) -> DataFrame:
    """All tables of a domain as rows of what, a, b, c."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = [
        d.principal.select(F.lit("principal").alias("what"), F.col("serial").alias("a"), text("number").alias("b"), F.col("person_name").alias("c")),
        d.resource.select(F.lit("resource"), "serial", "door_name", "location"),
        d.grp.select(F.lit("group"), "export_code", "name", F.col("is_implicit").cast("string")),
        d.grants.select(F.lit("grant"), "principal", "resource", "state"),
        d.membership.join(d.grp.select(F.col("id").alias("grp"), "export_code"), "grp").select(F.lit("member"), "principal", "export_code", F.lit("")),
        d.group_resource.join(d.grp.select(F.col("id").alias("grp"), "export_code"), "grp").select(F.lit("held"), "export_code", "resource", F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_BACKUP_5 = """, b AS (SELECT min(l_partkey) AS a, max(l_partkey) AS z FROM lineitem WHERE l_suppkey = 5),
new AS (SELECT 'principal' AS what, 'P5' AS a, '5' AS b, '' AS c UNION ALL SELECT 'resource', 'L' || a, 'Door ' || a, '' FROM b UNION ALL SELECT 'resource', 'L' || z, 'Door ' || z, '' FROM b
UNION ALL SELECT 'group', 'B5', 'Brand 5', 'true' UNION ALL SELECT 'grant', 'P5', 'L' || a, unnest(['active', 'removed', 'desired']) FROM b UNION ALL SELECT 'member', 'P5', 'B5', '' UNION ALL SELECT 'held', 'B5', 'L' || a, '' FROM b)\n"""


@query("WITH " + _BACKUP_5.lstrip(", ") + "SELECT * FROM new", prelude=False)
def m_restore_replace(spark, sf_dir):
    """The whole domain of one document."""
    return _domain_rows(B.restore_replace(B.read_backups(O.backup_files(spark, sf_dir)), "supplier-5"))


@query(_BACKUP_5 + """, states AS (SELECT principal, resource, unnest([CASE WHEN active THEN 'active' END, CASE WHEN planned THEN 'planned' END, CASE WHEN removed THEN 'removed' END, CASE WHEN desired THEN 'desired' END]) AS state FROM flags)
SELECT * FROM new UNION ALL SELECT 'principal', serial, coalesce(CAST(number AS VARCHAR), ''), person_name FROM principal UNION ALL SELECT 'resource', serial, door_name, location FROM resource
UNION ALL SELECT 'group', export_code, name, 'false' FROM grps WHERE export_code <> 'B5' UNION ALL SELECT 'grant', principal, resource, state FROM states WHERE state IS NOT NULL
UNION ALL SELECT 'member', principal, 'B' || grp, '' FROM membership UNION ALL SELECT 'held', 'B' || grp, resource, '' FROM group_resource WHERE grp <> 5""")
def m_restore_merged(spark, sf_dir):
    """The adapter's domain after one document is merged: its group has a known code, all else is new."""
    return _domain_rows(B.restore_merge(B.read_backups(O.backup_files(spark, sf_dir)), "supplier-5", AdapterDomain(spark, sf_dir)))


@query("""SELECT 'supplier-' || s AS doc, error FROM (SELECT l_suppkey AS s, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1) CROSS JOIN (SELECT unnest(['name', 'twice', 'dangling', 'shape']) AS error)
WHERE a < b AND CASE error WHEN 'name' THEN s % 5 <> 3 AND s BETWEEN 100 AND 124 WHEN 'twice' THEN s % 5 = 1 WHEN 'dangling' THEN s % 5 = 2 ELSE s % 5 = 3 END""", prelude=False)
def m_merge_errors(spark, sf_dir):
    """Faults that keep the documents from a merge; groups of suppliers from 100 on have the next group's name."""
    d = AdapterDomain(spark, sf_dir)
    grp = d.grp.select("id", F.concat(F.lit("Brand "), (F.col("id") + 99).cast("string")).alias("name"), "export_code", "is_implicit")
    errors = B.merge_errors(B.read_backups(O.backup_files(spark, sf_dir)), Domain(d.principal, d.resource, grp, d.grants, d.membership, d.group_resource))
    e = F.col("error")
    return errors.select("doc", F.when(e.startswith("group name"), "name").when(e.startswith("twice"), "twice").when(e.startswith("unknown in"), "dangling").otherwise("shape").alias("error"))


# -- groups and entities --------------------------------------------------------------------------------------------
simple("m_group_create", """SELECT 'group' AS what, id, name, export_code AS code FROM grps UNION ALL SELECT 'group', (SELECT max(id) + 1 FROM grps), 'Works shop', 'WS' UNION ALL SELECT 'outcome', (SELECT max(id) + 1 FROM grps), 'Works shop', 'WS'""",
       lambda d: (lambda made: made[0].select(F.lit("group").alias("what"), "id", "name", F.col("export_code").alias("code")).unionByName(made[1].select(F.lit("outcome").alias("what"), "id", "name", F.col("export_code").alias("code"))))(G.create_group(d.grp, " Works shop ", "ws")))
simple("m_group_rename", "SELECT id, CASE WHEN id = 4 THEN 'Renamed' ELSE name END AS name, export_code, is_implicit FROM grps", lambda d: G.rename_group(d.grp, 4, " Renamed ")[0])
simple("m_group_delete", """SELECT 'group' AS what, CAST(id AS VARCHAR) AS a, name AS b FROM grps WHERE id <> 4 UNION ALL SELECT 'member', principal, CAST(grp AS VARCHAR) FROM membership WHERE grp <> 4 UNION ALL SELECT 'held', CAST(grp AS VARCHAR), resource FROM group_resource WHERE grp <> 4
UNION ALL SELECT 'wish', principal, resource FROM flags WHERE desired""",
       lambda d: (lambda x: x.grp.select(F.lit("group").alias("what"), F.col("id").cast("string").alias("a"), F.col("name").alias("b")).union(x.membership.select(F.lit("member"), "principal", F.col("grp").cast("string"))).union(x.group_resource.select(F.lit("held"), F.col("grp").cast("string"), "resource")).union(x.grants.where("state = 'desired'").select(F.lit("wish"), "principal", "resource")))(G.delete_group(d, 4)))
simple("fn_derive_codes", "SELECT id, CASE row_number() OVER (ORDER BY lower(name), id) WHEN 1 THEN 'B' WHEN 2 THEN 'BR' WHEN 3 THEN 'BRA' WHEN 4 THEN 'BRAN' END AS export_code FROM grps", lambda d: G.derive_codes(d.grp))
simple("m_crud_create", """SELECT serial, CASE WHEN trim(raw) = '' THEN 'a serial is needed' WHEN contains(raw, '/') THEN 'a serial has no slash' WHEN lower(trim(raw)) = 'new' THEN 'the serial is reserved' WHEN k % 4 = 0 THEN 'the serial is there' END AS error
FROM (SELECT CAST(serial AS INTEGER) AS k, CASE CAST(serial AS INTEGER) % 4 WHEN 0 THEN ' ' || serial WHEN 1 THEN 'a/' || serial WHEN 2 THEN ' x' || serial || ' ' ELSE CASE serial WHEN '3' THEN 'New' WHEN '7' THEN ' ' ELSE 'y' || serial END END AS raw, trim(raw) AS serial FROM resource)""",
       lambda d: G.create_entities(d.resource, _wanted(d))[1])
simple("m_crud_created", "SELECT serial, door_name FROM resource UNION ALL SELECT 'x' || serial, 'made' FROM resource WHERE CAST(serial AS INTEGER) % 4 = 2 UNION ALL SELECT 'y' || serial, 'made' FROM resource WHERE CAST(serial AS INTEGER) % 4 = 3 AND serial NOT IN ('3', '7')",
       lambda d: G.create_entities(d.resource, _wanted(d))[0].select("serial", "door_name"))
simple("m_crud_edit", "SELECT serial, CASE WHEN number = 5 THEN 'edited' ELSE person_name END AS person_name, number FROM principal",
       lambda d: G.edit_entities(d.principal, d.principal.where("number = 5").select("serial", F.lit("edited").alias("person_name")))[0].select("serial", "person_name", "number"))
simple("m_crud_delete_resource", """, gone AS (SELECT serial FROM resource WHERE room_number = '7') SELECT 'grant' AS what, principal AS a, resource AS b FROM flags WHERE resource NOT IN (SELECT serial FROM gone) AND desired UNION ALL SELECT 'held', CAST(grp AS VARCHAR), resource FROM group_resource WHERE resource NOT IN (SELECT serial FROM gone)
UNION ALL SELECT 'resource', serial, door_name FROM resource WHERE serial NOT IN (SELECT serial FROM gone)""",
       lambda d: (lambda x: x.grants.where("state = 'desired'").select(F.lit("grant").alias("what"), F.col("principal").alias("a"), F.col("resource").alias("b")).union(x.group_resource.select(F.lit("held"), F.col("grp").cast("string"), "resource")).union(x.resource.select(F.lit("resource"), "serial", "door_name")))(G.delete_resources(d, d.resource.where("room_number = '7'"))))


def _wanted(d: Domain) -> DataFrame:
    """Resources that are asked for, some of them against a rule."""
    k = F.col("serial").cast("int") % 4
    own = F.when(F.col("serial") == "3", "New").when(F.col("serial") == "7", " ").otherwise(F.concat(F.lit("y"), "serial"))
    raw = F.when(k == 0, F.concat(F.lit(" "), "serial")).when(k == 1, F.concat(F.lit("a/"), "serial")).when(k == 2, F.concat(F.lit(" x"), "serial", F.lit(" "))).otherwise(own)
    return d.resource.select(raw.alias("serial"), F.lit("made").alias("door_name"))


# -- the halves that the older queries leave out --------------------------------------------------------------------
simple("m_unassign_membership", "SELECT principal, grp FROM membership WHERE grp <> 1", lambda d: R.unassign_group(d, d.membership.where("grp = 1"))[0])
simple("m_assign_membership", "SELECT principal, grp FROM membership UNION SELECT serial, 2 FROM principal WHERE number = 5",
       lambda d: R.assign_group(d, d.principal.where("number = 5").select(F.col("serial").alias("principal"), F.lit(2).cast("long").alias("grp")))[0])
simple("m_copy_membership", "SELECT principal, grp FROM membership JOIN principal ON serial = principal WHERE number IS DISTINCT FROM 5",
       lambda d: R.copy_desired(d, d.principal.where("number = 5").select(F.col("serial").alias("principal")))[0])
simple("m_set_desired_add", "SELECT principal, resource FROM flags WHERE desired OR active",
       lambda d: R.set_desired(d, d.flags().where("active").select("principal", "resource"), True).where("state = 'desired'").select("principal", "resource"))
_ADDED = """, change AS (SELECT serial AS resource FROM resource WHERE room_number = '9')"""
simple("m_group_resources_add", _ADDED + "SELECT 'held' AS what, CAST(grp AS VARCHAR) AS a, resource AS b FROM group_resource UNION SELECT 'held', '3', resource FROM change UNION SELECT 'wish', principal, resource FROM flags WHERE desired UNION SELECT 'wish', principal, resource FROM membership CROSS JOIN change WHERE grp = 3",
       lambda d: (lambda x: x[0].select(F.lit("held").alias("what"), F.col("grp").cast("string").alias("a"), F.col("resource").alias("b")).union(x[1].where("state = 'desired'").select(F.lit("wish"), "principal", "resource")))(R.set_group_resources(d, 3, d.resource.where("room_number = '9'").select(F.col("serial").alias("resource")), True)))
simple("m_seed_desired_keep", "SELECT principal, resource FROM flags WHERE desired", lambda d: R.seed_desired(d.grants).where("state = 'desired'").select("principal", "resource"))
simple("m_seed_desired_blank", "SELECT principal, resource FROM flags WHERE CASE WHEN CAST(principal AS INTEGER) % 2 = 0 THEN desired ELSE active OR planned END",
       lambda d: R.seed_desired(d.grants.where("state <> 'desired' OR CAST(principal AS INT) % 2 = 0")).where("state = 'desired'").select("principal", "resource"))
simple("m_toggle_held", """SELECT grp, resource FROM group_resource EXCEPT SELECT 2, CAST(x AS VARCHAR) FROM range(1, 41) t(x) UNION SELECT 3, '7' FROM range(1)""",
       lambda d: R.toggle_batch(d, [{"kind": "group", "id": 3, "on": True, "resources": ["7", "none"]}, {"kind": "group", "id": 2, "on": True, "resources": ["1"]}, {"kind": "group", "id": 2, "on": False, "resources": [str(x) for x in range(1, 41)]}]).group_resource)
simple("m_removed_report", "SELECT count(*) AS marks, count(DISTINCT principal) FILTER (CAST(resource AS INTEGER) % 3 <> 0) AS principals, count(*) FILTER (CAST(resource AS INTEGER) % 3 <> 0) AS grants, count(*) FILTER (CAST(resource AS INTEGER) % 3 = 0) AS skipped FROM flags WHERE planned",
       lambda d: R.removed_report(d.flags().where("planned").select("principal", F.when(F.col("resource").cast("int") % 3 == 0, F.concat(F.lit("none"), "resource")).otherwise(F.col("resource")).alias("resource")), d))
simple("q_picker_all", "SELECT serial, label FROM plabel WHERE contains(lower(label), 's') OR contains(lower(serial), 's') ORDER BY number NULLS FIRST, person_name, serial LIMIT 30", lambda d: A.picker(d, "S"))
simple("q_param_default", """SELECT principal, resource, 'active' AS scope FROM flags WHERE active""", lambda d: A._scoped(d.flags(), "nothing that is known").withColumn("scope", F.lit("active")))
simple("q_change_sheet_entries", """, e AS (SELECT principal, CASE WHEN desired THEN 'add' ELSE 'remove' END AS action, coalesce(nullif(location, ''), area, '') AS location, coalesce(nullif(door_name, ''), serial, resource) AS name, resource, CASE WHEN NOT desired AND planned AND NOT active THEN 'planned' ELSE '' END AS note
FROM flags LEFT JOIN resource ON serial = resource WHERE (active OR planned) <> desired) SELECT *, CAST(row_number() OVER (PARTITION BY principal, action ORDER BY location, name, resource, note) - 1 AS INTEGER) AS place FROM e""",
       lambda d: (lambda s: s.select("principal", F.lit("add").alias("action"), F.posexplode("add").alias("place", "e")).union(s.select("principal", F.lit("remove"), F.posexplode("remove"))).select("principal", "action", "place", "e.*"))(A.change_sheets(d)))
_SPARE = """, more AS (SELECT * FROM resource UNION ALL SELECT 'spare' || serial, '', '', '', '' FROM resource WHERE room_number = '1'), ci AS (SELECT serial AS principal, row_number() OVER (ORDER BY number NULLS FIRST, person_name, serial) - 1 AS ci FROM principal),
ri AS (SELECT serial AS resource, row_number() OVER (ORDER BY location, door_name, serial) - 1 AS ri FROM more {used})
SELECT ci, ri, CASE WHEN active THEN 2 WHEN planned THEN 1 ELSE 0 END AS weight, CAST(desired AS INTEGER) AS wished FROM flags JOIN ci USING (principal) JOIN ri USING (resource) WHERE active OR planned OR desired"""
for _hide, _used in ((True, "WHERE serial IN (SELECT resource FROM flags)"), (False, "")):
    simple("q_diff_spare" + "_hidden" * _hide, _SPARE.format(used=_used), lambda d, h=_hide: A.diff(_with_spare(d), h))


class _Spare(Domain):
    def flags(self) -> DataFrame:
        return self._flags


def _with_spare(d: Domain) -> Domain:
    """The domain with resources that nobody has."""
    blank = F.lit("")
    spare = d.resource.where("room_number = '1'").select(F.concat(F.lit("spare"), "serial").alias("serial"), *(blank.alias(c) for c in ("door_name", "room_number", "location", "area")))
    out = _Spare(d.principal, d.resource.unionByName(spare), d.grp, d.grants, d.membership, d.group_resource)
    out._flags = d.flags()
    return out


simple("q_group_members", """SELECT principal, label, CAST(row_number() OVER (ORDER BY number NULLS FIRST, person_name, serial) AS INTEGER) AS place FROM membership JOIN plabel ON serial = principal WHERE grp = 3""", lambda d: A.group_members(d, 3))
simple("q_principal_totals", """SELECT serial, count(*) FILTER (active) AS active, count(*) FILTER (planned) AS planned, count(*) FILTER (removed) AS removed, count(*) FILTER (desired) AS desired FROM principal LEFT JOIN flags ON principal = serial GROUP BY 1""", A.principal_totals)
simple("snk_markdown_lines", """, keys AS (SELECT principal, string_agg(export_code, '+' ORDER BY export_code) AS key FROM membership JOIN grps ON grp = id GROUP BY 1),
r AS (SELECT DISTINCT key, location, resource FROM keys JOIN membership USING (principal) JOIN group_resource USING (grp) JOIN resource ON serial = resource)
SELECT key, location, '### ' || location || chr(10) || chr(10) || string_agg('- ' || label || ' (' || resource || ')', chr(10) ORDER BY lower(label), resource) || chr(10) AS markdown FROM r JOIN (SELECT serial AS resource, label FROM rlabel) USING (resource) GROUP BY 1, 2""", A.markdown)
ORACLE_SQL["snk_markdown"] = ORACLE_SQL["snk_markdown_lines"]

# -- scalar functions and joins, with inputs that reach every branch ------------------------------------------------
_K = "WITH k AS (SELECT lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || 'X' || lpad(CAST(p_partkey // 100 AS VARCHAR), 4, 'A') AS s FROM part)\n"
_PAIRS = "[" + ", ".join(f"'{p}'" for x in T.LOOKALIKES for p in (x, x[::-1])) + "]"
_ALIKE = f"list_bool_and(list_transform(range(1, 8), lambda i: substr(raw, i, 1) = substr(s, i, 1) OR list_contains({_PAIRS}, substr(raw, i, 1) || substr(s, i, 1))))"
_BLOCK = "translate({0}, 'OQDS958BG6LI7TZA', '0000000000111124')"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(O.serial_of(F.col("p_partkey")).alias("serial"))


@query(_K + f""", q AS (SELECT DISTINCT replace(s, 'A', '4') AS raw FROM k), m AS (SELECT raw, s FROM q JOIN k ON {_BLOCK.format('raw')} = {_BLOCK.format('s')} WHERE {_ALIKE})
SELECT raw, CASE WHEN count(*) FILTER (raw = s) > 0 THEN raw WHEN count(s) = 1 THEN min(s) END AS serial FROM q LEFT JOIN m USING (raw) GROUP BY 1""", prelude=False)
def j_serial_lookalikes(spark, sf_dir):
    k = _known(spark, sf_dir)
    return E.match_serials(k.select(F.translate("serial", "A", "4").alias("raw")), k)


@query(_K + f"SELECT raw, s, {_ALIKE} AS alike FROM (SELECT s, replace(replace(s, 'A', CASE WHEN ends_with(s, '0') THEN '4' ELSE 'B' END), '7', '1') AS raw FROM k)", prelude=False)
def fn_lookalike(spark, sf_dir):
    k = _known(spark, sf_dir)
    swapped = F.replace(F.when(F.col("serial").endswith("0"), F.translate("serial", "A", "4")).otherwise(F.translate("serial", "A", "B")), F.lit("7"), F.lit("1"))
    return k.select(swapped.alias("raw"), F.col("serial").alias("s")).select("raw", "s", T.lookalike_equal(F.col("raw"), F.col("s")).alias("alike"))


@query(_K + """SELECT s AS known, replace(s, 'X', 'U') AS serial, true AS valid, true AS suspect FROM k
UNION ALL SELECT 'low ' || s, s, true, true FROM k UNION ALL SELECT 'cut ' || s, substr(s, 1, 6), false, true FROM k""", prelude=False)
def fn_repair_suspect(spark, sf_dir):
    """Digraphs, lower case and reads that can't be repaired."""
    k = _known(spark, sf_dir)
    read = k.select(F.col("serial").alias("known"), F.replace("serial", F.lit("X"), F.lit("tJ")).alias("raw")).union(k.select(F.concat(F.lit("low "), "serial"), F.lower("serial"))).union(k.select(F.concat(F.lit("cut "), "serial"), F.left("serial", F.lit(6))))
    r = T.repair_serial(F.col("raw"))
    return read.select("known", r["serial"].alias("serial"), r["valid"].alias("valid"), r["suspect"].alias("suspect"))


simple("fn_prefix_padded", "SELECT serial AS raw, CASE length(serial) WHEN 1 THEN '00' || serial WHEN 2 THEN '0' || serial ELSE serial END AS serial FROM principal",
       lambda d: R.resolve_padded(d.principal.select(F.col("serial").alias("raw")), d.principal.select(F.when(F.length("serial") < 3, F.lpad("serial", 3, "0")).otherwise(F.col("serial")).alias("serial"))))
simple("fn_derive_code_used", "SELECT id, CASE id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'BR' WHEN 2 THEN 'BRAN' END AS code FROM grps",
       lambda d: d.grp.select("id", T.derive_code(F.col("name"), F.when(F.col("id") % 4 == 0, F.array(F.lit("X"))).when(F.col("id") % 4 == 1, F.array(F.lit("b"))).when(F.col("id") % 4 == 2, F.array(F.lit("B"), F.lit("BR"), F.lit("BRA"))).otherwise(F.array(*map(F.lit, ("B", "BR", "BRA", "BRAN"))))).alias("code")))
simple("fn_norm_code_odd", "SELECT id, CASE WHEN id % 3 <> 0 AND length(CAST(id AS VARCHAR)) < 4 THEN 'A' || id END AS code FROM grps",
       lambda d: d.grp.select("id", T.norm_code(F.when(F.col("id") % 3 == 0, F.concat(F.lit("a-"), "id")).otherwise(F.concat(F.lit(" ä"), "id"))).alias("code")))


@query(", n AS (SELECT serial, 'Room ' || serial || ' ' || split_part(door_name, ' ', 1) AS k FROM resource) SELECT k || CASE CAST(serial AS INTEGER) % 4 WHEN 0 THEN '' WHEN 1 THEN '!' WHEN 2 THEN 'x' ELSE 'xyz' END AS name, CASE WHEN CAST(serial AS INTEGER) % 4 = 3 THEN NULL ELSE serial END AS serial FROM n")
def j_name_nearest(spark, sf_dir):
    """Equal, equal when normalised, one letter off, and too far off."""
    d = AdapterDomain(spark, sf_dir)
    known = d.resource.select("serial", F.concat(F.lit("Room "), "serial", F.lit(" "), F.split("door_name", " ")[0]).alias("door_name"))
    k = F.col("serial").cast("int") % 4
    return E.match_names(known.select(F.concat("door_name", F.when(k == 0, "").when(k == 1, "!").when(k == 2, "x").otherwise("xyz")).alias("name")), known)


simple("fn_edit_distance_near", ", n AS (SELECT DISTINCT door_name AS a FROM resource) SELECT a, CAST(least(levenshtein(a, replace(a, 'e', 'ab')), 3) AS INTEGER) AS d FROM n",
       lambda d: d.resource.select(F.col("door_name").alias("a")).distinct().select("a", T.edit_distance(F.col("a"), F.replace("a", F.lit("e"), F.lit("ab"))).alias("d")))
simple("fn_door_sides", "SELECT serial, CASE CAST(serial AS INTEGER) % 5 WHEN 0 THEN 'ost' WHEN 1 THEN 'west' WHEN 2 THEN 'b,links' WHEN 3 THEN '' ELSE 'nordwest' END AS sides FROM resource",
       lambda d: d.resource.select("serial", F.array_join(T.door_sides(F.concat(F.lit("Room "), "serial", F.element_at(F.array(*map(F.lit, (" Ost", "West", " B links", "hall", "Nordwest"))), (F.col("serial").cast("int") % 5 + 1)))), ",").alias("sides")))
simple("fn_number_split", "SELECT serial, CASE WHEN CAST(serial AS INTEGER) % 3 <> 1 THEN CAST(CAST(serial AS INTEGER) % 1000 AS INTEGER) END AS number, CASE CAST(serial AS INTEGER) % 3 WHEN 0 THEN 'Name' WHEN 1 THEN 'No one ' || serial ELSE '' END AS name FROM resource",
       lambda d: d.resource.select("serial", T.number_split(F.when(F.col("serial").cast("int") % 3 == 0, F.concat(F.lit("No. "), F.col("serial").cast("int") % 1000, F.lit(", Name "))).when(F.col("serial").cast("int") % 3 == 1, F.concat(F.lit("No one "), "serial")).otherwise(F.concat(F.lit("No"), F.col("serial").cast("int") % 1000))).alias("s")).select("serial", "s.*"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS x FROM events", prelude=False)
def fn_utc_iso(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.utc_iso(F.col("ts").cast("timestamp")).alias("x"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders", prelude=False)
def fn_iso_date(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", T.iso_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("d"))


# -- layout and pixels ----------------------------------------------------------------------------------------------
_ROWS = """WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS line, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)\n"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q")).withColumn("page", F.lit(1))


@query(_ROWS + "SELECT doc, line, last_value(CASE WHEN p % 3 = 0 THEN p END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line) AS section FROM r", prelude=False)
def lay_carry(spark, sf_dir):
    return L.carry(_rows(spark, sf_dir).withColumn("section", F.when(F.col("p") % 3 == 0, F.col("p"))), "section").select("doc", "line", "section")


@query(_ROWS + """, k AS (SELECT *, p % 5 = 0 AS is_break, CASE WHEN p % 5 <> 0 AND p % 2 = 0 THEN 'S' || p ELSE '' END AS serial FROM r), g AS (SELECT *, count(*) FILTER (serial <> '' OR is_break) OVER (PARTITION BY doc ORDER BY line) AS run FROM k)
SELECT doc, run AS "row", max(serial) AS serial, string_agg('t' || p, ' ' ORDER BY line) AS text FROM g WHERE NOT is_break GROUP BY 1, 2 HAVING max(serial) <> ''""", prelude=False)
def lay_wrap(spark, sf_dir):
    broken = F.col("p") % 5 == 0
    return L.wrap(_rows(spark, sf_dir).withColumns({"is_break": broken, "serial": F.when(~broken & (F.col("p") % 2 == 0), F.concat(F.lit("S"), "p")).otherwise(""), "text": F.concat(F.lit("t"), "p")}))


@query(_ROWS + "SELECT doc, count(*) FILTER (p % 2 = 0) >= count(*) FILTER (q < 25) AS reversed FROM r GROUP BY 1", prelude=False)
def lay_orient(spark, sf_dir):
    return L.orientation(_rows(spark, sf_dir).select("doc", (F.col("q") < 25).alias("normal_ok"), (F.col("p") % 2 == 0).alias("reversed_ok")))


@query(_ROWS + "SELECT doc, CAST(10 + p % 3 AS INTEGER) AS \"index\", min_by('v' || p, line) AS value, count(DISTINCT p) > 1 AS conflict FROM r GROUP BY 1, 2", prelude=False)
def lay_pages_first(spark, sf_dir):
    cells = _rows(spark, sf_dir).select("doc", F.col("line").alias("page"), F.lit(10).alias("start"), (F.col("p") % 3).cast("int").alias("i"), F.concat(F.lit("v"), "p").alias("value"))
    return L.assemble_pages(cells)


@query("""SELECT text, a AS row_from, b AS row_to, c AS col_from, d AS col_to FROM (SELECT l_partkey AS k, CAST(l_partkey % 90 AS INTEGER) AS a, CAST(l_partkey % 70 AS INTEGER) AS b, CAST(l_partkey % 50 AS INTEGER) AS c, CAST(l_partkey % 30 AS INTEGER) AS d,
CASE l_partkey % 3 WHEN 0 THEN 'Zeile ''' || a || '-' || b || ' ; Spalte ' || c || '-' || d WHEN 1 THEN 'x Zeile ' || a || ' - ' || b || '; Spalte' || c || '-' || d ELSE 'Zeile' || a || '-' || b || ' .. Spalte ''' || c || '- ' || d || ' y' END AS text FROM lineitem GROUP BY 1)""", prelude=False)
def lay_footer_odd(spark, sf_dir):
    p = F.col("l_partkey")
    a, b, c, d = ((p % n).cast("string") for n in (90, 70, 50, 30))
    one, two, three = F.concat(F.lit("Zeile '"), a, F.lit("-"), b, F.lit(" ; Spalte "), c, F.lit("-"), d), F.concat(F.lit("x Zeile "), a, F.lit(" - "), b, F.lit("; Spalte"), c, F.lit("-"), d), F.concat(F.lit("Zeile"), a, F.lit("-"), b, F.lit(" .. Spalte '"), c, F.lit("- "), d, F.lit(" y"))
    text = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().select(F.when(p % 3 == 0, one).when(p % 3 == 1, two).otherwise(three).alias("text"))
    return text.select("text", L.footer(F.col("text")).alias("f")).select("text", "f.*")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS col, l_partkey AS row, l_quantity / 50 AS ink, l_discount * 10 AS centre, l_tax FROM lineitem), f AS (SELECT doc, col, row FROM c WHERE ink >= 0.12 AND ink < 0.2 AND NOT (centre >= 0.45 AND ink >= 0.15 AND (l_tax >= 0.15 OR (ink < 0.35 AND l_tax >= 0.05)))),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY col, row) AS k FROM f) SELECT doc, CAST(k - 1 AS INTEGER) AS place, col, row FROM o WHERE k <= 8""", prelude=False)
def cls_faint_cells(spark, sf_dir):
    """The first faint cells of each document, as they are reported."""
    return P.faint_report(P._kinds(spark, sf_dir)).select("doc", F.posexplode("first").alias("place", "c")).select("doc", "place", "c.*")


_GRID = """WITH g AS (SELECT l_orderkey AS doc, l_linenumber AS col, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)\n"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 4 by 3 pixels whose greys follow from a part's key."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = li.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("col")).agg(F.min("l_partkey").alias("p"))
    return g.withColumns({"px": F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("p") * 7 + i * 37) % 256).cast("int")), "w": F.lit(4), "h": F.lit(3)})


@query(_GRID + """SELECT doc, col, len(list_filter(list_transform(range(12), lambda i: (p * 7 + i * 37) % 256), lambda v: v < 100)) / 12 AS ink FROM g""", prelude=False)
def cls_ink(spark, sf_dir):
    return _grid(spark, sf_dir).select("doc", "col", P.ink(F.col("px")).alias("ink"))


# -- pages as pixels ------------------------------------------------------------------------------------------------
#: The pages of `printouts.scanned_pages`, pixel by pixel: what lies inside a cell's border, 14 x 14 of 32 x 32.
_PIXELS = """WITH sold AS (SELECT l_suppkey AS s, year(l_shipdate) % 7 AS c, l_partkey % 12 AS r, count(*) % 6 AS kind FROM lineitem GROUP BY 1, 2, 3),
cells AS (SELECT s, c, r, coalesce(kind, 0) AS kind FROM (SELECT DISTINCT s FROM sold) CROSS JOIN (SELECT unnest(range(7)) AS c) CROSS JOIN (SELECT unnest(range(12)) AS r) LEFT JOIN sold USING (s, c, r)),
px AS (SELECT s, c, r, u, v, CASE WHEN kind = 1 AND (abs(u - v) <= 3 OR abs(u + v - 31) <= 3) THEN 0 WHEN kind = 2 AND (abs(u - v) <= 1 OR abs(u + v - 31) <= 1) THEN 0 WHEN kind = 3 AND (u + v) % 5 < 3 THEN 110
    WHEN kind = 4 AND (abs(u - v) <= 2 OR abs(u + v - 31) <= 2) THEN 185 WHEN kind = 5 AND u + v < 26 THEN 0 ELSE 255 END AS g FROM cells CROSS JOIN (SELECT unnest(range(9, 23)) AS u) CROSS JOIN (SELECT unnest(range(9, 23)) AS v)),
part AS (SELECT s, c, r, (CASE WHEN v < 14 THEN 0 WHEN v < 18 THEN 1 ELSE 2 END) * 3 + CASE WHEN u < 14 THEN 0 WHEN u < 18 THEN 1 ELSE 2 END AS k, CASE WHEN avg(g) < 127.5 THEN 1 ELSE 0 END AS ink, sum(255 - g) AS dark FROM px GROUP BY 1, 2, 3, 4),
shape AS (SELECT s, c, r, sum(ink) FILTER (k = 4) AS centre, sum(ink) FILTER (k % 2 = 0) / 5 - sum(ink) FILTER (k % 2 = 1) / 4 AS diagonal FROM part GROUP BY 1, 2, 3),
feature AS (SELECT s, c, r, count(*) FILTER (g < 200) / count(*) AS grey, count(*) FILTER (g < 128) / count(*) AS ink, count(*) FILTER (g < 64) / count(*) AS solid FROM px GROUP BY 1, 2, 3),
kinds AS (SELECT CAST(s AS VARCHAR) AS doc, CAST(c + 1 AS INTEGER) AS "column", CAST(r + 1 AS INTEGER) AS "row", grey, ink, solid, CAST(centre AS DOUBLE) AS centre, diagonal,
    CASE WHEN grey < 0.12 THEN 'empty' WHEN centre >= 0.45 AND solid >= 0.15 AND (diagonal >= 0.15 OR (ink < 0.35 AND diagonal >= 0.05)) THEN 'x' WHEN ink < 0.2 THEN 'faint' ELSE 'hatch' END AS kind FROM feature JOIN shape USING (s, c, r))\n"""


def _scan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the cells of the scanned pages are known to be."""
    left, top = O.MARGIN + O.LABEL, O.MARGIN + O.HEADING
    doc = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("doc")).distinct()
    at = doc.select("doc", F.lit(1).alias("page"), F.explode(F.sequence(F.lit(1), F.lit(O.YEARS))).alias("column")).withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(O.ROWS))))
    edge = lambda c, base, k: (base + O.CELL * (F.col(c) - 1 + k)).cast("int")
    return at.withColumns({"x0": edge("column", left, 0), "x1": edge("column", left, 1), "y0": edge("row", top, 0), "y1": edge("row", top, 1)})


@query(_PIXELS + """SELECT doc, "column", "row", grey, ink, solid, centre, diagonal, kind FROM kinds""", prelude=False)
def cls_cell_pixels(spark, sf_dir):
    """Features and kind of each cell, from the pixels of its page."""
    return RA.classify_cells(O.scanned_pages(spark, sf_dir), _scan_cells(spark, sf_dir)).drop("page")


@query(_PIXELS + """SELECT CAST(s AS VARCHAR) AS doc, CAST(c + 1 AS INTEGER) AS "column", CAST(r + 1 AS INTEGER) AS "row", CAST(k AS INTEGER) AS place, CAST(dark AS BIGINT) AS dark, ink FROM part""", prelude=False)
def cls_box_mean(spark, sf_dir):
    """The reduction of each cell to 3 x 3 parts."""
    sums = RA.cell_sums(O.scanned_pages(spark, sf_dir), _scan_cells(spark, sf_dir))
    parts = F.arrays_zip(F.array(*(f"dark{i}" for i in range(9))).alias("dark"), RA.inked_parts(sums).alias("ink"))
    return sums.select("doc", "column", "row", F.posexplode(parts).alias("place", "p")).select("doc", "column", "row", "place", "p.dark", "p.ink")


@query("""WITH d AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS doc FROM lineitem), l AS (SELECT 'v' AS axis, 0 AS place, 4.0::DOUBLE AS pos UNION ALL SELECT 'v', k + 1, 64.0 + 32 * k FROM (SELECT unnest(range(8)) AS k)
UNION ALL SELECT 'h', 0, 4.0 UNION ALL SELECT 'h', k + 1, 28.0 + 32 * k FROM (SELECT unnest(range(13)) AS k)) SELECT doc, axis, CAST(place AS INTEGER) AS place, pos FROM d CROSS JOIN l""", prelude=False)
def cls_rulings(spark, sf_dir):
    """The rulings of the scanned pages, as their pixels show them."""
    _, down, across = RA.grid(settled(O.scanned_pages(spark, sf_dir)))
    both = down.select("doc", F.lit("v").alias("axis"), "lines").unionByName(across.select("doc", F.lit("h").alias("axis"), "lines"))
    return both.select("doc", "axis", F.posexplode("lines").alias("place", "pos"))


@query(_PIXELS + """SELECT doc, "column", "row", kind FROM kinds WHERE kind <> 'empty'""", prelude=False)
def src_matrix_image(spark, sf_dir):
    """The marks of scanned pages: rulings, grid and kinds of cells from pixels alone."""
    return RA.read_scan(settled(O.scanned_pages(spark, sf_dir))).where("kind <> 'empty'").select("doc", "column", "row", "kind")


@query(_MATRIX + """SELECT doc, CAST(c AS INTEGER) AS "column", CAST(r AS INTEGER) AS "row", CASE (s + p) % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'planned' ELSE 'remove' END AS state FROM sold JOIN door USING (doc, p) WHERE (s + p) % 4 < 3""", prelude=False)
def src_native_matrix(spark, sf_dir):
    """The states of drawn marks."""
    return X.parse_native(O.matrix_words(spark, sf_dir, F.lit(False), O.MATRIX_ROWS), *O.drawn_marks(spark, sf_dir, O.MATRIX_ROWS), include_removed=True).marks


# -- SQL for queries of other modules ------------------------------------------------------------------------------
_W = """WITH w AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc, 1 AS page, CAST(l_partkey AS VARCHAR) AS text, CAST(l_partkey % 97 AS DOUBLE) AS x0, l_linenumber * 2.0::DOUBLE AS top, l_partkey % 2 = 0 AS upright FROM lineitem)\n"""
_STRIPS = """, s AS (SELECT *, sum(CASE WHEN d <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY x0 ROWS UNBOUNDED PRECEDING) - 1 AS strip FROM (SELECT *, x0 + 1 AS xc, x0 - lag(x0) OVER (PARTITION BY doc ORDER BY x0) AS d FROM w WHERE NOT upright))"""
ORACLE_SQL["lay_serial_band"] = _W + """, t AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc ORDER BY top) <= 2.5 THEN 0 ELSE 1 END AS new FROM w), g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY top, text ROWS UNBOUNDED PRECEDING) AS run FROM t),
r AS (SELECT doc, run, count(*) AS n, min(top) AS a, max(top + 1) AS b FROM (SELECT doc, top, max(run) OVER (PARTITION BY doc, top) AS run FROM g) GROUP BY 1, 2)
SELECT doc, 1 AS page, max_by(a, {'n': n, 'a': a}) - 4 AS low, max_by(b, {'n': n, 'a': a}) + 4 AS high FROM r GROUP BY 1"""
ORACLE_SQL["j_mark_nearest"] = _W + _STRIPS + """, c AS (SELECT doc, strip, avg(xc) AS xc FROM s GROUP BY 1, 2), m AS (SELECT DISTINCT doc, text, x0 FROM w WHERE upright)
SELECT doc, 1 AS page, text AS mark, arg_min(strip, {'d': abs(x0 - xc), 's': strip}) AS strip FROM m JOIN c USING (doc) WHERE abs(x0 - xc) <= 7 GROUP BY 1, 3"""
ORACLE_SQL["lay_lines"] = _W + """, a AS (SELECT doc, list_reduce(list_transform(list(DISTINCT top ORDER BY top), lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] > 3 THEN list_append(acc, x[1]) ELSE acc END) AS anchors FROM w GROUP BY 1)
SELECT doc, 1 AS page, CAST(line AS INTEGER) AS line, anchors[line + 1] AS top, string_agg(text, ' ' ORDER BY x0, text, top) AS text FROM (SELECT doc, anchors, x0, text, top, len(list_filter(anchors, lambda v: v <= top)) - 1 AS line FROM w JOIN a USING (doc)) GROUP BY 1, 3, 4"""
ORACLE_SQL["lay_native_cols"] = _W + _STRIPS + """, low AS (SELECT *, CASE WHEN top - lag(top + 1) OVER o > 2 THEN 1 ELSE 0 END AS cut FROM s WHERE top >= 9 WINDOW o AS (PARTITION BY doc, strip ORDER BY top, x0)), first AS (SELECT *, sum(cut) OVER (PARTITION BY doc, strip ORDER BY top, x0 ROWS UNBOUNDED PRECEDING) AS band FROM low),
raw AS (SELECT doc, strip, string_agg(reverse(text), '' ORDER BY -top, x0, reverse(text)) AS raw FROM first WHERE band = 0 GROUP BY 1, 2), name AS (SELECT doc, strip, string_agg(reverse(text), ' ' ORDER BY -top, x0, reverse(text)) AS name FROM s WHERE top < 9 GROUP BY 1, 2)
SELECT doc, strip, coalesce(raw, '') AS raw, coalesce(name, '') AS name FROM (SELECT DISTINCT doc, strip FROM s) LEFT JOIN raw USING (doc, strip) LEFT JOIN name USING (doc, strip) WHERE coalesce(name, '') <> '' OR regexp_full_match(raw, '[0-9]{7}')"""


@query(_MATRIX + "SELECT doc, CAST((c - 1) // 20 + 1 AS INTEGER) AS page, 'Room' || CASE WHEN p % 50 <> 0 THEN ' ' || p ELSE '' END AS name FROM door JOIN (SELECT DISTINCT doc, (c - 1) // 20 * 20 + 1 AS c FROM col) USING (doc)", prelude=False)
def lay_native_doors_named(spark, sf_dir):
    """Labels left of the grid, without the numbers of another column behind them."""
    return L.native_doors(O.matrix_words(spark, sf_dir)).select("doc", "page", "name")


@query(_MATRIX + f"SELECT doc, CAST((c - 1) // 20 + 1 AS INTEGER) AS page, {_SERIAL} AS raw, CASE WHEN s % 7 <> 0 THEN 'No. ' || s % 1000 || ' ' ELSE '' END || 'Supplier' || s AS name FROM col", prelude=False)
def lay_native_cols_named(spark, sf_dir):
    return L.native_columns(O.matrix_words(spark, sf_dir)).select("doc", "page", "raw", "name")


simple("src_routes", "SELECT serial, CASE CAST(serial AS INTEGER) % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'csv' WHEN 2 THEN 'backup' WHEN 3 THEN 'matrix' ELSE 'image' END AS kind FROM resource",
       lambda d: d.resource.select("serial", S.route(F.concat(F.lit("dir/"), "serial", F.element_at(F.array(*map(F.lit, (".PNG", ".Csv", ".json", ".pdf", ".jpeg"))), F.col("serial").cast("int") % 5 + 1)), F.lit("matrix")).alias("kind")))

_ALL_ROWS = """, states AS (SELECT principal, resource, unnest([CASE WHEN active THEN 'active' END, CASE WHEN planned THEN 'planned' END, CASE WHEN removed THEN 'removed' END, CASE WHEN desired THEN 'desired' END]) AS state FROM flags)
SELECT 'principal' AS what, serial AS a, coalesce(CAST(number AS VARCHAR), '') AS b, person_name AS c FROM principal UNION ALL SELECT 'resource', serial, door_name, location FROM resource UNION ALL SELECT 'group', export_code, name, CAST(is_implicit AS VARCHAR) FROM grps
UNION ALL SELECT 'grant', principal, resource, state FROM states WHERE state IS NOT NULL UNION ALL SELECT 'member', principal, 'B' || grp, '' FROM membership UNION ALL SELECT 'held', 'B' || grp, resource, '' FROM group_resource"""


@query(_ALL_ROWS)
def snk_tables(spark, sf_dir):
    """The domain, written as a version, published and read back."""
    settled(spark.range(1))  # a session without a folder gets one
    root = f"{spark.sparkContext.getCheckpointDir()}/domain-{uuid.uuid4().hex}"
    V.publish(spark, root, V.write_version(AdapterDomain(spark, sf_dir), root))
    return _domain_rows(V.current(spark, root))


@query(_MATRIX.replace("WITH ", ", ", 1) + f""", one AS (SELECT min('nation-' || doc || '.csv') AS path FROM sold), mine AS (SELECT * FROM sold JOIN door USING (doc, p) JOIN one ON path = 'nation-' || doc || '.csv')
SELECT 'principal' AS what, {_SERIAL} AS a, CAST(s % 1000 AS VARCHAR) AS b, 'Name' AS c FROM col JOIN one ON path = 'nation-' || doc || '.csv' UNION ALL SELECT DISTINCT 'resource', 'L' || p, p_name || ' ' || p, p_type || '.2' FROM mine JOIN part ON p = p_partkey
UNION ALL SELECT 'group', export_code, name, CAST(is_implicit AS VARCHAR) FROM grps UNION ALL SELECT 'grant', {_SERIAL}, 'L' || p, CASE WHEN (r - 1) % 4 = 0 THEN 'planned' ELSE 'active' END FROM mine""")
def m_import_csv(spark, sf_dir):
    """The adapter's domain rebuilt from the first nation's export."""
    return _rebuilt(spark, sf_dir, O.export_files(spark, sf_dir, O.first_export(spark, sf_dir)))


def _rebuilt(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    cells = settled(S.csv_cells(files))
    columns, doors, marks = S.csv_matrix(cells)
    marks = settled(marks)
    states = marks.where("ri % 4 = 0").select("doc", "ci", "ri", F.lit("planned").alias("state"))
    number = F.concat(F.substring("serial", 4, 4), F.substring("serial", 1, 2))
    persons = columns.select("doc", "ci", "serial", (F.regexp_replace(number, "A", "").cast("int") % 1000).alias("number"), F.lit("Name").alias("person_name"))
    return _domain_rows(S.rebuilt(AdapterDomain(spark, sf_dir), columns, doors, marks, persons, doors, states)[0])


@query(_MATRIX.replace("WITH ", ", ", 1) + f""" SELECT 'principal' AS what, {_SERIAL} AS a, CAST(s % 1000 AS VARCHAR) AS b, 'Name' AS c FROM col WHERE doc IN (SELECT doc FROM sold) UNION ALL SELECT DISTINCT 'resource', 'L' || p, p_name || ' ' || p, p_type || '.2' FROM sold JOIN part ON p = p_partkey
UNION ALL SELECT 'group', export_code, name, CAST(is_implicit AS VARCHAR) FROM grps UNION ALL SELECT 'grant', {_SERIAL}, 'L' || p, CASE WHEN (r - 1) % 4 = 0 THEN 'planned' ELSE 'active' END FROM sold JOIN door USING (doc, p)""")
def m_import_exports(spark, sf_dir):
    """The adapter's domain rebuilt from all exports of a folder."""
    return _rebuilt(spark, sf_dir, O.export_files(spark, sf_dir))


# -- folders of files, pages of a matrix ----------------------------------------------------------------------------
@query(_MATRIX + """, n AS (SELECT doc, CAST(doc AS INTEGER) % 5 AS k, (SELECT count(*) FROM col WHERE col.doc = door.doc) AS cols, count(*) AS doors, (SELECT count(*) FROM sold WHERE sold.doc = door.doc) AS marks FROM door GROUP BY doc)
SELECT 'nation-' || doc || '.csv' AS path, CASE k WHEN 3 THEN 'faulty' WHEN 4 THEN 'empty' ELSE 'read' END AS outcome, CASE WHEN k < 3 THEN 5 + cols + 6 * doors + marks ELSE 0 END AS cells,
CASE WHEN k < 3 THEN cols ELSE 0 END AS columns, CASE WHEN k < 3 THEN doors ELSE 0 END AS doors, CASE WHEN k < 3 THEN marks ELSE 0 END AS marks FROM n""", prelude=False)
def src_bulk_dir(spark, sf_dir):
    """What became of every file of a folder: of each five exports one is cut off inside a letter, and one is empty."""
    files = O.export_files(spark, sf_dir)
    k = F.regexp_extract("path", r"(\d+)", 1).cast("int") % 5
    content = F.when(k == 3, F.expr("substring(content, 1, length(content) - 1)")).when(k == 4, F.lit(b"")).otherwise(F.col("content"))
    return S.outcomes(files.select("path", F.length(content).cast("long").alias("length"), content.alias("content"), "first_column", "rows")).drop("error")


@query(_INDEX.format(used="") + """, tile AS (SELECT ci // 36 AS tc, ri // 48 AS tr, count(*) AS n, string_agg(ci || '-' || ri || ':' || weight, ' ' ORDER BY ci, ri) AS cells FROM w JOIN ci USING (principal) JOIN ri USING (resource) WHERE weight > 0 GROUP BY 1, 2),
pc AS (SELECT ci // 36 AS tc, string_agg(label, '|' ORDER BY ci) AS heads FROM ci JOIN plabel ON serial = principal GROUP BY 1), pr AS (SELECT ri // 48 AS tr, string_agg(label, '|' ORDER BY ri) AS labels FROM ri JOIN rlabel ON serial = resource GROUP BY 1)
SELECT CAST(tc AS INTEGER) AS tc, CAST(tr AS INTEGER) AS tr, heads, labels, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(cells, '') AS cells FROM pc CROSS JOIN pr LEFT JOIN tile USING (tc, tr)""")
def snk_tiles(spark, sf_dir):
    """The matrix as pages of A4, written as JSON by tile and read back."""
    d = AdapterDomain(spark, sf_dir)
    pages = TI.tiles(d, A.matrix(d), "a4")
    settled(spark.range(1))  # a session without a folder gets one
    path = f"{spark.sparkContext.getCheckpointDir()}/tiles-{uuid.uuid4().hex}"
    TI.write_tiles(pages, path)
    labels = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), "|")
    marks = F.array_join(F.transform("cells", lambda x: F.concat(x["ci"], F.lit("-"), x["ri"], F.lit(":"), x["weight"])), " ")
    return TI.read_tiles(spark, path, pages.schema).select("tc", "tr", labels("columns").alias("heads"), labels("rows").alias("labels"), F.size("cells").alias("n"), marks.alias("cells"))
