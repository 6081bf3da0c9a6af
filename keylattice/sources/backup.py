"""The strict backup document: {format, version, exported_at, resources, groups, principals}.

Only the shape of one document, which is bounded by MAX_BYTES, is checked in Python; duplicates and references are
joins over the records of all documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylattice.sources.domain import Domain
from keylattice.sources.shared import settled

FORMAT, VERSION, MAX_BYTES = "keylattice-backup", 1, 10 * 1024 * 1024
LISTS = ("active", "planned", "removed", "desired")
#: Fields of each kind with their rule: a length for text ("!" for text that can't be blank), or a name of RULES.
SHAPES = {
    "resources": {"serial": "!32", "door_name": "255", "room_number": "64", "location": "64", "area": "64"},
    "groups": {"name": "!128", "export_code": "code", "is_implicit": "bool", "resources": "ids"},
    "principals": {"serial": "!32", "number": "int", "person_name": "255", "locking_system": "64", "printed_on": "date", "source_file": "255", "imported_at": "time"} | dict.fromkeys(LISTS, "ids") | {"groups": "codes"},
}
RECORDS = "doc string, kind string, place int, id string, body string, error string"


def _is_id(v) -> bool:
    return isinstance(v, str) and 0 < len(v) <= 32


def _is_code(v) -> bool:
    return isinstance(v, str) and re.fullmatch("[A-Z0-9]{1,4}", v.strip().upper()) is not None


def _parses(read, v) -> bool:
    try:
        return isinstance(v, str) and read(v) is not None
    except ValueError:
        return False


RULES = {
    "code": _is_code,
    "bool": lambda v: isinstance(v, bool),
    "int": lambda v: v is None or (isinstance(v, int) and not isinstance(v, bool) and -(2**31) <= v < 2**31),
    "date": lambda v: v is None or _parses(date.fromisoformat, v),
    "time": lambda v: _parses(lambda x: datetime.fromisoformat(x).tzinfo, v),
    "ids": lambda v: isinstance(v, list) and all(map(_is_id, v)) and len(set(v)) == len(v),
    "codes": lambda v: isinstance(v, list) and all(map(_is_code, v)) and len({x.strip().upper() for x in v}) == len(v),
}


def _fits(rule: str, v) -> bool:
    if rule in RULES:
        return RULES[rule](v)
    return isinstance(v, str) and len(v) <= int(rule.lstrip("!")) and (v != "" or rule[0] != "!")


def _once(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a field is there twice")
    return dict(pairs)


def _records(content: bytes) -> list[tuple]:
    """(kind, place, id, body) of each record; raises ValueError at the first fault of shape."""
    if len(content) > MAX_BYTES:
        raise ValueError(f"more than {MAX_BYTES} bytes")
    root = json.loads(content.decode("utf-8"), object_pairs_hook=_once)
    json.dumps(root, ensure_ascii=False).encode()  # lone surrogates are no text
    if not isinstance(root, dict) or root.keys() != {"format", "version", "exported_at", *SHAPES}:
        raise ValueError("the document's fields are not those of a backup")
    if root["format"] != FORMAT or isinstance(root["version"], bool) or root["version"] != VERSION or not RULES["time"](root["exported_at"]):
        raise ValueError("format, version or exported_at is not valid")
    out = []
    for kind, shape in SHAPES.items():
        if not isinstance(root[kind], list):
            raise ValueError(f"{kind} is not a list")
        for place, record in enumerate(root[kind]):
            if not isinstance(record, dict) or record.keys() != shape.keys():
                raise ValueError(f"{kind} {place}: fields are missing or unknown")
            if bad := [f for f, rule in shape.items() if not _fits(rule, record[f])]:
                raise ValueError(f"{kind} {place}: {bad[0]} is not valid")
            if kind == "groups":
                record["export_code"] = record["export_code"].strip().upper()
            if kind == "principals":
                record["groups"] = [c.strip().upper() for c in record["groups"]]
            out.append((kind, place, record["export_code" if kind == "groups" else "serial"], json.dumps(record, ensure_ascii=False)))
    return out


def read_backups(files: DataFrame) -> DataFrame:
    """doc, kind, place, id, body (JSON), error of files (path, content): all records of a document, or its one fault."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                try:
                    rows = [(path, *r, None) for r in _records(bytes(content or b""))]
                except (ValueError, RecursionError) as e:
                    rows = [(path, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["doc", "kind", "place", "id", "body", "error"]).astype({"place": "Int32"})

    return files.select("path", "content").mapInPandas(read, RECORDS)


def _list(records: DataFrame, kind: str, field: str, name: str) -> DataFrame:
    """doc, owner and one row per entry of a list field."""
    entries = F.from_json(F.get_json_object("body", f"$.{field}"), "array<string>")
    return records.where(F.col("kind") == kind).select("doc", F.col("id").alias("owner"), F.explode(entries).alias(name))


def backup_errors(records: DataFrame, known: Domain | None = None) -> DataFrame:
    """doc, error of every fault: shape, repeated ids, several implicit groups, references to nothing.

    `known` are entities outside the document that it may refer to (merge); without it, only its own count (replace).
    """
    return _errors(settled(records), known)  # files are read once


def _errors(records: DataFrame, known: Domain | None) -> DataFrame:
    shape = records.where("error IS NOT NULL").select("doc", "error")
    ids = records.where("error IS NULL")
    twice = ids.groupBy("doc", "kind", "id").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.concat(F.lit("twice: "), "kind", F.lit(" "), "id").alias("error"))
    groups = ids.where("kind = 'groups'")
    names = groups.groupBy("doc", F.lower(F.get_json_object("body", "$.name")).alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("doc", F.concat(F.lit("twice: group name "), "name").alias("error"))
    implicit = groups.where(F.get_json_object("body", "$.is_implicit") == "true").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit("several implicit groups").alias("error"))

    def dangling(refs: DataFrame, kind: str, outside: DataFrame | None) -> DataFrame:
        left = refs.join(ids.where(F.col("kind") == kind).select("doc", F.col("id").alias("ref")), ["doc", "ref"], "left_anti")
        left = left if outside is None else left.join(outside, "ref", "left_anti")
        return left.select("doc", F.concat(F.lit(f"unknown in {kind}: "), "ref").alias("error")).distinct()

    doors = _list(records, "groups", "resources", "ref").select("doc", "ref")
    for s in LISTS:
        doors = doors.unionByName(_list(records, "principals", s, "ref").select("doc", "ref"))
    codes = _list(records, "principals", "groups", "ref").select("doc", "ref")
    here = lambda df, c: df.select(F.col(c).alias("ref")) if df is not None else None
    refs = dangling(doors.distinct(), "resources", here(known and known.resource, "serial")).union(dangling(codes.distinct(), "groups", here(known and known.grp, "export_code")))
    return shape.union(twice).union(names).union(implicit).union(refs)


def restore_replace(records: DataFrame, doc: str) -> Domain:
    """The domain that one valid document describes, exactly. Ids of groups are their places."""
    own = settled(records.where((F.col("doc") == doc) & F.col("error").isNull()))  # files are read once
    of = lambda kind, schema: own.where(F.col("kind") == kind).select("place", F.from_json("body", schema).alias("b"))
    principal = of("principals", "serial string, number int, person_name string").select("b.*")
    resource = of("resources", "serial string, door_name string, room_number string, location string, area string").select("b.*")
    grp = of("groups", "name string, export_code string, is_implicit boolean").select(F.col("place").cast("long").alias("id"), "b.*")
    grants = None
    for s in LISTS:
        part = _list(own, "principals", s, "resource").select(F.col("owner").alias("principal"), "resource", F.lit(s).alias("state"))
        grants = part if grants is None else grants.unionByName(part)
    code = grp.select(F.col("id").alias("grp"), F.col("export_code").alias("code"))
    membership = _list(own, "principals", "groups", "code").join(code, "code").select(F.col("owner").alias("principal"), "grp")
    held = _list(own, "groups", "resources", "resource").withColumnRenamed("owner", "code").join(code, "code").select("grp", "resource")
    return Domain(principal, resource, grp, grants, membership, held)


def merge_errors(records: DataFrame, known: Domain) -> DataFrame:
    """doc, error of every fault that keeps a document from being merged into a domain: those of the document with what is known,
    and group names that belong to another code."""
    records = settled(records)
    groups = records.where("error IS NULL AND kind = 'groups'").select("doc", F.col("id").alias("code"), F.get_json_object("body", "$.name").alias("name"))
    here = known.grp.select(F.lower("name").alias("low"), F.col("export_code").alias("other"))
    taken = groups.join(here, F.lower("name") == F.col("low")).where(F.upper("other") != F.col("code"))
    return _errors(records, known).union(taken.select("doc", F.concat(F.lit("group name of another code: "), "name").alias("error")))


def restore_merge(records: DataFrame, doc: str, domain: Domain) -> Domain:
    """The domain after one valid document is merged into it.

    Resources and principals are matched by serial, groups by code: what is listed replaces the fields and all relations of
    its record, what isn't listed stays. If the document names an implicit group, no other stays implicit. New groups
    get the next ids in the document's order.
    """
    new = restore_replace(records, doc)
    known = domain.grp.select(F.col("id").alias("old"), F.upper("export_code").alias("export_code"))
    last = domain.grp.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    ids = new.grp.join(known, "export_code", "left").crossJoin(last).select(F.col("id").alias("place"), F.coalesce("old", F.col("last") + 1 + F.col("id")).alias("grp"), "name", "export_code", "is_implicit")
    moved = new.grp.agg(F.coalesce(F.bool_or("is_implicit"), F.lit(False)).alias("moved"))  # one row
    kept = domain.grp.join(ids.select(F.col("grp").alias("id")), "id", "left_anti").crossJoin(moved)
    grp = kept.select("id", "name", "export_code", (F.col("is_implicit") & ~F.col("moved")).alias("is_implicit")).unionByName(ids.select(F.col("grp").alias("id"), "name", "export_code", "is_implicit"))

    def upsert(old: DataFrame, rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c != "serial" and c in old.columns]
        both = old.join(rows.select("serial", F.struct(*fields).alias("new")), "serial", "full")
        return both.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))

    named = lambda df, c: df.select(F.col(c).alias("grp")).distinct()
    by_place = ids.select(F.col("place").alias("grp"), F.col("grp").alias("id"))
    real = lambda df: df.join(by_place, "grp").drop("grp").withColumnRenamed("id", "grp")
    listed = new.principal.select(F.col("serial").alias("principal"))
    grants = domain.grants.join(listed, "principal", "left_anti").unionByName(new.grants)
    membership = domain.membership.join(listed, "principal", "left_anti").unionByName(real(new.membership).select("principal", "grp"))
    held = domain.group_resource.join(named(ids, "grp"), "grp", "left_anti").unionByName(real(new.group_resource).select("grp", "resource"))
    return Domain(upsert(domain.principal, new.principal), upsert(domain.resource, new.resource), grp, grants, membership, held)
