"""URL filters: a sorted array of 64-bit digests of rules in a file that each machine maps once and its tasks probe by binary search."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import shared_path, table

#: The rules of the registered query: (verdict, host, path prefix). Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def array_file(rules: Sequence[Rule]) -> bytes:
    """The file of a rule list: four counts, the lengths of paths, sorted 64-bit digests, ends of the rule strings, verdicts
    (1: block), and the full rule strings that confirm a hit. Of equal rules, block wins."""
    kept: dict[str, str] = {}
    for verdict, host, path in rules:
        if kept.get(host + path) != "block":
            kept[host + path] = verdict
    texts = sorted(kept, key=lambda r: (xxhash.xxh64_intdigest(r), r))
    raw = [r.encode() for r in texts]
    lengths = np.array(sorted({len(p) for _, _, p in rules}), np.int64)
    keys = np.array([xxhash.xxh64_intdigest(r) for r in texts], np.uint64)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    counts = np.array([len(lengths), len(texts), int(ends[-1]) if len(ends) else 0, 0], np.int64)
    return b"".join([counts.tobytes(), lengths.tobytes(), keys.tobytes(), ends.tobytes(), bytes(kept[r] == "block" for r in texts), *raw])


class DigestArray:
    """A mapped file of rules: nothing of it is read but the pages that probes touch."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n_lengths, n, text, _ = data[:32].view(np.int64).tolist()
        ends = 32 + np.cumsum([0, 8 * n_lengths, 8 * n, 8 * n, n, text])
        part = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.lengths = part[0].view(np.int64).tolist()
        self.keys, self.ends, self.block, self.text = part[1].view(np.uint64), part[2].view(np.int64), part[3], part[4]

    def rule(self, at: int) -> bytes:
        return self.text[self.ends[at - 1] if at else 0 : self.ends[at]].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Position of each candidate among the rules, or -1. Equal digests are told apart by the stored strings."""
        found = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not candidates:
            return found
        digest = np.array([xxhash.xxh64_intdigest(c) for c in candidates], dtype=np.uint64)
        at = np.searchsorted(self.keys, digest)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digest):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digest[i]:
                if self.rule(k) == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def judge(self, hosts: Sequence[str], paths: Sequence[str], default: str) -> tuple[list, list]:
        candidates: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            prefixes = [path[:n] for n in self.lengths if n <= len(path)]
            while host:
                candidates += [(host + p).encode() for p in prefixes]
                owner += [i] * len(prefixes)
                host = host.partition(".")[2]
        rules: list = [None] * len(hosts)
        verdicts = [default] * len(hosts)
        for j in np.flatnonzero((found := self.probe(candidates)) >= 0):
            i, text = owner[j], candidates[j].decode()
            if rules[i] is None or len(text) > len(rules[i]):
                rules[i], verdicts[i] = text, "block" if self.block[found[j]] else "allow"
        return rules, verdicts


@lru_cache(4)
def mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def share(spark: SparkSession, rules: Sequence[Rule]) -> str:
    """Writes the rules' file to the shared folder, from where Spark brings it to every executor once; its name."""
    jvm, path = spark.sparkContext._jvm, shared_path(spark, "rules")
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        data = array_file(rules)
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """Host, path, the longest fitting rule and the verdict of each url.

    A rule (verdict, host, path) fits a host and all its subdomains when the url's path starts with the rule's.
    The longest `host + path` wins, of equal rules block; without one, the verdict is `default` (the url is not in the digest
    array). Null urls and urls without :// have an empty host and path and get the default; repeated rows and null ids stay; a
    very long url is probed whole; an empty rule list gives every row the default, an empty table an empty result. Columns named
    host, path, rule or verdict are replaced.

    Rules are a list of the caller's. They go to a file that every executor gets once and all its tasks map.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    name = share(pages.sparkSession, rules)

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = mapped(name)
        for hosts, paths in batches:
            found, verdicts = own.judge(hosts.tolist(), paths.tolist(), default)
            yield pd.DataFrame({"rule": pd.Series(found, dtype=object), "verdict": pd.Series(verdicts, dtype=object)})

    parts = pages.select(F.struct("*").alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.select("page", "host", "path", judged("host", "path").alias("found")).select("page.*", "host", "path", "found.rule", "found.verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of all `pages`; null, odd and repeated urls as in `judge_urls`."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql(rules: Iterable[Rule]) -> str:
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in longest]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM part"""


ORACLE = {"op7_url_filter": _sql(RULES)}
