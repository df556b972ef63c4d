"""URL filters: block and allow rules found by hash in a sorted, memory-mapped digest array.

Each rule is a host and a path prefix.  It fits the host itself and all its subdomains where
the url's path starts with the prefix; the longest fitting rule decides.  The rules' full
strings are hashed with 64-bit xxhash and the sorted hashes are written to a file that tasks
map into memory.  For a batch of urls all candidates (every suffix of the host by labels, with
every prefix of the path of a length that some rule has) are hashed and probed together by
binary search; a hit counts only if the stored string equals the candidate.

The list travels to the tasks as one broadcast, so its size is checked: above ``MOST_BYTES``
the candidates are joined with the rules by digest as two tables instead.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict; repeated urls are judged each for itself; an empty list of rules is
allowed; of rules given twice with different verdicts, block counts.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import LOWER_AZ, UPPER_AZ, small_batches, table

#: Above this many bytes of rule strings the list is joined instead of broadcast.
MOST_BYTES = 64 << 20

_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans(UPPER_AZ, LOWER_AZ)

# The rules of the query, and the hosts that its own list blocks.
BASE_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SPAM_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.com", "free-clicks.example.org", "link-farm.example.com"]


def split_url(url: str | None) -> tuple[str, str]:
    """The host in lower case and the path of a url; both empty if there is no ``://``."""
    m = _URL.match(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class DigestArray:
    """Sorted 64-bit hashes of strings, mapped from a file, with the strings and a value of each."""

    def __init__(self, entries: dict[str, str]):
        keys = sorted(entries, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        self.strings = np.array(keys, object)
        self.values = np.array([entries[k] for k in keys], object)
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(keys):
            with tempfile.TemporaryFile() as f:  # has no name, so nothing stays behind
                f.write(digests.tobytes())
                f.flush()
                self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            digests = np.frombuffer(self._map, np.uint64)
        self.digests = digests

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.digests) or not keys:
            return np.full(len(keys), -1)
        want = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, want)
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == want):
            k = at[i]
            while k < len(self.digests) and self.digests[k] == want[i]:  # equal hashes stand together
                if self.strings[k] == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


def candidates(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """The (host suffix, path prefix) pairs a rule that fits could have, longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    pairs = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return sorted(pairs, key=lambda p: (-len(p[0]) - len(p[1]), -len(p[0])))


def _joined(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    """Entries by string; a NUL keeps host and path apart."""
    entries: dict[str, str] = {}
    for host, path, verdict in rules:
        key = f"{host.translate(_LOWER)}\0{path}"
        entries[key] = "block" if "block" in (verdict, entries.get(key)) else verdict
    return entries


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], own: list[tuple[str, str, str]] = (), default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``, which has a ``url``; ``rules`` come before ``own``."""
    spark = pages.sparkSession
    small_batches(spark, 4096)
    if sum(len(h) + len(p) for h, p, _ in [*rules, *own]) > MOST_BYTES:
        return _judge_by_join(pages, rules, own, default)
    shared = spark.sparkContext.broadcast([(_joined(r), sorted({len(p) for _, p, _ in r})) for r in (rules, own)])
    schema = pages.drop("host", "path", "rule", "verdict")
    names = [*schema.columns, "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(DigestArray(entries), lengths) for entries, lengths in shared.value]
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hit: list[list] = []
            for digests, lengths in lists:
                pairs = [candidates(h, p, lengths) for h, p in parts]
                found = digests.find([f"{h}\0{p}" for group in pairs for h, p in group])
                at, best = 0, []
                for group in pairs:
                    ks = [k for k in found[at : at + len(group)] if k >= 0]
                    best.append((digests.strings[ks[0]].replace("\0", ""), digests.values[ks[0]]) if ks else None)
                    at += len(group)
                hit.append(best)
            rule = [h[0] if h else None for h in hit[0]]
            verdict = [h[1] if h else o[1] if o else default for h, o in zip(*hit, strict=True)]
            new = [[h for h, _ in parts], [p for _, p in parts], rule, verdict]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in new)], names=names)

    return schema.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema), "host string", "path string", "rule string", "verdict string"]))


def _judge_by_join(pages: DataFrame, rules, own, default: str) -> DataFrame:
    """The same for lists too long to broadcast: candidates and rules meet by digest."""
    spark = pages.sparkSession
    base = pages.drop("host", "path", "rule", "verdict").withColumn("_row", F.monotonically_increasing_id())
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    base = base.withColumns({"host": F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER_AZ, LOWER_AZ), F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})
    both = [*((0, *r) for r in rules), *((1, *r) for r in own)]
    listed = spark.createDataFrame(both, "level int, h string, p string, v string").withColumn("h", F.translate("h", UPPER_AZ, LOWER_AZ)).groupBy("level", "h", "p").agg(F.max(F.col("v") == "block").alias("b"))
    lengths = sorted({len(p) for _, _, p, _ in both})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = base.filter("host <> ''").select("host", "path").distinct()
    pairs = distinct.select("host", "path", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter("n <= length(path)").withColumn("p", F.expr("substring(path, 1, n)"))
    key = F.xxhash64("h", "p").alias("_d")
    hits = pairs.withColumn("_d", key).join(listed.withColumn("_d", key), ["_d", "h", "p"]).groupBy("host", "path").agg(
        *(F.max(F.when(F.col("level") == k, F.struct(F.length("h") + F.length("p"), F.length("h"), F.concat("h", "p").alias("r"), "b"))).alias(f"m{k}") for k in (0, 1))
    )
    said = lambda k: F.when(F.col(f"m{k}.b"), "block").otherwise("allow")
    out = base.join(hits, ["host", "path"], "left").withColumns({"rule": F.col("m0.r"), "verdict": F.when(F.col("m0").isNotNull(), said(0)).when(F.col("m1").isNotNull(), said(1)).otherwise(default)})
    return out.select(*pages.drop("host", "path", "rule", "verdict").columns, "host", "path", "rule", "verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(h, "", "block") for h in SPAM_HOSTS]
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), BASE_RULES, own).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{UPPER_AZ}', '{LOWER_AZ}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u
), r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in BASE_RULES)}
), o(h) AS (VALUES {", ".join(f"('{h}')" for h in SPAM_HOSTS)}
), best AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM p JOIN r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.p) GROUP BY page_id
), spam AS (
  SELECT DISTINCT page_id FROM p JOIN o ON p.host = o.h OR p.host LIKE '%.' || o.h
)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.v, CASE WHEN spam.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) LEFT JOIN spam USING (page_id)
"""
