"""URL verdicts: longest-match host and path rules, then a blocklist in a Bloom filter cascade.

Level 0 of the cascade encodes the listed hosts; each further level encodes the keys
that the level before wrongly passes, taken from all hosts of the corpus.  The number
of levels a host passes decides, so membership is exact for every host of the corpus
and no join is needed.  All of it runs on DataFrame functions.

Null urls, and urls without ``://``, have empty host and path; the empty host is
never listed.  Repeated rows are judged alike; an empty table gives an empty result;
only the key and url columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: (verdict, host and path), the production rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        """Both halves of double hashing come from the key and the level's own seed."""
        a, b = F.xxhash64(F.lit(self.seed), key), F.xxhash64(F.lit(self.seed + 1), key)
        found = None
        for k in range(self.hashes):
            at = F.pmod(a + F.lit(k) * (b.bitwiseOR(F.lit(1)) % F.lit(1 << 40)), F.lit(self.size))
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
            bit = F.getbit(byte, (at % 8).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over ``keys``; bits are set and merged by Spark, one value for each byte reaches the driver."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, 8 * math.ceil(n * hashes / math.log(2) / 8))
    a, b = F.xxhash64(F.lit(seed), "key"), F.xxhash64(F.lit(seed + 1), "key")
    at = F.explode(F.array(*(F.pmod(a + F.lit(k) * (b.bitwiseOR(F.lit(1)) % F.lit(1 << 40)), F.lit(size)) for k in range(hashes))))
    one = keys.select(at.alias("at")).select(F.floor(F.col("at") / 8).alias("byte"), F.expr("shiftleft(1, cast(at % 8 as int))").alias("bit"))
    bits = bytearray(size // 8)
    for row in one.groupBy("byte").agg(F.bit_or("bit").alias("v")).toLocalIterator():
        bits[row["byte"]] = row["v"]
    return Level(bytes(bits), size, hashes, seed)


class Cascade:
    """Exact membership of the keys of one universe, by the parity of the levels passed."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)

    @classmethod
    def build(cls, universe: DataFrame, first_rate: float = 1 / 32, rate: float = 1 / 4, most: int = 64) -> Cascade:
        """``universe``: (key, listed), one row for each key.

        ``inside`` is what a level must pass, ``outside`` what it should stop; the keys
        of ``outside`` that it passes are what the next level must pass.
        """
        levels: list[Level] = []
        inside, outside = universe.where("listed"), universe.where("NOT listed")
        n = inside.count()
        while n:
            if len(levels) == most:
                raise ValueError(f"{most} levels do not separate the keys; is a key both listed and not?")
            levels.append(level := _level(inside, n, rate if levels else first_rate, 1000 + 2 * len(levels)))
            inside, outside = outside.where(level.passes(F.col("key"))), inside
            n = inside.count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Listed: the first level that stops the key is an odd one (counted from 0), or none does and their number is odd."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[k].passes(key), answer).otherwise(F.lit(k % 2 == 1))
        return answer


def plain_http_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """(key, listed) for every host of the corpus; listed: over a third of its urls are plain http."""
    rows = pages.select(host_of(F.col(url)).alias("key"), F.col(url).startswith("http://").alias("plain"))
    return rows.where("key <> ''").groupBy("key").agg((3 * F.sum(F.col("plain").cast("bigint")) > F.count(F.lit(1))).alias("listed"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, listed: Callable[[DataFrame, str], DataFrame] = plain_http_hosts, max_bytes: int = 8 << 20) -> DataFrame:
    """Per row: key, host, path, the rule that fits, and the verdict: the rule's, else block if the host is listed.

    The cascade travels inside the plan only while it is smaller than ``max_bytes``,
    some tens of millions of hosts; a larger list is looked up by a join.
    """
    universe = durable(listed(pages, url))
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # Bits of level 0 and, above it, of the hosts it may pass: no cascade is built that could not be used.
    n = universe.where("listed").count()
    if 2 * n <= max_bytes and (cascade := Cascade.build(universe)).bytes <= max_bytes:
        blocked = F.when(F.col("host") == "", F.lit(False)).otherwise(cascade.holds(F.col("host")))
    else:
        rows = rows.join(universe.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("_listed")), "host", "left")
        blocked = F.col("_listed").isNotNull()
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS (SELECT host FROM p WHERE host <> '' GROUP BY host HAVING 3 * sum((url LIKE 'http://%')::INT) > count(*)),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
