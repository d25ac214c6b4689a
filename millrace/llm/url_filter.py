"""URL rules decided by Bloom filter cascades, exact over the corpus's own keys and without joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import scalar_array
from .common import col, lower_ascii, materialise

BITS_PER_KEY, HASHES = 10, 7
# A filter travels inside the plan. The bound is on the rule list, which is a parameter, not on the corpus.
MAX_FILTER_KEYS = 20_000_000
RESULTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix at a dot, path prefix of a rule's length) that a rule for this url could have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    heads = F.filter(heads, lambda h: h.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h))))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    first, second = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    # 31-bit halves keep the sums inside a long.
    a, b = first.bitwiseAND(F.lit(0x7FFFFFFF)), second.bitwiseAND(F.lit(0x7FFFFFFF))
    return [(a + b * i) % bits for i in range(HASHES)]


class Cascade:
    """Exact membership of listed keys, for keys of a universe known when it is built.

    Level 1 encodes the listed keys.  Level 2 encodes the unlisted keys of the universe that level 1 lets
    through, level 3 the listed keys that level 2 lets through, and so on until a level lets none through.
    """

    def __init__(self, universe: DataFrame, listed: list[str] | DataFrame):
        """``universe`` and a ``listed`` table have one column ``key``."""
        self.levels: list[tuple[int, list[int]]] = []
        spark = universe.sparkSession
        if not isinstance(listed, DataFrame):
            listed = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        inside = materialise(listed.distinct().join(universe, "key", "left_semi"))
        outside = universe.join(listed, "key", "left_anti")
        encoded, other = inside, outside
        while True:
            count = encoded.count()
            if not count:
                break
            level = len(self.levels)
            self.levels.append(self._filter(encoded, count, level))
            encoded, other = materialise(other.where(self._test(F.col("key"), level))), encoded
        self.empty = not self.levels

    def _filter(self, keys: DataFrame, count: int, level: int) -> tuple[int, list[int]]:
        if count > MAX_FILTER_KEYS:
            raise ValueError(f"a filter of {count} keys is larger than the bound of {MAX_FILTER_KEYS}")
        words = math.ceil(max(1, count * BITS_PER_KEY) / 64)
        positions = F.explode(F.array(*_positions(F.col("key"), level, words * 64)))
        rows = keys.select(positions.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).collect()
        table = [0] * words
        for row in rows:
            table[row["w"]] = row["b"]
        return words * 64, table

    def _test(self, key: Column, level: int) -> Column:
        bits, table = self.levels[level]
        words, out = scalar_array(table, "bigint"), F.lit(True)
        for p in _positions(key, level, bits):
            out = out & (F.getbit(F.element_at(words, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        """Whether ``key``, one of the universe, is listed."""
        # A key that a level does not hold belongs to the other side; one that all hold to the last level's side.
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._test(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow",
               carry: list[str] | None = None) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest fitting rule
    decides, and a url that none fits gets ``default``.  Of two equal rules with opposite actions block wins.

    A null url, or one without ``://``, has empty host and path, no rule and the default verdict.  Repeated
    rows are judged alike.  Input columns named like a result column are replaced.  An empty table stays empty.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in RESULTS]
    url = F.coalesce(col(url_col), F.lit(""))
    parts = pages.select(*[col(c) for c in carry], url_host(url).alias("host"), url_path(url).alias("path"))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = sorted({len(r.path) for r in rules})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = materialise(pages.select(url_host(url).alias("host"), url_path(url).alias("path"))
                           .select(F.explode(F.array_distinct(keys)).alias("key")).distinct())
    blocked = Cascade(universe, [r.key for r in rules if r.action == "block"])
    allowed = Cascade(universe, [r.key for r in rules if r.action == "allow"])
    fits = F.filter(F.col("_keys"), lambda k: blocked.contains(k) | allowed.contains(k))
    longest = F.reduce(fits, F.lit(None).cast("string"), lambda best, k: F.when(
        best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))
    out = parts.withColumn("_keys", keys).withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), default).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    return out.withColumn("verdict", verdict).drop("_keys")


RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]

SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                             ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, h || pre AS rule, action,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS n
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.n = 1
"""
