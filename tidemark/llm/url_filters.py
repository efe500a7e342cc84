"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

A rule names a host (and all its subdomains) and a path prefix. The keys under which a URL could be listed are
its host suffixes joined with its path prefixes, for the numbers of labels and the prefix lengths that rules have:
the key universe. Level 1 of a cascade holds the listed keys, level 2 those keys of the corpus's whole universe
that level 1 takes for listed wrongly, level 3 the listed keys that level 2 takes for those, and so on until a
level errs on nothing. Membership is then exact for every key of the universe, from the bits alone: a key is
listed if the first level that denies it is an even one. Blocked and allowed keys have a cascade each.

Size: about log2(universe / listed) + 3 bits for each listed key, so it follows the list and hardly the corpus.
The bits are literals in the plan; pages are judged in one narrow pass without a join or a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): from the first ``://`` up to ``/ ? #``, A-Z in lower case, then up to ``? #``; else both empty."""
    host = F.translate(F.regexp_extract(url, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys a URL has for each (labels of the host, characters of the path) in ``shapes``; shorter URLs have fewer."""
    labels = F.size(F.split(host, r"\."))
    keys = [F.when((host != "") & (labels >= n) & (F.char_length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``hashes`` positions for each key."""

    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...] = ()

    def positions(self, key: Column) -> list[Column]:
        one, two = (F.pmod(F.xxhash64(key, F.lit(self.seed + s)), F.lit(self.bits)) for s in (0, 1))
        return [F.pmod(one + two * F.lit(i).cast("long"), F.lit(self.bits)) for i in range(self.hashes)]

    def of(self, keys: DataFrame) -> Level:
        """The filter that holds the column ``key``. What reaches the driver is its words: bits / 64 rows at most."""
        at = F.explode(F.array(*self.positions(F.col("key"))))
        rows = keys.select(at.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x")).collect()
        words = [0] * (self.bits // 64)
        for r in rows:
            words[r["w"]] = r["x"]
        return Level(self.seed, self.bits, self.hashes, tuple(words))

    def has(self, key: Column) -> Column:
        words = F.expr("array(" + ",".join(f"{w}L" if w > -(1 << 63) else "(-9223372036854775807L - 1L)" for w in self.words) + ")")
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.get(words, (p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
        return out


def _level(n: int, rate: float, seed: int) -> Level:
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64) * 64)
    return Level(seed, bits, max(1, round(math.log2(1 / rate))))


def build_cascade(listed: DataFrame, n_listed: int, universe: DataFrame, n_universe: int, seed: int = 0) -> list[Level]:
    """``listed`` and ``universe`` have a column ``key``; ``universe`` may repeat keys and is read once."""
    if not n_listed:
        return []
    levels = [_level(n_listed, min(0.5, max(2**-40, math.sqrt(0.5) * n_listed / max(1, n_universe))), seed).of(listed)]
    holds, other = listed, written(universe.filter(levels[0].has(F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade-level")
    n = other.count()
    while n:
        levels.append(_level(n, 0.5, seed + 2 * len(levels)).of(other))
        wrong = written(holds.filter(levels[-1].has(F.col("key"))), "cascade-level")
        holds, other, n = other, wrong, wrong.count()
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """True if the first level that denies the key is an even one; if none denies it, as if the next one did."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges every URL: the longest rule that fits decides, ``default`` (with a null rule) where none does.

    Of two fitting rules of one length that with the longer host decides. A null URL, or one without ``://``, has
    an empty host and path, which no rule fits; repeated rows are judged each; an empty table gives an empty
    result; other columns are ignored. A rule listed under two verdicts is an error.
    """
    spark = pages.sparkSession
    keys = {h + p: v for v, h, p in rules}
    if len(keys) < len({(v, h, p) for v, h, p in rules}):
        raise ValueError("a rule has two verdicts")
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # By length of key and then of host, the longest first: what fits first decides.
    found = F.array_sort(candidate_keys(F.col("host"), F.col("path"), shapes), lambda a, b: F.coalesce(F.nullif(F.char_length(b) - F.char_length(a), F.lit(0)), F.instr(b, "/") - F.instr(a, "/")))
    with_keys = parts.withColumn("keys", found)
    universe = with_keys.select(F.explode("keys").alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascades = {}
    for i, verdict in enumerate(sorted(set(keys.values()))):
        mine = [k for k, v in keys.items() if v == verdict]
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, mine))).alias("key"))
        cascades[verdict] = build_cascade(listed, len(mine), universe, n_universe, seed=1000 * i)
    which = lambda k: F.coalesce(*(F.when(is_listed(levels, k), F.lit(v)) for v, levels in cascades.items()))
    hit = F.filter(F.transform("keys", lambda k: F.struct(k.alias("rule"), which(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    return with_keys.withColumn("hit", F.get(hit, F.lit(0))).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM rest),
hit AS (SELECT p.row, max_by(s.host || s.path, length(s.host || s.path)) AS rule, max_by(s.verdict, length(s.host || s.path)) AS verdict
  FROM parts p JOIN rules s ON (p.host = s.host OR ends_with(p.host, '.' || s.host)) AND starts_with(p.path, s.path) GROUP BY p.row)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict FROM parts p LEFT JOIN hit h ON p.row = h.row
"""
