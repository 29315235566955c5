"""URL filters: host and path rules, and a cascade of Bloom filters that is exact over the corpus's keys."""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_lower, packed
from tidegauge.session import cut

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that the production list blocks, with all their subdomains: each bad name under each parent domain of the corpus.
BAD_NAMES, PARENTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{parent}" for name in BAD_NAMES for parent in PARENTS)
#: Listed keys of a corpus up to which the cascade is held as constants (some MB of bits in all); more of them meet the hosts in a join.
MOST_LISTED = 1_000_000
_WORD = 32


def with_host_path(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both empty if url is null or has no ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("rest_", F.coalesce(rest, F.lit("")))
    return out.withColumns({"host": ascii_lower(F.regexp_extract("rest_", "^[^/?#]*", 0)), "path": F.regexp_extract("rest_", "^[^/?#]*([^?#]*)", 1)}).drop("rest_")


def domains(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def rule_of(rules) -> Column:
    """The longest rule that fits host and path, as a struct of rule and verdict; null if none does. Of equally long rules the first wins."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


class Level:
    """One Bloom filter: its bits in words of 32, gathered by Spark from the keys it encodes."""

    def __init__(self, keys: DataFrame, n: int, level: int, rate: float):
        self.level, self.n = level, n
        self.bits = max(_WORD, ceil(-n * log(rate) / log(2) ** 2))
        self.hashes = max(1, round(-log2(rate)))
        places = keys.select(F.explode(F.array(*_places(F.col("key"), level, self.hashes, self.bits))).alias("p"))
        one = F.expr("shiftleft(1L, cast(p % 32 as int))")
        rows = places.groupBy(F.expr("p div 32").alias("w")).agg(F.bit_or(one).alias("b")).collect()  # bits / 32 rows at most
        words = [0] * (self.bits // _WORD + 1)
        for r in rows:
            words[r["w"]] = r["b"]
        self.words = packed(words, "bigint")

    def has(self, key: Column) -> Column:
        found = F.lit(True)
        for p in _places(key, self.level, self.hashes, self.bits):
            word = F.get(self.words, F.floor(p / _WORD).cast("int"))
            found = found & (word.bitwiseAND(F.element_at(packed([1 << b for b in range(_WORD)], "bigint"), (p % _WORD + 1).cast("int"))) != 0)
        return found


class Cascade:
    """Alternate levels encode the listed keys and the other keys of the universe that the level before took for listed.

    Level 0 holds the listed keys of the universe; level 1 its false positives; level 2 the listed keys that level 1 takes
    for those; and so on until none are left. A key of the universe is listed or not by the first level that lacks it; one
    that no level lacks belongs to what the last one encodes. The first level's rate makes its false positives about as
    many as the listed keys, so all levels together are bounded by the list's size.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame):
        keys = universe.select("key").distinct()
        marked = cut(keys.join(listed.select("key").distinct().withColumn("in_", F.lit(True)), "key", "left"))
        inside, outside = marked.filter("in_").select("key"), marked.filter("in_ is null").select("key")
        n_in, n_out = inside.count(), outside.count()
        self.levels: list[Level] = []
        sides, n, rate = [inside, outside], n_in, min(0.5, max(1e-9, n_in / max(1, n_out) * 0.7))
        while n:
            level = Level(sides[0], n, len(self.levels), rate)
            self.levels.append(level)
            taken = sides[1].filter(level.has(F.col("key")))
            sides, n, rate = [taken, sides[0]], taken.count(), 0.5

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed, from the filters alone."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.has(key), out).otherwise(F.lit(level.level % 2 == 1))
        return out


def _blocked_by_join(out: DataFrame, listed: DataFrame) -> DataFrame:
    """out with blocked_, by a join on the distinct hosts: for lists that no constant can hold."""
    hosts = out.select("host").distinct().select("host", F.explode_outer(domains(F.col("host"))).alias("key"))
    hit = hosts.join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct().withColumn("blocked_", F.lit(True))
    return out.join(hit, "host", "left").withColumn("blocked_", F.coalesce("blocked_", F.lit(False)))


def judge(pages: DataFrame, rules=RULES, listed=LISTED, most_listed: int = MOST_LISTED) -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest fitting rule decides; without one the url is blocked if its host or a parent domain is listed, else allowed.
    listed: hosts, or a DataFrame with a column key. Membership comes from a Bloom filter cascade over all domains that the
    corpus has, held as constants of bounded size: no join, no shuffle of pages. Null urls and urls without :// have empty
    host and path, fit no rule and are allowed. A list of more than most_listed keys is joined instead. Repeated rows are
    judged alike, an empty table gives an empty one. Columns of pages with our names give way.
    """
    out = with_host_path(pages)
    universe = out.select("host").distinct().select(F.explode_outer(domains(F.col("host"))).alias("key")).filter(F.col("key").isNotNull())
    if not isinstance(listed, DataFrame):
        listed = pages.sparkSession.createDataFrame([(h.lower(),) for h in listed], "key string")
    out = out.withColumn("rule_", rule_of(rules))
    if listed.limit(most_listed + 1).count() > most_listed:
        out = _blocked_by_join(out, listed)
    else:
        out = out.withColumn("blocked_", F.exists(domains(F.col("host")), Cascade(universe, listed).holds))
    verdict = F.coalesce(F.col("rule_")["verdict"], F.when(F.col("blocked_"), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("rule_")["rule"], "verdict": verdict}).drop("rule_", "blocked_")


def op2(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_SAYS = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)
_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
OP2_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {_SAYS} WHEN {_LISTED} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
