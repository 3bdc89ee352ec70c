"""URL rules by a cascade of Bloom filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.shared import checkpointed, column, held, released

#: (rule, verdict); a rule is a host and a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: False hits of the first level and of the others, probes of a key, and bits that a level has at most (32 MB).
FIRST_RATE, RATE, PROBES, MOST_BITS = 0.001, 0.1, 4, 1 << 28


@dataclass(frozen=True)
class Level:
    """A Bloom filter as a list of 64-bit words."""

    seed: int
    bits: int
    filled: tuple[int, ...]

    def probes(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * PROBES + i), key), F.lit(self.bits).cast("long")) for i in range(PROBES)]

    def holds(self, key: Column) -> Column:
        listed = F.array(*(F.lit(w).cast("long") for w in self.filled)) if len(self.filled) < 64 else F.from_json(F.lit(str(list(self.filled))), "array<long>")
        word = lambda at: F.element_at(listed, (F.shiftright(at, 6) + 1).cast("int"))
        bit = lambda at: F.call_function("shiftrightunsigned", word(at), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.forall(F.array(*self.probes(key)), bit)  # so the words are in the plan once


def build_level(keys: DataFrame, n: int, seed: int, rate: float) -> Level:
    """Of a DataFrame with the column key, n rows; sends its words to the driver, MOST_BITS at most."""
    bits = min(MOST_BITS, max(64, ceil(-n * log(rate) / log(2) ** 2 / 64) * 64))
    blank = Level(seed, bits, ())
    at = keys.select(F.explode(F.array(*blank.probes(F.col("key")))).alias("at"))
    one = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    found = dict(at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect())
    return Level(seed, bits, tuple(found.get(i, 0) for i in range(bits // 64)))


def build_cascade(listed: DataFrame, universe: DataFrame, deepest: int = 64) -> list[Level]:
    """Levels that tell exactly which keys of listed and universe (both with the column key) are listed.

    Level 1 encodes the listed keys; level 2 the other keys of the universe that level 1 holds by chance; level 3 the listed
    keys that level 2 holds by chance; and so on until no key is mistaken. Only the mistaken keys are kept from level to
    level, in the shared folder; they never come to the driver."""
    levels: list[Level] = []
    inside, outside = listed.select("key").distinct(), universe.select("key").distinct()
    n = inside.count()
    outside = outside.join(inside, "key", "left_anti") if n else outside
    while n and len(levels) < deepest:
        level = build_level(inside, n, len(levels), RATE if levels else FIRST_RATE)
        levels.append(level)
        mistaken = checkpointed(outside.filter(level.holds(F.col("key"))))
        inside, outside, n = mistaken, inside, mistaken.count()
    if n:
        raise ValueError(f"{n} keys are still mistaken at level {deepest}")
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """Exact for the keys that the cascade was built over: the first level without the key tells by its number."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _fit(verdict: str, key: Column) -> Column:
    return F.struct(F.length(key).alias("n"), key.alias("rule"), F.lit(verdict).alias("verdict"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; empty for null and without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict (in place of input columns of these names) to every row.

    A url's keys are each end of its host at a dot, with as many labels as a rule's host has at most, joined to each
    beginning of its path that is as long as some rule's path. One cascade for each verdict says without a join which of the keys are rules; the longest key wins. Urls without a
    rule aren't on the block list, so the cascade's answer for them is allow. Null and malformed urls have empty hosts, which
    no rule fits. An empty table gives an empty result.
    """
    spark: SparkSession = urls.sparkSession
    rows = held(urls, ("host", "path", "rule", "verdict"), url=column(url_col))
    host, path = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    lengths = sorted({len(rule) - rule.index("/") for rule, _ in rules})
    most = max((rule[: rule.index("/")].count(".") + 1 for rule, _ in rules), default=1)
    parts = F.split("host", r"\.")
    # no rule's host has more labels than `most`, so longer ends of a host can't be rules
    ends = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - most + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.lit(most)), "."))
    starts = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)))
    keys = F.flatten(F.transform(ends, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    rows = rows.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys))
    universe = rows.select(F.explode("keys").alias("key")).distinct()
    listed = {}
    for verdict in sorted({v for _, v in rules}):
        own = spark.range(1).select(F.explode(F.array(*(F.lit(r) for r, v in rules if v == verdict))).alias("key"))
        levels = build_cascade(own, universe)
        listed[verdict] = F.filter("keys", partial(is_listed, levels))
    fits = F.flatten(F.array(*(F.transform(found, partial(_fit, verdict)) for verdict, found in listed.items())))
    rows = rows.withColumn("best", F.array_max(fits))
    return released(rows, urls, (), host=F.col("host"), path=F.col("path"), rule=F.col("best.rule"), verdict=F.coalesce("best.verdict", F.lit("allow")))
