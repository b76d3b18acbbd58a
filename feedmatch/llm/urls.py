"""URL filter rules by a Bloom filter cascade, native expressions only.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's. The keys of a URL are its host suffixes,
with as many labels as some rule has, joined to path prefixes as long as some
rule's. Level 0 of a cascade is a Bloom filter of the listed keys; level 1
encodes those keys of the corpus that level 0 takes wrongly for listed, level 2
the listed keys that level 1 takes wrongly, and so on until nothing is left.
Walking the levels gives exact membership for every key of the corpus without a
join. Level 0's error rate follows the number of corpus keys, so that about as
many false positives as listed keys remain: the filters' size grows with the
rules and the logarithm of the corpus only. Rules whose filter would exceed
``MAX_BITS`` are dealt by a hash of the key into shards with a cascade each.

Block and allow rules have a cascade each. The longest listed key wins (of equal
lengths the larger one); a URL without a listed key gets ``default``.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule unless a rule is empty; host and path are read literally (user,
port and escapes included); repeated rules count once, a rule both blocked and
allowed is an error; pages keep their rows, repeats included; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmatch.llm.scratch import stored

#: Bits of one filter.
MAX_BITS = 1 << 24
MAX_HASHES = 8


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, their bits, seeds of its hashes."""

    words: tuple[int, ...]
    bits: int
    seeds: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        words = F.expr(f"cast(split('{','.join(map(str, self.words))}', ',') as array<bigint>)")
        test = F.lit(True)
        for seed in self.seeds:
            at = _position(key, seed, self.bits)
            test = test & (F.call_function("getbit", F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return test


def _position(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits).cast("long"))


def _size(n: int, rate: float) -> tuple[int, int]:
    """Hashes and bits of a filter of ``n`` keys with about this false positive rate."""
    hashes = min(MAX_HASHES, max(1, round(math.log2(1 / rate))))
    return hashes, max(64, math.ceil(-hashes * n / math.log(1 - rate ** (1 / hashes)) / 64) * 64)


def build_level(keys: DataFrame, n: int, rate: float, depth: int) -> Level:
    """A filter of ``n`` distinct ``key`` values with about this false positive rate."""
    hashes, bits = _size(n, rate)
    seeds = tuple(100 * depth + k for k in range(hashes))
    at = keys.select(F.explode(F.array(*(_position(F.col("key"), s, bits) for s in seeds))).alias("at"))
    rows = (at.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())  # bits / 64 rows at most
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return Level(tuple(words), bits, seeds)


def build_cascade(listed: DataFrame, universe: DataFrame, universe_rows: int, name: str) -> list[Level]:
    """Levels that tell ``listed`` keys from all others of ``universe`` (both: column ``key``)."""
    listed = listed.distinct()
    n = listed.count()
    if not n:
        return []
    levels = [build_level(listed, n, _rate(n, universe_rows), 0)]
    passed = universe.where(levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti")
    ours, others = stored(passed, f"{name}-0"), listed  # in turn: the set to encode next, and the one it is told from
    while n := ours.count():
        levels.append(build_level(ours, n, 0.5, len(levels)))
        ours, others = stored(others.where(levels[-1].holds(F.col("key"))), f"{name}-{len(levels)}"), ours
    return levels


def _rate(n: int, universe_rows: int) -> float:
    return min(0.5, n * math.sqrt(2) / max(1, universe_rows))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def build_cascades(listed: DataFrame, n: int, universe: DataFrame, universe_rows: int, name: str, max_bits: int = MAX_BITS) -> list[list[Level]]:
    """A cascade for each shard of the ``n`` listed keys; one shard unless its first filter would exceed ``max_bits``."""
    shards = -(-_size(n, _rate(n, universe_rows))[1] // max_bits)
    if shards == 1:
        return [build_cascade(listed, universe, universe_rows, name)]
    of = lambda df, k: df.where(_shard(F.col("key"), shards) == k)
    return [build_cascade(of(listed, k), of(universe, k), universe_rows // shards, f"{name}-{k}") for k in range(shards)]


def listed_in_shards(cascades: list[list[Level]], key: Column) -> Column:
    """Whether a key of the corpus is listed, by the cascade of its shard."""
    if len(cascades) == 1:
        return listed_in(cascades[0], key)
    test = F.lit(False)
    for k, levels in enumerate(cascades):
        test = F.when(_shard(key, len(cascades)) == k, listed_in(levels, key)).otherwise(test)
    return test


def listed_in(levels: list[Level], key: Column) -> Column:
    """Whether a key of the corpus is listed; false for null."""
    test = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        test = F.when(~levels[depth].holds(key), F.lit(depth % 2 == 1)).otherwise(test)
    return key.isNotNull() & test


def _keys(rules: list[tuple[str, str, str]]) -> Column:
    """The keys of a URL that rules of this shape can fit, as an array, from columns host and path."""
    labels = sorted({host.count(".") + 1 for host, _, _ in rules})
    lengths = sorted({len(path) for _, path, _ in rules})
    return F.expr(f"flatten(transform(array({', '.join(map(str, labels))}), n -> transform(filter(array({', '.join(map(str, lengths))}), "
                  "k -> k <= length(path)), k -> concat(substring_index(host, '.', -n), substring(path, 1, k)))))")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, url, host, path, rule, verdict; rules are (host, path, "block" or "allow")."""
    spark: SparkSession = pages.sparkSession
    rules = sorted(set(rules))
    if len({(h, p) for h, p, _ in rules}) < len(rules):
        raise ValueError("a rule is both blocked and allowed")
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = _keys(rules)
    universe = urls.select(F.explode(keys).alias("key"))
    rows = universe.agg(F.approx_count_distinct("key")).first()[0]

    def cascades(verdict: str) -> list[list[Level]]:
        own = sorted({h + p for h, p, v in rules if v == verdict})
        if not own:
            return []
        listed = stored(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(own)), "array<string>")).alias("key")), f"{verdict}-rules")
        return build_cascades(listed, len(own), universe, rows, verdict, max_bits)

    found = {verdict: cascades(verdict) for verdict in ("block", "allow")}
    named = lambda k, verdict: F.struct(F.length(k).alias("length"), k.alias("key"), F.lit(verdict).alias("verdict"))
    fit = lambda k: F.coalesce(*(F.when(listed_in_shards(own, k), named(k, v)) for v, own in found.items() if own))
    return (urls.withColumn("best", F.array_max(F.transform(keys, fit)))
            .select("page_id", "url", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
