"""URL filters: path rules, then exact membership of hosts by a cascade of Bloom filters.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that level 1
takes for listed although they aren't, level 3 the listed keys that level 2 takes for
those, and so on until a level has no false positive left. Over the universe the
cascade was built from, the answer is exact, and a page is judged without a join.

Null keys are never listed. Repeated keys count once. An empty list or an empty
universe gives a cascade without levels, which lists nothing.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.columns import free_name
from orgpulse.session import cut_lineage

# Bits of one row of bitmap_construct_agg.
CHUNK_BITS = 8 * 4096


@dataclass
class Cascade:
    """Filters as (bytes, bits, hashes); each is a literal of the query, so their size is checked when built."""

    levels: list[tuple[bytes, int, int]] = field(default_factory=list)

    def lists(self, key: Column) -> Column:
        """True for listed keys of the universe, false for its other keys."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            answer = F.when(_in_filter(key, number, *self.levels[number - 1]), answer).otherwise(F.lit(number % 2 == 0))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    first, step = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.shiftrightunsigned(first, 2) + i * F.shiftrightunsigned(step, 8), F.lit(bits).cast("long")) for i in range(hashes)]


def _in_filter(key: Column, level: int, data: bytes, bits: int, hashes: int) -> Column:
    found = F.lit(True)
    for at in _positions(key, level, bits, hashes):
        byte = F.conv(F.hex(F.substring(F.lit(data), (F.shiftright(at, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
        found = found & (F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))) % 2 == 1)
    return found


def _filter(keys: DataFrame, count: int, rate: float, level: int, max_bytes: int) -> tuple[bytes, int, int]:
    bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    if bits > 8 * max_bytes:
        raise ValueError(f"level {level} needs {bits // 8} bytes, more than max_bytes={max_bytes}: split the keys by hash and build one cascade for each part")
    hashes = max(1, round(bits / max(count, 1) * math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at")).select((F.col("at") + 1).alias("at"))
    chunks = at.groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    data = bytearray(math.ceil(bits / CHUNK_BITS) * CHUNK_BITS // 8)
    for row in chunks.toLocalIterator():  # as many rows as the filter has chunks of 4 KB
        data[(row.chunk - 1) * CHUNK_BITS // 8 : row.chunk * CHUNK_BITS // 8] = row.bitmap
    return bytes(data[: math.ceil(bits / 8)]), bits, hashes


def build_cascade(universe: DataFrame, max_bytes: int = 64 << 20) -> Cascade:
    """``universe``: columns key and listed, every key of the corpus. Keys stay on the executors; the driver gets filters only."""
    keys = cut_lineage(universe.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")).where("listed IS NOT NULL"))
    count = keys.agg(F.count(F.when(F.col("listed"), 1)).alias("y"), F.count(F.when(~F.col("listed"), 1)).alias("n")).first()
    cascade, own, other, size, rest = Cascade(), keys.where("listed"), keys.where("NOT listed"), count.y, count.n
    while size:
        level = len(cascade.levels) + 1
        # The first level balances its own size against what it leaves to the others.
        rate = 0.5 if level > 1 else min(0.5, max(1e-9, math.sqrt(0.5) * size / max(rest, 1)))
        cascade.levels.append(_filter(own, size, rate, level, max_bytes))
        wrong = cut_lineage(other.where(_in_filter(F.col("key"), level, *cascade.levels[-1])))
        own, other, size = wrong, own, wrong.count()
    return cascade


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z in lower case, and the path; both empty for null or without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Longest rule (host then path, e.g. ``example.org/es/``) that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(F.lit("." + rule_host))) & path.startswith(F.lit("/" + rule_path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: dict[str, str], listed_host: Column, url_col: str = "url", max_bytes: int = 64 << 20) -> DataFrame:
    """Pages with host, path, rule and verdict: the longest fitting rule's, else block for listed hosts and allow for others.

    ``listed_host`` is a condition on the column ``key``. Columns of these four names are replaced.
    """
    host, path = host_and_path(F.col(url_col))
    hosts = pages.select(host.alias("key"))
    cascade = build_cascade(hosts.groupBy("key").agg(F.lit(True)).select("key", listed_host.alias("listed")), max_bytes)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(cascade.lists(F.col("host")), "block").otherwise("allow")
    url = free_name(pages, "_url")
    parsed = pages.withColumn(url, F.col(url_col)).withColumns(dict(zip(("host", "path"), host_and_path(F.col(url)), strict=True))).drop(url)
    return parsed.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_list)})
