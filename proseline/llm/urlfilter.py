"""URL filters by a Bloom filter cascade, in DataFrame and SQL functions only.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts with the rule's. So a url has few keys that
could be listed: suffixes of its host at the dots, each with beginnings of its path (of the lengths that rules have), once for
each kind of rule. The longest listed key is the rule that holds.

Which keys are listed is told by a cascade. Level 0 is a Bloom filter of the listed keys. All keys of all urls are tried on it (the
corpus's complete key universe); those that pass without being listed are its false positives and make level 1, the listed keys that
pass level 1 make level 2, and so on until a level has no false positive left. A key falls through the levels until one refuses it: it
is listed if that level is an odd one. For every key of the corpus the answer is exact, without a join: urls stay where they are
and meet the levels as literals of the plan.

Scale. Two passes over the urls; only keys that pass level 0 are shuffled, each once a task (so a listed key that a third of the urls
have is counted where it is). Level 0 has as many bits a key as leave about as many false positives as keys are listed. A cascade has at most
``MAX_BITS`` bits at level 0; longer lists are dealt by hash over several cascades, which are tried one after the other, with the
urls' found rules saved between them. Hosts of any depth cost no more than the deepest rule's.

Defined results: a null url, or one without ``://``, has an empty host and an empty path. Where no rule fits, rule is null and the
verdict the default's (allow). The longest rule is that with the most characters, of those the one with the longer host; a key that is
listed both ways blocks. Rules with a null or empty host or an unknown action are an error; a null path is an empty one, which fits every path. Rules are
listed once however often they repeat. Repeated urls are judged each. Extra columns stay, but for those with a result's name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MAX_BITS, LATER, MOST_HASHES = 1 << 24, (8, 6), 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def bits_for(listed: int, universe: int) -> tuple[int, int]:
    """Bits and hashes a key with which about as many unlisted keys pass as keys are listed."""
    share, bits = min(0.5, listed / max(universe, 1)), 4
    while True:
        hashes = max(1, min(MOST_HASHES, round(bits * math.log(2))))
        if (1 - math.exp(-hashes / bits)) ** hashes <= share or bits >= 64:
            return bits, hashes
        bits += 1


class Level:
    """A Bloom filter: its bits as an array literal, their number, and the number of hashes."""

    def __init__(self, keys: DataFrame, n: int, bits: int, hashes: int, number: int):
        self.size, self.hashes, self.number = 64 * max(1, math.ceil(n * bits / 64)), hashes, number
        spots = keys.select(F.explode(F.array(*self.spots(F.col("key")))).alias("spot"))
        word = F.shiftright("spot", 6).alias("word")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63)).cast("int"))
        found = {r["word"]: r["bits"] for r in spots.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect()}  # at most size / 64
        # an array literal, put together by the optimiser
        self.bits = F.split(F.lit(",".join(str(found.get(w, 0)) for w in range(self.size // 64))), ",").cast("array<bigint>")

    def spots(self, key: Column) -> list[Column]:
        a, b = F.xxhash64(F.lit(2 * self.number), key), F.xxhash64(F.lit(2 * self.number + 1), key)
        mask = F.lit((1 << 40) - 1)
        return [F.pmod(a.bitwiseAND(mask) + b.bitwiseAND(mask) * i, F.lit(self.size)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        out = None
        for s in self.spots(key):
            one = F.getbit(F.get(self.bits, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = one if out is None else out & one
        return out


class Cascade:
    """Exact membership in ``listed`` (distinct keys) for all keys of ``universe`` (a column of keys, repeats allowed)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n: int, n_universe: int, scratch: Scratch):
        self.levels = [Level(listed, n, *bits_for(n, n_universe), 0)]
        passed = universe.where(self.levels[0].has(F.col("key"))).select("key", F.lit(0).alias("is_listed"))
        both = passed.unionByName(listed.select("key", F.lit(1).alias("is_listed"))).groupBy("key").agg(F.max("is_listed").alias("is_listed"))
        false, true = scratch.save(both.where("is_listed = 0").select("key")), listed
        while n := false.count():
            self.levels.append(Level(false, n, *LATER, len(self.levels)))
            false, true = scratch.save(true.where(self.levels[-1].has(F.col("key")))), false

    def has(self, key: Column) -> Column:
        out = self.levels[-1].has(key)
        for level in self.levels[-2::-1]:
            out = level.has(key) & ~out
        return out


def _keys(host: Column, path: Column, depth: int, lengths: list[int]) -> Column:
    """All keys of a url, the longest first: array of (back, host_back, action, rule)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    # "block" sorts after "allow", and comes first in the order by a number
    actions = F.array(*[F.struct(F.lit(k).alias("order"), F.lit(a).alias("action")) for k, a in enumerate(("block", "allow"))])
    entry = lambda s, h, a: F.struct((-F.length(s) - F.length(h)).alias("back"), (-F.length(s)).alias("host_back"), a["order"].alias("order"), a["action"].alias("action"), F.concat(s, h).alias("rule"))
    every = F.flatten(F.transform(suffixes, lambda s: F.flatten(F.transform(heads, lambda h: F.transform(actions, lambda a: entry(s, h, a))))))
    return F.array_sort(F.when(host == "", F.array().cast("array<struct<back:int,host_back:int,order:int,action:string,rule:string>>")).otherwise(every))


def rule_key(action: Column, rule: Column) -> Column:
    return F.concat(action, F.lit(" "), rule)


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", most_bits: int = MAX_BITS, scratch: Scratch | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. rules: action (allow or block), host, path."""
    scratch = scratch or Scratch(pages.sparkSession)
    added = ("host", "path", "rule", "verdict")
    listed = rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    shape = listed.agg(
        F.count_if(F.col("host").isNull() | (F.col("host") == "") | ~F.coalesce(F.col("action").isin("allow", "block"), F.lit(False))).alias("wrong"),
        F.max(F.size(F.split("host", r"\."))).alias("depth"),
        F.array_sort(F.collect_set(F.length("path"))).alias("lengths"),  # few: lengths of paths
    ).first()
    if shape["wrong"]:
        raise ValueError("a rule needs an action (allow or block) and a host")
    rest = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in added or c == url_col])
    out = rest.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}) if url_col.lower() not in added else rest
    if not shape["depth"]:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = _keys(F.col("host"), F.col("path"), shape["depth"], shape["lengths"])
    listed = scratch.save(listed.select(rule_key(F.col("action"), F.concat("host", "path")).alias("key")).distinct())
    n = listed.count()
    of_url = lambda df: df.select(F.explode(keys).alias("k")).select(rule_key(F.col("k.action"), F.col("k.rule")).alias("key"))
    n_universe = of_url(out).agg(F.approx_count_distinct("key")).first()[0]
    parts = max(1, math.ceil(n * bits_for(n, n_universe)[0] / most_bits))
    part_of = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))
    hits = fresh(out, "rule_hits")
    for part in range(parts):
        mine = (lambda key: F.lit(True)) if parts == 1 else (lambda key, part=part: part_of(key) == part)
        some = scratch.save(listed.where(mine(F.col("key")))) if parts > 1 else listed
        here = n if parts == 1 else some.count()
        if here:
            cascade = Cascade(some, of_url(out).where(mine(F.col("key"))), here, max(1, n_universe // parts), scratch)
            found = F.filter(keys, lambda k: mine(rule_key(k["action"], k["rule"])) & cascade.has(rule_key(k["action"], k["rule"])))
            out = out.withColumn(hits, F.get(found if hits not in out.columns else F.array_sort(F.array_compact(F.array(hits, F.get(found, F.lit(0))))), F.lit(0)))
            if part < parts - 1:
                out = scratch.save(out)
    return out.withColumns({"rule": F.col(f"{hits}.rule"), "verdict": F.coalesce(f"{hits}.action", F.lit(default))}).drop(hits)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def brute_force(urls: list, rules: list[tuple] = RULES, default: str = "allow") -> list[tuple]:
    """What judge says of urls, rule by rule (for tests)."""
    lower = str.maketrans(_UPPER, _LOWER)
    out = []
    for url in urls:
        _, found, rest = (url or "").partition("://")
        ends = [i for i in map(rest.find, "/?#") if i >= 0]
        host = rest[: min(ends, default=len(rest))]
        tail = rest[len(host) :]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
        host, path = (host.translate(lower), path) if found else ("", "")
        fits = [(-len(h + (p or "")), -len(h), a != "block", h + (p or ""), a) for a, h, p in ((a, h.translate(lower), p) for a, h, p in rules) if host and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = min(fits, default=None)
        out.append((host, path, best[3] if best else None, best[4] if best else default))
    return out
