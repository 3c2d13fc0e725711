"""URL filters: exact membership in rule lists through cascades of Bloom filters, without joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, scope

SEP = "\x00"  # between host and path in a key


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class TooLong(ValueError):
    """A level of a cascade doesn't fit into a constant."""


class Level:
    """One Bloom filter of a cascade: 64-bit words as text, a constant of the plan."""

    HASHES = 4

    def __init__(self, words: str, bits: int, seed: int):
        self.words, self.bits, self.seed = words, bits, seed

    @classmethod
    def positions(cls, key: Column, bits: int, seed: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits)) for i in range(cls.HASHES)]

    def holds(self, key: Column) -> Column:
        words, out = F.split(F.lit(self.words), ",").cast("array<bigint>"), F.lit(True)  # folded to a constant
        for p in self.positions(key, self.bits, self.seed):
            out &= F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return out


WORDS_A_ROW = 1024


def build_level(keys: DataFrame, n: int, seed: int, bits_per_key: int, most_bits: int) -> Level:
    """The filter of ``n`` keys. Its words are put together on the executors, 1,024 of them in a row."""
    bits = 64
    while bits < n * bits_per_key:
        bits *= 2
    if bits > most_bits:
        raise TooLong(f"{n} keys need {bits} bits; most_bits is {most_bits}")
    at = keys.select(F.explode(F.array(*Level.positions(F.col("key"), bits, seed))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    size = min(WORDS_A_ROW, bits // 64)
    parts = words.groupBy((F.col("w") / size).cast("int").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % size).alias("i"), "b"))).alias("m"))
    texts = {r["part"]: r["t"] for r in parts.select("part", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))), ",").alias("t")).collect()}
    none = ",".join(["0"] * size)
    return Level(",".join(texts.get(i, none) for i in range(bits // 64 // size)), bits, seed)


def cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 10, most_bits: int = 1 << 24) -> Callable[[Column], Column]:
    """An exact membership test for the keys of ``universe``.

    Both tables have a column ``key``. Level 1 encodes the listed keys, level 2 the keys of the
    universe that level 1 holds by mistake, level 3 the listed keys that level 2 holds by mistake,
    and so on until no mistake is left. A key is listed if the first level that doesn't hold it is
    an even one. Of the universe, only keys that level 1 holds are shuffled. The levels are constants
    of ``most_bits`` at most each; where one would be larger, ``TooLong`` is raised.
    """
    listed = listed.select("key").where("key is not null").distinct()
    levels: list[Level] = []
    with scope():
        listed = cut(listed, "listed")
        if n := listed.count():
            levels.append(build_level(listed, n, 0, bits_per_key, most_bits))
            tagged = listed.select("key", F.lit(True).alias("is_listed")).unionByName(universe.where(levels[0].holds(F.col("key"))).select("key", F.lit(False).alias("is_listed")))
            tagged = cut(tagged.groupBy("key").agg(F.max("is_listed").alias("is_listed")), "keys")
        while levels:
            held = tagged.where(F.col("is_listed") == (len(levels) % 2 == 0))
            for level in levels[1:]:  # the first one holds all of them
                held = held.where(level.holds(F.col("key")))
            if not (n := held.count()):
                break
            levels.append(build_level(held, n, len(levels), bits_per_key, most_bits))

    def member(key: Column) -> Column:
        out = F.lit(len(levels) % 2 == 1)  # held by all of them
        for i, level in reversed(list(enumerate(levels))):
            out = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out

    return member


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def candidate_keys(host: Column, path: Column, rules: DataFrame, most_shapes: int) -> Column | None:
    """Keys of all rules that could fit a url: its last labels and the beginning of its path.

    The rules' shapes (labels of the host, characters of the path) say how many of each. Over
    ``most_shapes`` of them, all beginnings up to the longest rule's are taken instead.
    """
    labels = lambda h: F.size(F.split(h, "[.]"))
    shapes = rules.select(labels("host").alias("n"), F.length("path").alias("p")).distinct()
    found = [(r["n"], r["p"]) for r in shapes.limit(most_shapes + 1).collect()]
    if not found:
        return None
    made = lambda n, p: F.concat(F.call_function("substring_index", host, F.lit("."), -n), F.lit(SEP), F.left(path, p))
    if len(found) > most_shapes:
        top = rules.agg(F.max(labels("host")).alias("n"), F.max(F.length("path")).alias("p")).first()
        counts = F.sequence(F.lit(1), F.least(labels(host), F.lit(top["n"])))
        lengths = F.sequence(F.lit(0), F.least(F.length(path), F.lit(top["p"])))
        return F.array_distinct(F.flatten(F.transform(counts, lambda n: F.transform(lengths, lambda p: made(n, p)))))

    def of_count(n: int) -> Column:
        lengths = F.split(F.lit(",".join(str(p) for k, p in sorted(found) if k == n)), ",").cast("array<int>")
        fitting = F.transform(F.filter(lengths, lambda p: p <= F.length(path)), lambda p: made(F.lit(n), p))
        return F.when(labels(host) >= n, fitting).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_count(n) for n in sorted({n for n, _ in found})]))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_bits: int = 1 << 24, most_shapes: int = 1 << 12) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains
    when the url's path starts with the rule's path; the longest rule (host and path together,
    then host) wins, a block before an allow of the same key. Without a rule that fits, ``rule`` is
    null and the verdict is ``default``: a url that no list holds.

    The universe is the candidate keys of all pages (see ``candidate_keys``); a cascade for each
    verdict tells exactly which of them are listed, without a join. Where a level of a cascade would
    be over ``most_bits``, that of the listed keys or that of the universe's mistakes, candidates are
    looked up by a join instead, with the same results.

    A null url, or one without ``://``, has an empty host and path and fits no rule. Rules with a
    null don't count. Very long urls are read whole; a longer path than any rule's makes no more
    keys. Rows are independent, repeated rows and null ids stay, older columns of these names are
    replaced, and no rows give none.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    keys = candidate_keys(F.col("host"), F.col("path"), rules, most_shapes)
    if keys is None:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    pages = pages.withColumn("__keys", keys)
    universe = pages.select(F.explode("__keys").alias("key"))
    keyed = rules.select(F.concat("host", F.lit(SEP), "path").alias("key"), "verdict")
    try:
        tests = {v: cascade(keyed.where(F.col("verdict") == v), universe, most_bits=most_bits) for v in ("allow", "block")}
    except TooLong:
        return _joined(pages, keyed, default)
    found = F.transform("__keys", lambda k: F.struct((F.length(k) - 1).alias("n"), (F.instr(k, SEP) - 1).alias("h"), F.when(tests["block"](k), "block").when(tests["allow"](k), "allow").alias("v"), F.replace(k, F.lit(SEP), F.lit("")).alias("rule")))
    best = F.array_max(F.filter(found, lambda x: x["v"].isNotNull()))
    pages = pages.withColumn("__best", best)
    return pages.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.v", F.lit(default))}).drop("__keys", "__best")


def _joined(pages: DataFrame, keyed: DataFrame, default: str) -> DataFrame:
    """For lists too long for constants: distinct candidate sets are looked up by a join and joined back."""
    sets = pages.select("__keys").distinct()
    one = keyed.groupBy("key").agg(F.max("verdict").alias("v"))  # block before allow
    hits = sets.select("__keys", F.explode("__keys").alias("key")).join(one, "key")
    best = hits.groupBy("__keys").agg(F.max(F.struct((F.length("key") - 1).alias("n"), (F.instr("key", SEP) - 1).alias("h"), "v", F.replace("key", F.lit(SEP), F.lit("")).alias("rule"))).alias("__best"))
    out = pages.join(best, "__keys", "left")
    return out.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.v", F.lit(default))}).drop("__keys", "__best")
