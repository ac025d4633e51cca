"""URL filters by Bloom filter cascades: exact membership over the corpus's keys, without joins at judging time.

Keys
    A rule is a host and a path; its key is both in a row, like ``example.net/en/``. A URL's candidate keys are its
    host and every parent domain, each with every leading part of its path that is as long as some rule's path; no
    other key can be a rule of it. All candidate keys of the table are the key universe.

Cascade
    Level 1 is a Bloom filter of the listed keys, level 2 one of the keys of the universe that level 1 takes for listed
    by mistake, level 3 one of the listed keys that level 2 takes for mistakes, and so on until a level makes none.
    A key of the universe is listed exactly if the number of levels that it passes in a row from the first is odd.
    Listed keys that block and listed keys that allow have a cascade each.

Filters are built with grouped bit-ors as arrays of 64-bit words, which judging holds as constants of its plan. Level
1 has ``bits_per_key`` bits per listed key and each further level holds a small part of the level before;
``most_words`` bounds a level (8 MB, about 6 million listed keys; an error beyond: split such a list by a hash of the
host and judge once per part).

Verdict: the longest listed key decides (ties: the longer host, then block); without any, ``default``.

Edge cases: a URL that is null or has no ``://`` has an empty host and path, and no rule fits it; rules listed twice
count once; repeated rows are judged each on its own; an empty table or list is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_LEVELS = 30


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path`` of the URL."""
    url = F.col(f"`{url_col}`")
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


class Rules:
    """Rules as a frame (host, path, verdict), with what bounds the candidate keys: path lengths and labels."""

    def __init__(self, rules: DataFrame):
        self.keys = rules.select(F.concat("host", "path").alias("key"), "verdict").distinct()
        shape = rules.agg(F.array_sort(F.collect_set(F.length("path"))), F.max(F.size(F.split("host", r"\.")))).first()
        self.lengths, self.labels = shape[0] or [], shape[1] or 0

    def candidates(self) -> Column:
        """Candidate keys of a row with ``host`` and ``path``, as structs (host, key)."""
        if not self.lengths:
            return F.array().cast("array<struct<host:string,key:string>>")
        labels = F.split("host", r"\.")
        hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(self.labels))),
                            lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)))
        lengths = F.filter(F.array(*map(F.lit, self.lengths)), lambda n: n <= F.length("path"))
        pairs = F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.struct(
            h.alias("host"), F.concat(h, F.substring(F.col("path"), F.lit(1), n)).alias("key"))))
        return F.flatten(pairs)


def positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    """Bit positions of a key at one level, each from a hash of its own."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level), F.lit(n)), F.lit(bits)) for n in range(hashes)])


def bloom_words(keys: DataFrame, level: int, words: int, hashes: int) -> DataFrame:
    """(words array<long>): the filter of the column ``key``."""
    spark = keys.sparkSession
    at = keys.select(F.explode(positions(F.col("key"), level, 64 * words, hashes)).alias("at"))
    held = at.groupBy(F.shiftright("at", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("word"))
    dense = spark.range(words).join(held, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x.word).alias("words"))


def passes(key: Column, filter_words: Column, level: int, words: int, hashes: int) -> Column:
    out = None
    for n in range(hashes):
        at = positions(key, level, 64 * words, hashes)[n]
        word = F.element_at(filter_words, (F.shiftright(at, 6) + 1).cast("int"))
        bit = F.getbit(word, (at % 64).cast("int")) == 1
        out = bit if out is None else out & bit
    return out


class Cascade:
    """Filters of one list of keys; ``levels`` holds the words of each level's filter."""

    def __init__(self, hashes: int):
        self.hashes, self.levels = hashes, []

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: int = 10, hashes: int = 4,
              most_words: int = 1 << 20) -> Cascade:
        """From the listed keys and the key universe (both: column ``key``, distinct)."""
        made = cls(hashes)
        inside = materialize(listed, "cascade-listed")
        count = inside.count()
        outside = None
        while count:
            level = len(made.levels)
            if level == MOST_LEVELS:
                raise RuntimeError("the cascade does not end")
            words = -(-count * bits_per_key // 64)
            if words > most_words:
                raise ValueError(f"{count} keys are too many for one filter; judge the list in parts")
            made.levels.append(bloom_words(inside, level, words, hashes).first()[0])
            # before the first mistakes are known, the other side is the universe without the listed keys
            other = outside if outside is not None else universe
            wrong = other.where(made.passed(F.col("key"), level))
            if outside is None:
                wrong = wrong.join(inside, "key", "left_anti")
            inside, outside = materialize(wrong, "cascade-wrong"), inside
            count = inside.count()
        return made

    def passed(self, key: Column, level: int) -> Column:
        words = self.levels[level]
        held = F.from_json(F.lit(str(words)), "array<bigint>")  # folded to a constant by the optimizer
        return passes(key, held, level, len(words), self.hashes)

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passed(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
          **how: int) -> DataFrame:
    """``pages`` with host, path, rule (the deciding key or null) and verdict (allow or block).

    ``rules``: host, path, verdict (``allow`` or ``block``). Columns of these four names in ``pages`` are replaced.
    """
    known = Rules(rules)
    parsed = with_host_and_path(pages, url_col)
    universe = parsed.select(F.explode(F.transform(known.candidates(), lambda c: c.key)).alias("key")).distinct()
    cascades = {verdict: Cascade.build(known.keys.where(F.col("verdict") == verdict).select("key"), universe, **how)
                for verdict in ("allow", "block")}

    def found(verdict: str) -> Column:
        listed = F.filter(known.candidates(), lambda c: cascades[verdict].has(c.key))
        return F.transform(listed, lambda c: F.struct(F.length(c.key).alias("size"), F.length(c.host).alias("host_size"),
                                                      F.lit(verdict).alias("verdict"), c.key.alias("key")))

    best = parsed.withColumn("best", F.array_max(F.concat(found("allow"), found("block"))))
    return best.withColumns({"rule": F.col("best.key"),
                             "verdict": F.coalesce("best.verdict", F.lit(default))}).drop("best")
