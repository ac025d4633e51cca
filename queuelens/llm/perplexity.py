"""Quality rules: base counts and n-gram perplexity bands per language.

Model
    A modified Kneser-Ney model of order ``ORDER`` over whole code points, one model per value of the language column
    (null counts as the language ``""``). Spark counts the n-grams of all texts: a task adds up its own and hands
    them on whenever it holds ``MOST_HELD`` of them, one shuffle adds up the tasks'. Continuation counts, counts of
    counts, discounts, context totals and probabilities are DataFrame aggregations and joins keyed by language and
    n-gram, so the model grows with the corpus and no task builds a language. It is stored as arrays sorted by the
    64-bit hash of the n-gram (log2 probability) and of the context (log2 back-off weight), dealt into parts by the
    two code points before the predicted one; the shortest n-grams (``SHARED`` orders) come with every part.

Bands
    A document has two figures, its code length in bits per code point and in bits per word: the logarithms of its
    perplexity by code point and by word. (Signs strewn between words are easy to foretell and lower the first, but
    they raise the second.) Per figure the documents that pass the base rules give a histogram per language and length
    class (powers of two of the words) in steps of 1/200 bit, and from it the median and half the distance of the
    quartiles (a floor at least). A class of fewer than ``least`` documents takes the figures of its whole language.
    The band goes from the median minus ``below`` to the median plus ``above`` times that half distance. A document
    outside of one of its two bands is rejected.

Scoring sends the tasks parts of ``part_bytes`` at most, as far as two code points can be told apart. Languages whose
parts fit together share a pass over their rows; a larger language takes one pass per part, each adding its share of
the code length to the rows, which are stored after every ``PASSES`` of them, so a task holds few parts at a time.

Edge cases: a null or empty text has no word, fails the base rules and has no figure; repeated rows are judged each
on its own; a language without any document that passes the base rules rejects nobody by its band; an empty table
gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, slices, text_of

ORDER, SHARED, PASSES = 4, 2, 4
#: An n-gram is two integers of three code points each: ``lo`` has the last three, ``hi`` those before.
BITS, THREE = 21, 3
START, POINT = 0x110000, (1 << 21) - 1
BASE_BITS = 20.0
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPREAD = 1_000_003
MOST_HELD = 2_000_000
MOST_WORDS, LEAST_WORDS = 2_000_000, 50
SIGNS = "#*$%&|<>"


def masks(order: int) -> tuple[int, int]:
    """What ``hi`` and ``lo`` keep of an n-gram when only its last ``order`` code points stay."""
    return (1 << BITS * max(0, order - THREE)) - 1, (1 << BITS * min(order, THREE)) - 1


def gram_blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``hi`` and ``lo`` of the n-gram that ends at each code point of the texts, and the text's number, in blocks."""
    pad = chr(0) * (ORDER - 1)
    line = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts)])[:len(texts)]
    own = np.ones(len(line), bool)
    for k in range(ORDER - 1):
        own[starts + k] = False
    line[~own] = START
    for begin in range(0, len(line) if texts else 0, size):
        at = np.flatnonzero(own[begin:begin + size]) + begin
        near = [line[at - k].astype(np.int64) << BITS * (k % THREE) for k in range(ORDER)]
        hi = np.zeros(len(at), np.int64)
        for x in near[THREE:]:
            hi |= x
        yield hi, near[0] | near[1] | near[2], np.searchsorted(starts, at, "right") - 1


def hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    h = (lo.astype(np.uint64) * MIX) ^ (hi.astype(np.uint64) * STIR + np.uint64(1))
    return (h ^ (h >> np.uint64(29))) * STIR


# --------------------------------------------------------------------------- counting

class Counts:
    """N-gram counts of a task, kept as arrays sorted by hash and merged when the pending ones outgrow them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.settled = 0

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        keys, first, n = np.unique(hashed(hi, lo), return_index=True, return_counts=True)
        self.parts.append((keys, hi[first], lo[first], n))
        self.held += len(keys)
        if self.held > 2 * self.settled + (1 << 18):
            self.merge()

    def merge(self) -> None:
        keys, hi, lo, n = (np.concatenate(x) for x in zip(*self.parts))
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        self.parts = [(keys, hi[first], lo[first], np.bincount(at, n, len(keys)).astype(np.int64))]
        self.held = self.settled = len(keys)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """All counts in batches; nothing is held afterwards."""
        if self.parts:
            self.merge()
            _, hi, lo, n = self.parts[0]
            for at in range(0, len(n), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n[cut]), pa.string()), *(pa.array(x[cut]) for x in (hi, lo, n))],
                    names=["lang", "hi", "lo", "n"])
        self.__init__()


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, hi, lo, n): n-gram counts over all rows, one row per language and n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counts] = {}
        for batch in slices(batches, "text", 1 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                for hi, lo, _ in gram_blocks([text_of(t) for t, own in zip(texts, langs) if own == lang]):
                    by_lang.setdefault(lang, Counts()).add(hi, lo)
            if sum(c.held for c in by_lang.values()) > MOST_HELD:
                for lang in list(by_lang):
                    yield from by_lang.pop(lang).rows(lang)
        for lang, counts in by_lang.items():
            yield from counts.rows(lang)

    narrow = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"))
    parts = narrow.mapInArrow(count, "lang string, hi bigint, lo bigint, n bigint")
    return parts.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------- model

def discounts(grams: DataFrame) -> DataFrame:
    """(lang, level, d1, d2, d3) of modified Kneser-Ney from the counts of counts of each order."""
    of = grams.groupBy("lang", "level").agg(
        *[F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.expr("n1 / (n1 + 2 * n2)")).otherwise(0.5)

    def d(k: int) -> Column:
        raw = F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1)))
        return F.least(F.greatest(F.coalesce(raw, F.lit(0.5 * k)), F.lit(0.01)), F.lit(k - 0.01)).alias(f"d{k}")

    return of.select("lang", "level", d(1), d(2), d(3))


def shortened(grams: DataFrame, order: int) -> DataFrame:
    """The n-grams of a shorter order, each with the number of different code points seen before it."""
    hi, lo = masks(order)
    return grams.groupBy("lang", F.col("hi").bitwiseAND(F.lit(hi)).alias("hi"),
                         F.col("lo").bitwiseAND(F.lit(lo)).alias("lo")).agg(F.count("*").alias("n"))


def together(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, level, hi, lo, p, spare): interpolated probability of each n-gram and spare share of its context."""
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        by_order[order] = shortened(by_order[order + 1], order)
    grams = materialize(together([g.select("lang", F.lit(k).alias("level"), "hi", "lo", "n") for k, g in by_order.items()]),
                        "kn-grams")
    cut = F.expr("CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END")
    context = Window.partitionBy("lang", "level", "hi", F.shiftright("lo", BITS))  # as many rows as code points at most
    shares = materialize(
        grams.join(discounts(grams), ["lang", "level"]).withColumn("cut", cut)
        .withColumn("total", F.sum("n").over(context)).withColumn("spare", F.sum("cut").over(context) / F.col("total"))
        .select("lang", "level", "hi", "lo", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "spare"), "kn-shares")
    levels: list[DataFrame] = []
    for order in range(1, ORDER + 1):
        level = shares.where(F.col("level") == order)
        if not levels:
            level = level.withColumn("below", F.lit(2.0 ** -BASE_BITS))
        else:
            hi, lo = masks(order - 1)
            level = level.withColumn("short_hi", F.col("hi").bitwiseAND(F.lit(hi))).withColumn(
                "short_lo", F.col("lo").bitwiseAND(F.lit(lo))).join(levels[-1].select(
                    "lang", F.col("hi").alias("short_hi"), F.col("lo").alias("short_lo"), F.col("p").alias("below")),
                ["lang", "short_hi", "short_lo"])
        levels.append(level.select("lang", "level", "hi", "lo", F.expr("own + spare * below").alias("p"), "spare"))
    return materialize(together(levels), "kn-levels")


def part_of(lo, parts):
    """Part of an n-gram by the two code points before its last; for arrays and Columns alike."""
    two = F.shiftright(lo, BITS) if isinstance(lo, Column) else lo >> BITS
    return two % SPREAD % parts


class Model:
    """Kneser-Ney model, or one part of it: per order sorted hash arrays of probabilities and back-off weights."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def log2(self, hi: np.ndarray, lo: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 probability of the last code point of each n-gram, backing off where an n-gram is missing."""
        if order == 0:
            return np.full(len(lo), -BASE_BITS)
        if order not in self.levels:
            return self.log2(*self.cut(hi, lo, order - 1), order - 1)
        hashes, p, contexts, weight = self.levels[order]
        found, at = self.find(hashes, hashed(hi, lo))
        out = np.empty(len(lo))
        out[found] = p[at[found]]
        if not found.all():
            rest_hi, rest_lo = hi[~found], lo[~found]
            known, at = self.find(contexts, hashed(rest_hi, rest_lo >> BITS))
            out[~found] = np.where(known, weight[at], 0.0) + self.log2(*self.cut(rest_hi, rest_lo, order - 1), order - 1)
        return out

    @staticmethod
    def cut(hi: np.ndarray, lo: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        keep_hi, keep_lo = masks(order)
        return hi & keep_hi, lo & keep_lo

    @staticmethod
    def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return sorted_keys[at] == wanted, at

    def code_length(self, texts: list[str], part: int = 0, parts: int = 1) -> np.ndarray:
        """Bits of each text, of those n-grams that lie in a part."""
        length = np.zeros(len(texts))
        for hi, lo, owner in gram_blocks(texts):
            if parts > 1:
                own = part_of(lo, parts) == part
                hi, lo, owner = hi[own], lo[own], owner[own]
            _, first, at = np.unique(hashed(hi, lo), return_index=True, return_inverse=True)
            length += np.bincount(owner, -self.log2(hi[first], lo[first])[at], len(texts))
        return length

    @classmethod
    def unpack(cls, rows: list[tuple[int, bytes, bytes, bytes, bytes]]) -> Model:
        kinds = (np.uint64, np.float32, np.uint64, np.float32)
        return cls({row[0]: tuple(np.frombuffer(x, k) for x, k in zip(row[1:], kinds)) for row in rows})


MODEL = "lang string, parts int, part int, level int, grams binary, p binary, contexts binary, weight binary"
ENTRY_BYTES = 24


def fit_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", part_bytes: int = 64 << 20) -> DataFrame:
    """The models of all languages, one row per language, part and order (part -1: the shared orders)."""

    def pack(table: pa.Table) -> pa.Table:
        hi, lo = table.column("hi").to_numpy(), table.column("lo").to_numpy()
        grams, contexts = hashed(hi, lo), hashed(hi, lo >> BITS)
        order = np.argsort(grams)
        of, first = np.unique(contexts, return_index=True)
        p, spare = (np.log2(table.column(c).to_numpy()).astype(np.float32) for c in ("p", "spare"))
        arrays = (grams[order], p[order], of, spare[first])
        return table.slice(0, 1).select(["lang", "parts", "part", "level"]).append_column(
            "grams", pa.array([arrays[0].tobytes()])).append_column("p", pa.array([arrays[1].tobytes()])).append_column(
            "contexts", pa.array([arrays[2].tobytes()])).append_column("weight", pa.array([arrays[3].tobytes()]))

    grams = probabilities(materialize(gram_counts(docs, text_col, lang_col), "kn-counts"))
    parts = grams.groupBy("lang").agg(
        F.ceil(F.sum(F.when(F.col("level") > SHARED, ENTRY_BYTES).otherwise(0)) / part_bytes).cast("int").alias("parts"))
    dealt = grams.join(parts.withColumn("parts", F.greatest("parts", F.lit(1))), "lang")
    dealt = dealt.withColumn("part", F.when(F.col("level") > SHARED, part_of(F.col("lo"), F.col("parts"))).otherwise(-1).cast("int"))
    return materialize(dealt.groupBy("lang", "part", "level").applyInArrow(pack, MODEL), "kn-model")


def model_chains(models: DataFrame, part_bytes: int) -> list[tuple[list[str], int]]:
    """Languages that are scored together with their number of parts: small ones share a pass, larger ones stand alone."""
    sizes = models.groupBy("lang", "parts").agg(F.sum(sum(F.octet_length(c) for c in ("grams", "p", "contexts", "weight"))))
    chains, held = [], part_bytes
    for lang, parts, size in sorted(sizes.collect()):
        if parts > 1:
            chains.append(([lang], parts))
        elif held + size > part_bytes or chains[-1][1] > 1:
            chains.append(([lang], 1))
            held = size
        else:
            chains[-1][0].append(lang)
            held += size
    return chains


# --------------------------------------------------------------------------- base counts

def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs, base = ids[:-1] * len(known) + ids[1:], len(known)
    if base > MOST_WORDS:  # the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[at] >= 2
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k:n - 2 + k] |= twice
    return int(marked.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: no word)."""
    text = text_of(text)
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SIGNS)), len(lines) - len(set(lines)),
            repeated_words(words))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Code lengths by code point and by word, and the least half quartile distance of each in bits.
FIGURES = {"bits": 0.015, "word_bits": 0.1}


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words")


def scored(docs: DataFrame, models: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: bool = True,
           part_bytes: int = 64 << 20) -> DataFrame:
    """``row`` (all columns of ``docs``; without the text if ``keep`` is false), ``lang``, base counts and the ``FIGURES``."""
    held = docs if keep else docs.drop(text_col)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in held.columns]).alias("row"),
                        F.col(f"`{text_col}`").alias("text"),
                        F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.lit(0.0).alias("length"))
    row_type = frame.schema["row"].dataType.simpleString()
    between = f"row {row_type}, text string, lang string, length double"
    out = f"row {row_type}, lang string, {', '.join(f'{c} bigint' for c in COUNTS)}, bits double, word_bits double"
    context = docs.sparkSession.sparkContext

    def passed(rows: DataFrame, langs: list[str], part: int, parts: int) -> DataFrame:
        """Rows with one part's share of the code length added; the last part also gives the base counts."""
        packed: dict[str, list] = {}
        for r in models.where(F.col("lang").isin(langs) & F.col("part").isin(-1, part)).toLocalIterator():
            packed.setdefault(r["lang"], []).append((r["level"], *(bytes(r[c]) for c in ("grams", "p", "contexts", "weight"))))
        sent, last = context.broadcast(packed), part == parts - 1

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {lang: Model.unpack(x) for lang, x in sent.value.items()}
            for batch in slices(batches, "text", 1 << 20):
                own = batch.column("lang").to_pylist()
                texts = [text_of(t) for t in batch.column("text").to_pylist()]
                length = batch.column("length").to_numpy().copy()
                for lang in set(own) & known.keys():
                    at = [k for k, x in enumerate(own) if x == lang]
                    length[at] += known[lang].code_length([texts[k] for k in at], part, parts)
                if last:
                    sizes = np.array([len(t) for t in texts])
                    counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
                    figures = [np.where((n > 0) & np.isin(own, list(known)), length / np.maximum(n, 1), np.nan)
                               for n in (sizes, counts[:, 0])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row"), batch.column("lang"), *(pa.array(c) for c in counts.T),
                         *(pa.array(x, from_pandas=True) for x in figures)], names=["row", "lang", *COUNTS, *FIGURES])
                else:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "text", "lang")), pa.array(length)],
                                                     names=["row", "text", "lang", "length"])

        return rows.mapInArrow(score, out if last else between)

    chains = model_chains(models, part_bytes)
    known = [lang for langs, _ in chains for lang in langs]
    # languages without any n-gram (null and empty texts) have no model; their rows come last, without a figure
    if not chains or not frame.where(~F.col("lang").isin(known)).select("lang").isEmpty():
        chains.append(([], 1))
    done = []
    for langs, parts in chains:
        rows = frame.where(F.col("lang").isin(langs) if langs else ~F.col("lang").isin(known))
        for part in range(parts):
            rows = passed(rows, langs, part, parts)
            if part % PASSES == PASSES - 1 and part < parts - 1:
                rows = materialize(rows, "quality-pass")
        done.append(rows)
    whole = done[0]
    for rows in done[1:]:
        whole = whole.union(rows)
    return whole


def length_class() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))).cast("int")


def bands(rows: DataFrame, least: int, steps: int = 200) -> DataFrame:
    """(lang, class, and per figure its middle and half): medians and half quartile distances of the figures by
    language and length class."""
    fine = rows.where(~base_failed() & F.col("bits").isNotNull())
    each = fine.select("lang", length_class().alias("class"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("figure"), F.round(F.col(name) * steps).cast("int").alias("cell")) for name in FIGURES])).alias("x"))
    cells = each.groupBy("lang", "class", "x.figure", "x.cell").agg(F.count("*").alias("n"))

    def spots(*keys: str) -> DataFrame:
        quarter = {q: F.expr(f"percentile(cell, {q}, n)") / steps for q in (0.25, 0.5, 0.75)}
        half = (quarter[0.75] - quarter[0.25]) / 2
        return cells.groupBy("figure", *keys).agg(quarter[0.5].alias("middle"), half.alias("half"), F.sum("n").alias("docs"))

    whole = spots("lang").select("lang", "figure", F.struct("middle", "half").alias("whole"))
    chosen = spots("lang", "class").join(whole, ["lang", "figure"]).select(
        "lang", "class", "figure", F.when(F.col("docs") < least, F.col("whole")).otherwise(F.struct("middle", "half")).alias("spot"))
    return chosen.groupBy("lang", "class").agg(*[
        F.max(F.when(F.col("figure") == name, part)).alias(f"{name}_{side}")
        for name, floor in FIGURES.items()
        for side, part in (("middle", F.col("spot.middle")), ("half", F.greatest(F.col("spot.half"), F.lit(floor))))])


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: bool = True, below: float = 6.0,
           above: float = 6.0, least: int = 40, part_bytes: int = 64 << 20) -> DataFrame:
    """``scored`` rows with ``perplexity`` (by code point), ``base_failed`` and ``kept``."""
    models = fit_models(docs, text_col, lang_col, part_bytes)
    figures = materialize(scored(docs, models, text_col, lang_col, keep=False, part_bytes=part_bytes), "quality-scored")
    limits = materialize(bands(figures, least), "quality-bands")
    # whole rows are scored again rather than stored with their texts
    rows = scored(docs, models, text_col, lang_col, part_bytes=part_bytes) if keep else figures
    fine = F.lit(True)
    for name in FIGURES:
        away = (F.col(name) - F.col(f"{name}_middle")) / F.col(f"{name}_half")
        fine = fine & F.coalesce(away.between(-below, above), F.lit(True))
    return (rows.withColumn("class", length_class()).join(limits, ["lang", "class"], "left")
            .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fine)
            .withColumn("perplexity", F.exp(F.col("bits") * float(np.log(2)))))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **how: float) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and lie within their language's band."""
    return judged(docs, text_col, lang_col, **how).where("kept").select("row.*")
