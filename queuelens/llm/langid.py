"""Language identification by prediction by partial matching (PPM) over bytes.

Model
    Every language has a context tree over the bytes of its training texts, contexts of 0 to ``ORDER`` bytes. In a
    context seen n times with t different next bytes, a byte seen c times has probability c / (n + t), and the escape
    to the next shorter context t / (n + t) (method C, no exclusion); below the empty context all 256 bytes are equal.
    A longer context that was never seen costs nothing. The statistics are frozen after training, so the code length
    of a byte depends on it and the ``ORDER`` bytes before it only. Training therefore tabulates the code length in
    every language for each string of 1 to ``ORDER + 1`` bytes seen in any language, and the escape cost of each
    context, as sorted arrays; scoring a text looks its strings up, from the longest to the shortest.

Training sample
    Rows with a language and a text, in the order of a hash of id and text, up to ``sample_bytes`` per language: a
    bounded sample (default 1 MB of text per language; a text counts up to that size). The hash at which a language's
    sample is full is found from sizes alone, in two steps of ``CELLS`` cells of the hash range, so that no text but
    those up to it is shuffled; a language with less text is taken whole. At most ``most_langs`` languages are learned (an error beyond), so
    the tables sent to the tasks are bounded by ``most_langs * sample_bytes`` strings per order.

Prediction
    The language with the shortest code; ``score`` is 2**-length of it over the sum of all (1: certain). Only the text
    is read. ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.

Rejection
    Some language always has the shortest code, so ``keep_known`` also asks how short it is. Every distinct text to learn
    from, not the sample's alone, is coded by tables of the half of the sample that it is not in; a language's limit of
    bits a byte lies as far above the 0.99 quantile of these figures as that lies above their median, and at least
    ``SLACK`` times the median. Texts beyond the limit of their
    language are rejected. A language with fewer than ``LEAST_TEXTS`` such texts takes the highest limit of the others
    (none at all has a limit: nothing is rejected for it).

Edge cases: repeated rows are judged each on its own; texts of any length are read whole; an empty table or a table
without languages gives ``und`` for whatever rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_of, whole_rows

ORDER = 4
#: Cells of a step on the way to the hash at which a sample is full, a power of two.
CELLS = 1 << 12
#: Least distance of a language's limit of bits a byte from the median, as a factor, and least texts that set a limit.
SLACK = 1.3
LEAST_TEXTS = 8
#: Steps of a bit in which held-out figures are counted.
STEPS = 1 << 12


def suffix_codes(line: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes up to each position as one number (bytes before the start count as 0)."""
    codes = np.zeros(len(line), np.uint64)
    for back in range(min(length, len(line))):
        codes[back:] |= line[:len(line) - back].astype(np.uint64) << np.uint64(8 * back)
    return codes


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each after ORDER zero bytes, and the bounds of each text's own bytes."""
    raw = [text_of(t).encode("utf-8", "surrogatepass") for t in texts]
    line = np.frombuffer(b"".join(bytes(ORDER) + r for r in raw), np.uint8)
    stops = np.cumsum([ORDER + len(r) for r in raw])
    return line, np.stack([stops - [len(r) for r in raw], stops], axis=1) if len(raw) else np.zeros((0, 2), int)


def own_positions(bounds: np.ndarray, n: int) -> np.ndarray:
    mask = np.zeros(n + 1, np.int64)
    np.add.at(mask, bounds[:, 0], 1)
    np.add.at(mask, bounds[:, 1], -1)
    return np.cumsum(mask)[:n] > 0


class Tables:
    """Code lengths in bits by string and language: ``keys[k]`` sorted strings of k + 1 bytes, ``cost[k]`` a row per
    string and a column per language; ``contexts[k]`` sorted contexts of k bytes, ``escape[k]`` likewise; ``limits``
    the most bits a byte of a text in a language, where it was asked for."""

    def __init__(self, langs, keys, cost, contexts, escape):
        self.langs, self.keys, self.cost, self.contexts, self.escape = langs, keys, cost, contexts, escape
        self.limits: dict[str, float] = {}

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Tables:
        langs = sorted(samples)
        lines = {}
        for lang in langs:
            line, bounds = joined_bytes(samples[lang])
            lines[lang] = (line, own_positions(bounds, len(line)))
        made = cls(langs, [], [], [], [])
        for order in range(ORDER + 1):
            seen = {lang: np.unique(suffix_codes(line, order + 1)[own], return_counts=True)
                    for lang, (line, own) in lines.items()}
            keys = np.unique(np.concatenate([k for k, _ in seen.values()]))
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts), len(langs)))
            cost = np.empty((len(keys), len(langs)))
            for column, lang in enumerate(langs):
                own, n = seen[lang]
                at = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                met = kinds > 0
                escape[met, column] = np.log2(total[met] + kinds[met]) - np.log2(kinds[met])
                away = escape[np.searchsorted(contexts, keys >> np.uint64(8)), column]
                cost[:, column] = away + (made.lengths(keys, order - 1)[:, column] if order else 8.0)
                cost[np.searchsorted(keys, own), column] = np.log2((total + kinds)[at]) - np.log2(n)
            made.keys.append(keys)
            made.cost.append(cost)
            made.contexts.append(contexts)
            made.escape.append(escape)
        return made

    def lengths(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each string of order + 1 bytes, by language."""
        if order < 0:
            return np.full((len(codes), len(self.langs)), 8.0)
        codes = codes & np.uint64((1 << 8 * (order + 1)) - 1)
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        out = self.cost[order][at]
        new = keys[at] != codes
        if new.any():
            context = codes[new] >> np.uint64(8)
            known = self.contexts[order]
            c = np.minimum(np.searchsorted(known, context), len(known) - 1)
            away = np.where((known[c] == context)[:, None], self.escape[order][c], 0.0)
            out[new] = away + self.lengths(codes[new], order - 1)
        return out

    def totals(self, texts: list[str]) -> np.ndarray:
        """Code length of each text by language."""
        line, bounds = joined_bytes(texts)
        own = own_positions(bounds, len(line))
        codes, at = np.unique(suffix_codes(line, ORDER + 1)[own], return_inverse=True)
        if not len(codes):
            return np.zeros((len(texts), len(self.langs)))
        table = self.lengths(codes, ORDER)
        ends = np.cumsum(bounds[:, 1] - bounds[:, 0])
        starts = np.concatenate(([0], ends[:-1]))
        out = np.zeros((len(texts), len(self.langs)))
        for column in range(len(self.langs)):
            sums = np.concatenate(([0.0], np.cumsum(table[:, column][at])))
            out[:, column] = sums[ends] - sums[starts]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits per byte) of each text."""
        if not self.langs:
            return [("und", 0.0, None)] * len(texts)
        out = []
        for text, bits in zip(texts, self.totals(texts)):
            if text is None or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, None))
                continue
            best = int(np.argmin(bits))
            out.append((self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()),
                        float(bits[best]) / len(text.encode("utf-8", "surrogatepass"))))
        return out


def _half(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % 2


def half_tables(samples: dict[str, list[str]]) -> list[Tables | None]:
    """Tables of the two halves of the distinct texts; the first judges the second half, the second the first."""
    halves: list[dict[str, list[str]]] = [{}, {}]
    for lang, texts in samples.items():
        for text in sorted(set(map(text_of, texts))):
            halves[_half(text)].setdefault(lang, []).append(text)
    return [Tables.fit(half) if half else None for half in halves]


def held_out_bits(tables: list[Tables | None], pairs: list[tuple[str, str]], most: int | None = None) -> list[float | None]:
    """Bits a byte of each (language, text) by the tables of the half that the text is not in, null where they do not know
    the language or the text is empty; ``most`` characters of a text were learned."""
    out: list[float | None] = [None] * len(pairs)
    for half in (0, 1):
        known = tables[1 - half]
        at = [i for i, (lang, text) in enumerate(pairs)
              if known is not None and text and lang in known.langs and _half(text[:most]) == half]
        if at:
            totals = known.totals([pairs[i][1] for i in at])
            for row, i in enumerate(at):
                lang, text = pairs[i]
                out[i] = float(totals[row, known.langs.index(lang)]) / len(text.encode("utf-8", "surrogatepass"))
    return out


def _limit(middle: float, high: float) -> float:
    return float(max(2 * high - middle, SLACK * middle))


def held_out_limits(texts: dict[str, list[str]]) -> dict[str, float]:
    """Most bits a byte by language, where these are all texts; ``limits_of_all`` does the same for a frame."""
    tables, found = half_tables(texts), {}
    for lang, own in texts.items():
        bits = held_out_bits(tables, [(lang, t) for t in sorted(set(map(text_of, own)))])
        found[lang] = [b for b in bits if b is not None]
    return {lang: _limit(*np.quantile(figures, [0.5, 0.99])) for lang, figures in found.items()
            if len(figures) >= LEAST_TEXTS}


def limits_of_all(rows: DataFrame, tables: list[Tables | None], most: int) -> dict[str, float]:
    """Most bits a byte by language from every distinct text of ``rows`` (lang, text), in steps of 1 / ``STEPS`` bit."""
    sent = rows.sparkSession.sparkContext.broadcast(tables)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            bits = held_out_bits(sent.value, list(zip(langs, texts)), most)
            marks = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(marks, pa.binary()),
                 pa.array([None if b is None else round(b * STEPS) for b in bits], pa.int64())],
                names=["lang", "mark", "step"])

    # a text counts once; then a count per step, so one language's state is bounded by the steps and not by its texts
    once = (rows.select("lang", "text").mapInArrow(judge, "lang string, mark binary, step bigint")
            .where("step IS NOT NULL").groupBy("lang", "mark").agg(F.min("step").alias("step")))
    figures = (once.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).groupBy("lang")
               .agg(F.sum("n").alias("n"), F.percentile("step", F.array(F.lit(0.5), F.lit(0.99)), F.col("n")).alias("at")))
    return {r.lang: _limit(r["at"][0] / STEPS, r["at"][1] / STEPS)
            for r in figures.where(F.col("n") >= LEAST_TEXTS).collect()}


def _spot(cells: int) -> Column:
    """The cell of a key, of ``cells`` in the order of the keys."""
    return F.shiftright("key", 64 - (cells.bit_length() - 1)) + cells // 2


def _full(rows: DataFrame, wanted: dict[str, int] | int, cell: Column) -> dict[str, tuple[int, int]]:
    """By language the first cell at which the sizes reach what is wanted, and the sizes before it; languages that
    do not reach it are left out."""
    goal = F.lit(wanted) if isinstance(wanted, int) else F.create_map(
        *[F.lit(x) for pair in wanted.items() for x in pair])[F.col("lang")]
    upto = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("lang", cell.alias("cell")).agg(F.sum("size").alias("own"))
    full = (sums.withColumn("upto", F.sum("own").over(upto)).where(F.col("upto") >= goal)
            .groupBy("lang").agg(F.min("cell"), F.min(F.col("upto") - F.col("own"))))
    return {lang: (at, before) for lang, at, before in full.collect()}


def _cuts(rows: DataFrame, wanted: int) -> dict[str, int]:
    """The last of ``CELLS ** 2`` cells of the keys that each language needs, by the sizes of its rows."""
    coarse = _full(rows, wanted, _spot(CELLS))
    if not coarse:
        return {}
    place = F.create_map(*[F.lit(x) for lang, (at, _) in coarse.items() for x in (lang, at)])[F.col("lang")]
    fine = _full(rows.where(_spot(CELLS) == place), {lang: wanted - before for lang, (_, before) in coarse.items()},
                 _spot(CELLS ** 2))
    return {lang: at for lang, (at, _) in fine.items()}


def _at_most(cuts: dict[str, int]) -> Column:
    if not cuts:
        return F.lit(True)
    last = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])[F.col("lang")]
    return F.coalesce(_spot(CELLS ** 2) <= last, F.lit(True))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_bytes: int = 1 << 20, most_langs: int = 256, limits: bool = False) -> Tables:
    """Learn from the rows where ``learn`` holds and the language is not null; see the module text for the bound.
    ``limits``: learn the most bits a byte of each language as well, for ``keep_known``."""
    size = F.least(F.octet_length("text"), F.lit(sample_bytes))
    order = Window.partitionBy("lang").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn(
        "key", F.xxhash64("id", "text", F.lit("langid")))
    langs = [r[0] for r in rows.select("lang").distinct().limit(most_langs + 1).collect()]
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not langs:
        return Tables([], [], [], [], [])
    cuts = _cuts(rows.withColumn("size", size), sample_bytes)
    picked = (rows.where(_at_most(cuts))
              .withColumn("before", F.coalesce(F.sum(size).over(order), F.lit(0)))
              .where(F.col("before") < sample_bytes)
              .select("lang", "key", "id", F.substring("text", 1, sample_bytes).alias("text")))
    samples: dict[str, list[str]] = {}
    for lang, _, _, text in sorted(picked.collect(), key=lambda r: (r[0], r[1], str(r[2]))):
        samples.setdefault(lang, []).append(text)
    made = Tables.fit(samples)
    if limits:
        made.limits = limits_of_all(rows, half_tables(samples), sample_bytes)
    return made


def identify(docs: DataFrame, tables: Tables, text_col: str = "text", keep: bool = True) -> DataFrame:
    """``row`` (all columns; without the text if ``keep`` is false), lang_pred, score and bits_per_byte per row."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    held = docs if keep else docs.drop(text_col)
    frame = whole_rows(docs, text_col).withColumn(
        "row", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in held.columns]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"in_{text_col}", 1 << 20):
            found = sent.value.predict(batch.column(f"in_{text_col}").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())],
                names=["row", "lang_pred", "score", "bits_per_byte"])

    return frame.mapInArrow(score, f"row {frame.schema['row'].dataType.simpleString()}, "
                                   "lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, tables: Tables, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, with a score of ``least`` or more, and with no more bits a byte
    than the limit of the language, where ``tables`` has limits."""
    known = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    if tables.limits:
        limit = F.create_map(*[F.lit(x) for pair in tables.limits.items() for x in pair])[F.col("lang_pred")]
        known &= F.col("bits_per_byte") <= F.coalesce(limit, F.lit(max(tables.limits.values())))
    return identify(docs, tables, text_col).where(known).select("row.*")
