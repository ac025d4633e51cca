"""Near duplicates by SimHash fingerprints and a binary trie self-join.

Fingerprints
    The text is lower-cased (A-Z only) and cut into words; every run of ``shingle`` words, repeats included, is
    hashed with XXH64 (seed 42). A bit is 1 if more than half of the hashes have it. A text with fewer words is one
    shingle; a null text or a text without words has fingerprint 0, which links like any other.

Links
    Two fingerprints link if they differ in at most ``budget`` bits. Equal fingerprints are one node from the start,
    so copies never meet each other. The 64 bits are cut into ``budget + 1`` bands; two linked fingerprints agree on
    one band at least. Per band the bits are rotated so that the band leads, and the fingerprints that agree on it
    form a binary trie which is joined with itself: pairs of nodes go down together, their differing bits add up, and
    a pair is dropped as soon as the sum passes the budget. Pairs of nodes that are already connected are dropped
    too, as only the classes are asked for; a dense group therefore costs no square of its size. A band value with
    more than ``split_rows`` fingerprints is dealt out as pairs of deeper nodes, so that no task gets all of it.

Classes
    Each task returns at most one link per fingerprint (a star per local class); stars of all tasks are joined by
    alternating large-star and small-star rounds, each written to the shared work folder.

Edge cases: null ids keep their row and get the class of their fingerprint; repeated rows share it; an empty table
gives an empty result. A class whose rows have no id has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, slices, text_of

SEED = 42
#: A-Z to a-z and nothing else.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles of a text, repeats included."""
    words = [w.encode() for w in WORD.findall(text_of(text).translate(LOWER))]
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:count].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, count)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Majority bits of the hashes (0 without hashes)."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        raw = hashes[part:part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) per row: the fingerprint's 64 bits as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            fps = [fingerprint_of(shingle_hashes(t, shingle)) for t in batch.column(text_col).to_pylist()]
            values = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), values], names=[id_col, "fp"])

    narrow = docs.select(id_col, text_col)
    return narrow.mapInArrow(score, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, fp bigint")


# --------------------------------------------------------------------------- trie self-join

class Classes:
    """Connected classes of positions 0..n-1, all operations on whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.changes = self._changes()

    def _changes(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        before = True
        while before:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            before = bool(apart.any())
            if before:
                np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
                while not np.array_equal(up := self.root[self.root], self.root):
                    self.root = up
        self.changes = self._changes()

    def joined(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        """Whether both ranges lie in one and the same class."""
        return ((self.root[lo_a] == self.root[lo_b]) & (self.changes[lo_a] == self.changes[hi_a - 1])
                & (self.changes[lo_b] == self.changes[hi_b - 1]))


STEP = 4  # trie levels that go down at once
LEAF_PAIRS = 64
CHUNK = 2048


def _leaf_pairs(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    wide = hi_b - lo_b
    counts = (hi_a - lo_a) * wide
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    per = np.repeat(wide, counts)
    return np.repeat(lo_a, counts) + at // per, np.repeat(lo_b, counts) + at % per


def trie_classes(keys: np.ndarray, lead: int, budget: int) -> np.ndarray:
    """Class root per position of the sorted distinct uint64 ``keys``.

    Keys link if they agree on the first ``lead`` bits and differ in at most ``budget`` bits.
    """
    classes = Classes(len(keys))
    if len(keys) < 2:
        return classes.root
    top = keys >> np.uint64(64 - lead)
    near = np.flatnonzero((np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget) & (top[1:] == top[:-1]))
    classes.link(near, near + 1)
    edges = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(keys)]))
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    differ = np.array([[(x ^ y).bit_count() for y in range(16)] for x in range(16)])
    stack = [(lead, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, la, ha, lb, hb, err = stack.pop()
        if len(la) > CHUNK:
            stack.append((depth, *(x[CHUNK:] for x in (la, ha, lb, hb, err))))
            la, ha, lb, hb, err = (x[:CHUNK] for x in (la, ha, lb, hb, err))
        open_ = ~classes.joined(la, ha, lb, hb)
        la, ha, lb, hb, err = (x[open_] for x in (la, ha, lb, hb, err))
        if not len(la):
            continue
        small = ((ha - la) * (hb - lb) <= LEAF_PAIRS) | (depth >= 64)
        if small.any():
            i, j = _leaf_pairs(la[small], ha[small], lb[small], hb[small])
            hit = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if hit.any():
                classes.link(i[hit], j[hit])
            la, ha, lb, hb, err = (x[~small] for x in (la, ha, lb, hb, err))
        if not len(la):
            continue
        step = min(STEP, 64 - depth)
        shift, fan = 64 - depth - step, 1 << step

        def cut(lo, hi):
            base = (keys[lo] >> np.uint64(64 - depth)) << np.uint64(step) if depth else np.zeros(len(lo), np.uint64)
            marks = (base[:, None] + np.arange(fan, dtype=np.uint64)) << np.uint64(shift)
            begin = np.searchsorted(keys, marks.ravel()).reshape(-1, fan)
            return begin, np.concatenate((begin[:, 1:], hi[:, None]), axis=1)

        (ba, ea), (bb, eb) = cut(la, ha), cut(lb, hb)
        total = err[:, None, None] + differ[None, :fan, :fan]
        fits = (total <= budget) & (ea > ba)[:, :, None] & (eb > bb)[:, None, :]
        same = la == lb
        fits[same] &= np.triu(np.ones((fan, fan), bool))
        p, x, y = np.nonzero(fits)
        errs = total[p, x, y]
        nodes = (ba[p, x], ea[p, x], bb[p, y], eb[p, y])
        alone = (nodes[0] == nodes[2]) & (nodes[1] - nodes[0] < 2)
        order = np.flatnonzero(~alone)
        order = order[np.argsort(errs[order], kind="stable")]  # close pairs first: they connect most
        stack.append((depth + step, *(v[order] for v in nodes), errs[order]))
    return classes.root


def bands(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the budget + 1 bands of 64 bits."""
    parts = budget + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotated(fp: Column, first: int) -> Column:
    if first == 0:
        return fp
    return F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, 64 - first))


def class_links(fps: DataFrame, budget: int = 4, group_rows: int = 20000, split_rows: int = 200000,
                split_bits: int = 6) -> DataFrame:
    """(src, dst) long: links between the distinct fingerprints in ``fps.fp`` that connect all their classes.

    ``group_rows`` is the mean number of fingerprints of a task's group.
    """
    n = fps.count()
    groups = max(16, -(-n // group_rows))
    cut = bands(budget)
    keyed = fps.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("band"), _rotated(F.col("fp"), first).alias("bits"),
                 F.shiftrightunsigned(_rotated(F.col("fp"), first), 64 - width).alias("lead"))
        for k, (first, width) in enumerate(cut)])).alias("k")).select("k.*")
    heavy = (keyed.groupBy("band", "lead").count().where(F.col("count") > split_rows)
             .select("band", "lead", F.lit(True).alias("heavy")))
    width_of = F.element_at(F.array(*[F.lit(w) for _, w in cut]), F.col("band") + 1)
    sub = F.expr(f"shiftrightunsigned(bits, 64 - width - {split_bits}) & {(1 << split_bits) - 1}")
    partners = F.expr(f"filter(sequence(0L, {(1 << split_bits) - 1}L), t -> bit_count(t ^ sub) <= {budget})")
    dealt = (keyed.join(heavy, ["band", "lead"], "left").withColumn("width", width_of).withColumn("sub", sub)
             .withColumn("other", F.explode(F.when(F.col("heavy"), partners).otherwise(F.array(F.lit(-1).cast("long")))))
             .select("band", "bits",
                     F.when(F.col("heavy"), F.concat_ws("/", "lead", F.least("sub", "other"), F.greatest("sub", "other")))
                     .otherwise(F.pmod("lead", F.lit(groups)).cast("string")).alias("part")))

    def join(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        first, width = cut[band]
        keys = np.unique(table.column("bits").to_numpy().view(np.uint64))
        root = trie_classes(keys, width, budget)
        away = np.flatnonzero(root != np.arange(len(keys)))
        plain = (keys >> np.uint64(first)) | (keys << np.uint64(64 - first)) if first else keys
        return pa.table({"src": plain[away].view(np.int64), "dst": plain[root[away]].view(np.int64)})

    return dealt.groupBy("band", "part").applyInArrow(join, "src bigint, dst bigint")


def connected_classes(links: DataFrame, label: str = "classes", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst long); root is the smallest node of its class."""
    edges = materialize(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"),
                                                        F.least("src", "dst").alias("v")).distinct(), label)
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(down.select("u", "m")))
        edges = materialize(small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                            .where("u <> v").distinct(), label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError("classes did not settle")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                           budget: int = 4, **how: int) -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``; see the module text."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-nodes")
    roots = connected_classes(class_links(nodes, budget, **how), "simhash-links")
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(id_col, "fp", "component_id")


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                        budget: int = 4, **how: int) -> DataFrame:
    """``docs`` with one row per near-duplicate class: the smallest id's first row, all columns kept.

    Rows are told apart by a row number given when they are stored, so repeated ids and repeated rows are safe.
    Rows without an id come last within their class.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = materialize(inner.withColumn("at", F.monotonically_increasing_id()), "simhash-docs")
    fps = fingerprints(marked.select("at", F.col(f"row.`{text_col}`").alias("text")), "at", "text", shingle)
    rows = materialize(fps.join(marked.select("at", F.col(f"row.`{id_col}`").alias("id")), "at"), "simhash-fp")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    nodes = materialize(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-nodes")
    roots = connected_classes(class_links(nodes.select("fp"), budget, **how), "simhash-links")
    winners = (nodes.join(roots, nodes.fp == roots.node, "left")
               .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.at"))
    return marked.join(winners, "at", "left_semi").select("row.*")
