"""Near copies of texts: MinHash bands propose pairs, the shingles of both texts decide.

Similarity
    The Jaccard similarity of the sets of word shingles (``shingle`` words, lower case, XXH64 as in ``simhash``). A
    text with fewer words is one shingle; null texts and texts without words have the empty set and count as equal.

Pairs
    Equal sets are one node from the start. Every node has ``BANDS`` keys, each of the smallest values of ``ROWS``
    permutations of its shingles, and two nodes that share a key are a candidate: a pair of similarity 0.8 is missed
    with probability (1 - 0.8**4)**24, that is 3 in a million, a closer one with less. First each node is compared with
    the smallest node of each of its keys; what that connects is one class, so a dense group costs no square of its
    size. Then the remaining pairs that share a key, lie in different classes and can reach ``least`` by their sizes are
    all compared. Only pairs whose exact similarity is ``least`` or more link, so no two texts are joined by chance.

Edge cases as in ``simhash``: repeated ids and rows are safe, rows without an id come last within their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .simhash import connected_classes, shingle_hashes

BANDS, ROWS = 24, 4
#: A mask and an odd factor per permutation, a factor per place within a band.
_RANDOM = np.random.default_rng(42)
MASKS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
FOLDS = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; no key for the empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 1024):
        mixed = (hashes[None, part:part + 1024] ^ MASKS[:, None]) * FACTORS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    # the high bits are the mixed ones
    return ((least >> np.uint64(16)).reshape(BANDS, ROWS) * FOLDS).sum(axis=1, dtype=np.uint64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(at, digest, n, keys) of (at, text): two hashes of the shingle set, its size and the key of each band."""
    import xxhash

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["at", "digest", "n", "keys"])

    return docs.select("at", "text").mapInArrow(sketch, "at bigint, digest binary, n bigint, keys array<bigint>")


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(src, dst) of those (a, b) whose texts in (at, text) are similar enough."""
    both = (pairs.join(texts.select(F.col("at").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("at").alias("b"), F.col("text").alias("text_b")), "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = None, np.empty(0, np.uint64)
        for batch in slices(batches, "text_b", 4 << 20):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            near = []
            for k, (text_a, text_b) in enumerate(zip(batch.column("text_a"), batch.column("text_b"))):
                if b[k] != seen:
                    seen, known = b[k], shingle_set(text_b.as_py(), shingle)
                near.append(similarity(shingle_set(text_a.as_py(), shingle), known) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             names=["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "src bigint, dst bigint")


def links(nodes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(src, dst): links that connect all classes of the nodes (at, n, keys), whose texts are in (at, text)."""
    keyed = nodes.select("at", "n", F.posexplode("keys").alias("band", "key"))
    shared = (keyed.groupBy("band", "key").agg(F.min("at").alias("first"), F.count("*").alias("size"))
              .where("size > 1").drop("size"))
    keyed = materialize(keyed.join(shared, ["band", "key"]), "near-keys")
    texts = materialize(texts.join(keyed.select("at").distinct(), "at", "left_semi"), "near-texts")
    star = materialize(keyed.where("at <> first").select(F.col("at").alias("a"), F.col("first").alias("b")).distinct(),
                       "near-pairs")
    found = materialize(compared(star, texts, shingle, least), "near-links")
    classes = connected_classes(found, "near-classes")
    placed = keyed.join(classes.select(F.col("node").alias("at"), "root"), "at", "left").select(
        "band", "key", "at", "n", F.coalesce("root", "at").alias("root"))
    mixed = (placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("band", "key"))
    placed = materialize(placed.join(mixed, ["band", "key"], "left_semi"), "near-apart")
    one, other = (placed.select("band", "key", *[F.col(c).alias(f"{c}_{x}") for c in ("at", "n", "root")]) for x in "ab")
    rest = (one.join(other, ["band", "key"])
            .where((F.col("at_a") > F.col("at_b")) & (F.col("root_a") != F.col("root_b"))
                   & (F.least("n_a", "n_b") + 1e-6 >= least * F.greatest("n_a", "n_b")))
            .select(F.col("at_a").alias("a"), F.col("at_b").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    return found.union(materialize(compared(rest, texts, shingle, least), "near-links"))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                        least: float = 0.8) -> DataFrame:
    """``docs`` with one row per class of near copies: the smallest id's first row, all columns kept."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = materialize(inner.withColumn("at", F.monotonically_increasing_id()), "near-docs")
    texts = marked.select("at", F.col(f"row.`{text_col}`").alias("text"))
    made = materialize(sketches(texts, shingle), "near-sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    sets = materialize(made.select("at", "digest").join(marked.select("at", F.col(f"row.`{id_col}`").alias("id")), "at")
                       .groupBy("digest").agg(F.min(order).alias("first"), F.min("at").alias("node")), "near-sets")
    nodes = made.join(sets.select(F.col("node").alias("at")), "at", "left_semi").select("at", "n", "keys")
    roots = connected_classes(links(nodes, texts, shingle, least), "near-classes")
    winners = (sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
               .agg(F.min("first").alias("first")).select("first.at"))
    return marked.join(winners, "at", "left_semi").select("row.*")
