"""Merkle manifest of a data set: leaf digests, subroots per group, one root and a proof for every row.

Digests
    H is lower-case hex SHA-256 of the concatenated inputs; digests enter as hex text. A leaf is H of chosen columns, each
    written as ``-`` if null, else byte count, ``:`` and value. The leaves of a group ascend by id; every two
    consecutive nodes become their H, a last single one the H of itself, until one node remains: the subroot, which for a
    single leaf is the leaf. The subroots, in the order of their groups, are joined to the root in the same way.

Nested-struct rollup
    Nodes get their rank within the group by ranges (no task holds a group). A block is 2**``DIGITS`` consecutive
    ranks; the rank's low binary digits are columns. One exchange brings a block together and one sort puts it in order;
    then the digit columns are grouped away one after the other, lowest first, and each grouping nests the
    structs of the children in the struct of their parent. Those groupings need no further exchange, and a block has a
    bounded size. The block hashes are the nodes of the next round, until every group is one block; then the subroots
    are rolled up the same way.

Proofs
    Going down again, the row of a block's tree meets the row of its steps above (a union grouped by block), and one nested
    ``transform`` with an ``explode`` gives every node its steps: the hashes before and after it at each level. No row is
    joined to a digest. Folding a leaf with its steps gives the root.

Edge cases: null values are leaves' values like others, and a null id comes first in its group; rows that agree on the id
go by their leaf digest, so repeated rows swap places without effect; an empty table gives an empty result; columns with
names of this module are safe, as rows are carried as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.operators.prefixscan import ranked

from .common import materialize

#: Binary digits of the rank that one round groups away; a block holds 2**DIGITS nodes.
DIGITS = 9


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def written(value: Column) -> Column:
    """A value as it enters a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[written(c) for c in columns])


def levels_of(rows: Column) -> Column:
    """Levels above ``rows`` nodes: halvings, rounded up, until one is left."""
    return F.when(rows <= 1, 0).otherwise(F.length(F.bin(rows - 1))).cast("int")


def _rolled(nodes: DataFrame, digits: int) -> DataFrame:
    """(grp, block, hash, tree) of nodes (grp, rank, rows, item with a field hash), by grouping digits away."""
    names = [f"d{k}" for k in range(digits)]
    cut = nodes.select("grp", F.shiftright("rank", digits).alias("block"), levels_of(F.col("rows")).alias("levels"),
                       *[F.shiftright("rank", k).bitwiseAND(1).cast("byte").alias(names[k]) for k in range(digits)],
                       F.col("item").alias("node"))
    order = ["grp", "block", "levels", *reversed(names)]
    frame = cut.repartition("grp", "block").sortWithinPartitions(*order)
    for k, digit in enumerate(names):
        kids = F.array_compact(F.array(F.first(F.when(F.col(digit) == 0, F.col("node")), ignorenulls=True),
                                       F.first(F.when(F.col(digit) == 1, F.col("node")), ignorenulls=True)))
        frame = frame.groupBy(*order[:len(order) - 1 - k]).agg(kids.alias("kids"))
        hashes = F.array_join(F.transform("kids", lambda kid: kid.hash), "")
        # above the group's last level a node is handed on as it is
        joined = F.when(F.col("levels") <= k, F.col("kids")[0].hash).otherwise(F.sha2(hashes.cast("binary"), 256))
        frame = frame.select(*order[:len(order) - 1 - k], F.struct(joined.alias("hash"), "kids").alias("node"))
    return frame.select("grp", "block", "levels", F.col("node.hash").alias("hash"), F.col("node").alias("tree"))


def _emitted(tree: Column, levels: Column, digits: int) -> Column:
    """Array of (item, steps) over the nodes below a block's tree; steps go from the node up to the block."""
    none = F.array().cast("array<struct<before:string,after:string>>")

    def step(kids: Column, place: Column, level: int) -> Column:
        before = F.when(place == 1, kids[0].hash).otherwise(F.lit(""))
        after = F.when((place == 0) & (F.size(kids) == 2), kids[1].hash).otherwise(F.lit(""))
        return F.when(levels > level, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(none)

    def below(node: Column, level: int, above: list[Column]) -> Column:
        kids = node.kids
        if level == 0:
            return F.transform(kids, lambda kid, k: F.struct(
                kid.alias("item"), F.concat(step(kids, k, 0), *reversed(above)).alias("steps")))
        return F.flatten(F.transform(kids, lambda kid, k: below(kid, level - 1, [*above, step(kids, k, level)])))

    return below(tree, digits - 1, [])


def _rounds(nodes: DataFrame, digits: int, label: str) -> list[DataFrame]:
    """Block rows (grp, block, hash, tree) of each round; in the last one every group is one block."""
    rounds = []
    while True:
        blocks = materialize(_rolled(nodes, digits), label)
        rounds.append(blocks)
        if blocks.agg(F.max("block")).first()[0] in (None, 0):
            return rounds
        # a round halves ``digits`` times, so what is left of the levels tells the number of blocks well enough
        nodes = blocks.select("grp", F.col("block").alias("rank"), "levels", F.struct("hash").alias("item"))
        nodes = nodes.select("grp", "rank", F.expr(f"shiftleft(1L, greatest(levels - {digits}, 0))").alias("rows"), "item")


def _down(rounds: list[DataFrame], tops: DataFrame, digits: int, label: str) -> DataFrame:
    """(grp, rank, item, steps, top) of the nodes of the first round; ``tops`` has (grp, steps, top) per group."""
    above = tops.select("grp", F.lit(0).cast("bigint").alias("block"), "steps", "top")
    for at, blocks in reversed(list(enumerate(rounds))):
        trees = blocks.select("grp", "block", "levels", "tree", F.lit(None).cast(above.schema["steps"].dataType).alias("steps"),
                              F.lit(None).cast(above.schema["top"].dataType).alias("top"))
        steps = above.select("grp", "block", F.lit(None).cast("int").alias("levels"),
                             F.lit(None).cast(blocks.schema["tree"].dataType).alias("tree"), "steps", "top")
        met = trees.unionByName(steps).groupBy("grp", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "tree", "steps", "top")])
        nodes = met.select("grp", "block", F.col("steps").alias("up"), "top", F.posexplode(
            _emitted(F.col("tree"), F.col("levels"), digits)).alias("place", "node"))
        out = nodes.select("grp", (F.shiftleft("block", digits) + F.col("place")).alias("block"), F.col("node.item").alias("item"),
                           F.concat("node.steps", "up").alias("steps"), "top")
        above = materialize(out.drop("item"), f"{label}-steps") if at else out
    return above.withColumnRenamed("block", "rank")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(s.before, acc, s.after))


def proof_digest(steps: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s.before, s.after)), "").cast("binary"), 256)


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, keep: Column, digits: int = DIGITS) -> DataFrame:
    """(keep, leaf, subroot, root, steps): one row per row of ``rows``.

    ``leaf`` is a leaf digest, ``group`` a text (null is a group of its own, first in order), ``order`` the id that leaves
    of a group ascend by, ``keep`` a struct to carry.
    """
    leaves = rows.select(group.alias("grp"), order.alias("ord"), leaf.alias("hash"), keep.alias("keep"))
    placed = ranked(leaves, ["grp"], ["ord", "hash"], "rank", "rows").select(
        "grp", "rank", "rows", F.struct("hash", "keep").alias("item"))
    groups = _rounds(placed, digits, "merkle-leaves")
    subroots = ranked(groups[-1].select("grp", "hash").withColumn("all", F.lit(0)), ["all"], ["grp"], "rank", "rows")
    top = _rounds(subroots.select(F.lit("").alias("grp"), "rank", "rows", F.struct("hash", F.col("grp").alias("of")).alias("item")),
                  digits, "merkle-groups")
    none = F.array().cast("array<struct<before:string,after:string>>")
    root = top[-1].select("grp", none.alias("steps"), F.col("hash").alias("top"))
    per_group = materialize(_down(top, root, digits, "merkle-groups").select(
        F.col("item.of").alias("grp"), "steps", F.struct(F.col("item.hash").alias("subroot"), F.col("top").alias("root")).alias("top")),
        "merkle-subroots")
    return _down(groups, per_group, digits, "merkle-leaves").select(
        "item.keep", F.col("item.hash").alias("leaf"), "top.subroot", "top.root", "steps")


def tampered(doc_id: str = "doc_id") -> Column:
    """The rows that the audit alters: 7 divides the CRC-32 of the id's decimal text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def audited(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Manifest of documents with an audit of every row against its proof, some rows altered first."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.when(tampered(), F.col("n_chars") + 1).otherwise(F.col("n_chars")) if f == "n_chars" else F.col(f) for f in fields]
    seen = F.when(tampered() & F.col("n_chars").isNotNull(), leaf_digest(changed))
    found = manifest(docs, leaf_digest([F.col(f) for f in fields]), F.col("lang"), F.col("doc_id"),
                     F.struct("doc_id", seen.alias("seen")), digits)
    return found.select("keep.doc_id", "leaf", "subroot", "root", "steps",
                        fold(F.coalesce("keep.seen", "leaf"), F.col("steps")).alias("folded_root"))


# DuckDB has no CRC-32, so the byte-wise form is spelled out; rows of equal id go by their leaf as above.
SQL = """
WITH RECURSIVE field AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END AS f1,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS f2,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS f3,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS f4,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS f4b,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS f5,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda a, step: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(f1 || f2 || f3 || f4 || f5) AS leaf,
         CASE WHEN coalesce(crc % 7 = 0, FALSE) THEN sha256(f1 || f2 || f3 || f4b || f5) ELSE sha256(f1 || f2 || f3 || f4 || f5) END AS seen
  FROM field
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves
), lower_levels AS (
  SELECT 0 AS level, g, rank AS idx, leaf AS h FROM placed
  UNION ALL
  (SELECT any_value(level) + 1, g, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM
     (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM lower_levels) WHERE n > 1 GROUP BY g, idx // 2)
), subroots AS (
  SELECT g, h AS subroot, level AS height FROM (SELECT *, count(*) OVER (PARTITION BY g, level) AS n FROM lower_levels)
  WHERE n = 1
), upper_levels AS (
  SELECT 0 AS level, g AS idx, subroot AS h FROM subroots
  UNION ALL
  (SELECT any_value(level) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM
     (SELECT *, count(*) OVER () AS n FROM upper_levels) WHERE n > 1 GROUP BY idx // 2)
), tops AS (
  SELECT h AS root, level AS height FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM upper_levels) WHERE n = 1
), steps AS (
  SELECT p.g, p.rank, l.level, (p.rank >> l.level) % 2 AS right_side, s.h AS sibling
  FROM placed p JOIN (SELECT DISTINCT g, level FROM lower_levels) l ON p.g = l.g
  JOIN subroots r ON r.g = p.g AND l.level < r.height
  LEFT JOIN lower_levels s ON s.g = p.g AND s.level = l.level AND s.idx = xor(p.rank >> l.level, 1)
  UNION ALL
  SELECT p.g, p.rank, 1000 + l.level, (p.g >> l.level) % 2, s.h
  FROM placed p CROSS JOIN (SELECT DISTINCT level FROM upper_levels) l JOIN tops t ON l.level < t.height
  LEFT JOIN upper_levels s ON s.level = l.level AND s.idx = xor(p.g >> l.level, 1)
), proofs AS (
  SELECT g, rank, coalesce(string_agg(sibling, '' ORDER BY level), '') AS siblings,
         list({'right_side': right_side, 'sibling': coalesce(sibling, '')} ORDER BY level) AS path FROM steps GROUP BY g, rank
), folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, t.root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(p.seen, coalesce(list_transform(q.path, lambda s: s.right_side || s.sibling), [])),
           lambda acc, s: CASE WHEN s[1] = '1' THEN sha256(s[2:] || acc) ELSE sha256(acc || s[2:]) END) AS folded_root
  FROM placed p JOIN subroots r ON r.g = p.g CROSS JOIN tops t LEFT JOIN proofs q ON q.g = p.g AND q.rank = p.rank
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
