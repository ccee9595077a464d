"""Merkle manifest of a dataset (operator 11).

A row's leaf is the SHA-256 of its fields.  The leaves of a language, by
ascending ``doc_id``, form a tree in which every ``FAN`` consecutive nodes have
one parent, the SHA-256 of their joined hex digests (its preimage); the roots
of all languages form one more tree of that kind.

A manifest stores preimages, not nodes: a block of ``BLOCK`` consecutive nodes
holds, for each level above them, the joined child digests of all its parents,
so that a parent's preimage is a slice of ``FAN`` times 64 characters.  Blocks
of blocks form the next tier, so a tree of any size takes a number of shuffles
that grows with its logarithm to the base of ``BLOCK``, and no group is larger
than a block, however many rows one language has.

A leaf's path are the preimages of its ancestors and its slot in each.  The
leaf's siblings are what is left of a preimage without its own 64 characters;
folding puts another digest in their place and hashes the result, level by
level up to the root.

Layout of a manifest, all Parquet: ``tree-K`` and ``forest-K``, the blocks of
tier K of the languages' trees and of the tree above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portfolia.llm.common import bound_batches, drop_path, scratch_path, stage

#: Children of a parent, levels of a block, its nodes, and the characters of a digest.
FAN, HEIGHT, SLOT = 2, 6, 64
BLOCK = FAN**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 of fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered_n_chars() -> dict[str, Column]:
    """The change that the query detects: one more character where 7 divides the CRC-32 of the decimal ``doc_id``."""
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(seventh, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))}


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, a row's place (from 0) among those of its ``key`` by ``order``, nulls first, and ``n``, how many these are.

    Rows are dealt by ranges of key and order, so a frequent key is spread over
    many tasks; one line for each range and key gives the places before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id() % F.lit(1 << 33)), name)
    sizes = dealt.groupBy(key, "part").agg(F.min("pos").alias("first"), F.count("*").alias("here"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("here").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(sizes.select(key, "part", (before - F.col("first")).alias("base"), F.sum("here").over(of_key).alias("n")), f"{name}-offsets")
    return dealt.join(offsets, [key, "part"]).withColumn("idx", F.col("pos") + F.col("base")).drop("part", "pos", "base")


def preimages(nodes: list[str], full: bool) -> tuple[list[str], str]:
    """For each level above ``nodes`` the joined digests of all parents' children, and the node that remains.

    A block of a larger tree is ``full``: it has all ``HEIGHT`` levels, a last
    node without siblings included.
    """
    levels = []
    while len(nodes) > 1 or full and len(levels) < HEIGHT:
        levels.append("".join(nodes))
        nodes = [sha256_hex(levels[-1][at : at + FAN * SLOT]) for at in range(0, len(levels[-1]), FAN * SLOT)]
    return levels, nodes[0]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        built = [preimages([i["hash"] for i in items], n > BLOCK) for items, n in zip(batch.column("items").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        levels, tops = zip(*built, strict=True) if built else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels, pa.list_(pa.string())), pa.array(tops, pa.string())], names=[*batch.schema.names, "levels", "top"])


def _write_tiers(nodes: DataFrame, most: int, path: str) -> tuple[int, DataFrame]:
    """Write the blocks of all tiers over ``nodes`` (tree, idx, n, hash and more); how many these are, and each tree's root (tree, top)."""
    tier, payload = 0, [c for c in nodes.columns if c not in ("tree", "n")]
    while True:
        items = F.sort_array(F.collect_list(F.struct("idx", *[c for c in payload if c != "idx"]))).alias("items")
        grouped = nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).cast("long").alias("block")).agg(F.first("n").alias("n"), items)
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
        blocks = stage(grouped.mapInArrow(_build, f"{kind}, levels array<string>, top string"), path=f"{path}-{tier}")
        tier, most = tier + 1, -(-most // BLOCK)
        if most <= 1:
            return tier, blocks.select("tree", "top")
        nodes = blocks.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("hash"))
        payload = ["idx", "hash"]


def write_manifest(docs: DataFrame, path: str, claims: dict[str, Column] | None = None) -> tuple[int, int]:
    """Write the manifest of ``docs`` to ``path``; how many tiers trees and forest have.

    ``claims`` gives columns other values, whose leaf ``proofs`` folds in place
    of the stored one.  Nulls are fields like others; null ids and a null
    language come first.  Rows of equal language and id are ordered by their
    leaf, so equal rows have neighbouring places, each with a proof of its own.
    An empty table has an empty manifest.  Columns beside the five are not read.
    """
    spark, scratch = docs.sparkSession, scratch_path(docs.sparkSession, "merkle")
    bound_batches(spark)
    values = {c: F.col(c) for c in COLUMNS}
    leaf = leaf_of(list(values.values()))
    claimed = leaf_of(list((values | (claims or {})).values()))
    differs = F.lit(False)
    for c, other in (claims or {}).items():
        differs = differs | ~other.cast("string").eqNullSafe(values[c].cast("string"))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree")
    leaves = stage(docs.select(tree, "doc_id", leaf.alias("hash"), F.when(differs, claimed).alias("claimed")), path=f"{scratch}-leaves")
    nodes = numbered(leaves, "tree", ["doc_id", "hash"], "merkle-numbered")
    most = leaves.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    tiers, subroots = _write_tiers(nodes.select("tree", "idx", "n", "hash", "doc_id", "claimed"), most, f"{path}/tree")
    drop_path(spark, f"{scratch}-leaves")
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("hash"))
    trees = numbered(named, "tree", ["name"], "merkle-trees")
    over, _ = _write_tiers(trees.select("tree", "idx", "n", "hash", "name"), subroots.count(), f"{path}/forest")
    return tiers, over


def path_in(levels: list[str], at: int) -> tuple[list[str], list[int]]:
    """Preimages of the ancestors that node ``at`` of a block has in it, and its slot in each."""
    cut, slots = [], []
    for joined in levels:
        slots.append(at % FAN)
        at //= FAN
        cut.append(joined[at * FAN * SLOT : (at + 1) * FAN * SLOT])
    return cut, slots


def siblings(cut: list[str], slots: list[int]) -> str:
    """The siblings on a path, level by level: preimages without their own slot."""
    return "".join(p[: s * SLOT] + p[(s + 1) * SLOT :] for p, s in zip(cut, slots, strict=True))


def folded(node: str, cut: list[str], slots: list[int]) -> str:
    """The root that follows from ``node`` and the siblings on a path: it is put in its slot of each preimage in turn."""
    for p, s in zip(cut, slots, strict=True):
        node = sha256_hex(p[: s * SLOT] + node + p[(s + 1) * SLOT :])
    return node


_PATH = "above array<string>, slots array<int>, subroot string, root string"


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each node of a block: what it has in the block, and then the block's own."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            out = {c: [] for c in ("tree", "block", "above", "slots", "subroot", "root")}
            for k, item in enumerate(row["items"]):
                cut, slots = path_in(row["levels"], k)
                out["tree"].append(item.get("name", row["tree"]))
                out["block"].append(0 if "name" in item else item["idx"])
                out["above"].append(cut + row["above"])
                out["slots"].append(slots + row["slots"])
                out["subroot"].append(item["hash"] if "name" in item else row["subroot"])
                out["root"].append(row["root"])
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": pa.array(out["tree"], pa.string()),
                    "block": pa.array(out["block"], pa.int64()),
                    "above": pa.array(out["above"], pa.list_(pa.string())),
                    "slots": pa.array(out["slots"], pa.list_(pa.int32())),
                    "subroot": pa.array(out["subroot"], pa.string()),
                    "root": pa.array(out["root"], pa.string()),
                }
            )


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            block = batch.slice(at, 1)
            row = block.to_pylist()[0]
            paths = []
            for k in range(len(row["items"])):
                cut, slots = path_in(row["levels"], k)
                paths.append((cut + row["above"], slots + row["slots"]))
            items, n = row["items"], len(paths)
            roots = [folded(i["claimed"] or i["hash"], *p) for i, p in zip(items, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("items").flatten().field("doc_id"),
                    pa.array([i["hash"] for i in items], pa.string()),
                    pa.array([row["subroot"]] * n, pa.string()),
                    pa.array([row["root"]] * n, pa.string()),
                    pa.array([sha256_hex(siblings(*p)) for p in paths], pa.string()),
                    pa.array(roots, pa.string()),
                    pa.array([r == row["root"] for r in roots], pa.bool_()),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def proofs(spark: SparkSession, path: str, tiers: int, over: int) -> DataFrame:
    """For each row of a manifest: doc_id, leaf, subroot, root, the SHA-256 of its siblings, the root folded from its claimed leaf (its own, if
    nothing else is claimed) and whether that is the manifest's root.

    Paths go down tier by tier: blocks are joined with the path of their own
    node, one row for one row, so no key is frequent; only the last step has a
    row for each leaf, and it needs no shuffle after its blocks are joined.
    """

    def blocks(kind: str, tier: int) -> DataFrame:
        return spark.read.parquet(f"{path}/{kind}-{tier}")

    root = F.col("top")
    top = blocks("forest", over - 1).withColumn("above", F.array().cast("array<string>")).withColumn("slots", F.array().cast("array<int>"))
    paths = top.withColumn("subroot", F.lit(None).cast("string")).withColumn("root", root).mapInArrow(_descend, f"tree string, block long, {_PATH}")
    for tier in reversed(range(over - 1)):
        paths = blocks("forest", tier).join(paths, ["tree", "block"]).mapInArrow(_descend, f"tree string, block long, {_PATH}")
    for tier in reversed(range(1, tiers)):
        paths = blocks("tree", tier).join(paths, ["tree", "block"]).mapInArrow(_descend, f"tree string, block long, {_PATH}")
    lowest = blocks("tree", 0)
    id_type = lowest.schema["items"].dataType.elementType["doc_id"].dataType.simpleString()
    return lowest.join(paths, ["tree", "block"]).mapInArrow(
        _prove, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


#: The tree level by level and each leaf's path by recursion; CRC-32 bit by bit over the decimal digits.
ORACLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, row_number() OVER () AS r,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS register
  FROM documents),
hashed AS (
  SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') || tail) AS other,
    coalesce(xor(register, 4294967295) % 7 = 0, false) AS tampered
  FROM fields),
leaves AS (
  SELECT r, doc_id, lang, leaf, CASE WHEN tampered THEN other ELSE leaf END AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
levels AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM levels WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, level AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM levels WHERE n = 1),
over_levels AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM over_levels WHERE n > 1 GROUP BY level, i // 2, n),
roots AS (SELECT level AS top, h AS root FROM over_levels WHERE n = 1),
climb AS (
  SELECT r, false AS up, s.lang, 0 AS level, l.i, s.top, s.i AS tree, claimed AS h, '' AS proof FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT r, c.level >= c.top OR up, c.lang, CASE WHEN c.level >= c.top AND NOT up THEN 0 ELSE c.level + 1 END, CASE WHEN c.level >= c.top AND NOT up THEN tree ELSE c.i // 2 END, c.top, tree,
    CASE WHEN c.level >= c.top AND NOT up THEN c.h
      ELSE sha256(CASE WHEN c.i % 2 = 0 THEN c.h || coalesce(a.h, b.h, '') ELSE coalesce(a.h, b.h, '') || c.h END) END,
    proof || CASE WHEN c.level >= c.top AND NOT up THEN '' ELSE coalesce(a.h, b.h, '') END
  FROM climb c CROSS JOIN roots
    LEFT JOIN (SELECT lang, level AS la, i AS ia, h FROM levels) a ON NOT up AND c.level < c.top AND a.lang IS NOT DISTINCT FROM c.lang AND la = c.level AND ia = xor(c.i, 1)
    LEFT JOIN (SELECT level AS lb, i AS ib, h FROM over_levels) b ON up AND lb = c.level AND ib = xor(c.i, 1)
  WHERE NOT up OR c.level < roots.top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = root AS verified
FROM climb c JOIN leaves USING (r) JOIN subroots s ON leaves.lang IS NOT DISTINCT FROM s.lang CROSS JOIN roots
WHERE c.up AND c.level = roots.top
"""
