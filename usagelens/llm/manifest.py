"""Operator 11: a Merkle tree over the dataset, one subtree a language.

A leaf is the hash of one row: doc_id, source, lang, n_chars and text, each as its
UTF-8 byte count, a colon and its value, null as ``-``. Leaves of a language stand in
order of doc_id; two neighbours become the hash of both, a last one alone the hash
of itself, until one is left, the subroot. Subroots in order of language, null first,
make the root the same way. Hashes are SHA-256; hashes of hashes take hex text.

The tree is cut into aligned subtrees of ``HEIGHT`` levels above their leaves. Each is
one row of a Parquet table, its digests in van Emde Boas order: the upper half of
the levels first, then each tree below it, every one of them laid out the same
way. ``address`` computes where a node stands, for building and for reading. The
roots of the subtrees are the leaves of the next table, so a table has a 1024th of
the rows of the one below. No task holds more than one subtree; what the driver
learns is the size of the largest language.

A proof is the digests that stand beside the way from a leaf to the root. They are
read from the subtrees, upper tables first: each subtree hands every leaf of it what
it knows about the way above.

Files of a table:

    tree       language as ``ranks.group_key`` has it, empty in the tables over languages
    block      place of the subtree among those of the tree
    blocks     subtrees of the tree
    leaves     leaves of the subtree
    height     levels above the leaves
    nodes      digests in van Emde Boas order, 32 bytes each, zero where no node is
    doc_ids, claimed   of the first table: ids, and the leaf that the audited row gives where it differs

Null doc_id stands last in its language, rows that share an id follow their leaves,
equal rows are leaves of their own. Nulls elsewhere and empty texts are values like
any other. An empty table has no root and gives no rows. Further columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.llm.ranks import group_key, ranked

#: Levels of a subtree above its leaves: 1024 leaves, 64 KB of digests.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: How a sibling stands: none, right of the node, left of it.
NONE, RIGHT, LEFT = 0, 1, 2

BLOCK = pa.schema([
    ("tree", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()),
    ("nodes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("claimed", pa.list_(pa.binary())),
])
BLOCK_DDL = "tree string, block long, blocks long, leaves int, height int, nodes binary, doc_ids array<long>, claimed array<binary>"


def digest(*parts: bytes) -> bytes:
    """Hash of digests, each as hex text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of nodes ``index`` of one depth of a complete tree of ``levels`` levels."""
    index, base = np.asarray(index, np.int64), np.zeros(np.shape(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        # In one of the trees below the upper half, which all have the same size.
        below, levels, depth = depth - top, levels - top, depth - top
        base = base + ((1 << top) - 1) + (index >> below) * ((1 << levels) - 1)
        index = index & ((1 << below) - 1)
    return base


def height_of(leaves: int) -> int:
    """Levels above that many leaves of one tree."""
    return (leaves - 1).bit_length()


def lay_out(leaves: list[bytes], height: int) -> bytes:
    """Digests of the subtree over these leaves, in van Emde Boas order."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    level = leaves
    for up in range(height + 1):
        places = address(height + 1, height - up, np.arange(len(level)))
        nodes[places] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return nodes.tobytes()


class Subtree:
    """A laid out subtree."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.leaves, self.height = leaves, height
        self.nodes = np.frombuffer(nodes, np.uint8).reshape(-1, 32)

    def level(self, up: int, index: np.ndarray) -> np.ndarray:
        """Digests of nodes ``up`` levels above the leaves."""
        return self.nodes[address(self.height + 1, self.height - up, index)]

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def leaf(self) -> list[bytes]:
        return [x.tobytes() for x in self.level(0, np.arange(self.leaves))]

    def ways(self) -> tuple[list[bytes], list[bytes]]:
        """Of each leaf: how its siblings stand level by level, and the digests of those that are there."""
        own = np.arange(self.leaves)
        stands = np.zeros((self.leaves, self.height), np.uint8)
        beside = np.zeros((self.leaves, self.height, 32), np.uint8)
        for up in range(self.height):
            there = -(-self.leaves >> up)
            index = own >> up
            other = index ^ 1
            found = other < there
            stands[:, up] = np.where(found, np.where(index & 1, LEFT, RIGHT), NONE)
            beside[:, up] = self.level(up, np.where(found, other, 0))
        return [s.tobytes() for s in stands], [b[s > 0].tobytes() for s, b in zip(stands, beside, strict=True)]


def fold(leaf: bytes, stands: bytes, beside: bytes) -> bytes:
    """The root that a leaf and what stands beside its way give."""
    at = 0
    for side in stands:
        other = beside[at : at + 32] if side else b""
        leaf = digest(leaf) if side == NONE else digest(leaf, other) if side == RIGHT else digest(other, leaf)
        at += len(other)
    return leaf


def leaf_hash(changed: dict[str, Column] | None = None) -> Column:
    """Hex hash of a row; ``changed`` replaces fields."""
    parts = []
    for name in FIELDS:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _write_tables(nodes: DataFrame, folder: str, most: int, cut: int) -> int:
    """Write the tables over ranked nodes (tree, pos, n, digest, doc_id, claimed) whose largest tree has ``most``; how many."""

    def group(key: tuple, rows: pa.Table) -> pa.Table:
        """The subtree over the rows of one block."""
        rows = rows.sort_by("pos")
        tree, block = key[0].as_py(), key[1].as_py()
        n = rows.column("n")[0].as_py()
        height = min(cut, height_of(n))
        nodes = lay_out(rows.column("digest").to_pylist(), height)
        ids, claimed = rows.column("doc_id").to_pylist(), rows.column("claimed").to_pylist()
        row = [tree, block, -(-n >> cut), rows.num_rows, height, nodes, ids, claimed]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

    spark, table = nodes.sparkSession, 0
    while True:
        blocks = nodes.groupBy("tree", F.shiftright("pos", cut).alias("block")).applyInArrow(group, BLOCK_DDL)
        # Digests do not compress and never repeat.
        blocks.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{folder}/table={table}")
        if most <= 1 << cut:
            return table + 1
        most = -(-most >> cut)
        nodes = _roots(_blocks(spark, folder, table))
        table += 1


def _blocks(spark: SparkSession, folder: str, table: int) -> DataFrame:
    return spark.read.schema(BLOCK_DDL).parquet(f"{folder}/table={table}")


def _roots(blocks: DataFrame) -> DataFrame:
    """Roots of subtrees as nodes of the next table; a root is what stands first."""
    return blocks.select(
        "tree", F.col("block").alias("pos"), F.col("blocks").alias("n"), F.substring("nodes", 1, 32).alias("digest"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("claimed"),
    )


@dataclass(frozen=True)
class Manifest:
    """Where the tables are: ``trees`` tables over documents, ``over`` tables over languages, cut every ``height`` levels."""

    folder: str
    trees: int
    over: int
    height: int


def write_manifest(docs: DataFrame, folder: str, audited: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Write the tables of a dataset.

    ``audited`` gives fields as an auditor finds them in the same rows; the leaves
    that follow from them are kept beside the true ones.
    """
    fields = docs.select(*[F.col(c).cast("string" if c in ("source", "lang", "text") else "long").alias(c) for c in FIELDS])
    leaf, found = leaf_hash(), leaf_hash(audited) if audited else F.lit(None).cast("string")
    rows = fields.select(group_key("lang").alias("tree"), "doc_id", F.unhex(leaf).alias("digest"), F.unhex(found).alias("found"))
    rows = rows.select("tree", "doc_id", "digest", F.when(F.col("found") != F.col("digest"), F.col("found")).alias("claimed"))
    placed = ranked(rows, "tree", [F.col("doc_id").asc_nulls_last(), F.col("digest")], "leaves")
    trees = _write_tables(placed, f"{folder}/trees", placed.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], height)
    tops = _roots(_blocks(docs.sparkSession, f"{folder}/trees", trees - 1)).drop("n", "pos")
    tops = ranked(tops.withColumn("name", F.col("tree")).withColumn("tree", F.lit("")), "tree", [F.col("name")], "subroots").drop("name")
    over = _write_tables(tops, f"{folder}/over", tops.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], height)
    return Manifest(folder, trees, over, height)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; a row holds a whole subtree."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


WAYS_DDL = "tree string, pos long, stands binary, beside binary, subroot binary, root binary"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each leaf of a subtree the way to the root: its own part, then what its subtree's root has above."""
    names = ["tree", "pos", "stands", "beside", "subroot", "root"]
    for row in _each(batches):
        tree = Subtree(row["nodes"], row["leaves"], row["height"])
        stands, beside = tree.ways()
        subroot = [row["subroot"]] * tree.leaves
        if row["root"] is None:  # the topmost subtree over languages: each of its leaves is a subroot
            row["root"], row["up_stands"], row["up_beside"] = tree.root(), b"", b""
        if row["over"]:
            subroot = tree.leaf()
        columns = [
            [row["tree"]] * tree.leaves, [row["block"] * row["width"] + i for i in range(tree.leaves)], [s + row["up_stands"] for s in stands],
            [b + row["up_beside"] for b in beside], subroot, [row["root"]] * tree.leaves,
        ]
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _below(blocks: DataFrame, above: DataFrame | None, over: bool, height: int) -> DataFrame:
    """Subtrees with what their roots have above: pos of ``above`` is block here."""
    if above is None:
        empty = F.lit(None).cast("binary")
        found = blocks.select("*", *[empty.alias(c) for c in ("up_stands", "up_beside", "subroot", "root")])
    else:
        up = above.select("tree", F.col("pos").alias("block"), F.col("stands").alias("up_stands"), F.col("beside").alias("up_beside"), "subroot", "root")
        found = blocks.join(up, ["tree", "block"])
    return found.withColumns({"over": F.lit(over), "width": F.lit(1 << height)})


def open_subtrees(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """The subtrees over documents, each with the way from its root to the top."""
    above = None
    for table in reversed(range(manifest.over)):
        blocks = _blocks(spark, f"{manifest.folder}/over", table).drop("doc_ids", "claimed")
        # Only leaves of the lowest table are subroots; further up their place is all that counts.
        above = _below(blocks, above, table == 0, manifest.height).mapInArrow(_ways, WAYS_DDL)
    # Back from places to languages, by the order they were ranked in.
    names = ranked(_blocks(spark, f"{manifest.folder}/trees", manifest.trees - 1).select("tree").withColumn("_all", F.lit("")), "_all", [F.col("tree")], "names")
    above = above.drop("tree").join(names.select("tree", "pos"), "pos").withColumn("pos", F.lit(0).cast("long"))
    for table in reversed(range(1, manifest.trees)):
        above = _below(_blocks(spark, f"{manifest.folder}/trees", table).drop("doc_ids", "claimed"), above, False, manifest.height).mapInArrow(_ways, WAYS_DDL)
    return _below(_blocks(spark, f"{manifest.folder}/trees", 0), above, False, manifest.height)


def audit(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Of each document: leaf, subroot, root, hash of its proof, the root that the audited row folds to, and whether that is the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for row in _each(batches):
            tree = Subtree(row["nodes"], row["leaves"], row["height"])
            leaves, (stands, beside) = tree.leaf(), tree.ways()
            stands, beside = [s + row["up_stands"] for s in stands], [b + row["up_beside"] for b in beside]
            proofs = [hashlib.sha256(b.hex().encode()).hexdigest() for b in beside]
            folded = [fold(c or x, s, b) for x, c, s, b in zip(leaves, row["claimed"], stands, beside, strict=True)]
            root, n = row["root"], tree.leaves
            columns = [
                row["doc_ids"], [x.hex() for x in leaves], [row["subroot"].hex()] * n, [root.hex()] * n, proofs, [f.hex() for f in folded],
                [f == root for f in folded],
            ]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return open_subtrees(spark, manifest).mapInArrow(run, ddl)
