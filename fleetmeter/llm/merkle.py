"""Merkle manifest of a table, with a witness for every row.

Rows are the leaves of one tree for each value of a column; the roots of these trees are
the leaves of one more. Nodes are joined in twos, and one without a partner is hashed by
itself, until one is left.

Leaves are numbered along their order and dealt in aligned blocks. A block is appended
leaf by leaf to an open tree: the subtrees still open are held with the leaves below
them, whose witnesses are partial; when a subtree's sibling is complete, both sides'
witnesses grow by the other's digest. A block of 2^k leaves becomes one root, and roots
of blocks are appended in the same way, as leaves of the level above, so a tree of n
leaves takes log n / k rounds, each a table 2^k times smaller. Witnesses of blocks then
extend those of the rows in them. No task holds more than one block, whatever the size
of a tree.

Defined cases: a NULL field is written as `-`; a NULL tree is a tree of its own and comes
first, ids ascend with NULL first; rows of one id follow each other by their leaves, and
equal rows are leaves of their own; an empty table has no trees. Very long texts are
hashed where they are read and go no further.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.operators.numbering import in_order, numbered
from fleetmeter.sources.staging import staged

#: Leaves of a block; a power of two.
BLOCK = 1 << 12

#: Where the sibling of a node stands: nowhere, before it, after it.
ALONE, BEFORE, AFTER = 0, 1, 2

PATH = "array<struct<side:tinyint,digest:binary>>"


def leaf_of(*fields):
    """Digest of the fields of a row, as hex text: each `-` or its length in bytes, `:`, and itself."""
    def written(field):
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[written(field) for field in fields]), 256)


def _joined(*digests):
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class OpenTree:
    """Leaves appended one by one; each has a witness that grows as subtrees are completed."""

    def __init__(self):
        self.paths = []
        self._open = []  # (level, digest, first leaf) of complete subtrees that wait for a sibling

    def append(self, digest):
        self.paths.append([])
        self._settle(0, digest, len(self.paths) - 1)

    def _settle(self, level, digest, first):
        while self._open and self._open[-1][0] == level:
            _, before, start = self._open.pop()
            for path in self.paths[start:first]:
                path.append((AFTER, digest))
            for path in self.paths[first:]:
                path.append((BEFORE, before))
            level, digest, first = level + 1, _joined(before, digest), start
        self._open.append((level, digest, first))

    def close(self, height=None):
        """The root; nodes without a sibling are raised alone, the last one up to `height`."""
        level, digest, first = self._open.pop()
        while self._open or (height is not None and level < height):
            for path in self.paths[first:]:
                path.append((ALONE, None))
            self._settle(level + 1, _joined(digest), first)
            level, digest, first = self._open.pop()
        return digest


def _paths_array(paths):
    steps = [step for path in paths for step in path]
    flat = pa.StructArray.from_arrays(
        [pa.array([s for s, _ in steps], pa.int8()), pa.array([d for _, d in steps], pa.binary())],
        names=["side", "digest"])
    ends = np.cumsum([0, *map(len, paths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _append_blocks(names, block_leaves):
    """Rows sorted by tree, block and number -> the same with their path in the block; the first row of a
    block carries its root. One block is in memory beside a batch."""
    at = {name: i for i, name in enumerate(names)}
    height = block_leaves.bit_length() - 1

    def finished(held, tree):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        # A tree of several blocks needs all of them at one height.
        several = rows.column(at["total"])[0].as_py() > block_leaves
        root = tree.close(height if several else None)
        roots = pa.array([root, *[None] * (rows.num_rows - 1)], pa.binary())
        return pa.RecordBatch.from_arrays([*rows.columns, _paths_array(tree.paths), roots],
                                          names=[*names, "path", "block_root"])

    def append(batches):
        held, tree, open_key = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = batch.column(at["digest"]).to_pylist()
            blocks, trees = batch.column(at["block"]).to_numpy(), batch.column(at["tree"]).to_pylist()
            starts = [0, *[i for i in range(1, batch.num_rows)
                           if blocks[i] != blocks[i - 1] or trees[i] != trees[i - 1]], batch.num_rows]
            for begin, end in zip(starts[:-1], starts[1:]):
                key = (trees[begin], int(blocks[begin]))
                if key != open_key:
                    if tree is not None:
                        yield finished(held, tree)
                    held, tree, open_key = [], OpenTree(), key
                held.append(batch.slice(begin, end - begin))
                for digest in digests[begin:end]:
                    tree.append(digest)
        if tree is not None:
            yield finished(held, tree)

    return append


def _climbed(nodes, finish, block_leaves):
    """(*nodes, path, subroot, root): witnesses of `nodes` (tree, number, total, digest, ...) up to what `finish`
    makes of the roots (tree, number, digest)."""
    biggest = nodes.agg(F.max("total")).first()[0] or 0
    blocks = nodes.withColumn("block", F.floor(F.col("number") / block_leaves).cast("long"))
    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "number")
    added = T.StructType.fromDDL(f"path {PATH}, block_root binary")
    partial = staged(dealt.mapInArrow(
        _append_blocks(dealt.columns, block_leaves), T.StructType([*dealt.schema.fields, *added.fields])), "merkle-partial")
    roots = partial.where("block_root IS NOT NULL").select(
        "tree", F.col("block").alias("number"), F.ceil(F.col("total") / block_leaves).cast("long").alias("total"),
        F.col("block_root").alias("digest"))
    above = finish(roots) if biggest <= block_leaves else _climbed(staged(roots, "merkle-roots"), finish, block_leaves)
    above = above.select(F.col("tree").alias("above_tree"), F.col("number").alias("above_number"),
                         F.col("path").alias("above_path"), "subroot", "root")
    same = (partial["tree"] == above["above_tree"]) & (partial["block"] == above["above_number"])
    return partial.join(above, same).select(
        *nodes.columns, F.concat("path", "above_path").alias("path"), "subroot", "root")


def manifest(leaves, keep=(), block_leaves=BLOCK):
    """(tree, id, leaf, *keep, path, subroot, root) of every row of `leaves` (tree, id, leaf, *keep).

    `leaf` is hex text; `path` lists the steps to the root, `subroot` is the root of the row's tree.
    """
    # Read twice by the sort; the turn tells equal rows apart.
    tree = F.coalesce(F.concat(F.lit("="), "tree"), F.lit(""))
    rows = staged(leaves.select(
        tree.alias("tree"), F.col("tree").alias("tree_value"), "id", F.unhex("leaf").alias("digest"), *keep,
        F.monotonically_increasing_id().alias("turn")), "merkle-leaves")
    order = [F.asc("tree"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("turn")]
    rows = numbered(in_order(rows, order, "merkle-order"), ["tree"], total="total").drop("turn")
    rows = staged(rows, "merkle-numbered")

    def forest(roots):
        """The roots of the trees as the leaves of one more."""
        ordered = in_order(staged(roots.select("tree", "digest"), "merkle-trees"), [F.asc("tree")], "merkle-trees")
        known = staged(numbered(ordered, total="total").select(
            F.col("tree").alias("own"), F.lit("").alias("tree"), "number", "total", "digest"), "merkle-forest")
        found = _climbed(known, lambda tops: tops.select(
            "tree", "number", F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"),
            F.col("digest").alias("root")), block_leaves)
        return found.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("number"), "path",
                            F.col("digest").alias("subroot"), "root")

    found = _climbed(rows, forest, block_leaves)
    return found.select(F.col("tree_value").alias("tree"), "id", hex_text(F.col("digest")).alias("leaf"), *keep, "path",
                        hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"))


def hex_text(digest):
    return F.lower(F.hex(digest))


def siblings(path):
    """The siblings on the way to the root, one after another, as hex text."""
    known = F.filter(path, lambda step: step["digest"].isNotNull())
    return F.array_join(F.transform(known, lambda step: hex_text(step["digest"])), "")


def folded(leaf, path):
    """The root that a leaf (hex text) and a path lead to."""
    def step_up(digest, step):
        other = hex_text(step["digest"])
        both = F.when(step["side"] == BEFORE, F.concat(other, digest)).when(
            step["side"] == AFTER, F.concat(digest, other)).otherwise(digest)
        return F.sha2(both, 256)

    return F.aggregate(path, leaf, step_up)
