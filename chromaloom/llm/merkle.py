"""Merkle manifest of a table: a leaf per row, a tree per language, a tree over the languages.

Trees are built in aligned blocks of 1,024 consecutive nodes. A block is one small persistent
tree inside a task: nodes are never changed, and a tampered leaf makes a new version of the
root that copies the leaf's ancestors and shares every other node with the original. Block
roots are the nodes of the next level, which is cut into blocks again, so a tree over n leaves
takes log n to the base 1,024 rounds. Sibling paths come down from the top the same way, one
row per block; a version leaves its block as one digest and goes on through that path.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.llm.common import ranged_runs
from chromaloom.session import checked_broadcast, cut

BITS = 10                    # levels of a block: the most nodes a group holds are 2 ** BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a row's fields, each `-` if null, else its bytes, `:`, its value."""
    def written(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*[written(c) for c in FIELDS]), 256)


class PersistentTree:
    """Hash tree over a run of nodes; every node is written once, versions share them.

    Two neighbours become the digest of both, the last of an odd level that of itself alone.
    `levels` is the height; without it the tree ends where one node is left.
    """

    def __init__(self, leaves: list[str], levels: int | None = None):
        self.digests, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        nodes, self.levels = list(range(len(leaves))), 0
        while len(nodes) > 1 if levels is None else self.levels < levels:
            nodes = [self._join(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else -1) for i in range(0, len(nodes), 2)]
            self.levels += 1
        self.root = nodes[0]

    def _join(self, left: int, right: int) -> int:
        return self._add(digest(self.digests[left] + (self.digests[right] if right >= 0 else "")), left, right)

    def _add(self, value: str, left: int = -1, right: int = -1) -> int:
        self.digests.append(value)
        self.left.append(left)
        self.right.append(right)
        return len(self.digests) - 1

    def path(self, i: int, root: int | None = None) -> list[int]:
        """Nodes from a root down to leaf i."""
        at = [self.root if root is None else root]
        for level in reversed(range(self.levels)):
            at.append((self.right if i >> level & 1 else self.left)[at[-1]])
        return at

    def siblings(self, i: int) -> list[str | None]:
        """The other child at every level from the leaf up; None where there is none."""
        out = []
        for level, parent in enumerate(reversed(self.path(i)[:-1])):
            other = (self.left if i >> level & 1 else self.right)[parent]
            out.append(self.digests[other] if other >= 0 else None)
        return out

    def replaced(self, i: int, leaf: str) -> int:
        """Root of a new version in which leaf i is another; only its ancestors are copied."""
        new = self._add(leaf)
        for level, parent in enumerate(reversed(self.path(i)[:-1])):
            new = self._join(self.left[parent], new) if i >> level & 1 else self._join(new, self.right[parent])
        return new


def fold(value: str, i: int, siblings: list[str | None]) -> str:
    """Digest at the upper end of a path of siblings, from a node at place i."""
    for level, other in enumerate(siblings):
        value = digest((other or "") + value if i >> level & 1 else value + (other or ""))
    return value


def _tree(nodes: pa.Table, bits: int) -> tuple[pa.Table, PersistentTree]:
    """A block's nodes in order and their tree: `bits` levels high if the whole tree goes on above."""
    nodes = nodes.sort_by("idx")
    whole = nodes.column("n")[0].as_py()
    return nodes, PersistentTree(nodes.column("digest").to_pylist(), bits if whole > 1 << bits else None)


def _block(bits: int) -> Column:
    return F.shiftright("idx", bits).alias("block")


def _roots(nodes: DataFrame, bits: int) -> DataFrame:
    """The next block level: tree, idx, digest and the number n of its nodes."""
    def build(group: pa.Table) -> pa.Table:
        nodes, tree = _tree(group, bits)
        first = nodes.slice(0, 1)
        n = first.column("n")[0].as_py()
        return pa.table({"tree": first.column("tree"), "idx": pa.array([first.column("idx")[0].as_py() >> bits], pa.int64()),
                         "digest": [tree.digests[tree.root]], "n": pa.array([-(-n >> bits)], pa.int64())})

    flat = nodes.select("tree", "idx", "digest", "n")
    return flat.groupBy("tree", _block(bits)).applyInArrow(build, "tree long, idx long, digest string, n long")


def raise_trees(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """tree, idx, path, root of every node: all siblings on the way to its tree's root.

    `nodes` has tree, idx (0 to n - 1 in a tree), digest and n. A path holds one entry per
    level, null where a node has no sibling.
    """
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(cut(_roots(levels[-1], bits)))

    def descend(group: pa.Table, above: pa.Table) -> pa.Table:
        nodes, tree = _tree(group, bits)
        rest, root = above.column("path")[0].as_py(), above.column("root")[0].as_py()
        return pa.table({"tree": nodes.column("tree"), "idx": nodes.column("idx"),
                         "path": pa.array([tree.siblings(i) + rest for i in range(nodes.num_rows)], pa.list_(pa.string())),
                         "root": [root] * nodes.num_rows})

    paths = levels.pop().select("tree", "idx", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    while levels:
        below = levels.pop().select("tree", "idx", "digest", "n").groupBy("tree", _block(bits))
        paths = cut(below.cogroup(paths.groupBy("tree", "idx")).applyInArrow(descend, "tree long, idx long, path array<string>, root string"))
    return paths


def placed_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, changed (the tampered leaf or null), tree, idx, n, trees.

    Leaves ascend by doc_id (null first), equal ids by leaf; trees ascend by lang (null first,
    bytewise). Ranges of that order are numbered by themselves and shifted by the rows before
    them, so no task sees more than one range.
    """
    rows = docs.select(
        "doc_id", "lang", leaf_digest().alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(n_chars=F.col("n_chars").cast("decimal(38,0)") + 1)).alias("changed"))
    ranged, runs = ranged_runs(rows, "lang", ["doc_id", "leaf"])
    langs = runs.groupBy("lang").agg(F.sum("c").alias("n"), F.min("part").alias("part"))
    # a range holds few languages' first rows or, with very many languages, about its share of them
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("lang").asc_nulls_first()))
    per_part = langs.groupBy("part").agg(F.count("*").alias("c"))
    shift = per_part.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"),
                            F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("trees"))
    langs = langs.withColumn("i", inside).join(shift, "part").select(F.col("lang").alias("l"), "n", (F.col("s") + F.col("i") - 1).alias("tree"), "trees")
    runs = runs.join(langs, F.col("lang").eqNullSafe(F.col("l"))).select(
        F.col("lang").alias("l"), F.col("part").alias("p"), "first", "before", "n", "tree", "trees")
    there = (F.col("part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("l"))
    return ranged.join(checked_broadcast(runs), there).select(
        "doc_id", "leaf", "changed", "tree", (F.col("seq") - F.col("first") + F.col("before")).alias("idx"), "n", "trees")


def manifest(docs: DataFrame, tampered: Column, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array), folded_root, verified of every row.

    `tampered` says which rows are tested with n_chars increased by one; the others fold their
    own leaf. Null fields count as `-`, null text is not empty text; a tampered row whose
    n_chars is null stays as it is and verifies. `bits` is the height of a block. Repeated rows are leaves of their own, next to
    each other. An empty table has no tree and gives no row. Other columns are not read.
    """
    leaves = cut(placed_leaves(docs, tampered))
    base = leaves.select("tree", "idx", F.col("leaf").alias("digest"), "n")
    blocks = raise_trees(cut(_roots(base, bits)), bits)
    subroots = blocks.where("idx = 0").select(F.col("tree").alias("t"), F.col("root").alias("subroot"))
    trees = leaves.where("idx = 0").select(F.col("tree").alias("t"), "trees")
    top = raise_trees(cut(subroots.join(trees, "t").select(
        F.lit(0).cast("long").alias("tree"), F.col("t").alias("idx"), F.col("subroot").alias("digest"), F.col("trees").alias("n"))), bits)
    top = checked_broadcast(top.select(F.col("idx").alias("t"), F.col("path").alias("top"), F.col("root").alias("whole")))
    above = blocks.join(top, F.col("tree") == F.col("t")).select("tree", "idx", "path", "root", "top", "whole")

    def finish(group: pa.Table, above: pa.Table) -> pa.Table:
        nodes, tree = _tree(group.rename_columns(["digest" if c == "leaf" else c for c in group.column_names]), bits)
        path, subroot, top, whole = (above.column(c)[0].as_py() for c in ("path", "root", "top", "whole"))
        place, branch = nodes.column("tree")[0].as_py(), nodes.column("idx")[0].as_py() >> bits

        def upper(value: str) -> str:
            return fold(fold(value, branch, path), place, top)

        untouched = upper(tree.digests[tree.root])
        proofs, folded = [], []
        for i, changed in enumerate(nodes.column("changed").to_pylist()):
            proofs.append([s for s in [*tree.siblings(i), *path, *top] if s is not None])
            folded.append(untouched if changed is None else upper(tree.digests[tree.replaced(i, changed)]))
        k = nodes.num_rows
        return pa.table({"doc_id": nodes.column("doc_id"), "leaf": nodes.column("digest"), "subroot": [subroot] * k, "root": [whole] * k,
                         "proof": pa.array(proofs, pa.list_(pa.string())), "folded_root": folded, "verified": [f == whole for f in folded]})

    rows = leaves.groupBy("tree", _block(bits)).cogroup(above.groupBy("tree", "idx"))
    return rows.applyInArrow(finish, "doc_id long, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")
