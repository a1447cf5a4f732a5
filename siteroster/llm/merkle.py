"""Merkle manifest of a table: one tree per group, one tree over the groups' roots, and a proof for each row.

Every level is a slot pivot. Nodes of a tree are numbered; conditional aggregates spread the nodes of each run of
``FANOUT`` over as many columns of one parent row, the columns in order hash to the parent, and leaving out a node's
own column gives its siblings. Levels go up until each tree has one node, and paths come down by one join per level
on (tree, place), which no two parents share. Level by level there are ``FANOUT`` times fewer rows, so all work after
numbering the leaves is a fraction of them. Leaves are numbered by range-split row numbers (``operators.running``):
a group may hold nearly all rows.

Repeated rows are leaves of their own, side by side. NULL groups form one group, before all others. A NULL field
hashes as ``-``, an empty one as ``0:``; NULL keys come first in their group. A tree of one node is that node, and an
empty table has no levels and gives no rows. Columns of the input that are not named take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.operators.running import with_index
from siteroster.session import durable

#: Nodes under one parent.
FANOUT = 8
_SLOTS = [f"slot{i}" for i in range(FANOUT)]


@dataclass(frozen=True)
class Manifest:
    """Levels from the leaves' parents up, for the trees of the groups and for the tree over their roots.

    A level has (tree, place, slot0.., hash): a parent's number in its tree, its nodes and its own hash. A slot holds
    the node's hash; next to the leaves also the columns that leaves carry, next to the group roots the group.
    """

    groups: list[DataFrame]
    roots: list[DataFrame]


def field(value: Column) -> Column:
    """``-`` for NULL, else length in bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def build(leaves: DataFrame, order: Sequence[str], group: str = "group", value: str = "hash",
          carried: Sequence[str] = ()) -> Manifest:
    """The manifest of (group, hash) rows, ordered by ``order`` inside a group; ``carried`` columns ride along.

    Rows that agree in ``order`` must have equal hashes.
    """
    # written first: ranges are sampled, and the hashes of long rows should be taken once
    rows = durable(leaves.select(F.struct(F.col(group).alias("group")).alias("tree"), F.col(value).alias("hash"),
                                 *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                                 F.struct(*[F.col(c) for c in carried], F.lit(0).alias("_")).alias("carried")), "leaves")
    by = [f"o{i}" for i in range(len(order))]
    # the last order column parts equal rows, so that many copies of one row still make several ranges
    numbered = with_index(rows.withColumn("row", F.monotonically_increasing_id()), [*by, "hash", "row"], ["tree"], "place", 0)
    groups = _climb(numbered, "carried")
    roots = groups[-1].select(F.struct(F.lit(0).alias("group")).alias("tree"), F.col("tree.group").alias("group"), "hash")
    placed = with_index(roots, ["group"], name="place", start=0)
    return Manifest(groups, _climb(placed, "group"))


def _climb(nodes: DataFrame, carried: str) -> list[DataFrame]:
    levels = [durable(_lift(nodes, carried), "level")]
    last = levels[0].agg(F.max("place")).first()[0]
    while last:
        levels.append(durable(_lift(levels[-1].select("tree", "place", "hash")), "level"))
        last //= FANOUT
    return levels


def _lift(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row per run of nodes, its nodes in columns and its hash."""
    slot, node = F.pmod("place", F.lit(FANOUT)), F.struct("hash", *carried)
    wide = nodes.groupBy("tree", F.expr(f"place div {FANOUT}").alias("place")).agg(
        *[F.max(F.when(slot == i, node)).alias(name) for i, name in enumerate(_SLOTS)])
    joined = F.concat(*[F.coalesce(F.col(f"{s}.hash"), F.lit("")) for s in _SLOTS])
    return wide.withColumn("hash", F.when(_alone(), F.col(f"{_SLOTS[0]}.hash")).otherwise(F.sha2(joined, 256)))


def _alone() -> Column:
    """Of a parent: its node is the only one of the tree, which then needs no parent."""
    return (F.col("place") == 0) & F.col(_SLOTS[1]).isNull()


def proofs(manifest: Manifest) -> DataFrame:
    """(carried columns, leaf, subroot, root, path) of every leaf.

    ``path`` has, for each level from the leaf to the root at which it has siblings or stands alone in a run, the
    siblings' hashes before it and after it, joined.
    """
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    top = manifest.roots[-1].select("tree", "place", F.col("hash").alias("root"), nothing.alias("path"))
    ends = _descend(manifest.roots, top, ["root"])
    above = ends.select(F.struct(F.col("node.group").alias("group")).alias("tree"), F.lit(0).cast("long").alias("place"),
                        F.col("node.hash").alias("subroot"), "root", "path")
    found = _descend(manifest.groups, above, ["subroot", "root"])
    names = [f.name for f in manifest.groups[0].schema[_SLOTS[0]].dataType["carried"].dataType.fields if f.name != "_"]
    return found.select(*[F.col(f"node.carried.{n}").alias(n) for n in names], F.col("node.hash").alias("leaf"), "subroot", "root", "path")


def _descend(levels: list[DataFrame], paths: DataFrame, kept: list[str]) -> DataFrame:
    """(tree, place, node, kept columns, path) of the nodes below the first level."""
    for level in reversed(levels):
        wide = level.drop("hash").join(paths, ["tree", "place"])
        cells = []
        for i, own in enumerate(_SLOTS):
            before, after = ([F.coalesce(F.col(f"{s}.hash"), F.lit("")) for s in part] for part in (_SLOTS[:i], _SLOTS[i + 1:]))
            step = F.struct(F.concat(F.lit(""), *before).alias("before"), F.concat(F.lit(""), *after).alias("after"))
            path = F.when(_alone(), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
            cells.append(F.struct((F.col("place") * FANOUT + i).alias("place"), F.col(own).alias("node"), path.alias("path")))
        each = wide.select("tree", *kept, F.explode(F.filter(F.array(*cells), lambda c: c["node"].isNotNull())).alias("cell"))
        paths = each.select("tree", *kept, "cell.place", "cell.node", "cell.path")
        if level is not levels[0]:
            paths = paths.drop("node")
    return paths


def fold(path: str, start: Column) -> Column:
    """The root that a leaf's hash leads to along a path."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def siblings(path: str) -> Column:
    """All siblings of a path, joined in order."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def audit(rows: DataFrame, changed: Column, suspect: Column, key: str = "doc_id", group: str = "lang",
          columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """Seal the rows, then verify each against its proof, after ``suspect`` rows have had ``changed`` for their text.

    (key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row; all but the last two speak of the
    rows as sealed.
    """
    original = leaf_hash([F.col(c) for c in columns])
    tampered = leaf_hash([changed if c == text else F.col(c) for c in columns])
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), original.alias("hash"),
                         F.when(suspect, tampered).alias("seen"))
    found = proofs(build(leaves, ["key"], carried=["key", "seen"]))
    root = fold("path", F.coalesce("seen", "leaf"))
    return (found.select(F.col("key").alias(key), "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"),
                         root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root")))
