"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct beginning of conversations: its first d turns. It is named by the smallest conversation that
starts with it and by its depth, as two nodes of one depth never share a conversation. Nodes are found without walking
the turns: the sum of hashes of (position, turn) up to a turn is the key of that beginning, two 64-bit sums from a
SHA-256 of the turn, so a running total per conversation (``operators.running``, range-split) does it and one
very long conversation is spread over tasks. What a node's conversations are is known from its members alone; so is
its weight, the number of (conversation, turn) rows at or below it.

The rollup of values over subtrees splits the forest of parent edges at weighted centroids. In each round every
component finds its centroid (the deepest node with half the component's weight), sums the values at and
below it, adds that sum to each node on the path from the centroid to the top, and falls apart into the part above and
one component per child of the centroid. The weight of a component halves with each round, however deep the trie
is, and a path costs no more rows than its component has. Components of at most ``cut`` rows go whole to one task, where the same
splitting goes on. Nodes meet the facts of their component over salts by its weight, and members
by blocks of depth, so neither one huge component nor one long conversation lands in one task.

Rows without a conversation id belong to no conversation and are left out. NULL roles and texts are empty. Turns are
ordered by turn (NULL first), then role and text; equal rows stand side by side. An empty table has no nodes, not even
a root. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.operators.running import running, with_index
from siteroster.session import durable

#: Rows that a component may have to be finished in one task.
CUT = 256
#: Weight or depths per salt, depths per block of a path, and ids hashed as one piece.
SALT_ROWS, BLOCK, PIECE = 1 << 16, 1 << 10, 1 << 12


def ordered_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, i, content, bytes): turns numbered from 1, with a hash of role and text and the text's length in bytes."""
    said = turns.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    numbered = with_index(said, ["turn", "role", "text", "row"], ["conv"], "i")
    return durable(numbered.select("conv", "i", content.alias("content"), F.octet_length("text").cast("long").alias("bytes")), "turns")


def reopened(turns: DataFrame, group: int = 5, openings: int = 9) -> DataFrame:
    """(conv, depth, length, content, bytes): conversations that begin like the first of their group of ids.

    Conversation c takes the first h turns of c - c % group, h being crc32(c) % openings, then its own turns after its
    first h. ``length`` is that of the rebuilt conversation, which also has a row of depth 0.
    """
    n = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(openings))
    counts = durable(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
                     .withColumns({"base": F.col("conv") - F.col("conv") % group, "h": n}), "counts")
    sizes = counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    opened = F.least("h", F.coalesce("n_base", F.lit(0))).cast("long")
    convs = durable(counts.join(sizes, "base", "left").select(
        "conv", "base", "h", "n", opened.alias("opened"), (opened + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = turns.filter(F.col("i") < openings).select(F.col("conv").alias("base"), "i", "content", "bytes")
    opening = convs.join(first, "base").filter("i <= opened").select("conv", F.col("i").alias("depth"), "length", "content", "bytes")
    # a long conversation meets its one row in blocks
    own = turns.withColumn("block", F.expr(f"i div {SALT_ROWS}")).filter(F.col("i") > n)
    facts = convs.select("conv", "h", "opened", "length", F.explode(F.expr(f"sequence(0L, n div {SALT_ROWS})")).alias("block"))
    rest = own.join(facts, ["conv", "block"]).select("conv", (F.col("opened") + F.col("i") - F.col("h")).alias("depth"), "length", "content", "bytes")
    start = convs.select("conv", F.lit(0).cast("long").alias("depth"), "length", F.lit("").alias("content"), F.lit(0).cast("long").alias("bytes"))
    return opening.unionByName(rest).unionByName(start)


def trie(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and membership of (conv, depth, length, content, bytes) rows, one per turn and one of depth 0 per conversation.

    Nodes: (conv, depth, parent, n_convs, n_children, bytes, size); ``size`` counts the rows at and below a node.
    Members: (conv, depth, length, node): the node that a conversation has reached at a depth, by its conversation.
    """
    def part(at: int) -> Column:
        return F.when(F.col("depth") > 0, F.xxhash64("depth", F.substring("content", at, 32))).otherwise(0).cast("decimal(20,0)")

    summed = running(steps.withColumns({"own_a": part(1), "own_b": part(33)}), ["depth"], ["conv"],
                     sums={"a": F.col("own_a"), "b": F.col("own_b")})
    keyed = durable(summed.select("conv", "depth", "length", "bytes", (F.col("a") + F.col("own_a")).alias("a"),
                                  (F.col("b") + F.col("own_b")).alias("b")), "keyed")
    found = durable(keyed.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.sum("length").alias("lengths")), "nodes")
    members = durable(keyed.join(found.select("depth", "a", "b", "node"), ["depth", "a", "b"]).select("conv", "depth", "length", "node"), "members")
    above = members.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = found.select(F.col("node").alias("conv"), "depth", "n_convs", "bytes",
                         (F.col("lengths") - F.col("n_convs") * (F.col("depth") - 1)).alias("size")).join(above, ["conv", "depth"], "left")
    nodes = durable(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    return durable(nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes"), members


def rollup(nodes: DataFrame, members: DataFrame, values: dict[str, Column], cut: int = CUT) -> DataFrame:
    """(conv, depth, values): the sums of ``values`` over the subtree of every node, by centroid decomposition."""
    names = list(values)
    zero = [F.lit(0).cast("long").alias(v) for v in names]
    root = nodes.filter("depth = 0").select("conv", "size").first()
    if root is None:
        return nodes.select("conv", "depth", *zero)
    top = ["top_conv", "top_depth"]
    state = durable(nodes.select("conv", "depth", "parent", "size", *[values[v].cast("long").alias(v) for v in names], F.lit(root["conv"]).alias("top_conv"),
                                 F.lit(0).cast("long").alias("top_depth"), F.lit(root["size"]).alias("whole")), "state")
    small, added = [], []
    while True:
        small.append(state.filter(F.col("whole") <= cut))
        big = state.filter(F.col("whole") > cut)
        heavy = big.filter("2 * size >= whole").groupBy(*top, "whole").agg(F.max(F.struct("depth", "conv", "size")).alias("c"))
        centres = durable(heavy.select(*top, "whole", F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"),
                                       F.col("c.size").alias("c_size")), "centres")
        if centres.isEmpty():
            break
        path = durable(_paths(centres, members), "paths")
        state, totals = _split(big, centres, path, members, names)
        added.append(durable(_salted(path, totals, "path").select("conv", "depth", *names), "added"))
    parts = [*added, *[_finished(s, names) for s in small]]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("conv", "depth").agg(*[F.sum(v).alias(v) for v in names])


def _paths(centres: DataFrame, members: DataFrame) -> DataFrame:
    """(conv, depth, top_conv, top_depth, whole): the nodes from each centroid up to its component's top."""
    reach = centres.select("top_conv", "top_depth", "whole", "c_conv", "c_depth",
                           F.explode(F.expr(f"sequence(top_depth div {BLOCK}, c_depth div {BLOCK})")).alias("block"))
    rows = members.select(F.col("conv").alias("c_conv"), "depth", "node", F.expr(f"depth div {BLOCK}").alias("block"))
    return (reach.join(rows, ["c_conv", "block"]).filter("depth BETWEEN top_depth AND c_depth")
            .select(F.col("node").alias("conv"), "depth", "top_conv", "top_depth", "whole"))


def _salted(rows: DataFrame, facts: DataFrame, what: str) -> DataFrame:
    """Give each row the facts of its component, over as many salts as the component's weight asks for."""
    salts = F.expr(f"whole div {SALT_ROWS}")
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts))).drop("whole")
    return rows.withColumn("salt", F.pmod(F.xxhash64("conv", "depth"), salts + 1)).join(copies, ["top_conv", "top_depth", "salt"]).drop("salt")


def _split(big: DataFrame, centres: DataFrame, path: DataFrame, members: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The components after their centroids have gone, and the sums of values at and below each centroid."""
    seen = _salted(big, centres, "centre")
    kids = seen.filter("parent = c_conv AND depth = c_depth + 1").select(
        F.col("conv").alias("k_conv"), F.col("depth").alias("k_depth"), F.col("size").alias("k_size"), "top_conv", "top_depth")
    rows = members.select("conv", F.col("depth").alias("k_depth"), F.col("node").alias("k_conv"), "length")
    under = (kids.join(rows, ["k_conv", "k_depth"])
             .withColumn("block", F.explode(F.expr(f"sequence(k_depth div {SALT_ROWS}, length div {SALT_ROWS})"))).drop("length"))
    on_path = path.select("conv", "depth", F.lit(True).alias("on_path"))
    placed = (seen.withColumn("block", F.expr(f"depth div {SALT_ROWS}"))
              .join(under, ["conv", "top_conv", "top_depth", "block"], "left").join(on_path, ["conv", "depth"], "left"))
    below = F.coalesce(F.col("depth") >= F.col("k_depth"), F.lit(False))
    centre = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    lost = F.when(F.col("on_path") & ~below, F.col("c_size")).otherwise(0)
    told = durable(placed.select(
        "conv", "depth", "parent", (F.col("size") - lost).alias("size"), *names, "top_conv", "top_depth", "whole", "c_size", below.alias("below"),
        centre.alias("centre"), "k_conv", "k_depth", "k_size"), "split")
    totals = told.filter("below OR centre").groupBy("top_conv", "top_depth", "whole").agg(*[F.sum(v).alias(v) for v in names])
    state = told.filter("NOT centre").select(
        "conv", "depth", "parent", "size", *names, F.when(F.col("below"), F.col("k_conv")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(F.col("below"), F.col("k_depth")).otherwise(F.col("top_depth")).alias("top_depth"),
        F.when(F.col("below"), F.col("k_size")).otherwise(F.col("whole") - F.col("c_size")).alias("whole"))
    return state, totals


def _finished(state: DataFrame, names: list[str]) -> DataFrame:
    """The same splitting inside tasks, for components that are small."""
    chosen = state.select("top_conv", "top_depth", "depth", "conv", "parent", "size", *names)
    schema = state.select("conv", "depth", *names).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:2] != held[0][:2]:
                    done += split_here(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], pa_schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in split_here(held)], pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    return chosen.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth", "conv").mapInArrow(work, schema)


def split_here(rows: list[tuple]) -> list[tuple]:
    """(conv, depth, sums) of one component's nodes (top_conv, top_depth, depth, conv, parent, size, values), by depth."""
    at = {(r[3], r[2]): i for i, r in enumerate(rows)}
    up = [at.get((r[4], r[2] - 1), -1) for r in rows]
    size = [r[5] for r in rows]
    sums = [[0] * (len(rows[0]) - 6) for _ in rows]
    parts = [list(range(len(rows)))]
    while parts:
        part = parts.pop()
        centre = max(i for i in part if 2 * size[i] >= size[part[0]])  # rows come by depth: the last is the deepest
        child: dict[int, int] = {}  # node below the centroid -> child of the centroid above it
        groups: dict[int, list[int]] = {}
        rest = []
        for i in part:
            if i == centre:
                continue
            kid = i if up[i] == centre else child.get(up[i])
            if kid is None:
                rest.append(i)
            else:
                child[i] = kid
                groups.setdefault(kid, []).append(i)
        total = [sum(rows[i][6 + k] for i in (centre, *child)) for k in range(len(sums[0]))]
        node = centre
        while True:
            sums[node] = [s + t for s, t in zip(sums[node], total)]
            if node != centre:
                size[node] -= size[centre]
            if node == part[0]:
                break
            node = up[node]
        parts += [g for g in (rest, *groups.values()) if g]
    return [(r[3], r[2], *s) for r, s in zip(rows, sums)]


def ends(members: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas.

    A hash has to read its input in order. Ids are joined in pieces of bounded size first, and one
    task streams the pieces of a node through the hash; it never holds them together.
    """
    last = members.filter("depth = length").select(F.col("node").alias("at"), "depth", F.col("conv").alias("id"))
    placed = with_index(last, ["id"], ["at", "depth"], "i", 0)
    pieces = placed.groupBy("at", "depth", F.expr(f"i div {PIECE}").alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda c: c.cast("string")), ",").alias("ids"))
    kind = members.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for at, depth, ids in zip(*[batch.column(n).to_pylist() for n in ("at", "depth", "ids")]):
                if (at, depth) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (at, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(done, batch.column("at").type)
        if now:
            yield _rows([(*now, digest.hexdigest())], batch.column("at").type)

    return (pieces.repartition("at", "depth").sortWithinPartitions("at", "depth", "piece").select("at", "depth", "ids")
            .mapInArrow(work, f"conv {kind}, depth long, ends_sha256 string"))


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*done)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string()))], names=["conv", "depth", "ends_sha256"])


def shared_prefixes(steps: DataFrame, cut: int = CUT) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``saved_tokens`` sums (n_convs - 1) times the bytes of a node's last text over its subtree: what storing each shared
    beginning once would save.
    """
    nodes, members = trie(steps)
    sums = rollup(nodes, members, {"n_leaves": F.col("n_children") == 0, "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}, cut)
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, ["conv", "depth"]).join(ends(members), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
