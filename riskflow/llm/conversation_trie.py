"""The prefix trie of conversations, with subtree totals by centroid decomposition.

A turn is the digest of its role and text. A prefix is known by its length and the sums, lane
by lane, of hashes of its turns and their places; so prefixes are sums over the rows before a
row, which need no task to see a whole conversation. Conversations of equal prefix are the
members of a node, and the node is named by its smallest member and its depth.

Subtree totals come from the parent edges in levels. Every component of what is left of the
tree has one centroid: the deepest node with more than half of the component's weight below
it. What lies above half forms the path from the centroid to the component's top. The total
of the centroid's side is added to every node of that path; then the centroid goes, and its
children's sides and the rest are components of their own, at most half as heavy. So levels
grow with the logarithm of the turns, however deep a conversation is. A node weighs its
members, since then the weights of all subtrees are known beforehand.

Defined cases: a null role or text is empty; rows without a conversation's id take no part.
Turns come by number, null first; rows of one conversation with the same number come by
their digest, and rows that repeat are turns of their own. An empty table has no nodes.
Texts are digested whole where they are read and shuffled nowhere. Other columns play no
part, whatever their names. A conversation may have up to 2**31 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sums
from .stored import stored

BLOCK_TURNS = 4096
LANES = ("k1", "k2", "k3", "k4")
# Parts that a node's members are counted in, so that no task meets all members of one.
SALTS = 64


def numbered_turns(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Every turn as conv_id, its place from 0, the digest of role and text, and its characters."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    # Rows that repeat are counted before they are ordered.
    turns = turns.groupBy("conv_id", "turn", "digest").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("copies"))
    turns = running_sums(turns, ["conv_id"], ["turn", "digest"], {"first": "copies"})
    last = F.col("copies") - 1
    some = F.sequence(F.lit(0).cast("long"), last, F.lit(BLOCK_TURNS).cast("long"))
    turns = turns.withColumn("__some", F.explode(some))
    each = F.sequence("__some", F.least(F.col("__some") + (BLOCK_TURNS - 1), last))
    return turns.withColumn("__each", F.explode(each)).select(
        "conv_id", (F.col("first") + F.col("__each")).alias("place"), "digest", "chars"
    )


def with_shared_heads(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their group of ids.

    Conversation c takes the first h turns of conversation ``c - c % group`` (all if fewer,
    none if it is absent) in place of its own first h; h is the CRC-32 of c's digits modulo
    ``heads``. Returns the turns and, per conversation, its length.
    """
    turns = stored(turns, "turns")
    id_ = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.select("conv_id", "n", (F.crc32(id_.cast("string").cast("binary")) % heads).alias("h"), (id_ - id_ % group).alias("first"))
    leads = own.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    taken = F.least("h", F.coalesce("n_first", F.lit(0)))
    lengths = own.join(leads, "first", "left").withColumn("taken", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    lengths = stored(lengths.select("conv_id", "first", "h", "taken", length.alias("length")), "lengths")
    rest = turns.join(lengths.select("conv_id", "h", "taken"), "conv_id").filter(F.col("place") >= F.col("h"))
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars")
    # At most heads - 1 turns of one conversation, for at most 2 * group others.
    head = turns.filter(F.col("place") < heads - 1).withColumnRenamed("conv_id", "first")
    head = lengths.join(head, "first").filter(F.col("place") < F.col("h"))
    return head.select("conv_id", "place", "digest", "chars").union(rest), lengths.select("conv_id", "length")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``turns`` has conv_id, place, digest and chars (see :func:`numbered_turns`), ``lengths``
    every conversation's number of turns, which may be 0. Returns conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (characters
    that members share, over the subtree) and ends_sha256.
    """
    paths = stored(_paths(turns, lengths), "paths")
    # A node's own row is that of its smallest member.
    nodes = paths.filter(F.col("conv_id") == F.col("node")).drop("conv_id", "length")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    ends = ends_digests(paths.filter("depth = length").select("node", "depth", "conv_id"))
    values = nodes.select(
        "node", "depth", "weight",
        (F.col("ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = subtree_totals(values, paths.select("conv_id", "depth", "node", "parent"), ["n_leaves", "saved_tokens"])
    at = ["node", "depth"]
    return nodes.join(totals, at).join(children, at, "left").join(ends, at, "left").select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes that every conversation passes, and the numbers of each node."""
    depth = F.col("place") + 1
    hashed = turns.select(
        "conv_id", depth.alias("depth"), "chars",
        F.md5(F.concat(depth.cast("string").cast("binary"), "digest")).alias("turn"),
    )
    lanes = {name: F.conv(F.substring("turn", 8 * i + 1, 8), 16, 10).cast("long") for i, name in enumerate(LANES)}
    hashed = hashed.select("conv_id", "depth", "chars", *[c.alias(f"own_{n}") for n, c in lanes.items()])
    block = F.floor(F.col("depth") / BLOCK_TURNS)
    summed = running_sums(hashed, ["conv_id"], ["depth"], {n: f"own_{n}" for n in LANES}, block=block)
    rows = summed.join(lengths, "conv_id").select(
        "conv_id", "length", "depth", "chars", *[(F.col(n) + F.col(f"own_{n}")).alias(n) for n in LANES]
    )
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", F.col("length").cast("long"), zero, zero, *[zero for _ in LANES])
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    rows = stored(rows.union(roots).withColumn("salt", salt), "prefixes")
    key = ["depth", *LANES]
    parts = rows.groupBy(*key, "salt").agg(
        F.min("conv_id").alias("node"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.max("chars").alias("chars"),
        F.count_if(F.col("length") == F.col("depth")).alias("ends"),
    )
    nodes = parts.groupBy(*key).agg(
        F.min("node").alias("node"), *[F.sum(c).alias(c) for c in ("n_convs", "weight", "ends")], F.max("chars").alias("chars")
    )
    known = parts.select(*key, "salt").join(nodes, key)
    passed = stored(rows.drop("chars").join(known, [*key, "salt"]).drop(*LANES, "salt"), "passed")
    above = passed.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    return passed.join(above, ["conv_id", "depth"], "left")


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's conv_ids in order, joined by commas.

    Ids stream through the hash in their order, so a node's ids are never held together.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            nodes, depths, ids = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((nodes[1:] != nodes[:-1]) | (depths[1:] != depths[:-1])) + 1
            out = []
            for start, stop in zip([0, *edges], [*edges, len(ids)]):
                if stop == start:
                    continue
                text = ",".join(map(str, ids[start:stop].tolist()))
                if (nodes[start], depths[start]) == node:
                    running.update(f",{text}".encode())
                    continue
                if node:
                    out.append((*node, running.hexdigest()))
                node, running = (nodes[start], depths[start]), hashlib.sha256(text.encode())
            if out:
                yield _records(out)
        if node:
            yield _records([(*node, running.hexdigest())])

    ordered = ends.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id")
    return ordered.mapInArrow(digest, "node long, depth long, ends_sha256 string")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    nodes, depths, digests = zip(*rows)
    columns = [pa.array(nodes, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "depth", "ends_sha256"])


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sums of the values over every node's subtree, the node included.

    ``nodes`` has node, depth, weight (of the subtree, greater than that of any part of it)
    and the values; ``paths`` has, per conversation and depth, the node passed there and that
    node's parent. Each level is a written table.
    """
    root = nodes.filter("depth = 0").first()
    if root is None:
        return nodes.select("node", "depth", *values)
    top = ["top", "top_depth"]
    # Written, so that joins on the first component's top have columns to join by, not literals.
    state = stored(nodes.withColumns({"top": F.lit(root["node"]), "top_depth": F.lit(0).cast("long")}), "level")
    look = paths.select(F.col("conv_id").alias("__conv"), F.col("depth").alias("__depth"), F.col("node").alias("__side"), F.col("parent").alias("__above"))
    added = []
    while not state.isEmpty():
        is_top = (F.col("node") == F.col("top")) & (F.col("depth") == F.col("top_depth"))
        totals = state.filter(is_top).select(*top, F.col("weight").alias("total"))
        whole = state.join(totals, top).withColumn("on_path", 2 * F.col("weight") > F.col("total"))
        deepest = F.max(F.struct(F.col("depth").alias("c_depth"), F.col("node").alias("c_node"), F.col("weight").alias("c_weight")))
        centroids = whole.filter("on_path").groupBy(*top).agg(deepest.alias("c")).select(*top, "c.*")
        # Nodes named like the centroid lie on its own path; of the others the path tells
        # whether they pass the centroid. Those not asked about get a key that none has.
        below, same = F.col("depth") > F.col("c_depth"), F.col("node") == F.col("c_node")
        asked = below & (F.col("node") > F.col("c_node"))
        key = F.when(asked, F.col("c_depth") + 1).otherwise(-1 - F.col("depth"))
        level = whole.join(centroids, top)
        level = level.join(look, (F.col("node") == F.col("__conv")) & (key == F.col("__depth")), "left")
        under = below & (same | F.coalesce(F.col("__above") == F.col("c_node"), F.lit(False)))
        level = level.select(
            "node", "depth", "weight", *values, *top, "on_path", "c_depth", "c_weight",
            (same & (F.col("depth") == F.col("c_depth"))).alias("is_centroid"),
            under.alias("is_under"),
            F.when(same, F.col("c_node")).otherwise(F.col("__side")).alias("side"),
        )
        level = stored(level, "level")
        sides = level.filter("is_under or is_centroid").groupBy(*top).agg(*[F.sum(v).alias(v) for v in values])
        added.append(level.filter("on_path").select("node", "depth", *top).join(sides, top).drop(*top))
        state = level.filter("not is_centroid").select(
            "node", "depth", *values,
            (F.col("weight") - F.when(F.col("on_path"), F.col("c_weight")).otherwise(0)).alias("weight"),
            F.when(F.col("is_under"), F.col("side")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("is_under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
    return reduce(DataFrame.union, added).groupBy("node", "depth").agg(*[F.sum(v).alias(v) for v in values])
