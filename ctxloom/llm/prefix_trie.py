"""The trie of conversations' prefixes, all of them aggregated by one ROLLUP.

A turn's id is a digest of its role and text, so texts don't travel. A conversation is cut into blocks
of BLOCK turns, a row of positional turn-id columns each; ROLLUP over them, beside the block and the
node where it begins, gives every prefix of every conversation, and grouping_id its depth.
A node is known by its depth and an exclusive-or of hashes of (place, turn id) along its path, so that
a block's node follows from sums and not from a walk through the blocks ahead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .ordered import KEY, SPAN, ahead_of, runs

BLOCK = 8
NODE = ["depth", "z1", "z2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_id, chars of turns (conv_id, turn, role, text).

    Turns stand by `turn`, null first; equal ones by the digest of role and text. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out. Rows are numbered
    by runs of a global sort, so that a conversation of any length isn't one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("conv_id").cast("long").alias(KEY), "turn", turn_id.alias("turn_id"), F.length(text).alias("chars"), F.spark_partition_id().alias("split"))
    order = ["conv_id", F.asc_nulls_first("turn"), "turn_id", "split"]
    numbered, groups = runs(rows, order, order, "turns")
    return numbered.join(groups.select("part", "run", "before"), ["part", "run"]).select("conv_id", (F.col("before") + F.col("pos")).alias("place"), "turn_id", "chars")


def rebuilt(turns: DataFrame, stride: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): every conversation c begins with the first h turns of c - c % stride, then has its own after its first h; h = crc32(c) % most.

    conversations (conv_id, length) has those without a turn left as well. turns as of numbered_turns().
    """
    numbered = materialise(numbered_turns(turns), "numbered-turns")
    heads = numbered.where((F.col("conv_id") % stride == 0) & (F.col("place") < most - 1)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "chars"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("top", F.col("conv_id") - F.col("conv_id") % stride)
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,turn_id:binary,chars:int>>")), F.lit(1), F.col("h"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "top"), "top", "left").select("conv_id", "n", "h", head.alias("head"))
    convs = materialise(convs.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = numbered.join(convs.select("conv_id", "h", F.size("head").alias("taken")), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_id", "chars")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.place", "t.turn_id", "t.chars")
    return convs.select("conv_id", "length"), own.unionByName(first)


def _hash(seed: int, turn: Column, place: Column) -> Column:
    return F.xxhash64(F.lit(seed), turn, place.cast("long"))


def _blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, block, node (k1, k2) where it begins, its turns in order, and where it ends (e1, e2); a conversation without turns has an empty block."""
    cut = turns.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "turn_id", "chars"))).alias("turns"),
        *[F.bit_xor(_hash(seed, F.col("turn_id"), F.col("place"))).alias(f"x{seed}") for seed in (1, 2)],
    )
    zero = F.lit(0).cast("long")
    none = convs.where("length = 0").select("conv_id", zero.alias("block"), F.array().cast("array<struct<place:bigint,turn_id:binary,chars:int>>").alias("turns"), zero.alias("x1"), zero.alias("x2"))
    chained = ahead_of(cut.unionByName(none), ["conv_id"], "block", {"k1": ("x1", "xor"), "k2": ("x2", "xor")})
    turn = lambda k: F.struct(F.get("turns", F.lit(k)).turn_id.alias("id"), F.get("turns", F.lit(k)).chars.alias("chars"))
    columns = [F.when(F.size("turns") > k, turn(k)).alias(f"t{k + 1}") for k in range(BLOCK)]
    return chained.select("conv_id", "block", "k1", "k2", (F.col("block") * BLOCK + F.size("turns")).alias("end"), *columns, *[F.col(f"k{s}").bitwiseXOR(F.col(f"x{s}")).alias(f"e{s}") for s in (1, 2)])


def _rollup(blocks: DataFrame, figures: str) -> DataFrame:
    """depth, z1, z2, parent (p1, p2), chars of the last turn and the figures of every prefix."""
    names = [f"t{k + 1}" for k in range(BLOCK)]
    columns = ", ".join(names)
    found = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {columns}, {BLOCK} - bit_count(grouping_id()) AS level, {figures} FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({columns})",
        blocks=blocks,
    )
    # below a conversation's end a row has no turn, and a block's own node is the last of the block before
    last = F.get(F.array(*names), F.col("level") - 1)
    found = found.withColumn("last", F.when(F.col("level") > 0, last)).where("last is not null or (level = 0 and block = 0)")
    depth = F.col("block") * BLOCK + F.col("level")
    ids = []
    for seed in (1, 2):
        steps = [F.when(F.col("level") > k, _hash(seed, F.col(f"{name}.id"), F.col("block") * BLOCK + k)).otherwise(0) for k, name in enumerate(names)]
        z = F.col(f"k{seed}")
        for step in steps:
            z = z.bitwiseXOR(step)
        ids += [z.alias(f"z{seed}"), F.when(F.col("level") > 0, _hash(seed, F.col("last.id"), depth - 1)).otherwise(0).alias(f"step{seed}")]
    given = [c for c in found.columns if c not in ("block", "k1", "k2", *names, "level", "last")]
    out = found.select(depth.alias("depth"), *ids, F.coalesce("last.chars", F.lit(0)).alias("chars"), *given)
    return out.withColumns({f"p{s}": F.col(f"z{s}").bitwiseXOR(F.col(f"step{s}")) for s in (1, 2)}).drop("step1", "step2")


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations (conv_id, length) and their turns (conv_id, place, turn_id, chars).

    nodes: depth, z1, z2 (together the node), conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the characters of the last turn). ends:
    conv_id and the node where the conversation ends. Repeated conversations share all nodes. Without
    conversations there is no node; a conversation without turns is a member of the root alone.

    A subtree's sum is taken from its members by the same ROLLUP: a node's figure is carried by its
    smallest member, whose nodes are a chain; what the chain holds above a node is subtracted.
    """
    blocks = materialise(_blocks(convs, turns), "trie-blocks")
    nodes = materialise(_rollup(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"), "trie-nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("z1"), F.col("p2").alias("z2")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    own = nodes.select(*NODE, "conv_id", "n_convs", saved, "p1", "p2").join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = materialise(ahead_of(own, ["conv_id"], "depth", {"above": ("saved", "sum")}), "trie-chains")
    chains = own.groupBy("conv_id").agg(F.sum("saved").alias("chain"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    sums = _rollup(blocks.join(chains, "conv_id"), "sum(chain) AS chains, sum(leaf) AS n_leaves").select(*NODE, "chains", "n_leaves")
    # own is read from a table for both sides, so that AQE can split a node with very many children
    parents = own.select((F.col("depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(parents, ["depth", "p1", "p2"], "left").join(sums, NODE)
    out = out.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("chains") - F.col("above")).alias("saved_tokens"))
    ends = blocks.select("conv_id", F.col("end").alias("depth"), F.col("e1").alias("z1"), F.col("e2").alias("z2")).join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi")
    return out, ends


def member_digests(ends: DataFrame) -> DataFrame:
    """depth, z1, z2, ends_sha256: SHA-256 of the ids that end in a node, ascending, with commas between them.

    Ids are joined in spans of SPAN numbers, which can hold no more than so many, and a node's spans
    are hashed as a stream, so that no row holds a node's ids.
    """
    span = F.floor(F.col("conv_id") / SPAN)
    joined = ends.groupBy(*NODE, span.alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row(node: tuple, digest: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([node[2]], pa.int64()), pa.array([digest])], names=[*NODE, "ends_sha256"])

        for frame in frames:
            out = []
            for *node, ids in zip(*(frame.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if tuple(node) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append(row(now, state.hexdigest()))
                now, state = tuple(node), hashlib.sha256(ids.encode())
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        if now is not None:
            yield row(now, state.hexdigest())

    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "span").mapInArrow(fold, "depth long, z1 long, z2 long, ends_sha256 string")
