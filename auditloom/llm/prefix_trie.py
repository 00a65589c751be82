"""Prefix trie of conversations by hashes of blocks of turns.

A turn is its role and text; only a 128-bit digest and its length in code points travel. Each
conversation is cut into blocks of ``BLOCK`` turns; its last block may be shorter or empty. A block's
digest is the exclusive-or of its turns' hashes, each tagged with its depth, so digests of successive
blocks add up to the digest of any prefix, and a running exclusive-or in chunks (``scale.running``)
names the prefix before each block, also in a conversation that holds a third of all turns.

First conversations are grouped by (prefix before the block, block). Where all conversations of a prefix
go on with one and the same block, its turns are the nodes as they stand. Only where siblings diverge is
the block refined: the distinct blocks, not the conversations, are cut at each turn and grouped again.
Groups are sums, counts and smallest ids, which combine before the shuffle.

Subtree figures need no walk. A conversation owns a node if it is the smallest member; it then owns the
rest of its path, so what it shares with smaller ids is one number, the characters above its first own
node. Over the members of a node at which ``above`` characters precede the node's own text:

* leaves: members that own a childless node, each of which is one leaf;
* saved characters: sum over all members but the owner of (shared characters - ``above``).

Defined results: a null ``role`` or ``text`` is the empty one; rows without ``conv_id`` belong to no
conversation; rows of one conversation that tie in ``turn`` are ordered by the digest of role and text,
repeated rows are repeated turns; a conversation rebuilt without turns is a member of the root only; an
empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.scale import Prefix, running

from .common import materialize
from .ordering import numbered

#: Turns of a block.
BLOCK = 4
#: Conversations whose base is shared: blocks of ids, and the number of shared lengths.
BASE_EVERY, SHARE_MODULO = 100, 6
#: Range of ids whose texts are joined into one row before the digest of all ends is streamed.
END_RANGE = 1024
_NODE = ["depth", "n1", "n2"]


def _xor(left: Column, right: Column) -> Column:
    return left.bitwiseXOR(right)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, k1, k2, chars) of every turn: digest and length instead of texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    light = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    light = materialize(light.select("conv_id", "turn", F.xxhash64(F.lit(1), "digest").alias("k1"), F.xxhash64(F.lit(2), "digest").alias("k2"), "chars",
                                     F.xxhash64(F.monotonically_increasing_id()).alias("spread")), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("spread")]
    return numbered(light, ["conv_id"], order, "at").select("conv_id", (F.col("at") + 1).alias("depth"), "k1", "k2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first conversation of their hundred: (conv_id, n_turns) and their turns.

    The opening has as many turns as a hash of the id says (fewer, if there are no more) and takes the
    place of as many own turns. It is at most five turns for at most 99 conversations, so nothing fans out.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARE_MODULO
    convs = counts.select("conv_id", "n_own", share.alias("share"), (F.col("conv_id") - F.col("conv_id") % BASE_EVERY).alias("base"))
    bases = counts.where(F.col("conv_id") % BASE_EVERY == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("opening", F.least("share", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = materialize(convs.withColumn("n_turns", F.col("opening") + F.greatest(F.lit(0).cast("long"), F.col("n_own") - F.col("share"))), "convs")
    own = turns.join(convs, "conv_id").where(F.col("depth") > F.col("share")).select(
        "conv_id", (F.col("depth") - F.col("share") + F.col("opening")).alias("depth"), "k1", "k2", "chars")
    first = turns.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("depth") < SHARE_MODULO)).withColumnRenamed("conv_id", "base")
    shared = first.join(convs, "base").where(F.col("depth") <= F.col("share")).select("conv_id", "depth", "k1", "k2", "chars")
    return convs.select("conv_id", "n_turns"), own.unionByName(shared)


def conversation_blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, block, turns, last) with d1, d2 (block), z1, z2 (prefix before it) and through (characters before it)."""
    turn = F.struct("depth", F.xxhash64("depth", "k1", "k2").alias("h1"), F.xxhash64("k2", "depth", "k1", F.lit(2)).alias("h2"), "chars")
    full = turns.select("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), turn.alias("turn"))
    full = full.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    ends = convs.select("conv_id", F.expr(f"n_turns div {BLOCK}").alias("tail"), (F.col("n_turns") % BLOCK == 0).alias("empty"))
    none = full.schema["turns"].dataType.simpleString()
    full = full.unionByName(ends.where("empty").select("conv_id", F.col("tail").alias("block"), F.array().cast(none).alias("turns")))
    zero = F.lit(0).cast("long")
    full = full.join(ends.select("conv_id", "tail"), "conv_id").select(
        "conv_id", "block", "turns", (F.col("block") == F.col("tail")).alias("last"),
        F.aggregate("turns", zero, lambda a, x: _xor(a, x["h1"])).alias("d1"), F.aggregate("turns", zero, lambda a, x: _xor(a, x["h2"])).alias("d2"),
        F.aggregate("turns", zero, lambda a, x: a + x["chars"]).alias("chars"))
    out = running(full, ["conv_id"], "block", [
        Prefix("z1", "xor", F.col("d1"), False), Prefix("z2", "xor", F.col("d2"), False), Prefix("through", "sum", F.col("chars"), False)])
    return materialize(out.fillna(0, ["z1", "z2", "through"]), "blocks")


def _cut(blocks: DataFrame, carry: list[str]) -> DataFrame:
    """One row for each turn of each block: the node there, the node above it and the characters above its text."""
    zero = F.lit(0).cast("long")

    def node(x: Column, i: Column) -> Column:
        head = F.slice("turns", F.lit(1), i)
        fold = lambda name: F.aggregate(head, zero, lambda a, y: _xor(a, y[name]))
        up1, up2 = _xor(F.col("z1"), fold("h1")), _xor(F.col("z2"), fold("h2"))
        return F.struct(x["depth"].alias("depth"), _xor(up1, x["h1"]).alias("n1"), _xor(up2, x["h2"]).alias("n2"), up1.alias("p1"), up2.alias("p2"),
                        (F.col("through") + F.aggregate(head, zero, lambda a, y: a + y["chars"])).alias("above"), (i == 0).alias("first"))

    return blocks.select(F.explode(F.transform("turns", node)).alias("node"), *carry).select("node.*", *carry)


def _sums(blocks: DataFrame, figures: list[Column], turns: bool) -> DataFrame:
    """Distinct blocks under each prefix with figures of the conversations that pass through them."""
    shape = [F.first("turns").alias("turns"), F.first("through").alias("through")] if turns else []
    return blocks.groupBy("block", "z1", "z2", "d1", "d2", F.size("turns").alias("n")).agg(*figures, *shape)


def _ends(blocks: DataFrame) -> DataFrame:
    """Nodes where conversations end: how many, and the digest of their ids in order, joined by commas.

    Ids are joined in ranges first; a task then streams the ranges of a node through one digest, which
    holds no more than a batch of them, however many conversations end there.
    """
    at = blocks.where("last").select((F.col("block") * BLOCK + F.size("turns")).alias("depth"), _xor(F.col("z1"), F.col("d1")).alias("n1"),
                                     _xor(F.col("z2"), F.col("d2")).alias("n2"), "conv_id", F.expr(f"conv_id div {END_RANGE}").alias("part"))
    parts = at.groupBy(*_NODE, "part").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    parts = parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "part")
    schema = pa.schema([("depth", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, count, digest = None, 0, None
        for batch in batches:
            done = []
            for *key, n, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "n", "ids"))):
                if key != node:
                    if node is not None:
                        done.append((*node, count, digest.hexdigest()))
                    node, count, digest = key, 0, hashlib.sha256()
                digest.update((("," if count else "") + ids).encode())
                count += n
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*done) if done else [[]] * 5, schema)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, count, digest.hexdigest()), schema)], schema=schema)

    return parts.mapInArrow(stream, "depth long, n1 long, n2 long, n_ends long, ends_sha256 string")


def _nodes(blocks: DataFrame) -> DataFrame:
    """All nodes with members, owner (conv_id), owner of the node above and characters above."""
    groups = _sums(blocks, [F.count("*").alias("members"), F.min("conv_id").alias("conv_id")], turns=True)
    groups = materialize(groups, "block-groups")
    prefixes = groups.groupBy("block", "z1", "z2").agg(
        F.count("*").alias("kinds"), F.min("conv_id").alias("prefix_conv_id"), F.sum("members").alias("prefix_members"))
    prefixes = materialize(prefixes, "prefixes")
    met = groups.join(prefixes, ["block", "z1", "z2"])
    alike = _cut(met.where("kinds = 1"), ["members", "conv_id"]).withColumn("parent_conv_id", F.col("conv_id")).drop("first")
    refined = _cut(met.where("kinds > 1"), ["members", "conv_id", "prefix_conv_id"]).groupBy(*_NODE).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("above").alias("above"), F.sum("members").alias("members"),
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("first"), F.col("prefix_conv_id"))).alias("boundary_conv_id"))
    refined = materialize(refined, "refined")
    up = refined.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("inner_conv_id"))
    inner = refined.where("boundary_conv_id is null").join(up, ["depth", "p1", "p2"])
    heads = refined.where("boundary_conv_id is not null").withColumn("inner_conv_id", F.col("boundary_conv_id"))
    diverged = inner.unionByName(heads).drop("boundary_conv_id").withColumnRenamed("inner_conv_id", "parent_conv_id")
    zero = F.lit(0).cast("long")
    root = prefixes.where("block = 0").select(
        *[zero.alias(c) for c in (*_NODE, "p1", "p2", "above")], F.col("prefix_members").alias("members"),
        F.col("prefix_conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"))
    return materialize(alike.unionByName(diverged).unionByName(root), "nodes")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, n_turns) and (conv_id, depth, k1, k2, chars).

    Columns: conv_id (smallest member; with ``depth`` it names the turn that holds the node's text), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.
    """
    blocks = conversation_blocks(convs, turns)
    nodes, ends = _nodes(blocks), materialize(_ends(blocks), "ends")
    nodes = nodes.join(ends, _NODE, "left")
    # of each conversation: the characters it shares with smaller ids, and whether it stands for a leaf
    first_own = nodes.where("parent_conv_id is null or conv_id <> parent_conv_id").select("conv_id", F.col("above").alias("shared"))
    leaves = nodes.where("n_ends = members").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    length = blocks.where("last").select("conv_id", (F.col("through") + F.col("chars")).alias("length"))
    own = length.join(first_own, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "length").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    figures = ["shared", "leaf", "owner_shared"]
    of_owner = F.min(F.struct("conv_id", "shared")).alias("owner")
    sums = _sums(blocks.join(own, "conv_id"), [F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf"), of_owner], turns=True)
    sums = materialize(sums, "block-sums")
    totals = [F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf"), F.min("owner").alias("owner")]
    each = _cut(sums, ["shared", "leaf", "owner"]).groupBy(*_NODE).agg(*totals)
    zero = F.lit(0).cast("long")
    every = sums.where("block = 0").groupBy(*[zero.alias(c) for c in _NODE]).agg(*totals)
    each = each.unionByName(every).select(*_NODE, "shared", "leaf", F.col("owner.shared").alias("owner_shared"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    out = nodes.join(children, _NODE, "left").join(each.select(*_NODE, *figures), _NODE)
    saved = F.col("shared") - F.col("owner_shared") - (F.col("members") - 1) * F.col("above")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("n_ends", zero).alias("n_ends"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt over their shared openings."""
    return prefix_trie(*rebuilt(ordered_turns(conversations)))
