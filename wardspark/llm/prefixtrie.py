"""Trie of conversation prefixes, built from vertical bitmaps.

A node of depth d is a distinct sequence of the first d turns (role, text). Conversations lie in shards of 4,096
neighbouring ids. A shard's index maps (position, turn) to the bitset of its conversations that have that turn there. From
the root's bitset, depth first, a parent's bitset is intersected with the postings of the next position: each
intersection is a child, its population count the child's members in the shard; the conversations that end at a node are
the parent's bitset and the bitset of that length. A conversation that is alone needs no more intersections, its
remaining turns are a chain.

Shards are merged by the nodes' keys, 128-bit hashes of the turns so far. Sums over subtrees need each node once: a node
belongs to the shard of its smallest member. A second pass over the shards adds up, from the leaves, what the shard's own
nodes contribute to each of its nodes, and a last grouping adds the shards.

Scale: turns enter the shards as MD5 of role and text, position and length; texts are never shuffled. A node that a third
of all conversations share is one row per shard. Its end list comes as one list per shard, in order of ids, and is hashed
as a stream. The tables of heads and lengths are joined by key. The order of turns is found in ranges of 1,024 turn
numbers, so the turns of one very long conversation are ordered by several tasks; a shard holds their digests together.

Defined cases: a null role or text is empty. A null turn is first; equal turns are ordered by role, then text. Rows
with a null conversation id belong to no conversation. A conversation without turns is a member of the root. An empty
table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import join_checked
from wardspark.session import materialize

_U = np.uint64


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, ord, md5, bytes): the place of each turn in its conversation, from 0, and a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        text.alias("text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    ranged = t.withColumn("range", F.floor(F.col("turn") / 1024))
    near = Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = ranged.select("conv", "range", F.row_number().over(near).alias("near"), digest.alias("md5"),
                           F.octet_length("text").cast("long").alias("bytes"))
    sizes = rows.where(F.col(conv_col).isNotNull()).groupBy(
        F.col(conv_col).cast("long").alias("conv"), F.floor(F.col(turn_col).cast("long") / 1024).alias("range")).agg(
        F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv").orderBy(F.asc_nulls_first("range")).rowsBetween(Window.unboundedPreceding, -1)
    # only conversations of several ranges have rows here
    before = materialize(sizes.withColumn("before", F.sum("n").over(ahead)).where("before > 0").select(
        F.col("conv").alias("c"), F.col("range").alias("r"), "before"), "trie-ranges")
    on = (F.col("conv") == F.col("c")) & F.col("range").eqNullSafe(F.col("r"))
    return join_checked(placed, before, on, "left").select(
        "conv", (F.col("near") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("ord"), "md5", "bytes")


def with_shared_heads(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """(conv, depth, md5, bytes): the first ``head`` turns of the conversation ``base``, then the conversation's own
    turns after its first ``head``; both are expressions of the column ``conv``. A conversation left without turns has
    one row of depth 0.
    """
    turns = materialize(turns, "trie-turns")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", base.alias("base"),
                                                                          head.cast("long").alias("head"))
    size = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    plan = materialize(convs.join(size, "base", "left").select(
        "conv", "own", "base", "head", F.least("head", F.coalesce("base_own", F.lit(0))).alias("taken")), "trie-plan")
    most = plan.agg(F.max("taken")).first()[0] or 0
    starts = turns.where(F.col("ord") < most).select(F.col("conv").alias("base"), "ord", "md5", "bytes")
    first = plan.where("taken > 0").join(starts, "base").where("ord < taken").select(
        "conv", (F.col("ord") + 1).alias("depth"), "md5", "bytes")
    rest = turns.join(plan.select("conv", "head", "taken"), "conv").where("ord >= head").select(
        "conv", (F.col("ord") - F.col("head") + F.col("taken") + 1).alias("depth"), "md5", "bytes")
    bare = plan.where("taken = 0 and own <= head").select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("md5"), F.lit(0).cast("long").alias("bytes"))
    return first.unionByName(rest).unionByName(bare)


def _shards(conversations: DataFrame) -> DataFrame:
    """(conv, place): places ascend with the id and are consecutive in a partition, so their upper bits name a shard.

    The table is written, so that the cut, which is by a sample, stays as it is.
    """
    ids = materialize(conversations.select("conv").distinct(), "trie-ids")
    parts = max(1, -(-ids.count() // (1 << 18)))
    return materialize(ids.repartitionByRange(parts, "conv").sortWithinPartitions("conv").select(
        "conv", F.monotonically_increasing_id().alias("place")), "trie-places")


def _bitset(at: np.ndarray, size: int) -> int:
    flags = np.zeros(size, np.uint8)
    flags[at] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int, size: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((size + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:size])


def _levels(depth: np.ndarray):
    """Begin and end of each run of equal numbers."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(depth), 1), bool), depth[1:] != depth[:-1]]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(depth)][:len(starts)], strict=True)


def _prefix_keys(conv: np.ndarray, depth: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """128-bit key of the turns so far, for rows in order of depth; ``digest``: two 64-bit numbers a row."""
    n = int(conv.max(initial=-1)) + 1
    state = np.tile(np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64), (n, 1))
    keys = np.empty_like(digest)
    for lo, hi in _levels(depth):
        c = conv[lo:hi]
        a, b = state[c, 0], state[c, 1]
        x = bytesx.mix(a * _U(0x9E3779B97F4A7C15) + digest[lo:hi, 0]) ^ bytesx.mix(b + digest[lo:hi, 1])
        y = bytesx.mix(b * _U(0xC2B2AE3D27D4EB4F) + digest[lo:hi, 1] + x)
        state[c, 0], state[c, 1] = x, y
        keys[lo:hi, 0], keys[lo:hi, 1] = x, y
    return keys


class VerticalIndex:
    """Postings (position, turn) -> bitset of a shard's conversations, kept where at least two share the turn."""

    def __init__(self, n: int, conv: np.ndarray, depth: np.ndarray, digest: np.ndarray):
        """Rows: conversation 0 to n - 1, position from 1, two 64-bit numbers of the turn."""
        self.n = n
        self.length = np.zeros(n, np.int64)
        np.maximum.at(self.length, conv, depth)
        order = np.lexsort((conv, digest[:, 1], digest[:, 0], depth))
        c, p, g = conv[order], depth[order], digest[order]
        new = np.ones(len(c), bool)
        new[1:] = (p[1:] != p[:-1]) | (g[1:] != g[:-1]).any(1)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(c)))
        at = {}
        for s, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            bits = _bitset(c[s:s + k], n)
            for x in c[s:s + k].tolist():
                at[int(p[s]), x] = bits
        self.posting = at
        by_length = np.argsort(self.length, kind="stable")
        cut = np.flatnonzero(np.diff(self.length[by_length], prepend=-1))
        self.ends = {int(self.length[part[0]]): _bitset(part, n) for part in np.split(by_length, cut[1:]) if len(part)}

    def nodes(self):
        """(depth, bitset, bitset of those that end there) of every node, parents first, but for the nodes below one
        that has a single member; those single members are returned with the depth at which they are alone."""
        shared: list[tuple[int, int, int]] = []
        alone: list[tuple[int, int]] = []
        stack = [(0, (1 << self.n) - 1)]
        while stack:
            depth, members = stack.pop()
            ends = members & self.ends.get(depth, 0)
            shared.append((depth, members, ends))
            rest = members & ~ends
            while rest:
                low = (rest & -rest).bit_length() - 1
                child = rest & self.posting.get((depth + 1, low), 1 << low)
                rest ^= child
                if child & (child - 1):
                    stack.append((depth + 1, child))
                else:
                    alone.append((depth + 1, low))
        return shared, alone


_LOCAL = ("shard long, k1 long, k2 long, p1 long, p2 long, depth long, conv long, n long, bytes long, ends array<long>")


def _local_nodes(t: pa.Table, bits: int) -> pa.Table:
    """Nodes of one shard: key, parent's key, depth, least member, members, bytes of the last text, ids that end there."""
    t = t.combine_chunks()
    shard = t["place"][0].as_py() >> bits
    place, depth, size, ids = (t[c].to_numpy() for c in ("place", "depth", "bytes", "conv"))
    conv = place & ((1 << bits) - 1)
    n = int(conv.max()) + 1
    name = np.zeros(n, np.int64)
    name[conv] = ids
    real = np.flatnonzero(depth > 0)
    real = real[np.lexsort((conv[real], depth[real]))]
    md5 = t["md5"].take(pa.array(real)).combine_chunks()
    raw = b"".join(md5.to_pylist())
    digest = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    conv, depth, size = conv[real], depth[real], size[real]
    keys = _prefix_keys(conv, depth, digest)
    # rows by conversation and depth: row of (c, d) is first[c] + d - 1
    by_conv = np.lexsort((depth, conv))
    keys, size = keys[by_conv], size[by_conv]
    index = VerticalIndex(n, conv, depth, digest)
    first = np.cumsum(index.length) - index.length
    shared, alone = index.nodes()
    d = np.array([x[0] for x in shared], np.int64)
    low = np.array([(x[1] & -x[1]).bit_length() - 1 for x in shared], np.int64)
    count = np.array([x[1].bit_count() for x in shared], np.int64)
    ends = [name[_members(x[2], n)] if x[2] else name[:0] for x in shared]
    # chains: all depths from where a conversation is alone to its end
    start, who = (np.array(x, np.int64) for x in (zip(*alone, strict=True) if alone else ((), ())))
    links = index.length[who] - start + 1
    chain_low = np.repeat(who, links)
    chain_d = np.repeat(start, links) + np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
    last = chain_d == index.length[chain_low]
    d, low = np.concatenate([d, chain_d]), np.concatenate([low, chain_low])
    count = np.concatenate([count, np.ones(len(chain_d), np.int64)])
    n_ends = np.concatenate([[len(e) for e in ends], last]).astype(np.int64)
    ended = np.concatenate([*ends, name[chain_low[last]]]) if len(n_ends) else name[:0]
    row = first[low] + d - 1
    root, top = d == 0, d <= 1

    def key(at, none):
        out = np.zeros((len(at), 2), np.uint64)
        out[~none] = keys[at[~none]]
        return out.view(np.int64)

    own, parent = key(row, root), key(row - 1, top)
    length = np.zeros(len(d), np.int64)
    length[~root] = size[row[~root]]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ends)]).astype(np.int32)), pa.array(ended))
    return pa.table({"shard": np.full(len(d), shard), "k1": own[:, 0], "k2": own[:, 1], "p1": parent[:, 0],
                     "p2": parent[:, 1], "depth": d, "conv": name[low], "n": count, "bytes": length, "ends": lists})


def _subtrees(t: pa.Table) -> pa.Table:
    """What the nodes of one shard contribute to the sums over the subtrees of its nodes."""
    t = t.combine_chunks()
    k1, k2, p1, p2, depth, conv, n, size, g_conv, g_children = (
        t[c].to_numpy() for c in ("k1", "k2", "p1", "p2", "depth", "conv", "n", "bytes", "g_conv", "g_children"))
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    own, parent = np.empty(len(k1), pair), np.empty(len(k1), pair)
    own["a"], own["b"], parent["a"], parent["b"] = k1, k2, p1, p2
    order = np.argsort(own)
    up = order[np.minimum(np.searchsorted(own[order], parent), len(own) - 1)]
    mine = conv == g_conv
    saved = n * size - mine * size
    leaves = (mine & (g_children == 0)).astype(np.int64)
    by_depth = np.argsort(-depth, kind="stable")
    for lo, hi in _levels(depth[by_depth]):
        at = by_depth[lo:hi]
        if depth[at[0]]:
            np.add.at(saved, up[at], saved[at])
            np.add.at(leaves, up[at], leaves[at])
    above = np.where(depth > 0, g_conv[up], 0)
    return pa.table({"k1": k1, "k2": k2, "parent": pa.array(above, mask=depth == 0), "saved": saved, "leaves": leaves})


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, sha): SHA-256 of the ids that end at a node; a node's lists come in order and are hashed as a stream."""
    def run(batches):
        key, sha, comma = None, None, b""
        for b in batches:
            done = []
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, ids in enumerate(b.column(2)):
                k = (int(k1[i]), int(k2[i]))
                if k != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha, comma = k, hashlib.sha256(), b""
                sha.update(comma + ",".join(map(str, ids.values.to_numpy().tolist())).encode())
                comma = b","
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "sha"), r, strict=True)) for r in done], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "sha": sha.hexdigest()}], schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())])
    sorted_ends = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv").select("k1", "k2", "ends")
    return sorted_ends.mapInArrow(run, "k1 long, k2 long, sha string")


def trie(conversations: DataFrame, shard_bits: int = 12) -> DataFrame:
    """Nodes of the trie of (conv, depth, md5, bytes) rows: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    ``depth``: 1, 2, ... within a conversation without gaps; a row of depth 0 names a conversation without turns. A
    shard has 2 ** ``shard_bits`` conversations.
    """
    conversations = materialize(conversations, "trie-rebuilt")
    placed = conversations.join(_shards(conversations), "conv")
    local = materialize(
        placed.select("place", "conv", "depth", "md5", "bytes", F.shiftright("place", shard_bits).alias("shard"))
        .groupBy("shard").applyInArrow(lambda t: _local_nodes(t, shard_bits), _LOCAL), "trie-local")
    merged = local.groupBy("k1", "k2").agg(
        F.min("conv").alias("g_conv"), F.sum("n").alias("g_n"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("depth").alias("depth"))
    merged = materialize(merged, "trie-merged")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("g_children"))
    nodes = materialize(merged.select("k1", "k2", "depth", "g_conv", "g_n").join(children, ["k1", "k2"], "left").select(
        "k1", "k2", F.col("depth").alias("g_depth"), "g_conv", "g_n", F.coalesce("g_children", F.lit(0)).alias("g_children")),
        "trie-nodes")
    sums = (local.drop("ends").join(nodes, ["k1", "k2"])
            .select("shard", "k1", "k2", "p1", "p2", "depth", "conv", "n", "bytes", "g_conv", "g_children")
            .groupBy("shard").applyInArrow(_subtrees, "k1 long, k2 long, parent long, saved long, leaves long")
            .groupBy("k1", "k2").agg(F.first("parent").alias("parent"), F.sum("saved").alias("saved"),
                                     F.sum("leaves").alias("leaves")))
    hashes = _end_hashes(local.where(F.size("ends") > 0).select("k1", "k2", "conv", "ends"))
    return (nodes.join(sums, ["k1", "k2"]).join(hashes, ["k1", "k2"], "left").select(
        F.col("g_conv").alias("conv_id"), F.col("g_depth").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("g_n").alias("n_convs"), F.col("g_children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
