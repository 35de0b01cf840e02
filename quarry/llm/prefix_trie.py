"""The prefix trie of conversations, encoded shard by shard in balanced parentheses.

Conversations are sorted by their turns, so those with equal beginnings are neighbours, and dealt out to shards by ranges
of that order. A shard writes its nodes in preorder as parentheses: one opens where a turn sequence is new, and closes
where a later conversation leaves it. Blocks of least excess find the parenthesis that closes a node, which delimits its
subtree; ranks up to both ends then count leaves and nodes in it, and cumulative sums give what it saves. Only the
nodes on a shard's first and last path, its spines, can go on in other shards. They leave the shard as two paths with
what hangs on them, and all spines are merged by the same encoding once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, materialize, or_empty, table

#: Conversations of one family share the first conversation's beginning of fewer than SHARED turns.
FAMILY, SHARED = 5, 9
#: Turns of a shard, values of a block of excess, ids of one piece of a list of ends.
SHARD_TURNS, BLOCK, PIECE = 400_000, 64, 256
NEVER = np.iinfo(np.int64).max


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): one row per conversation with 16 bytes for each turn, in order, and its text's bytes.

    Turns are in order of turn, null first; equal ones by role and then by digest. Null roles and texts count as empty,
    and rows without conv_id belong to no conversation. Texts stay where they are; a conversation is one row of 24 bytes
    a turn.
    """
    role, text = or_empty(F.col("role")), or_empty(F.col("text"))
    turn = F.struct(F.col("turn").alias("n"), role.alias("role"), turn_digest(role, text).alias("h"), F.octet_length(text).cast("long").alias("s"))
    held = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return held.select("conv_id", F.col("t.h").alias("path"), F.col("t.s").alias("sizes"))


def rebuilt(held: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Conversations whose first crc32(conv_id) % shared turns are those of their family's first conversation.

    That is conversation c - c % family; the turns are as many as it has, none where it is absent.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % family, F.crc32(F.col("conv_id").cast("string")) % shared
    heads = held.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, shared - 1).alias(f"head_{c}") for c in ("path", "sizes")])
    met = held.withColumns({"base": base, "h": h.cast("int")}).join(heads, "base", "left")

    def joined(c: str) -> Column:
        own = F.expr(f"slice({c}, h + 1, greatest(size({c}) - h, 0))")
        return F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0)), own)

    return met.select("conv_id", joined("path").alias("path"), joined("sizes").alias("sizes"))


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each opening parenthesis the place of the one that closes it: the first where the excess is lower.

    Blocks of BLOCK values keep their least one, blocks of these likewise; a search runs to the end of its block, then
    over blocks of ever higher levels, and down again into the block that holds the place.
    """
    levels = [excess]
    while len(levels[-1]) > BLOCK:
        low = levels[-1]
        levels.append(np.pad(low, (0, -len(low) % BLOCK), constant_values=np.iinfo(low.dtype).min).reshape(-1, BLOCK).min(1))
    at, goal = opens + 1, excess[opens] - 1

    def scan(level: int, some: np.ndarray) -> np.ndarray:
        """Move to the first value in the block that reaches the goal; those that find none, now at the next block."""
        beyond = []
        while len(some):
            some = some[levels[level][at[some]] > goal[some]]
            at[some] += 1
            ended = at[some] % BLOCK == 0
            beyond.append(some[ended])
            some = some[~ended]
        return np.concatenate(beyond) if beyond else some

    some, found = np.arange(len(opens)), []
    for level in range(len(levels)):
        rest = scan(level, some)
        found.append(np.setdiff1d(some, rest, assume_unique=True))
        at[rest] //= BLOCK
        some = rest
    down = some
    for level in range(len(levels) - 1, 0, -1):
        down = np.concatenate([found[level], down])
        at[down] *= BLOCK
        scan(level - 1, down)
    return at


class Trie(NamedTuple):
    """Nodes in preorder: the row that opens them, depth, parent, the node after their subtree and the row after it."""

    row: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    after: np.ndarray
    row_after: np.ndarray
    #: Nodes up to each row, its last turn's included.
    opened: np.ndarray
    #: depth and place in preorder as one number, in order.
    by_depth: np.ndarray
    leaves: np.ndarray

    def at(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node that a row's path has at a depth: the last one of that depth so far."""
        n = len(self.row)
        return self.by_depth[np.searchsorted(self.by_depth, depth * n + self.opened[row]) - 1] % n

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each node's subtree."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.after] - sums[:-1]


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def build(lengths: np.ndarray, turns: np.ndarray) -> Trie:
    """The trie of paths in their order; turns (n, 2) holds the digests of all of them, one path after the other."""
    rows = len(lengths)
    starts = np.cumsum(lengths) - lengths
    both = np.minimum(lengths[1:], lengths[:-1])
    pair, place = np.repeat(np.arange(rows - 1), both), ragged(both)
    differ = np.flatnonzero((turns[starts[pair + 1] + place] != turns[starts[pair] + place]).any(1))
    common = both.copy()
    firsts, where = np.unique(pair[differ], return_index=True)
    common[firsts] = place[differ[where]]
    common = np.concatenate([[-1], common])  # turns shared with the row before
    new = lengths - common
    row, depth = np.repeat(np.arange(rows), new), ragged(new) + np.repeat(common + 1, new)
    n = len(row)
    closed = np.cumsum(np.concatenate([[0], lengths[:-1] - common[1:]]))
    opens = np.arange(n) + closed[row]
    parens = np.full(2 * n, -1, np.int8)
    parens[opens] = 1
    close = find_close(np.cumsum(parens, dtype=np.int32), opens)
    # Before its closing parenthesis stand as many that open as close, and depth more.
    after = (close + 1 + depth) // 2
    order = np.sort(depth * n + np.arange(n))
    parent = np.where(depth > 0, order[np.searchsorted(order, (depth - 1) * n + np.arange(n)) - 1] % n, -1)
    # A leaf is an opening and a closing parenthesis side by side.
    leaf = parens[opens + 1] == -1
    out = Trie(row, depth, parent, after, np.append(row, rows)[after], np.cumsum(new), order, leaf)
    return out._replace(leaves=out.below(leaf))


def _keys(turns: np.ndarray) -> list[bytes]:
    """A digest for each beginning of a path, the empty one first."""
    held, out = hashlib.blake2b(digest_size=16), []
    out.append(held.digest())
    for x in turns:
        held.update(x.tobytes())
        out.append(held.copy().digest())
    return out


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lengths of all paths, their turns, and the columns ``names``, lists flattened."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return np.empty(0, np.int64), np.empty((0, 2), np.uint64), [np.empty(0, np.int64) for _ in names]
    tab = pa.Table.from_batches(found).combine_chunks()
    path = tab.column("path").combine_chunks()
    lengths = np.asarray(path.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    turns = np.frombuffer(b"".join(path.flatten().to_pylist()), np.uint64).reshape(-1, 2) if lengths.any() else np.empty((0, 2), np.uint64)
    columns = []
    for name in names:
        column = tab.column(name).combine_chunks()
        columns.append(np.asarray((column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False), np.int64))
    return lengths, turns, columns


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"
SHARD = f"part string, {NODE}, ends_sha256 string, parent_key binary, key binary, first long, piece string, path array<binary>, sizes array<long>, counts array<long>, least array<long>, hang_children array<long>, hang_leaves array<long>, hang_saved array<long>"
MERGED = f"key binary, {NODE}, hanging long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    """Rows with the given columns, null in all others."""
    n = len(next(iter(columns.values())))
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], _KINDS[kind]) if k in columns else pa.nulls(n, _KINDS[kind]) for k, kind in fields], [k for k, _ in fields])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted paths to finished nodes, spines and the ends of spines."""
    lengths, turns, (conv, sizes) = _read(batches, ["conv_id", "sizes"])
    if not len(lengths):
        return
    trie = build(lengths, turns)
    n, starts = len(trie.row), np.cumsum(lengths) - lengths
    counts = trie.row_after - trie.row
    spans = np.stack([trie.row, trie.row_after], 1).ravel()
    least = np.minimum.reduceat(np.append(conv, NEVER), spans)[::2]
    size = np.where(trie.depth > 0, np.append(sizes, 0)[starts[trie.row] + trie.depth - 1], 0)
    spine = (trie.row == 0) | (trie.after == n)
    saved = trie.below(np.where(spine, 0, (counts - 1) * size))
    held = ~spine & spine[trie.parent]
    hang = [np.zeros(n, np.int64) for _ in range(3)]
    for into, values in zip(hang, (np.ones(n, np.int64), trie.leaves, saved)):
        np.add.at(into, trie.parent[held], values[held])
    children = np.bincount(trie.parent[1:], minlength=n)

    keys: dict[int, bytes] = {}
    for r in dict.fromkeys((0, len(lengths) - 1)):
        nodes = trie.at(np.full(lengths[r] + 1, r), np.arange(lengths[r] + 1))
        keys.update(zip(nodes.tolist(), _keys(turns[starts[r] : starts[r] + lengths[r]])))
        fresh = nodes if r == 0 else np.where(trie.row[nodes] == 0, -1, nodes)  # what both paths share counts once

        def one(values: np.ndarray, other: int = 0) -> list:
            return [np.where(fresh >= 0, values[fresh], other).tolist()]

        path = [[x.tobytes() for x in turns[starts[r] : starts[r] + lengths[r]]]]
        yield _batch(SHARD, {"part": ["spine"], "path": path, "sizes": [size[nodes].tolist()], "counts": one(counts), "least": one(least, NEVER), "hang_children": one(hang[0]), "hang_leaves": one(hang[1]), "hang_saved": one(hang[2])})

    # The conversations that end at a node are a run of rows, the first of which opens it.
    ends_at = trie.opened - 1
    runs = np.flatnonzero(np.append(True, ends_at[1:] != ends_at[:-1]))
    ids = conv.astype(str)
    ends = {}
    for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(lengths)]):
        node = int(ends_at[a])
        if spine[node]:
            pieces = range(a, b, PIECE)
            yield _batch(SHARD, {"part": ["ends"] * len(pieces), "key": [keys[node]] * len(pieces), "first": [int(conv[k]) for k in pieces], "piece": [",".join(ids[k : min(k + PIECE, b)]) for k in pieces]})
        else:
            ends[node] = hashlib.sha256(",".join(ids[a:b]).encode()).hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    done = np.flatnonzero(~spine)
    for some in np.array_split(done, max(1, len(done) // 50_000)):
        hangs = held[some]
        above = np.where(hangs, 0, least[trie.parent[some]]).tolist()
        yield _batch(SHARD, {
            "part": np.where(hangs, "hanging", "node").tolist(), "conv_id": least[some], "depth": trie.depth[some], "parent_conv_id": [None if h else x for h, x in zip(hangs, above)],
            "n_convs": counts[some], "n_children": children[some], "n_leaves": trie.leaves[some], "saved": saved[some], "ends_sha256": [ends.get(k, nothing) for k in some.tolist()],
            "parent_key": [keys[p] if h else None for h, p in zip(hangs, trie.parent[some].tolist())],
        })


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spines to their nodes, finished but for the ends."""
    names = ["sizes", "counts", "least", "hang_children", "hang_leaves", "hang_saved"]
    lengths, turns, (sizes, counts, least, *hang) = _read(batches, names)
    if not len(lengths):
        return
    trie = build(lengths, turns)
    n, cells = len(trie.row), lengths + 1
    node = trie.at(np.repeat(np.arange(len(lengths)), cells), ragged(cells))
    size, total, low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, NEVER)
    size[node] = sizes
    np.add.at(total, node, counts)
    np.minimum.at(low, node, least)
    sums = [np.zeros(n, np.int64) for _ in hang]
    for into, values in zip(sums, hang):
        np.add.at(into, node, values)
    children = sums[0] + np.bincount(trie.parent[1:], minlength=n)
    leaves = trie.below(sums[1] + (children == 0))
    saved = trie.below(sums[2] + (total - 1) * size)
    keys: list[bytes] = [b""] * n
    starts = np.cumsum(lengths) - lengths
    for r in range(len(lengths)):
        nodes = trie.at(np.full(lengths[r] + 1, r), np.arange(lengths[r] + 1))
        for k, key in zip(nodes.tolist(), _keys(turns[starts[r] : starts[r] + lengths[r]])):
            keys[k] = key
    above = [None if p < 0 else int(low[p]) for p in trie.parent]
    yield _batch(MERGED, {"key": keys, "conv_id": low, "depth": trie.depth, "parent_conv_id": above, "n_convs": total, "n_children": children, "n_leaves": leaves, "saved": saved, "hanging": sums[0]})


def _hash_ends(frames):
    """Rows in order of key and first id to one digest per key; only the running digest is held."""
    last, held = None, None
    for pdf in frames:
        out = []
        for key, piece in zip(pdf["key"], pdf["piece"]):
            if key != last:
                if last is not None:
                    out.append((last, held.hexdigest()))
                last, held = key, hashlib.sha256(piece.encode())
            else:
                held.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if last is not None:
        yield pd.DataFrame([(last, held.hexdigest())], columns=["key", "ends_sha256"])


def trie_nodes(held: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of paths (conv_id, path, sizes): every distinct beginning of a path, the root included.

    conv_id is the smallest of the n_convs conversations that begin so, parent_conv_id that of the parent (null for the
    root), n_leaves counts childless nodes in the subtree, saved_tokens sums (n_convs - 1) x bytes of the last text over
    it, and ends_sha256 is the digest of the ids that end here, ascending and joined by commas. Conversation ids are
    distinct. Without conversations there is no node.

    A shard holds about ``shard_turns`` turns, whatever they are: conversations with equal turns are dealt out by their
    ids. Two paths of each shard meet in one task, which grows with the number of shards; ids that end at a spine's node
    are hashed as a stream, as a digest of all of them has to be.
    """
    spark, held = held.sparkSession, materialize(held)
    turns = held.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    ordered = held.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = materialize(ordered.mapInArrow(_shard, SHARD), "part")
    part = lambda name: made.filter(F.col("part") == name)
    spines = part("spine").select("path", "sizes", "counts", "least", "hang_children", "hang_leaves", "hang_saved")
    merged = materialize(spines.coalesce(1).sortWithinPartitions("path").mapInArrow(_merge, MERGED))
    hashed = part("ends").select("key", "first", "piece").repartition("key").sortWithinPartitions("key", "first").mapInPandas(_hash_ends, "key binary, ends_sha256 string")
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    on_spine = merged.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    above = merged.filter("hanging > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), "hanging")
    hanging = part("hanging").drop("parent_conv_id")
    hung = attach(hanging, above, ["parent_key"], "hanging", made.count()).withColumnRenamed("above", "parent_conv_id")
    return part("node").select(*numbers).unionByName(hung.select(*numbers)).unionByName(on_spine.select(*numbers))


def op13_prefix_trie(spark, sf_dir):
    """All nodes of the rebuilt conversations' trie."""
    return trie_nodes(rebuilt(paths(table(spark, sf_dir, "conversations"))))


#: crc32 bit by bit, as SQL over c, a number.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: z::BIGINT)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))))"
SQL = f"""WITH t AS (SELECT conv_id AS c, list(struct_pack(k := md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), s := strlen(coalesce(text, '')))
  ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, turns, c - c % {FAMILY} AS base, {_CRC} % {SHARED} AS h FROM t),
r AS (SELECT h.c, list_concat(coalesce(b.turns[1 : h.h], []), h.turns[h.h + 1 :]) AS turns FROM h LEFT JOIN t b ON b.c = h.base),
p AS (SELECT c, d, len(turns) AS n, md5(array_to_string(list_transform(turns[1 : d], lambda x: x.k), '')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1 : d - 1], lambda x: x.k), '')) END AS above, CASE WHEN d > 0 THEN turns[d].s ELSE 0 END AS s
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
nodes AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(s) AS s, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
kids AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * s AS own FROM nodes LEFT JOIN kids USING (key)),
up AS (SELECT p.key, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.own)::BIGINT AS saved_tokens FROM full_nodes x JOIN p ON p.c = x.conv_id AND p.d <= x.d GROUP BY 1)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256 FROM full_nodes x JOIN up USING (key) LEFT JOIN full_nodes y ON y.key = x.above"""
