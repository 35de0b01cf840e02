"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

Each partition is streamed without a shuffle. A document's ids, with an end id, are cut into full windows, which need
no packing, and a rest. Rests gather until they fill ``windows`` windows exactly; then multiway differencing deals
them out: every rest is a partial partition of the windows, and the two partial partitions with the largest imbalances
are merged again and again, the fullest window of one with the emptiest of the other. As long as a window exceeds its
capacity, there is one window more. Of the near-equal windows, each with some room, those that the total does not need
are then taken apart, and their pieces cut to fill the others, so that only the last windows of a partition have padding.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ids_back, ids_out, table

CAPACITY = 1024
WINDOWS = 32
END_ID = 0


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of sizes dealt out into k groups of near-equal sums, by multiway differencing."""
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(k, "int64")
        sums[-1] = n
        heap.append((-n, i, sums, [()] * (k - 1) + [(i, None)]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        groups = [(in_a[j], in_b[k - 1 - j]) for j in order.tolist()]
        count += 1
        heapq.heappush(heap, (-int(sums[-1]), count, sums, groups))

    out = []
    for tree in heap[0][3] if heap else [()] * k:
        members, todo = [], [tree]
        while todo:
            x = todo.pop()
            if not x:
                continue
            if x[1] is None:
                members.append(x[0])
            else:
                todo += x
        out.append(sorted(members))
    return out


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of near-equal sums, none above the capacity: one more as long as any exceeds it. No size exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, k)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return groups
        k += 1


def level(groups: list[list[tuple]], capacity: int) -> list[list[tuple]]:
    """As few of the groups as the total allows, filled up with the pieces of the others, which are cut for that.

    Pieces are (doc, start, ids, doc_tokens), and no group exceeds the capacity. The emptiest groups are taken apart.
    """
    size = lambda g: sum(len(p[2]) for p in g)
    groups = sorted(groups, key=size, reverse=True)
    needed = -(-sum(map(size, groups)) // capacity)
    groups, rest = groups[:needed], [p for g in groups[needed:] for p in g]
    for g in groups:
        room = capacity - size(g)
        while room and rest:
            doc, start, ids, n = rest.pop()
            g.append((doc, start, ids[:room], n))
            if len(ids) > room:
                rest.append((doc, start + room, ids[room:], n))
            room -= min(room, len(ids))
    return groups


class Packer:
    """Deals out the pieces of one partition; holds at most the rests that fill a few windows."""

    def __init__(self, first: int, capacity: int, windows: int):
        self.next, self.capacity, self.windows = first, capacity, windows
        self.pieces: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        full = n // cap * cap
        for start in range(0, full, cap):
            self._place([(doc, start, ids[start : start + cap], n)])
        if n > full:
            self.pieces.append((doc, full, ids[full:], n))
            self.total += n - full
            surplus = self.total - cap * self.windows
            if surplus >= 0:
                # The last rest is cut so that the windows can be filled to the end.
                _, start, rest, _ = self.pieces.pop()
                at = len(rest) - surplus
                left = [(doc, start + at, rest[at:], n)] if surplus else []
                self.pieces += [(doc, start, rest[:at], n)] if at else []
                self._deal()
                self.pieces, self.total = left, surplus

    def _deal(self) -> None:
        groups = deal([len(p[2]) for p in self.pieces], self.capacity)
        for group in level([[self.pieces[i] for i in g] for g in groups], self.capacity):
            if group:
                self._place(group)

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        if self.pieces:
            self._deal()
            self.pieces, self.total = [], 0

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


@functools.cache
def _fast(path: str):
    """The same vocabulary, pattern and special tokens in tiktoken, which needs a fifth of the time of tokenizers."""
    import tiktoken

    from quarry.llm.bpe import encoder

    own = encoder(path)
    ranks = sorted((r, i) for i, r in own.rank.items())
    assert [i for _, i in ranks] == list(range(len(ranks))), "ids must be in the order of the merges"
    return tiktoken.Encoding("packing", pat_str=own.words.pattern, mergeable_ranks={own.bytes_of[i]: i for _, i in ranks}, special_tokens=own.special)


#: Runs so long that tiktoken's pattern matcher may overflow its stack; such texts take the encoder of bpe.py.
LONG_RUN = re.compile(r"\s{2000}|\S{20000}")


def token_ids(path: str, text: str) -> np.ndarray:
    if len(text) >= 2000 and LONG_RUN.search(text):
        from quarry.llm.bpe import encoder

        return np.frombuffer(encoder(path).encode_batch([text])[0], "<u4")
    return _fast(path).encode_to_numpy(text, allowed_special="all", disallowed_special=())


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are one end id. Rows with the same doc_id are packed as documents of their own. An empty
    table gives no rows. sequence_id is unique over all partitions; offsets in a sequence leave no gaps.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, windows)
        columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        size = 0
        for pdf in frames:
            for doc, t in zip(pdf["id"].tolist(), pdf["text"].tolist()):
                t = t if isinstance(t, str) else ""
                packer.add(doc, np.append(token_ids(path, t), END_ID).astype("<u4"))
                size += len(t)
                if size >= 4_000_000:
                    size = 0
                    yield pd.DataFrame(packer.taken(), columns=columns, dtype=object)
        packer.finish()
        yield pd.DataFrame(packer.taken(), columns=columns, dtype=object)

    rows = ids_out(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id")
    out = rows.mapInPandas(run, "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return ids_back(out, "doc_id", docs.schema[doc_id].dataType)


def op1_packing(spark, sf_dir):
    """All documents packed; the ids of each piece as a checksum."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
