import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, n_convs long, __sha string"


def brute(rows):
    """The contract by nested dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, h, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(full) + 1):
            nodes.setdefault(full[:d], [[], []])[0].append(c)
        nodes[full][1].append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    out = []
    for k in sorted(nodes, key=len, reverse=True):
        members, ends = nodes[k]
        own_saved = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        below = kids.get(k, [])
        nodes[k] += [sum(nodes[x][2] for x in below) or 1, own_saved + sum(nodes[x][3] for x in below)]
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(k), min(nodes[k[:-1]][0]) if k else None, len(members), len(below), nodes[k][2], nodes[k][3], sha))
    return out


def conversations(seed, n, wide=4, deep=7):
    random.seed(seed)
    out = []
    for c in random.sample(range(-20, 3 * n), n):
        out += [(c, t if random.random() < 0.97 else None, random.choice(["user", "assistant", None, "é"][: 1 + t % 3]), random.choice(["", "a", "ü b", None, "long " * 20][: 1 + (t + seed) % wide])) for t in range(random.randint(1, deep))]
    return out


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS).repartition(3)
    got = prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.paths(table)), **options).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("seed, n, wide, deep, shard", [(1, 300, 4, 7, 60), (2, 300, 2, 9, 25), (3, 60, 5, 3, 10_000), (4, 1, 4, 7, 10), (5, 2, 1, 2, 10)])
def test_against_brute_force(spark, seed, n, wide, deep, shard):
    check(spark, conversations(seed, n, wide, deep), shard_turns=shard)


def test_hot_paths_ties_nulls_and_long_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900, 2) for t in range(3)]  # a third and more are alike
    rows += [(c, t, "user", f"same {t}" if t < 2 else f"own {c}") for c in range(1, 300, 2) for t in range(4)]
    rows += [(5000, t, "user", "x" * (t % 3)) for t in range(3000)] + [(5001, t, "user", "x" * (t % 3)) for t in range(2990)]
    rows += [(6000, 1, "user", "b"), (6000, 1, "user", "a"), (6000, None, None, None), (6000, 1, "user", "a"), (None, 1, "user", "lost"), (None, None, None, None), (7000, 0, "a", "bc"), (7005, 0, "ab", "c")]
    check(spark, rows, shard_turns=100)


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.paths(none))).count() == 0


def test_find_close():
    random.seed(8)
    for size in (1, 5, 300, 20_000):
        depth, parens = 0, []
        left = size
        while left or depth:
            opening = left and (not depth or random.random() < random.choice((0.3, 0.5, 0.9)))
            parens.append(1 if opening else -1)
            depth += parens[-1]
            left -= opening
        stack, want = [], {}
        for k, x in enumerate(parens):
            if x > 0:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.flatnonzero(np.array(parens) > 0)
        got = prefix_trie.find_close(np.cumsum(parens, dtype=np.int32), opens)
        assert got.tolist() == [want[k] for k in opens.tolist()]
    deep = np.array([1] * 100_000 + [-1] * 100_000)
    assert prefix_trie.find_close(np.cumsum(deep, dtype=np.int32), np.arange(100_000)).tolist() == list(range(199_999, 99_999, -1))
