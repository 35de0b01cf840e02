"""Near-duplicate embeddings by spherical-cap filters.

A random product code gives filter directions: after a random rotation the dimensions are halved, each half has a code
of random unit vectors, and every pair of code words is a direction. A vector is list-decoded to all directions that
its score exceeds, without visiting the others: a code word of the first half goes on only if the best one of the
second half lifts it over the threshold. Vectors that share a direction are compared in double precision. Several
codes are used, as many as a simulated pair at the similarity asked for needs to be found with probability RECALL.

Equal vectors are one class with a multiplicity. Filters with many classes are cut into blocks, and each pair of
blocks is a cell of its own, so no task gets a whole filter and no pairs are written out: a cell sums up, for each
class, the links found in it, and the stars that connect it. A pair that shares several filters counts in the first.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, materialize, table
from quarry.llm.components import clusters, components

SIMILARITY = 0.9
RECALL = 0.98
#: Directions of one code that a vector exceeds on average.
LIST = 16
#: Classes in a block of a filter, about.
BLOCK = 768


class Code:
    """Product codes of one dimension for about n vectors; equal parameters give equal codes everywhere."""

    def __init__(self, dim: int, n: int, similarity: float):
        self.dim = dim
        self.half = max(1, dim // 2)
        self.words = 1 << min(12, max(5, math.ceil(math.log2(max(2, n)) / 2)))
        self.cut = math.sqrt(2) * NormalDist().inv_cdf(1 - LIST / max(2 * LIST, self.words**2)) / math.sqrt(dim)
        self.codes = [self._draw(0)]
        rng = np.random.default_rng(11)
        x = rng.standard_normal((1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if dim < 3:
            self.codes = [self._draw(k) for k in range(8)]
            return
        y = rng.standard_normal((1000, dim))
        y -= (x * y).sum(1, keepdims=True) * x
        y = similarity * x + math.sqrt(1 - similarity**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = (v.astype("int64") * self.words**2 + f for v, f in (self.decode(x), self.decode(y)))
        found = min(0.999, max(0.02, len(np.unique(np.intersect1d(a, b) // self.words**2)) / len(x)))
        self.codes += [self._draw(k) for k in range(1, max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - found))))]

    def _draw(self, k: int):
        rng = np.random.default_rng((k, self.dim, self.words))
        rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        halves = []
        for d in (self.half, max(1, self.dim - self.half)):
            c = rng.standard_normal((self.words, d))
            halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        return rotation, *halves

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, filter) for every filter that a unit vector in x exceeds."""
        rows, filters = [], []
        for k, (rotation, first, second) in enumerate(self.codes):
            y = x @ rotation.T
            a, b = y[:, : self.half] @ first.T, y[:, -second.shape[1] :] @ second.T
            v, i = np.nonzero(a >= (self.cut - b.max(1))[:, None])
            for s in range(0, len(v), 20_000):
                vs, is_ = v[s : s + 20_000], i[s : s + 20_000]
                w, j = np.nonzero(b[vs] >= (self.cut - a[vs, is_])[:, None])
                rows.append(vs[w])
                filters.append((k * self.words + is_[w]) * self.words + j)
        return np.concatenate([np.empty(0, "int64"), *rows]), np.concatenate([np.empty(0, "int64"), *filters])


@functools.cache
def code(dim: int, n: int, similarity: float) -> Code:
    return Code(dim, n, similarity)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("float64")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(pdf: pd.DataFrame, n: int, similarity: float, kind: str):
    """For each dimension in pdf: its rows, and (row, filter) sorted by both."""
    for size in sorted(set(map(len, pdf["vec"]))):
        part = pdf[[len(v) == size for v in pdf["vec"]]]
        for s in range(0, len(part), 2000):
            some = part.iloc[s : s + 2000]
            v, f = code(size // np.dtype(kind).itemsize, n, similarity).decode(_unit(some["vec"].tolist(), kind))
            order = np.lexsort((f, v))
            yield some, v[order], f[order]


def cell_links(filter_: int, ids: np.ndarray, mult: np.ndarray, side: np.ndarray, raw: list[bytes], lists: list[bytes], similarity: float, kind: str):
    """Links and stars of one cell: (id, other, links); a cell of two blocks compares one with the other."""
    x = _unit(raw, kind)
    a, b = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
    linked = x[a] @ x[b].T >= similarity
    if side.min() == side.max():
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    held = [np.frombuffer(s, "<i4") for s in lists]
    held = [h[h < filter_] for h in held]
    # Pairs that share an earlier filter count there.
    p, q = np.nonzero(linked)
    if len(p) <= 500:
        sets = {k: set(held[k].tolist()) for k in {*a[p].tolist(), *b[q].tolist()}}
        for u, v in zip(p.tolist(), q.tolist()):
            if not sets[a[u]].isdisjoint(sets[b[v]]):
                linked[u, v] = False
    else:
        values, at, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1
        rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
        shared = counts[at] > 1
        has = np.zeros((len(held), int((counts > 1).sum())), "float32")
        has[rows[shared], place[at[shared]]] = 1
        linked &= has[a] @ has[b].T == 0
    if not linked.any():
        return []
    whole = np.zeros((len(ids), len(ids)), bool)
    whole[np.ix_(a, b)] = linked
    whole |= whole.T
    links, first = whole @ mult, clusters(whole)
    return [(int(ids[k]), int(ids[first[k]]), int(links[k])) for k in np.flatnonzero(links)]


def _cells(frames, similarity: float, kind: str):
    """Streams rows sorted by cell through cell_links()."""
    columns, rest = ["a", "b", "links"], None
    key = ["filter", "i", "j", "size"]

    def done(pdf: pd.DataFrame):
        out = []
        edges = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(1)) + 1
        bounds = [0, *edges.tolist(), len(pdf)]
        ids, mult, side = pdf["id"].to_numpy(), pdf["mult"].to_numpy(), pdf["block"].to_numpy()
        raw, lists, filters = pdf["vec"].tolist(), pdf["filters"].tolist(), pdf["filter"].to_numpy()
        for s, e in zip(bounds, bounds[1:]):
            if e - s > 1:
                out += cell_links(int(filters[s]), ids[s:e], mult[s:e], side[s:e], raw[s:e], lists[s:e], similarity, kind)
        return pd.DataFrame(out, columns=columns)

    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf) == 0:
            continue
        last = (pdf[key] != pdf[key].iloc[-1]).any(axis=1).to_numpy()
        at = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        rest = pdf.iloc[at:]
        if at:
            yield done(pdf.iloc[:at])
    if rest is not None and len(rest):
        yield done(rest)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. Equal vectors link with each other. kept marks vec_id = component_id, so with repeated ids
    more than one row. An empty table gives no rows.
    """
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.when(sound, v).alias("vec")))
    usable = base.filter("vec is not null")
    classes = materialize(usable.groupBy("vec").agg(F.min("row").alias("id"), F.count("*").alias("mult"), F.min("vec_id").alias("least")))
    n, n_rows = classes.count(), base.count()

    def as_bytes(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "mult": pdf["mult"], "vec": [np.asarray(x, kind).tobytes() for x in pdf["vec"]]})

    packed = classes.select("id", "mult", "vec").mapInPandas(as_bytes, "id long, mult long, vec binary")

    def filters_of(frames):
        for pdf in frames:
            for some, _, f in _decoded(pdf, n, similarity, kind):
                values, counts = np.unique(f, return_counts=True)
                yield pd.DataFrame({"filter": values, "size": len(some["vec"].iloc[0]), "n": counts})

    def placed(frames):
        for pdf in frames:
            for some, v, f in _decoded(pdf, n, similarity, kind):
                ends = np.searchsorted(v, np.arange(len(some) + 1))
                own = [f[s:e].astype("<i4").tobytes() for s, e in zip(ends, ends[1:])]
                yield pd.DataFrame({"filter": f, "id": some["id"].to_numpy()[v], "mult": some["mult"].to_numpy()[v], "vec": some["vec"].to_numpy()[v], "filters": np.array([*own, None], object)[v]}).assign(size=len(some["vec"].iloc[0]))

    crowded = packed.mapInPandas(filters_of, "filter long, size int, n long").groupBy("filter", "size").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK)
    blocks = crowded.select("filter", "size", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spread = packed.mapInPandas(placed, "filter long, id long, mult long, vec binary, filters binary, size int").join(blocks, ["filter", "size"], "left")
    block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    cells = spread.select("filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "size", "id", "mult", "vec", "filters", "block")
    cells = cells.repartition("filter", "i", "j", "size").sortWithinPartitions("filter", "i", "j", "size")
    found = materialize(cells.mapInPandas(lambda frames: _cells(frames, similarity, kind), "a long, b long, links long"))

    links = found.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("id"), "links")
    groups = components(found.filter("a <> b").select("a", "b")).select(F.col("node").alias("id"), "component")
    known = classes.join(links, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = materialize(known.select("id", "vec", "mult", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    known = attach(known, lowest, ["component"], "classes", n).select("vec", "mult", "n_links", "component_id")
    joined = attach(usable, known, ["vec"], "mult", n_rows).select("vec_id", "n_links", "component_id")
    lone = base.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_near_embeddings(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
