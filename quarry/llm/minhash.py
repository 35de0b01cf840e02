"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words in a row, hashed. A shingle weighs its count in the text times its inverse document frequency
log((N + 1) / (df + 1)) + 1, which saturates: shingles in fewer than one of SATURATION documents weigh alike, as if they
were in that many. So a similarity depends on shares of documents and not on their number, and what has to be known are
the frequencies of common shingles, of which there are at most SATURATION times the mean number of shingles in a text.
Those are exact, in two passes over all texts: the first sums up two rows of hashed counters, each of which is at least
the frequency of any shingle in it; the second counts the shingles whose counters are both high enough.

Each of BANDS * ROWS samples picks a shingle with its quantised weight so that two texts agree with the probability of
their weighted Jaccard similarity. Texts that agree in all samples of a band meet in a bucket. Every text is verified
against the bucket's smallest. Where a bucket still holds texts of different components, all of its pairs are verified,
in blocks by matrix products, of which only the stars that connect texts are written out. Verification computes the
weighted Jaccard similarity of whole texts.

Texts with the same words are one class. Pairs and components are of classes; members follow their class.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, fresh, ids_back, ids_out, materialize, or_empty, table
from quarry.llm.components import clusters, components
from quarry.llm.exact_dedup import filter_bits, maybe_repeated, member_bits

WORDS = 5
SIMILARITY = 0.8
#: A pair at the similarity asked for meets in some bucket with probability 1 - (1 - 0.8^4)^10 = 0.995.
BANDS, ROWS = 10, 4
#: Shingles in fewer than one of so many documents weigh alike.
SATURATION = 512
#: Counters of a row, those that travel together, and shingles a task counts before it passes them on.
COUNTERS, TOGETHER, COUNTED = 1 << 19, 1 << 12, 1 << 21
#: Words of more bytes are hashed one by one.
LONG = 256
#: Shingles that are counted at once, characters of texts that are hashed at once, shingles that are sampled at once, about.
AT_ONCE, CHARS, DRAWN = 1 << 19, 1 << 17, 2000
#: Random draws are taken from so many quantiles (2^BITS).
BITS = 16
#: Texts compared with one other in a task at most, before a further task takes the rest.
SHARE = 256
#: Texts in a block of a bucket, about.
BLOCK = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


#: What str.split() parts words at: in ASCII, and beyond it by its first bytes in UTF-8.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_WIDE_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The first k of eight bytes, least first.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], "uint64")


def word_hashes(text: str) -> np.ndarray:
    """The hash of each of text.split()."""
    return _word_hashes([text])[0]


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts in a row, eight bytes of all words at a time, and where each text's begin and all end."""
    parts = [t.encode() for t in texts]
    for k, t in enumerate(texts):
        if not t.isascii() and any(w in parts[k] for w in _WIDE):
            parts[k] = _WIDE_SPACES.sub(" ", t).encode()
    lengths = np.fromiter(map(len, parts), "int64", len(parts))
    raw = b" ".join([b"", *parts, b" " * 8])
    blank = _BLANK.take(np.frombuffer(raw, "uint8"))
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    out = (eight[starts] & _FIRST.take(np.minimum(sizes, 8))) ^ (sizes.astype("uint64") * np.uint64(0xD6E8FEB86659FD93))
    out *= _MIX
    out ^= out >> np.uint64(32)
    rest = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    for s in range(8, LONG, 8):
        rest = rest[sizes[rest] > s]
        if not len(rest):
            break
        h = (out[rest] ^ (eight[starts[rest] + s] & _FIRST.take(np.minimum(sizes[rest] - s, 8)))) * _MIX
        out[rest] = h ^ (h >> np.uint64(32))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    return out, np.searchsorted(starts, np.append(0, np.cumsum(lengths + 1)))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The hash of every run of WORDS words; of all words where there are fewer; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, WORDS)
    out = np.zeros(n - size + 1, "uint64")
    for k in range(size):
        out = (out ^ hashes[k : n - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def parsed(texts):
    """For each text the hashes of its words and of its shingles; some CHARS of texts are read at once."""
    part, size = [], 0

    def done():
        hashes, bounds = _word_hashes(part)
        runs, bounds = shingles(hashes), bounds.tolist()
        for s, e in zip(bounds, bounds[1:]):
            yield hashes[s:e], runs[s : e - WORDS + 1] if e - s >= WORDS else shingles(hashes[s:e])

    for t in texts:
        part.append(t)
        size += len(t)
        if size > CHARS:
            yield from done()
            part, size = [], 0
    if part:
        yield from done()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and where each of them begins in the sorted values."""
    values = np.sort(values)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[at], at


class Weights:
    """Inverse document frequencies among n documents, from the shingles (in order) in more than n / SATURATION of them."""

    def __init__(self, n: int, common: np.ndarray, df: np.ndarray):
        self.common = common
        self.idf = np.append(np.log((n + 1) / (df + 1)) + 1, np.log((n + 1) / (n / SATURATION + 1)) + 1)

    def counted(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles in order, their counts, and their inverse document frequencies."""
        values, starts = distinct(found)
        counts = np.diff(starts, append=len(found))
        at = np.searchsorted(self.common, values)
        at[at == len(self.common)] = 0
        found = self.common[at] == values if len(self.common) else np.zeros(len(values), bool)
        return values, counts, self.idf[np.where(found, at, len(self.common))]

    def weighed(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order, and their weights."""
        values, counts, idf = self.counted(found)
        return values, counts * idf

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weighed(shingles(word_hashes(text)))


def similarity(a, b) -> float:
    """Weighted Jaccard similarity: the sum of the smaller over that of the larger weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - both
    return float(both / union) if union > 0 else 0.0


@functools.cache
def _draws():
    """Quantiles of log c, c of gamma(2, 1), of r, of gamma(2, 1) too, each with its uniform draw, and a multiplier for each sample."""
    rng = np.random.default_rng(2)
    n = 1 << BITS
    gamma = np.sort(rng.standard_gamma(2.0, 16 * n)).reshape(n, 16)[:, 8].astype("float32")
    # Multiples of the golden ratio: any few quantiles of r in a row have uniform draws that are spread evenly.
    uniform = ((np.arange(n) * 0.6180339887498949 + 0.5 / n) % 1).astype("float32")
    odd = rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype="uint64") | np.uint64(1)
    return np.log(gamma), gamma, (1 / gamma).astype("float32"), uniform, odd


def _steps(log_w, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised log weights by the draws at these quantiles: the step t, and what log c is lowered by, log y + r."""
    _, gamma, inverse, uniform, _ = _draws()
    beta = uniform.take(at)
    t = np.floor(log_w * inverse.take(at) + beta)
    # log y = r (t - beta)
    return t, gamma.take(at) * (t - beta + 1)


@functools.lru_cache(4)
def _lowered(log_w: float) -> np.ndarray:
    return _steps(np.float32(log_w), np.arange(1 << BITS))[1]


def sample(values: np.ndarray, weights: np.ndarray, usual: float | None = None) -> np.ndarray:
    """For each of the BANDS * ROWS samples, a hash of the shingle picked and its quantised weight.

    What the draws make of the usual weight is looked up; it is the same as for any other weight.
    """
    log_c, *_, odd = _draws()
    log_w = np.log(weights).astype("float32")
    best, picked = np.full(len(odd), np.inf, "float32"), np.zeros(len(odd), "uint64")
    mask, rows = np.uint64((1 << BITS) - 1), np.arange(len(odd))
    other = np.ones(len(values), bool) if usual is None else weights != usual
    table = _lowered(0.0 if usual is None else float(np.log(usual).astype("float32")))
    size = -(-len(values) // -(-len(values) // DRAWN))
    for s in range(0, len(values), size):
        v, lw = values[s : s + size], log_w[s : s + size]
        h = v[None, :] * odd[:, None]
        at = (h >> np.uint64(64 - BITS)).view("int64")
        h >>= np.uint64(64 - 2 * BITS)
        h &= mask
        low = table.take(at, mode="clip")
        some = np.flatnonzero(other[s : s + size])
        if len(some):
            low[:, some] = _steps(lw[some], at[:, some])[1]
        a = log_c.take(h.view("int64"), mode="clip")
        a -= low
        k = a.argmin(1)
        least = a[rows, k]
        better = least < best
        best = np.where(better, least, best)
        t = _steps(lw[k], at[rows, k])[0]
        with np.errstate(over="ignore"):
            mark = (v[k] ^ (t.astype("int64").astype("uint64") * _MIX)) * _MIX
        picked = np.where(better, mark, picked)
    return picked


def band_hashes(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype="uint64")
    for k in range(ROWS):
        out = (out ^ parts[:, k]) * _MIX
        out ^= out >> np.uint64(32)
    return out.view("int64")


def counters_of(values: np.ndarray) -> np.ndarray:
    """The counter of each shingle in each of the two rows."""
    shift = np.uint64(65 - COUNTERS.bit_length())
    return np.stack([values >> shift, COUNTERS + ((values * _MIX) >> shift)]).astype("int64")


def _shingled(frames):
    """The distinct shingles of each text in frames, those of several texts in a row, and the number of these texts."""
    found, size = [], 0
    for pdf in frames:
        for _, own in parsed(pdf["text"]):
            found.append(distinct(own)[0])
            size += len(found[-1])
            if size > AT_ONCE:
                yield np.concatenate(found), len(found)
                found, size = [], 0
    if found:
        yield np.concatenate(found), len(found)


def fit(texts: DataFrame) -> Weights:
    """Weights from all rows of the column ``text``."""

    def count(frames):
        seen, rows = np.zeros(2 * COUNTERS, "int64"), 0
        for values, n in _shingled(frames):
            seen += np.bincount(counters_of(values).ravel(), minlength=len(seen))
            rows += n
        blocks = seen.astype("<i4").reshape(-1, TOGETHER)
        some = np.flatnonzero(blocks.any(1))
        yield pd.DataFrame({"block": np.append(some, -1), "counts": [*(b.tobytes() for b in blocks[some]), np.array([rows], "<i4").tobytes()]})

    def summed(frames):
        total = {}
        for pdf in frames:
            for block, raw in zip(pdf["block"].tolist(), pdf["counts"]):
                total[block] = total.get(block, 0) + np.frombuffer(raw, "<i4").astype("int64")
        yield pd.DataFrame({"block": list(total), "counts": [x.tobytes() for x in total.values()]})

    blocks = texts.select("text").mapInPandas(count, "block int, counts binary")
    # 2 * COUNTERS counters and the number of texts, whatever the input.
    got = blocks.repartition("block").mapInPandas(summed, "block int, counts binary").toPandas()
    seen, n = np.zeros((2 * COUNTERS // TOGETHER, TOGETHER), "int64"), 0
    for block, raw in zip(got["block"].tolist(), got["counts"]):
        if block < 0:
            n = int(np.frombuffer(raw, "int64")[0])
        else:
            seen[block] = np.frombuffer(raw, "int64")
    high = texts.sparkSession.sparkContext.broadcast(seen.ravel() > n / SATURATION)

    def exact(frames):
        found, size = [], 0

        def summed():
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            return pd.DataFrame({"shingle": values.view("int64"), "n": counts})

        for values, _ in _shingled(frames):
            first, second = counters_of(values)
            found.append(values[high.value.take(first) & high.value.take(second)])
            size += len(found[-1])
            if size > COUNTED:
                yield summed()
                found, size = [], 0
        if found:
            yield summed()

    counts = texts.select("text").mapInPandas(exact, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df"))
    # At most SATURATION times the mean number of shingles in a text.
    common = counts.filter(F.col("df") > n / SATURATION).toPandas()
    values, df = common["shingle"].to_numpy("int64").view("uint64"), common["df"].to_numpy("int64")
    order = np.argsort(values)
    return Weights(n, values[order], df[order])


def _verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar.

    Texts of b travel to their pairs; pairs of one a are dealt out in shares of about SHARE, each with a copy of a.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    shares = degree.select("a", F.ceil(F.col("degree") / SHARE).cast("int").alias("shares"))
    # An a with few pairs is in one share; only for others must its pairs know the number of shares.
    many = shares.filter("shares > 1")
    dealt = pairs.join(many, "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int")).select("a", "b", "share")
    right = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "share", F.lit(True).alias("other"), "b", "text")
    left = shares.join(texts.withColumnRenamed("id", "a"), "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    left = left.select("a", "share", F.lit(False).alias("other"), F.col("a").alias("b"), "text")
    both = left.unionByName(right).repartition("a", "share").sortWithinPartitions("a", "share", "other", "b")

    def compare(frames):
        now, own = None, None
        for pdf in frames:
            out = []
            for a, share, b, t in zip(pdf["a"], pdf["share"], pdf["b"], pdf["text"]):
                w = weights.value.of(t)
                if (a, share) != now:
                    now, own = (a, share), w
                elif similarity(own, w) >= threshold:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return both.mapInPandas(compare, "a long, b long")


def _block_links(texts: list[str], side: np.ndarray, of: Weights, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of texts, from two sides or within one, that are at least so similar.

    A shingle that occurs k times is k features of its weight, so the sum of the smaller weights is a product of
    binary vectors.
    """
    docs, feats, weights = [], [], []
    for k, t in enumerate(texts):
        values, counts, idf = of.counted(shingles(word_hashes(t)))
        level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        v = np.repeat(values, counts)
        docs.append(np.full(len(v), k))
        weights.append(np.repeat(idf, counts))
        feats.append((v ^ level.astype("uint64") * np.uint64(0xD6E8FEB86659FD93)) * _MIX)
    doc, feat, weight = np.concatenate(docs), np.concatenate(feats), np.concatenate(weights)
    total = np.bincount(doc, weight, len(texts))
    _, at, counts = np.unique(feat, return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    place = (np.cumsum(counts > 1) - 1)[at[shared]]
    doc, root = doc[shared], np.sqrt(weight[shared])
    a, b = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    both = np.zeros((len(a), len(b)))
    for s in range(0, int(place.max(initial=-1)) + 1, 4096):
        some = (place >= s) & (place < s + 4096)
        x = np.zeros((len(texts), 4096))
        x[doc[some], place[some] - s] = root[some]
        both += x[a] @ x[b].T
    union = total[a][:, None] + total[b][None, :] - both
    linked = both >= threshold * np.maximum(union, 1e-12) * (1 - 1e-12)
    out = np.zeros((len(texts), len(texts)), bool)
    out[np.ix_(a, b)] = linked
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _open_links(open_: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Edges (a, b) that connect all similar pairs within each bucket of (bucket, id, size), in blocks of BLOCK."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = dealt.select("id", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block").join(texts, "id")
    cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def done(pdf: pd.DataFrame):
        ids, linked = pdf["id"].to_numpy(), _block_links(pdf["text"].tolist(), pdf["block"].to_numpy(), weights.value, threshold)
        first = clusters(linked)
        some = np.flatnonzero(first != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[first[some]], "b": ids[some]})

    def run(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["bucket", "i", "j"]].to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            for s, e in zip(starts, starts[1:]):
                yield done(pdf.iloc[s:e])
            rest = pdf.iloc[starts[-1] :]  # this cell may go on
        if rest is not None and len(rest):
            yield done(rest)

    return cells.mapInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, component_id, kept.

    class_id is the smallest doc_id with the same words, component_id the smallest doc_id that links reach. kept marks
    one document of each component. Null texts are empty; texts without words are one class. A null doc_id sorts last.
    An empty table gives no rows.
    """
    return _groups(docs, doc_id, text, threshold).select("doc_id", "class_id", "component_id", "kept")


def _groups(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), or_empty(F.col(f"`{text}`")).alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(fit(texts))

    def sign(frames):
        usual = weights.value.idf[-1]
        for pdf in frames:
            digests, bands = [], []
            for hashes, found in parsed(pdf["text"]):
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                values, own = weights.value.weighed(found)
                bands.append(band_hashes(sample(values, own, usual)) if len(values) else np.empty(0, "int64"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sha": pdf["sha"], "digest": digests, "bands": bands})

    hashed = texts.withColumn("sha", _sha(F.col("text")))
    signed = ids_out(hashed, "doc_id").mapInPandas(sign, "doc_id string, sha binary, digest binary, bands array<long>")
    signed = materialize(ids_back(signed, "doc_id", docs.schema[doc_id].dataType).withColumn("row", F.monotonically_increasing_id()))
    n = signed.count()
    # A class is known by the row of its first member.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "sha", "bands"))
    classes = materialize(
        signed.groupBy("digest").agg(first.alias("first"), F.count("*").alias("members"))
        .select("digest", "members", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("id"), F.col("first.sha").alias("sha"), F.col("first.bands").alias("bands"))
    )
    banded = materialize(classes.select("id", F.explode("bands").alias("bucket")))
    sizes = banded.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    held = materialize(attach(banded, sizes, ["bucket"], "n", n * BANDS))
    # One text for each class that has to be compared; a Bloom filter keeps all other texts where they are.
    wanted = materialize(classes.join(held.select("id").distinct(), "id").select("id", "sha"))
    bits = filter_bits(wanted.count())
    words = materialize(member_bits(wanted, "sha", bits))
    maybe = maybe_repeated(hashed.select("sha", "text"), "sha", words, bits, "maybe").filter("maybe").drop("maybe")
    bodies = materialize(maybe.groupBy("sha").agg(F.min("text").alias("text")).join(wanted, "sha").select("id", "text"))

    pairs = held.filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = materialize(_verified(materialize(pairs), bodies, weights, threshold))
    groups = components(links)
    # Buckets with texts of several components.
    state = held.select("bucket", "id").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low <> high and size > 2").select("bucket", "size")
    open_ = attach(state.select("bucket", "id"), mixed, ["bucket"], "size", n * BANDS)
    known = groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = components(known.unionByName(materialize(_open_links(open_, bodies, weights, threshold))))

    known = classes.join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    known = materialize(known.select("digest", "members", "class_id", "id", F.coalesce("component", "id").alias("component")))
    lowest = known.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "id")).alias("low"), F.count("*").alias("classes"))
    known = attach(known, lowest, ["component"], "classes", n).select("digest", "members", "class_id", F.col("low.class_id").alias("component_id"), F.col("low.id").alias("keep_row"))
    out = attach(signed.select("row", "doc_id", "sha", "digest"), known, ["digest"], "members", n)
    return out.withColumn("kept", F.col("row") == F.col("keep_row"))


def _sha(text):
    return F.unhex(F.sha2(text, 256))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """docs with one document of each component; columns as given.

    Null texts count as empty, rows with a null id as rows like others; an empty table gives no rows. Rows whose text cannot be one to drop pass straight through; rows that repeat both id and text stay together.
    """
    out = materialize(_groups(docs, doc_id, text, threshold))
    own, flag, own_id, own_sha = fresh(docs, "__own_sha", "__maybe", "__id", "__sha")
    kept, gone = out.filter("kept").select("doc_id", "digest"), out.filter("not kept").select("doc_id", "sha", "digest").distinct()
    same = F.col("gone.doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("gone.digest") == F.col("kept.digest"))
    gone = gone.alias("gone").join(kept.alias("kept"), same, "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias(own_id), F.col("sha").alias(own_sha)))
    bits = filter_bits(gone.count())
    words = materialize(member_bits(gone, own_sha, bits))
    flagged = maybe_repeated(docs.withColumn(own, _sha(or_empty(F.col(f"`{text}`")))), own, words, bits, flag)
    stay = flagged.filter(F.col(flag)).join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(own_sha)), "left_anti")
    return flagged.filter(~F.col(flag)).unionByName(stay).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_minhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
