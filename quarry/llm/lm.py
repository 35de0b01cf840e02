"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Texts are lower-cased (A-Z) and split at ASCII white space; a text's tokens are its words and one end. A token enters the
model as the mean of the vectors of its subword ids. Every vector, class, weight and threshold is learnt from all
training documents:

1. Words are counted.
2. Each subword id gets a vector from the documents it occurs in, by random indexing: ids have random signs, a document
   is the rounded direction of the sum of its ids' signs, and an id sums up the documents it occurs in. The sums are
   integers, so no order of rows changes them. Their principal axes are the vectors.
3. k-means on these vectors gives CLASSES; a word's class is that of the mean of its ids. The last class is the end.
4. The attention model predicts the class of each token from the tokens before it: token t attends to those of its block
   of CONTEXT tokens and of the block before, a window that overlaps the next one by a block; a mask hides later tokens.
   Blocks start anew with each document, so a score does not depend on the rows beside it. The document's start stands
   before its first token.

Training takes each training document once. It has ROUNDS rounds, in each of which all tasks sum up the gradient of
their documents of that round at the same weights; the sums are added by a shuffle and Adam takes one step. So weights
do not depend on how rows are dealt out either, but for the rounding of sums.

A token's chance is that of its class in its context times the token's share of its class, smoothed by one: (c + 1) /
(N_k + V_k + 1). Against the base score, (c + 1) / (N + V + 1), only the class part differs, so all counts are exact in
both. Words that make up at least one in COMMON tokens are at most COMMON, so their counts are broadcast; all other
words are joined with their counts, and none of these has many rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ids_back, ids_out, materialize, or_empty, table

#: Components of a vector, tokens of a block, units between attention and classes, classes.
WIDTH, CONTEXT, HIDDEN, CLASSES = 16, 16, 32, 32
#: Steps of training, and the first one's length; it falls evenly.
ROUNDS, RATE = 16, 0.06
COMMON = 1_000_000
#: Tokens in a step of the numpy code.
BATCH = 1 << 11
#: Ids of documents, and characters of texts, taken at once.
CHARS, TEXTS = 250_000, 2_000_000
#: Words a task counts before it passes them on, and those it keeps encoded.
COUNTED = 400_000
#: Words of a shuffle partition that a join may hold in memory; more are sorted instead.
HASHED = 1_000_000
#: Longer words are encoded piece by piece.
PIECE = 1000


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


@functools.cache
def _subwords(path: str):
    from quarry.llm.packing import _fast

    return _fast(path)


@functools.cache
def _starts_with_space(path: str) -> np.ndarray:
    enc = _subwords(path)
    return np.array([enc.decode_single_token_bytes(i).startswith(b" ") for i in range(enc.n_vocab)])


#: White space beyond ASCII, which words may hold and the vocabulary's pattern parts.
_SPACES = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def word_ids(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words in a row, each with a space before it, and how many ids each word has.

    The empty word is the end, an id of its own, and stands last if at all. Words are encoded together, as no id spans
    two of them, but one by one where a word holds white space, and very long words in pieces of PIECE.
    """
    enc, end = _subwords(path), bool(words) and not words[-1]
    words = words[:-1] if end else words
    text = b" ".join([b"", *words]).decode()
    ids = sizes = None
    if max(map(len, words), default=0) < PIECE and not _SPACES.search(text):
        ids = enc.encode_to_numpy(text, disallowed_special=()).astype("int64")
        starts = np.flatnonzero(_starts_with_space(path)[ids])
        sizes = np.diff(np.append(starts, len(ids)))
    if (sizes is None or len(sizes) != len(words)) and len(words) > 64:
        # Only the part that holds such a word is encoded word by word.
        halves = [word_ids(path, words[: len(words) // 2]), word_ids(path, words[len(words) // 2 :])]
        ids, sizes = (np.concatenate(x) for x in zip(*halves))
    elif sizes is None or len(sizes) != len(words):
        each = [[i for s in range(0, len(t), PIECE) for i in enc.encode_ordinary(t[s : s + PIECE])] for t in (" " + w.decode() for w in words)]
        ids, sizes = np.array([i for x in each for i in x], "int64"), np.array([len(x) for x in each], "int64")
    return (np.append(ids, enc.n_vocab), np.append(sizes, 1)) if end else (ids, sizes)


class Encoded(NamedTuple):
    """Documents in a row: ids of their distinct tokens, how many of them each of these has, how many tokens each
    document has, and which of the distinct tokens each token is."""

    ids: np.ndarray
    sizes: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray

    @classmethod
    def read(cls, path: str, ids: list[bytes], ends: list[bytes], tokens: list[bytes] | None = None) -> Encoded:
        """From columns that encoded() has written; without tokens, each token has ids of its own."""
        ids = [np.frombuffer(x, _kind(path)) for x in ids]
        last = [np.unpackbits(np.frombuffer(e, "uint8"), count=len(x)) for x, e in zip(ids, ends)]
        distinct = np.array([np.count_nonzero(x) for x in last], "int64")
        sizes = np.diff(np.flatnonzero(np.concatenate(last)), prepend=-1)
        ids = np.concatenate(ids).astype("int64")
        if tokens is None:
            return cls(ids, sizes, distinct, np.arange(len(sizes)))
        own = [np.frombuffer(x, _number(n)) for x, n in zip(tokens, distinct)]
        lengths = np.array([len(x) for x in own], "int64")
        return cls(ids, sizes, lengths, np.concatenate(own).astype("int64") + np.repeat(np.cumsum(distinct) - distinct, lengths))


def _kind(path: str) -> str:
    return "<u2" if _subwords(path).n_vocab < 1 << 16 else "<u4"


def _number(n: int) -> str:
    """Type of the numbers of n distinct tokens."""
    return "<u2" if n <= 1 << 16 else "<u4"


def encoded(texts: DataFrame, path: str, logs) -> DataFrame:
    """Rows of texts (doc_id, text, held_out) as ids, with what is known of their words.

    ``ids`` has the subword ids of the text's distinct tokens, as they first occur, and ``ends`` a bit for each that
    says whether a token ends there; ``tokens`` says for each token which of the distinct ones it is. Of words in logs, a
    broadcast of log10(count + 1), ``n_common`` is the number and ``common`` the sum; all other words of the text are in
    ``rare``, with their ``times``. ``slice`` is the round that trains on the row, -1 for none.
    """

    def work(frames):
        get, words = logs.value.get, None
        for pdf in frames:
            for part in _groups(pdf):
                # Distinct words are numbered, looked up and encoded once, until there are too many; the end is number 0.
                if words is None or len(words) > COUNTED or len(ids) > TEXTS:
                    number = defaultdict()
                    number.default_factory = number.__len__
                    number[b""], words = 0, [b""]
                    ids, sizes, found = np.array([_subwords(path).n_vocab], _kind(path)), np.ones(1, "int64"), np.array([get(b"", -1.0)])
                texts = [np.fromiter(map(number.__getitem__, [*words_of(t), b""]), "int32") for t in part["text"]]
                new = list(itertools.islice(number, len(words), None))
                new_ids, new_sizes = word_ids(path, new)
                words += new
                ids, sizes = np.append(ids, new_ids.astype(_kind(path))), np.append(sizes, new_sizes)
                found = np.append(found, [get(w, -1.0) for w in new])
                starts = np.cumsum(sizes) - sizes
                place, rows = np.empty(len(words), "int32"), []
                for t in texts:
                    # A token's number is that of the place where it first occurs, among such places.
                    at = np.arange(len(t), dtype="int32")
                    place[t[::-1]] = at[::-1]
                    first = place[t]
                    is_first = first == at
                    distinct, own = t[is_first], (np.cumsum(is_first) - 1)[first]
                    times, size, log = np.bincount(own), sizes[distinct], found[distinct]
                    last = np.cumsum(size)
                    ends = np.zeros(last[-1], bool)
                    ends[last - 1] = True
                    some = ids[np.repeat(starts[distinct] - last + size, size) + np.arange(last[-1])]
                    known = log >= 0
                    rare = [words[k] for k in distinct[~known].tolist()]
                    rows.append((len(t), times @ known, times[known] @ log[known], rare, times[~known], some.tobytes(), np.packbits(ends).tobytes(), own.astype(_number(len(distinct))).tobytes()))
                out = pd.DataFrame(rows, columns=["n_tokens", "n_common", "common", "rare", "times", "ids", "ends", "tokens"])
                for c in ("doc_id", "held_out", "slice"):
                    out[c] = part[c].to_numpy()
                yield out

    rows = texts.withColumn("slice", F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))).cast("int"))
    return rows.mapInPandas(work, "n_tokens long, n_common long, common double, rare array<binary>, times array<long>, ids binary, ends binary, tokens binary, doc_id string, held_out boolean, slice int")


def _parts(pdf: pd.DataFrame):
    """Parts of pdf with documents of some CHARS bytes of ids, or twice as many of their tokens' numbers."""
    size = np.maximum(pdf["ids"].str.len(), pdf["tokens"].str.len() // 2).cumsum().to_numpy()
    for group in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(size // CHARS)) + 1):
        if len(group):
            yield pdf.iloc[group]


def _groups(pdf: pd.DataFrame):
    """Parts of pdf with texts of some TEXTS characters."""
    size = pdf["text"].str.len().cumsum().to_numpy()
    for group in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(size // TEXTS)) + 1):
        if len(group):
            yield pdf.iloc[group]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``; the empty word stands for the ends of texts."""

    def count(frames):
        c = Counter()
        for pdf in frames:
            for t in pdf["text"]:
                c.update(words_of(t))
                c[b""] += 1
                if len(c) > COUNTED:
                    yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                    c = Counter()
        yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return texts.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@functools.cache
def signs(size: int) -> np.ndarray:
    return np.random.default_rng(3).integers(0, 2, (size, WIDTH)) * 2 - 1


def id_sums(encoded: DataFrame, path: str) -> DataFrame:
    """(id, n, s0, s1 ...): how often each subword id occurs, and the sum of the documents it occurs in."""
    names = [f"s{j}" for j in range(WIDTH)]

    def work(frames):
        size = _subwords(path).n_vocab + 1
        # All numbers are integers that doubles hold exactly.
        own, sums, counts = signs(size).astype("float64"), np.zeros((size, WIDTH)), np.zeros(size)
        place = np.empty(size, "int64")
        for pdf in frames:
            for part in _parts(pdf):
                some = Encoded.read(path, part["ids"], part["ends"], part["tokens"])
                every = np.repeat(np.bincount(some.tokens, minlength=len(some.sizes)), some.sizes)
                ends = np.cumsum(part["ids"].str.len().to_numpy() // np.dtype(_kind(path)).itemsize)
                for s, e in zip([0, *ends[:-1]], ends):
                    ids, at = some.ids[s:e], np.arange(e - s)
                    place[ids] = at
                    distinct = ids[place[ids] == at]
                    place[distinct] = np.arange(len(distinct))
                    times = np.bincount(place[ids], every[s:e])
                    doc = times @ own.take(distinct, 0)
                    doc = np.round(100 * doc / max(1.0, math.sqrt(doc @ doc)))
                    sums[distinct] += times[:, None] * doc
                    counts[distinct] += times
        some = np.flatnonzero(counts)
        out = pd.DataFrame(sums[some].astype("int64"), columns=names)
        out.insert(0, "n", counts[some].astype("int64"))
        out.insert(0, "id", some)
        yield out

    kind = ", ".join(["id int", "n long", *(f"{c} long" for c in names)])
    return encoded.select("ids", "ends", "tokens").mapInPandas(work, kind).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def id_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A vector for each id: its mean document less that of all ids, on principal axes; rare ids are drawn to zero."""
    total = counts.sum()
    if not total:
        return np.zeros_like(sums, "float32")
    x = (sums - sums.sum(0) / total * counts[:, None]) / (counts[:, None] + 5)
    _, axes = np.linalg.eigh((x * counts[:, None]).T @ x / total)
    x = x @ axes[:, ::-1]
    size = math.sqrt((x**2 * counts[:, None]).sum() / total / WIDTH)
    return (x / (2 * size + 1e-9)).astype("float32")


def k_means(x: np.ndarray, weight: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """Centres of weighted k-means, from the heaviest point and then those with the most weighted distance."""
    centres = np.zeros((k, x.shape[1]))
    if not weight.any():
        return centres
    x = x.astype("float64")
    centres[0] = x[int(np.argmax(weight))]
    far = ((x - centres[0]) ** 2).sum(1) * weight
    for j in range(1, k):
        centres[j] = x[int(np.argmax(far))]
        far = np.minimum(far, ((x - centres[j]) ** 2).sum(1) * weight)
    for _ in range(steps):
        near = nearest(x, centres)
        mass = np.bincount(near, weight, k)
        for c in range(x.shape[1]):
            centres[:, c] = np.where(mass > 0, np.bincount(near, weight * x[:, c], k) / np.maximum(mass, 1), centres[:, c])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    centres = centres.astype("float64")
    turned, size = -2 * centres, (centres**2).sum(1)[:, None]
    # A distance's last bits hold the centre's number, so that the least one tells it.
    number = np.arange(len(centres))[:, None]
    low = (1 << len(centres).bit_length()) - 1
    out = np.empty(len(x), "int64")
    for s in range(0, len(x), BATCH):
        far = turned @ x[s : s + BATCH].T.astype("float64")
        far += size
        bits = far.view("int64")
        bits &= ~low
        bits |= number
        out[s : s + BATCH] = far.min(0).view("int64") & low
    return out


class Vocabulary:
    """Vectors of ids and centres of classes; both of bounded size."""

    def __init__(self, sums: np.ndarray, counts: np.ndarray):
        self.vectors = id_vectors(sums, counts)
        self.centres = k_means(self.vectors, counts.astype("float64"), CLASSES - 1)

    def of(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and classes of tokens, from their ids in a row."""
        if not len(sizes):
            return np.zeros((0, WIDTH), "float32"), np.zeros(0, "int64")
        ends = np.cumsum(sizes)
        x = np.empty((len(sizes), WIDTH), "float32")
        for s in range(0, len(sizes), 4 * BATCH):
            own = sizes[s : s + 4 * BATCH]
            order = np.argsort(-own, kind="stable")  # those with most ids first
            own = own[order]
            at = ends[s : s + 4 * BATCH][order] - own
            part = self.vectors.take(ids[at], 0)
            for k in range(1, int(own[0])):  # the next id of the words that have one
                n = np.searchsorted(-own, -k)
                part[:n] += self.vectors.take(ids[at[:n] + k], 0)
            part /= own[:, None].astype("float32")
            x[s + order] = part
        kind = nearest(x, self.centres)
        kind[ids[ends - 1] == len(self.vectors) - 1] = CLASSES - 1
        return x, kind


SHAPES = {
    "match": (WIDTH, WIDTH),  # queries' times keys' weights
    "near": (CONTEXT, 2 * CONTEXT),
    "value": (WIDTH, WIDTH),
    "inner": (2 * WIDTH, HIDDEN),
    "shift": (HIDDEN,),
    "out": (HIDDEN, CLASSES),
    "prior": (CLASSES,),
}
_ENDS = np.cumsum([math.prod(s) for s in SHAPES.values()])


def unpacked(row: np.ndarray, kind: str = "float32") -> dict[str, np.ndarray]:
    """Weights by name, from all of them in a row."""
    return {k: part.reshape(s).astype(kind) for (k, s), part in zip(SHAPES.items(), np.split(np.asarray(row, "float64"), _ENDS[:-1]))}


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.asarray(p[k], "float64").ravel() for k in SHAPES])


def initial(share: np.ndarray) -> np.ndarray:
    """Weights before training: the classes' shares, whatever the context."""
    p = {k: np.zeros(s) for k, s in SHAPES.items()}
    p["value"] = np.eye(WIDTH)
    p["inner"] = np.random.default_rng(5).standard_normal(SHAPES["inner"]) / math.sqrt(2 * WIDTH)
    p["shift"] += 0.1
    p["prior"] = np.log(share)
    return packed(p)


#: Added to the scores of later tokens, whose weight is then zero.
_LATER = np.where(np.arange(2 * CONTEXT)[None, :] <= np.arange(CONTEXT)[:, None] + CONTEXT, 0, -1e9).astype("float32")
_ONES = np.ones(2 * CONTEXT, "float32")
_EACH = np.ones(CLASSES, "float32")


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of documents laid out in whole blocks, and for each block whether a document starts there."""
    blocks = -(-lengths // CONTEXT)
    starts = (np.cumsum(blocks) - blocks) * CONTEXT
    first = np.zeros(int(blocks.sum()), bool)
    first[starts // CONTEXT] = True
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths), first


def forward(p: dict, x: np.ndarray, first: np.ndarray, targets: np.ndarray):
    """Log chances (natural) of targets, and what the gradient needs.

    x has the vectors of the tokens before, laid out in blocks; the block before the first one is not seen.
    """
    d, c = WIDTH, CONTEXT
    blocks = x.reshape(-1, c, d)
    window = np.concatenate([np.concatenate([np.zeros_like(blocks[:1]), blocks[:-1]]), blocks], 1)
    turned = np.ascontiguousarray(window.transpose(0, 2, 1))
    a = np.matmul((x @ p["match"]).reshape(-1, c, d), turned)
    a += p["near"] + _LATER
    # Bounded values keep the exponentials finite; those of later tokens are zero.
    np.exp(np.minimum(a, 30, out=a), out=a)
    a[np.flatnonzero(first), :, :c] = 0
    # Weights stay as they are, and means are divided by their sums.
    share = 1 / (a.reshape(-1, 2 * c) @ _ONES)[:, None]
    h = np.concatenate([x, np.matmul(a, window).reshape(-1, d)], 1)
    h[:, d:] *= share
    # The values' weights act on all means alike, so they are taken with those that follow.
    both = np.concatenate([p["inner"][:d], p["value"] @ p["inner"][d:]])
    f = h @ both
    f += p["shift"]
    np.maximum(f, 0, out=f)
    z = f @ p["out"]
    z += p["prior"]
    np.maximum(np.minimum(z, 80, out=z), -80, out=z)
    e = np.exp(z)
    total = e @ _EACH
    logs = z.ravel().take(targets + np.arange(len(targets)) * CLASSES) - np.log(total)
    return logs, (x, window, turned, a, share, h, both, f, e, total, targets)


def gradient(p: dict, kept, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted sum of log chances, negated."""
    x, window, turned, a, share, h, both, f, e, total, targets = kept
    d, c = WIDTH, CONTEXT
    dz = e * (weights / total)[:, None]
    dz.ravel()[targets + np.arange(len(targets)) * CLASSES] -= weights
    df = dz @ p["out"].T
    df *= f > 0
    dmean = df @ both[d:].T
    dmean *= share
    da = np.matmul(dmean.reshape(-1, c, d), turned)
    da -= ((dmean * h[:, d:]) @ _ONES[:d]).reshape(-1, c, 1)
    da *= a
    dq = np.matmul(da, window).reshape(-1, d)
    each, dboth = np.ones(len(x), "float32"), h.T @ df
    inner = np.concatenate([dboth[:d], p["value"].T @ dboth[d:]])
    return {"match": x.T @ dq, "near": da.sum(0), "value": dboth[d:] @ p["inner"][d:].T, "inner": inner, "shift": each @ df, "out": f.T @ dz, "prior": each @ dz}


def _steps(x: np.ndarray, kind: np.ndarray, lengths: np.ndarray, end: np.ndarray, tokens: np.ndarray | None = None):
    """Vectors of the tokens before, first blocks, targets and which of these are tokens, some BATCH at a time.

    x and kind are the tokens' vectors and classes, or those of distinct tokens if ``tokens`` says which of them each
    token is; end is the vector of the end, which also stands before each document. Each step but the first begins with the block before it, whose tokens are no targets of its own.
    """
    places, first = laid_out(lengths)
    size = len(first) * CONTEXT
    x = np.concatenate([x, end[None, :]])
    tokens = np.arange(len(places)) if tokens is None else tokens
    before, targets, real = np.full(size, len(x) - 1), np.zeros(size, "int64"), np.zeros(size, bool)
    before[places[1:]] = tokens[:-1]
    before[places[np.cumsum(lengths) - lengths]] = len(x) - 1
    targets[places], real[places] = kind[tokens], True
    for s in range(0, size, BATCH):
        part = slice(max(0, s - CONTEXT), s + BATCH)
        own = real[part].copy()
        own[: s - part.start] = False
        yield x.take(before[part], 0), first[part.start // CONTEXT : (s + BATCH) // CONTEXT], targets[part], own


def steps(vocabulary: Vocabulary, docs: Encoded):
    yield from _steps(*vocabulary.of(docs.ids, docs.sizes), docs.lengths, vocabulary.vectors[-1], docs.tokens)


def gradients(encoded: DataFrame, path: str, weights: np.ndarray, vocabulary) -> tuple[np.ndarray, int]:
    """The sum of the gradients of all tokens of documents (ids, ends, tokens) at the given weights, and the number of tokens."""

    def work(frames):
        p = unpacked(weights)
        total, n = np.zeros(len(weights)), 0
        for pdf in frames:
            for part in _parts(pdf):
                for x, first, targets, own in steps(vocabulary.value, Encoded.read(path, part["ids"], part["ends"], part["tokens"])):
                    _, kept = forward(p, x, first, targets)
                    total += packed(gradient(p, kept, own.astype("float32")))
                    n += int(own.sum())
        yield pd.DataFrame({"sums": [np.append(total, n)] if n else []})

    rows = encoded.select("ids", "ends", "tokens").mapInPandas(work, "sums array<double>").select(F.posexplode("sums").alias("place", "value"))
    # One row for each weight.
    got = rows.groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
    return (got[:-1], int(got[-1])) if len(got) else (np.zeros(len(weights)), 0)


def fit(rows: DataFrame, counts: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray, object]:
    """Weights, sizes of classes, and a broadcast Vocabulary, from encoded training rows and word counts (word, n)."""
    spark = rows.sparkSession
    size = _subwords(path).n_vocab + 1
    seen = id_sums(rows, path).toPandas()  # one row for each subword id at most
    sums, id_counts = np.zeros((size, WIDTH)), np.zeros(size)
    sums[seen["id"]], id_counts[seen["id"]] = seen[[f"s{j}" for j in range(WIDTH)]].to_numpy(), seen["n"]
    vocabulary = spark.sparkContext.broadcast(Vocabulary(sums, id_counts))

    def classed(frames):
        for pdf in frames:
            for s in range(0, len(pdf), 20_000):
                words = pdf["word"].iloc[s : s + 20_000].tolist()
                kind = np.full(len(words), CLASSES - 1)
                kind[[len(w) > 0 for w in words]] = vocabulary.value.of(*word_ids(path, [w for w in words if w]))[1]
                yield pd.DataFrame({"kind": kind, "n": pdf["n"].iloc[s : s + 20_000].to_numpy()})

    sizes = np.ones(CLASSES)
    for r in counts.mapInPandas(classed, "kind int, n long").groupBy("kind").agg((F.sum("n") + F.count("*")).alias("size")).collect():
        sizes[r["kind"]] += r["size"]
    weights = initial(sizes / sizes.sum())
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    step = 0
    for k in range(ROUNDS):
        total, tokens = gradients(rows.filter(F.col("slice") == k), path, weights, vocabulary)
        if tokens:
            g = total / tokens
            step += 1
            mean, square = 0.8 * mean + 0.2 * g, 0.9 * square + 0.1 * g**2
            weights = weights - RATE * (1 - k / ROUNDS) * mean / (1 - 0.8**step) / (np.sqrt(square / (1 - 0.9**step)) + 1e-6)
    return weights, sizes, vocabulary


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 7 != 2


def score_texts(docs: DataFrame, training: Column, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training says which rows are learnt from; a null there counts as held out. Null and empty texts are one end.
    Repeated rows count and are scored as often as they occur. Without training rows all counts are zero and all
    classes are as likely. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), or_empty(F.col(text)).alias("text"), (~F.coalesce(training, F.lit(False))).alias("held_out"))
    counts = materialize(word_counts(texts.filter("not held_out")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, n // COMMON)
    # At most COMMON words have at least n / COMMON tokens, and at most n words at all. The end counts as one of them.
    logs = {bytes(r["word"]): math.log10(r["n"] + 1) for r in counts.filter((F.col("n") >= least) | (F.length("word") == 0)).toLocalIterator()}
    rows = encoded(ids_out(texts, "doc_id"), path, spark.sparkContext.broadcast(logs)).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "slice")
    weights, sizes, vocabulary = fit(rows.filter("slice >= 0"), counts, path)

    def work(frames):
        p, log_sizes = unpacked(weights), np.log10(sizes)
        for pdf in frames:
            for part in _parts(pdf):
                docs = Encoded.read(path, part["ids"], part["ends"], part["tokens"])
                own = [(forward(p, x, first, targets)[0] / math.log(10) - log_sizes[targets])[real] for x, first, targets, real in steps(vocabulary.value, docs)]
                yield part[names].assign(own=np.add.reduceat(np.concatenate(own), np.cumsum(docs.lengths) - docs.lengths))

    # A row and its rare words meet by the row's number.
    names = ["row", "doc_id", "held_out", "n_tokens", "n_common", "common"]
    own = rows.select(*names, "ids", "ends", "tokens").mapInPandas(work, "row long, doc_id string, held_out boolean, n_tokens long, n_common long, common double, own double")
    rare = rows.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))).alias("r")).select("row", "r.word", "r.times")
    # Common words are found in the task; the others have few rows each.
    others = counts.filter(F.col("n") < least)
    if v <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions")):
        others = others.hint("shuffle_hash")  # spares sorting both sides
    found = rare.join(others, "word")
    sums = found.groupBy("row").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    logs = F.col("common") + F.coalesce("logs", F.lit(0.0))
    out = own.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("times", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (logs + F.col("own")).alias("score"),
    )
    return ids_back(out, "doc_id", docs.schema[doc_id].dataType)


def op10_lm_score(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, is_training(F.col("doc_id")), public_tokenizers.path("byte_bpe_50k.json"))
