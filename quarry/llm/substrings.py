"""Removal of long byte strings that occur more than once, by a difference-cover suffix sort.

Sorting the suffixes of all bytes at once would shuffle every byte many times over, so anchors first cut the work to
what can repeat, without loss. The anchor of a window of ``length`` bytes is its smallest hash of GRAM bytes, so equal
windows have equal anchors at equal places. The windows that share an anchor's place are its context, a string of less
than 2 * length bytes. Anchors whose hash occurs once cannot be in a repeat. Contexts that occur more than once repeat
in full. Only anchors with different contexts are compared, with one copy of each context:

1. Contexts are dealt out by anchor hash, and those of a task are joined to texts of some TEXT bytes.
2. Their suffixes are sorted with the difference cover {1, 2} modulo 3: the triples at covered places are sorted and
   named, the string of names is sorted by recursion, and the remaining suffixes are merged in by (byte, next rank).
3. Adjacent suffixes are compared: windows whose common prefix is at least ``length`` bytes repeat.

An anchor with more than CROWD contexts is not sorted in one task: hashes of parts of its contexts, and of single
windows where these do not decide, are counted instead; equal hashes are summed before the shuffle.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, ids_back, ids_out, materialize, or_empty, table

LENGTH = 400
GRAM = 32
CROWD = 1000
#: Places of an anchor in a window that one range of a crowded anchor holds, down to single windows.
RANGES = (47, 8, 1)
#: Bytes hashed or sorted at once.
TEXT = 1 << 20
#: Windows of a text in a slice, so that the places of few slices fit PLACE bits.
SLICE, PLACE = 1 << 22, 25
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
#: An odd factor for each power of two.
_FACTORS = {1 << k: np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) % (1 << 64) | 1) for k in range(24)}


def gram_hashes(x: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A mixed hash of the ``size`` bytes (a power of two) from each place."""
    h = x.astype("uint64") + np.uint64(1)
    step = 1
    while step < size:
        h = h[:-step] * _FACTORS[step] + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint64(31))) * _A
    return h ^ (h >> np.uint64(29))


def string_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place, joined from hashes of powers of two."""
    out = np.zeros(max(0, len(x) - size + 1), "uint64")
    at = 0
    for k in reversed(range(size.bit_length())):
        if size >> k & 1:
            part = gram_hashes(x, 1 << k) if k else x.astype("uint64") * _B
            out = (out ^ part[at : at + len(out)]) * _A
            out ^= out >> np.uint64(30)
            at += 1 << k
    return out


def anchors(texts: list[bytes], length: int):
    """For each run of windows with one anchor: text, anchor, first and last window (places in the text), hash.

    Texts are taken in slices that overlap by length - 1 bytes, so that each window is in one of them; runs end there.
    """
    slices = [(k, s, t[s : s + SLICE + length - 1]) for k, t in enumerate(texts) for s in range(0, max(1, len(t) - length + 1), SLICE)]
    sizes = np.cumsum([len(t) for *_, t in slices])
    parts = []
    for group in np.split(np.arange(len(slices)), np.flatnonzero(np.diff(sizes // SLICE)) + 1):
        some = [slices[i] for i in group]
        t, a, first, last, h = _anchors([x for *_, x in some], length)
        text, start = np.array([k for k, *_ in some], "int64")[t], np.array([s for _, s, _ in some], "int64")[t]
        parts.append((text, a + start, first + start, last + start, h))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(texts: list[bytes], length: int):
    x = np.frombuffer(b"".join(texts), "uint8")
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    w = length - GRAM + 1
    none = np.empty(0, "int64")
    if len(x) < length:
        return none, none, none, none, none
    h = gram_hashes(x)
    mask = np.uint64((1 << PLACE) - 1)
    v = (h & ~mask) | np.arange(len(h), dtype="uint64")
    n = len(v) - w + 1
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & mask).astype("int64")
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    ends = (starts + sizes)[text]
    inside = np.arange(n) + length <= ends
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0) | (inside[1:] != inside[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    t, a = text[first], place[first]
    return t, a - starts[t], first - starts[t], last - starts[t], h[a].view("int64")


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of s (integers from 1 on), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        ranks = np.empty(n, "int64")
        ranks[order] = np.arange(1, n + 1)
        return ranks
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype("uint64")
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # one place past the end parts the two halves
    cover = np.concatenate([one, two])
    bits = np.uint64(max(1, int(s.max()).bit_length()))
    # Sort and name the triples.
    key = (t[cover] << (bits + bits)) | (t[cover + 1] << bits) | t[cover + 2]
    values, names = np.unique(key, return_inverse=True)
    names = names + 1
    ranks12 = names if len(values) == len(cover) else suffix_ranks(names)
    rank = np.zeros(n + 3, "uint64")
    rank[cover] = ranks12
    # Sort the other suffixes by (symbol, rank of the next), then merge.
    zero = np.arange(0, n, 3)
    wide = np.uint64(max(1, int(len(cover) + 1).bit_length()))
    near = (t[zero] << wide) | rank[zero + 1]
    order = np.argsort(near, kind="stable")
    zero, near = zero[order], near[order]
    far = (t[zero] << (bits + wide)) | (t[zero + 1] << wide) | rank[zero + 2]
    c = np.empty(len(cover), "int64")
    c[ranks12 - 1] = cover  # the cover in order, without the place past the end
    c = c[c < n]
    first = c % 3 == 1
    before = np.empty(len(c), "int64")
    before[first] = np.searchsorted(near, (t[c[first]] << wide) | rank[c[first] + 1])
    before[~first] = np.searchsorted(far, (t[c[~first]] << (bits + wide)) | (t[c[~first] + 1] << wide) | rank[c[~first] + 2])
    out = np.empty(n, "int64")
    out[c] = np.arange(1, len(c) + 1) + before
    out[zero] = np.arange(1, len(zero) + 1) + np.cumsum(np.bincount(before, minlength=len(zero) + 1))[: len(zero)]
    return out


def repeated_windows(contexts: list[bytes], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its windows also start elsewhere in a context of the same group.

    The contexts are joined by separators, so that no common prefix goes beyond one.
    """
    symbols = [np.append(np.frombuffer(c, "uint8").astype("int64") + 1, 257 + k) for k, c in enumerate(contexts)]
    s = np.concatenate(symbols)
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    order = np.empty(len(s), "int64")
    order[suffix_ranks(s) - 1] = np.arange(len(s))
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(s))
    # Only windows of whole length are compared, each with the next of these in order.
    order = order[left[order] >= length]
    same = np.zeros(len(order) + 1, bool)
    if len(order) > 1:
        h = string_hashes(np.concatenate([np.append(np.frombuffer(c, "uint8"), np.uint8(0)) for c in contexts]), length)
        a, b = order[:-1], order[1:]
        same[1:-1] = (h[a] == h[b]) & (groups[owner[a]] == groups[owner[b]])
    repeated = np.zeros(len(s), bool)
    repeated[order] = same[1:] | same[:-1]
    return [repeated[p : p + n - length + 1] for p, n in zip(starts.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype("int8"), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _batches(pdf: pd.DataFrame):
    size = pdf["text"].str.len().cumsum().to_numpy()
    for group in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(size // TEXT)) + 1):
        yield pdf.iloc[group]


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, end) of byte ranges that windows starting also elsewhere cover, for texts (row, text)."""

    def find(frames):
        for pdf in frames:
            for part in _batches(pdf):
                raw = [t.encode() for t in part["text"]]
                t, a, first, last, h = anchors(raw, length)
                # Equal contexts have equal bytes and their anchor at an equal place.
                hashes = [xxhash.xxh3_64_intdigest(raw[i][f : e + length], int(k - f)) - (1 << 63) for i, k, f, e in zip(t.tolist(), a.tolist(), first.tolist(), last.tolist())]
                yield pd.DataFrame({"row": part["row"].to_numpy()[t], "first": first, "last": last, "at": a - first, "gram": h, "context": np.array(hashes, "int64")})

    found = materialize(texts.mapInPandas(find, "row long, first long, last long, at long, gram long, context long"))
    n = found.count()
    classes = found.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "last", "at")).alias("one"))
    kinds = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("copies").alias("uses")).filter("uses > 1")
    classes = materialize(attach(classes, kinds, ["gram"], "kinds", n))

    # One copy of each context that occurs once, beside others of its anchor; what repeats in full is needed for these.
    mixed = classes.filter("kinds > 1").select("gram", "context", "copies", "kinds", "one.row", "one.first", "one.last", "one.at")
    wanted = mixed.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "copies", "kinds", "first", "last", "at")).alias("wanted"))

    def cut(frames):
        for pdf in frames:
            out = []
            for t, items in zip(pdf["text"], pdf["wanted"]):
                raw = t.encode()
                out += [(w["gram"], w["context"], w["copies"], w["kinds"], w["at"], raw[w["first"] : w["last"] + length]) for w in items]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=["gram", "context", "copies", "kinds", "at", "bytes"])
                    out = []
            yield pd.DataFrame(out, columns=["gram", "context", "copies", "kinds", "at", "bytes"])

    cuts = materialize(texts.join(wanted, "row").select("text", "wanted").mapInPandas(cut, "gram long, context long, copies long, kinds long, at long, bytes binary"))

    def sort(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            gram = pdf["gram"].to_numpy()
            same = int(np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))[-1])  # the last group may go on
            rest = pdf.iloc[same:]
            yield from _sorted(pdf.iloc[:same], length)
        if rest is not None and len(rest):
            yield from _sorted(rest, length)

    few = cuts.filter(F.col("kinds") <= CROWD).select("gram", "context", "copies", "bytes")
    by_sort = few.repartition("gram").sortWithinPartitions("gram").mapInPandas(sort, "gram long, context long, start long, end long")

    by_hash = _crowded(cuts.filter(F.col("kinds") > CROWD).select("gram", "context", "at", "bytes"), length)

    whole = classes.filter("copies > 1").select("gram", "context", "copies", F.lit(0).cast("long").alias("start"), F.lit(1 << 40).cast("long").alias("end"))
    ranges = by_sort.unionByName(by_hash).join(classes.filter("copies = 1").select("gram", "context", "copies"), ["gram", "context"]).select("gram", "context", "copies", "start", "end").unionByName(whole)
    ranges = materialize(ranges.groupBy("gram", "context").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("start", "end")).alias("ranges")))
    placed = attach(found, ranges, ["gram", "context"], "copies", n).select("row", "first", "last", F.explode("ranges").alias("r"))
    return placed.select("row", (F.col("first") + F.col("r.start")).alias("start"), (F.least(F.col("first") + F.col("r.end") - 1, "last") + length).alias("end"))


def _crowded(cuts: DataFrame, length: int) -> DataFrame:
    """(gram, context, start, end) of repeated windows of the contexts of crowded anchors, without sorting them.

    The places of an anchor in its window are cut into ranges. Windows of one range share a core, the bytes they all
    hold, so a context whose core is its own has no repeat in that range; contexts with all bytes of a range's windows
    in common repeat there in full. What neither decides is cut into smaller ranges, down to single windows. Of
    contexts that agree in a range one goes on for all.
    """
    found, left = None, cuts.select("gram", "context", "at", F.lit(0).alias("low"), F.lit(length).alias("high"), "bytes")
    for size in RANGES:

        def split(frames, size=size):
            for pdf in frames:
                out = []
                for g, c, at, least, most, raw in zip(pdf["gram"], pdf["context"], pdf["at"], pdf["low"], pdf["high"], pdf["bytes"]):
                    least, most = max(least, at - (len(raw) - length)), min(most, at)
                    for r in range(least // size, most // size + 1):
                        low, high = max(least, r * size), min(most, r * size + size - 1)
                        core = raw[at - r * size : at - (r * size + size - 1) + length]
                        hull = raw[at - high : at - low + length]
                        out.append((g, c, at, low, high, r, xxhash.xxh3_64_intdigest(core) - (1 << 63), xxhash.xxh3_64_intdigest(hull, high * 1024 + low) - (1 << 63), raw))
                yield pd.DataFrame(out, columns=["gram", "context", "at", "low", "high", "cell", "core", "hull", "bytes"])

        key = ["gram", "cell", "core", "hull"]
        cells = materialize(left.mapInPandas(split, "gram long, context long, at long, low int, high int, cell int, core long, hull long, bytes binary"))
        n = cells.count()
        hulls = cells.groupBy(*key).agg(F.count("*").alias("m"), F.min("context").alias("one"))
        full = attach(cells.drop("bytes"), hulls.filter("m > 1"), key, "m", n)
        full = full.select("gram", "context", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + 1).alias("end"))
        found = full if found is None else found.unionByName(full)
        cores = hulls.groupBy("gram", "cell", "core").agg(F.count("*").alias("hulls")).filter("hulls > 1")
        ones = hulls.select(*key, F.col("one").alias("context")).join(cores.select("gram", "cell", "core"), ["gram", "cell", "core"])
        left = cells.join(ones, [*key, "context"], "left_semi").select("gram", "context", "at", "low", "high", "bytes")
    return found


def _sorted(pdf: pd.DataFrame, length: int):
    """Ranges of repeated windows in whole groups of contexts, some TEXT bytes at a time."""
    if not len(pdf):
        return
    gram, sizes = pdf["gram"].to_numpy(), pdf["bytes"].str.len().cumsum().to_numpy()
    edges = np.flatnonzero(gram[1:] != gram[:-1]) + 1
    part = sizes[np.append(edges - 1, len(pdf) - 1)] // TEXT
    cuts = edges[np.flatnonzero(np.diff(part))]
    for some in np.split(np.arange(len(pdf)), cuts):
        g, c, raw = gram[some], pdf["context"].to_numpy()[some], pdf["bytes"].iloc[some].tolist()
        out = [(int(g[k]), int(c[k]), s, e) for k, flags in enumerate(repeated_windows(raw, g, length)) for s, e in _runs(flags)]
        yield pd.DataFrame(out, columns=["gram", "context", "start", "end"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain, joined).

    Each byte goes that a string of ``length`` bytes covers which also starts elsewhere, in the same document or
    another; strings never cross documents. Null texts are empty, repeated rows are documents of their own, and texts
    shorter than ``length`` stay whole. Rows repeat if their ids do; an empty table gives no rows.
    """
    texts = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), or_empty(F.col(text)).alias("text")))
    spans = repeats(texts.select("row", "text"), length).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(frames):
        for pdf in frames:
            out = []
            for t, spans in zip(pdf["text"], pdf["spans"]):
                raw = t.encode()
                if spans is None or not len(spans):
                    out.append((len(raw), 0, 0, raw))
                    continue
                cover = np.zeros(len(raw) + 1, "int32")
                np.add.at(cover, [s["start"] for s in spans], 1)
                np.add.at(cover, [s["end"] for s in spans], -1)
                gone = np.cumsum(cover)[:-1] > 0
                out.append((len(raw), int(gone.sum()), len(_runs(gone)), np.frombuffer(raw, "uint8")[~gone].tobytes()))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame

    rows = ids_out(texts.join(spans, "row", "left").select("doc_id", "text", "spans"), "doc_id")
    return ids_back(rows.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary"), "doc_id", docs.schema[doc_id].dataType)


def op4_repeated_substrings(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
