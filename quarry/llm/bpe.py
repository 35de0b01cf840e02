"""Byte-level BPE encoding and decoding over a trie of distinct words.

A text is cut at its single spaces, where the tokenizer's own pattern always cuts; the pattern then splits the distinct
pieces that are not cached into words. The distinct words go into a trie, which is walked depth first. The state of a
node is the last token of the encoding of its prefix: with it, the encoding of any prefix is that token, then the
encoding of the prefix without it. Words that share a prefix share its states, so each is computed once.

The last token of a prefix is the only token t ending there that can follow the last token p of what stands before t,
that is, where merging the bytes of p and t by rank never joins them across their border. The tokens that end somewhere
follow from the longest token start that ends there, which each byte moves on; these moves are kept as they are met.

The vocabulary file is a parameter; it has the form of the tokenizers library (byte-level BPE without normalizer).
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ids_out, or_empty, table

#: Distinct pieces kept with their ids in each of the two generations of a Python worker's cache. When the young one is
#: full it becomes the old one, from which pieces that are met again move on.
CACHED_PIECES = 700_000
#: Pieces of more characters are not kept.
LONGEST_KEPT = 200


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        raw = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * (max([*raw.values(), *self.special.values()]) + 1)
        for t, i in raw.items():
            self.bytes_of[i] = bytes(chars[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        # The bytes of all tokens in a row, for decoding.
        self.flat = np.frombuffer(b"".join(self.bytes_of), "uint8")
        self.lengths = np.array(list(map(len, self.bytes_of)))
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.id_of = {self.bytes_of[i]: i for i in raw.values()}
        # Tokens by rank: the bytes first, then the result of each merge in order.
        self.rank, self.parts, self.joined = {}, {}, {}
        for t, i in raw.items():
            if len(t) == 1:
                self.rank[i] = len(self.rank) - 256
                self.parts[i] = None
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, both = raw[a], raw[b], raw[a + b]
            self.joined[left, right] = n
            if both not in self.rank:
                self.rank[both], self.parts[both] = n, (left, right)
        # Every start of a token is a node: its bytes, its moves by byte, and the tokens that end it, the longest first,
        # each with its length and the tokens that are known to stay apart from it or not.
        self.starts = {t[:end] for t in self.id_of for end in range(1, len(t) + 1)}
        self.nodes: dict[bytes, tuple] = {}
        self.apart: dict[int, dict[int, bool]] = {}
        self.n_apart = 0
        self.root: tuple[bytes, dict[int, tuple], list] = (b"", {}, [])
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.outside = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.young: dict[str | tuple[str, bool], bytes | None] = {}
        self.old: dict[str | tuple[str, bool], bytes | None] = {}

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the bytes of left and right across their border.

        The tokens are taken apart from the latest merge on. A merge across the border happens if it comes before
        the merges that build the parts it needs away (on equal rank the one further left comes first).
        """
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = 1 << 60
        while True:
            at = joined.get((left, right))
            if at is not None and at < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                if a < 0:
                    return True
                limit, left = a, parts[left][1]
            else:
                if b < 0:
                    return True
                limit, right = b + 1, parts[right][0]

    def _move(self, node: tuple, byte: int) -> tuple:
        """The node of the longest token start that ends with what node stands for, then byte."""
        held = node[0] + bytes((byte,))
        while held not in self.starts:
            held = held[1:]
        to = self.nodes.get(held)
        if to is None:
            ids = [(self.id_of[held[k:]], len(held) - k) for k in range(len(held)) if held[k:] in self.id_of]
            to = self.nodes[held] = (held, {}, [(t, n, self.apart.setdefault(t, {})) for t, n in ids])
        node[1][byte] = to
        return to

    def _encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words, by depth-first traversal of their trie."""
        move, stay_apart, lengths = self._move, self._stay_apart, self.lengths.tolist()
        done: dict[str, bytes] = {}
        last: list[int] = [-1]  # state of each node on the path from the root, and its longest token start
        nodes: list[tuple] = [self.root]
        path = b""
        for raw, word in sorted(zip([w.encode() for w in words], words)):  # this order visits the trie depth first
            same = 0
            for x, y in zip(raw, path):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], nodes[same + 1 :]
            node = nodes[same]
            for byte in raw[same:]:
                same += 1
                node = node[1].get(byte) or move(node, byte)
                for t, n, apart in node[2]:
                    p = last[same - n]
                    if p < 0:
                        break  # the token is the whole prefix
                    ok = apart.get(p)
                    if ok is None:
                        ok = apart[p] = stay_apart(p, t)
                        self.n_apart += 1
                    if ok:
                        break
                last.append(t)
                nodes.append(node)
            path = raw
            out, end = [], len(raw)
            while end:
                t = last[end]
                out.append(t)
                end -= lengths[t]
            done[word] = array("I", out[::-1]).tobytes()
        if self.n_apart > 2_000_000:
            self.n_apart = 0
            for known in self.apart.values():
                known.clear()
        return done

    def _encode_new(self, pieces: list[str | tuple[str, bool]]) -> None:
        """Encode distinct pieces into the cache.

        A string stands for a space and itself, a tuple for its text as it is, whole if it is special. Where a string
        is empty or ends in white space the pattern may not cut after it, which is marked by None.
        """
        find, cache, split = self.words.findall, self.young, {}
        for x in pieces:
            if isinstance(x, str):
                if not x or x[-1].isspace():
                    cache[x] = None
                else:
                    # The usual forms, a run of letters with or without one mark after it, need no pattern.
                    split[x] = [" " + x] if x.isalpha() else [" " + x[:-1], x[-1]] if x[-1] in ".,;:!?" and x[:-1].isalpha() else find(" " + x)
            elif x[1]:
                cache[x] = array("I", [self.special[x[0]]]).tobytes()
            else:
                split[x] = find(x[0])
        done = self._encode_words({w for words in split.values() for w in words})
        for x, words in split.items():
            cache[x] = done[words[0]] if len(words) == 1 else b"".join(map(done.__getitem__, words))

    def _cache(self, pieces: set[str | tuple[str, bool]]) -> dict[str | tuple[str, bool], bytes | None]:
        """The young generation of the cache, holding all of pieces."""
        new = pieces.difference(self.young)
        if len(self.young) + len(new) > CACHED_PIECES:
            self.old, self.young, new = self.young, {}, pieces
        known = self.old.keys() & new
        self.young.update((x, self.old[x]) for x in known)
        self._encode_new(list(new - known))
        return self.young

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        """Words and special tokens of a text."""
        parts = self.outside.split(text) if self.outside is not None else [text]
        return [x for k, p in enumerate(parts) for x in ([(p, True)] if k % 2 else [(w, False) for w in self.words.findall(p)])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str | tuple[str, bool]]] = []
        for text in texts:
            if any(s in text for s in self.special):
                split.append(self._pieces(text))
                continue
            pieces: list = text.split(" ")
            # Without white space at its end the first piece ends where the pattern cuts.
            if pieces[0][-1:].isspace():
                split.append(self._pieces(text))
            else:
                pieces[0] = (pieces[0], False)
                split.append(pieces)
        met = set().union(*split)
        cache = self._cache(met)
        done: list[bytes] = []
        for text, pieces in zip(texts, split):
            try:
                done.append(b"".join(map(cache.__getitem__, pieces)))
            except TypeError:  # a piece marked by None
                words = self._pieces(text)
                met.update(words)
                done.append(b"".join(map(self._cache(set(words)).__getitem__, words)))
        long = [x for x in met if len(x if isinstance(x, str) else x[0]) > LONGEST_KEPT]
        for kept in (self.young, self.old):
            for x in long:
                kept.pop(x, None)
        return done

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        all_ids, out = np.frombuffer(ids, "<u4"), []
        for s in range(0, len(all_ids), 1 << 16):
            some = all_ids[s : s + (1 << 16)]
            n = self.lengths[some]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.offsets[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> TrieEncoder:
    """One encoder for each vocabulary and Python worker."""
    return TrieEncoder(path)


#: Characters of text encoded at once; this bounds what a task holds besides its cache.
BATCH_CHARS = 8_000_000


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Slices of texts of about BATCH_CHARS, with the index of their first."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, the text read back from ids.

    One row per row of docs, repeated rows each, none for an empty table; null texts count as empty; special tokens'
    strings in a text become their ids, as the tokenizers library has it. No shuffle: each partition is streamed, some BATCH_CHARS at a time.
    """

    def run(frames):
        enc = encoder(path)
        for pdf in frames:
            texts = pdf["text"].tolist()
            for start, part in chunks(texts):
                ids = enc.encode_batch(part)
                out = pdf[names].iloc[start : start + len(part)].copy()
                out["n_tokens"] = np.array([len(x) // 4 for x in ids], "int64")
                out["ids"] = ids
                out["decoded"] = [enc.decode(x) for x in ids]
                yield out

    # Kept columns go through Python as strings, under names of their own.
    names = [f"k{j}" for j in range(len(keep))]
    rows = ids_out(docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(names, keep)], or_empty(F.col(f"`{text}`")).alias("text")), *names)
    out = rows.mapInPandas(run, ", ".join([*(f"{k} string" for k in names), "n_tokens long", "ids binary", "decoded string"]))
    return out.select(*[F.col(k).cast(docs.schema[c].dataType).alias(c) for k, c in zip(names, keep)], "n_tokens", "ids", "decoded")


def op8_bpe(spark, sf_dir):
    """Digests of the ids of every document and of the text decoded from them."""
    import public_tokenizers

    out = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
