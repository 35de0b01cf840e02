"""Fill-in-middle texts: prefix, middle and suffix of a text in another order, and the text back again.

The bytes of many texts stand one after the other in one array. Cuts between the lines part each text into three, and
all bytes of a part move by the same number of places, so a difference array with an entry at each part's start says,
summed up, how far every byte of the batch moves: one scatter writes all outputs, and one gather reads the texts back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import or_empty, table

#: The marks before prefix, suffix and middle (fixed values), all of MARK bytes.
PREFIX, SUFFIX, MIDDLE, MARK = "<P>", "<S>", "<M>", 3
#: Bytes of texts that are taken together, and bytes whose moves are worked out at once.
BLOCK, STEP = 8 << 20, 1 << 20


def dice(key: Column, seed: int = 7) -> list[Column]:
    """Four numbers below 2^32 that a key and a seed decide; a null key counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), or_empty(key.cast("string"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def moves(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, targets) of all bytes, some STEP of them at a time; shifts says how far those from starts on move.

    starts ascends; of parts with the same start the last holds, all before it are empty.
    """
    deltas, carry = np.diff(shifts, prepend=0), 0
    for low in range(0, size, STEP):
        high = min(low + STEP, size)
        a, b = np.searchsorted(starts, (low, high))
        change = np.zeros(high - low, np.int64)
        np.add.at(change, starts[a:b] - low, deltas[a:b])
        np.cumsum(change, out=change)
        change += carry
        carry = int(change[-1])
        places = np.arange(low, high)
        yield places, places + change


def marks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every mark within the texts that end at ends, in order."""
    at = np.flatnonzero(data[: len(data) - MARK + 1] == ord("<"))
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    of = np.searchsorted(ends, at, "right")
    whole = at + MARK <= ends[of]
    return of[whole], at[whole]


def scatter(data: np.ndarray, ends: np.ndarray, rolls: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Output bytes, their ends, and (n, form, prefix_chars, middle_chars) of each text; rolls holds four numbers a text."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    feeds = np.flatnonzero(data == ord("\n"))
    first, after = np.searchsorted(feeds, starts), np.searchsorted(feeds, ends)
    n = after - first
    full = sizes > 0
    n[full] += data[ends[full] - 1] != ord("\n")

    def cut(units: np.ndarray) -> np.ndarray:
        """Places where so many lines of the texts end."""
        out = np.where(units > 0, ends, starts)
        ended = (units > 0) & (units <= after - first)
        out[ended] = feeds[(first + units - 1)[ended]] + 1
        return out

    one, two = rolls[:, 0] % (n + 1), rolls[:, 1] % (n + 1)
    a, b = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    plain = ~full | (rolls[:, 2] % 100 >= rate)
    plain[marks(data, ends)[0]] = True
    a[plain], b[plain] = ends[plain], ends[plain]
    turned = ~plain & (rolls[:, 3] % 100 < spm)
    out_ends = np.cumsum(sizes + np.where(plain, 0, 3 * MARK))
    out_starts = out_ends - sizes - np.where(plain, 0, 3 * MARK)
    tail = ends - b
    # Where the three parts begin in the output; the middle always comes last.
    to_prefix = out_starts + np.where(plain, 0, np.where(turned, 2 * MARK + tail, MARK))
    to_suffix = out_starts + np.where(turned, MARK, 2 * MARK + a - starts)
    to_middle = out_starts + 3 * MARK + (a - starts) + tail
    froms = np.stack([starts, a, b], 1).ravel()
    shifts = np.stack([to_prefix - starts, to_middle - a, to_suffix - b], 1)
    shifts[plain] = shifts[plain, :1]
    out = np.empty(int(out_ends[-1]) if len(out_ends) else 0, np.uint8)
    # Empty parts at the very end of the data move nothing.
    inside = froms < len(data)
    for places, targets in moves(len(data), froms[inside], shifts.ravel()[inside]):
        out[targets] = data[places]
    for mark, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k, byte in enumerate(mark.encode()):
            out[to[~plain] - MARK + k] = byte
    lead = (data & 0xC0) != 0x80
    facts = []
    for k in range(len(ends)):
        if plain[k]:
            facts.append((int(n[k]), "plain", None, None))
        else:
            facts.append((int(n[k]), "spm" if turned[k] else "psm", int(np.count_nonzero(lead[starts[k] : a[k]])), int(np.count_nonzero(lead[a[k] : b[k]]))))
    return out, out_ends, facts


def gather(data: np.ndarray, ends: np.ndarray, forms: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts that outputs stand for, their ends, and which outputs are of their form."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    form = np.array([x or "" for x in forms], object)
    cut = (form == "psm") | (form == "spm")
    of, at = marks(data, ends)
    of, at = of[cut[of]], at[cut[of]]
    order = {"psm": b"PSM", "spm": b"SPM"}
    good = form == "plain"
    lows, highs = np.repeat(starts[:, None], 3, 1), np.repeat(starts[:, None], 3, 1)  # of prefix, middle and suffix
    highs[good, 0] = ends[good]
    bounds = np.searchsorted(of, np.arange(len(ends) + 1))
    for k in np.flatnonzero(cut):
        found = at[bounds[k] : bounds[k + 1]]
        if len(found) == 3 and found[0] == starts[k] and data[found + 1].tobytes() == order[form[k]]:
            good[k] = True
            for place, end in zip(found, [*found[1:], ends[k]]):
                part = b"PMS".index(data[place + 1])
                lows[k, part], highs[k, part] = place + MARK, end
    sizes = (highs - lows) * good[:, None]
    to = np.cumsum(sizes.ravel()) - sizes.ravel()
    out = np.empty(int(sizes.sum()), np.uint8)
    inside = to < len(out)
    for places, sources in moves(len(out), to[inside], (lows.ravel() - to)[inside]):
        out[places] = data[sources]
    return out, np.cumsum(sizes.sum(1)), good


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, bytes of their strings in a column and the ends of these, about BLOCK bytes at a time."""
    for batch in batches:
        strings = batch.column(column).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)
        held = strings.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
        low = 0
        while low < len(strings):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low]
            low = high


def _strings(data: np.ndarray, ends: np.ndarray, good: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    if good is not None and not good.all():
        out = pa.array([x if ok else None for x, ok in zip(out.to_pylist(), good)], pa.large_string())
    return out.cast(pa.string())


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs (doc_id, text).

    Of 100 texts some ``rate`` are cut, of those some ``spm`` get their suffix first. Texts are cut between lines, of
    which they have n. A null text counts as empty, a null doc_id as an empty string where it decides the cuts, and rows
    with equal doc_id and text give equal rows. Empty texts, and those that hold a mark, stay as they are: their form is
    plain and their counts are null. A table without rows gives none, and other columns are left out. Partitions are
    streamed, about BLOCK bytes at a time, or one text where it is longer. Nothing is shuffled.
    """

    def run(batches):
        for rows, data, ends in _blocks(batches, 1):
            rolls = np.stack([rows.column(k).to_numpy() for k in range(2, 6)], 1)
            out, out_ends, facts = scatter(data, ends, rolls, rate, spm)
            n, form, prefix, middle = zip(*facts)
            columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(out, out_ends)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kept = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        kept = kept.add(name, kind)
    numbers = [x.alias(f"h{k}") for k, x in enumerate(dice(F.col("doc_id"), seed))]
    return docs.select("doc_id", or_empty(F.col("text")).alias("text"), *numbers).mapInArrow(run, kept)


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """outputs with ``restored``, the text that each was made of; null where an output is not of its form.

    Null outputs count as empty; other columns stay, but for an older ``restored``. Nothing is shuffled.
    """
    outputs = outputs.drop("restored")

    def run(batches):
        for rows, data, ends in _blocks(batches, names.index(output)):
            out, out_ends, good = gather(data, ends, rows.column(names.index(form)).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns, _strings(out, out_ends, good)], [*names, "restored"])

    names = outputs.columns
    return outputs.mapInArrow(run, T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())]))


def op12_infill(spark, sf_dir):
    """Every document cut and put together, and restored from that alone."""
    out = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts, length(t) - length(replace(t, chr(10), '')) + (t <> '' AND NOT ends_with(t, chr(10)))::INTEGER AS n,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM l),
s AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN a = n THEN length(t) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS x, CASE WHEN b = 0 THEN 0 WHEN b = n THEN length(t) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS y FROM c),
f AS (SELECT doc_id, n, t, x, y, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS z FROM s)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
