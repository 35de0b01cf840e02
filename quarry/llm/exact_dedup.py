"""Exact deduplication by two-pass Bloom filtering, with built-in functions only.

Pass 1 sets two bits per text hash and keeps, packed in 64-bit words, the bits that were hit more than once. Pass 2
tests every row against that filter: a row with a bit that was hit once has no equal and passes straight through, the
others shuffle on their hash. A false hit only shuffles a row that had no need to, so the result is exact at any size
of the filter. The filter is broadcast; ``MAX_BITS`` bounds it (2^27 bits are 2 M words, some 64 MB as a relation),
and beyond that size more rows shuffle.

Rows of large groups of copies stay where they are, and their few keepers are broadcast (common.attach); only rows of
smaller groups are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, fresh, materialize, or_empty, table

#: What counts as white space: runs of these are one space.
SPACES = r"[\x20\x09-\x0D]+"
BITS_PER_ROW = 16
MAX_BITS = 1 << 27


def normalised(text: Column) -> Column:
    """Null as empty, runs of ASCII white space as one space."""
    return F.regexp_replace(or_empty(text), SPACES, " ")


def filter_bits(rows: int) -> int:
    """Size of the filter: a power of two, from BITS_PER_ROW a row, at most MAX_BITS."""
    return min(MAX_BITS, 1 << max(10, (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))


def _slots(sha: str, bits: int) -> list[Column]:
    return [F.xxhash64(F.col(sha), F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in (1, 2)]


def repeated_bits(hashes: DataFrame, sha: str, bits: int) -> DataFrame:
    """Pass 1: words of the filter (word, hits) with the bits that more than one insertion set."""
    twice = hashes.select(F.explode(F.array(*_slots(sha, bits))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    return _words(twice)


def member_bits(hashes: DataFrame, sha: str, bits: int) -> DataFrame:
    """Words of a plain Bloom filter (word, hits) of the values in sha; maybe_repeated() tests against it likewise."""
    return _words(hashes.select(F.explode(F.array(*_slots(sha, bits))).alias("slot")))


def _words(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("hits"))


def maybe_repeated(df: DataFrame, sha: str, words: DataFrame, bits: int, flag: str) -> DataFrame:
    """Pass 2: add the boolean column flag, false where no other row can have the same hash."""
    out, kept = df, list(df.columns)
    names = fresh(df, "__word0", "__hits0", "__word1", "__hits1")
    slots = _slots(sha, bits)
    for k, slot in enumerate(slots):
        side = words.select(F.col("word").alias(names[2 * k]), F.col("hits").alias(names[2 * k + 1]))
        out = out.join(F.broadcast(side), F.shiftright(slot, 6) == F.col(names[2 * k]), "left")
    hit = [F.coalesce(F.expr(f"shiftrightunsigned({names[2 * k + 1]}, cast(xxhash64(`{sha}`, {k + 1}) & 63 as int)) & 1"), F.lit(0)) == 1 for k in range(2)]
    return out.select(*[F.col(f"`{c}`") for c in kept], (hit[0] & hit[1]).alias(flag))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays. A null text is empty. A null doc_id sorts last, so it stays only where
    no equal text has an id. Of rows that repeat both id and text, one is marked kept. An empty table gives no rows;
    other columns are ignored.
    """
    digests = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)).alias("sha"),
        )
    )
    n = digests.count()
    bits = filter_bits(n)
    words = materialize(repeated_bits(digests, "sha", bits))
    flagged = maybe_repeated(digests, "sha", words, bits, "maybe")
    singles = flagged.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    suspects = flagged.filter("maybe").drop("maybe")
    groups = suspects.groupBy("sha").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
    )
    grouped = attach(suspects, groups, ["sha"], "group_size", n).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha"
    )
    return singles.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a smaller doc_id; columns as given.

    Rows that cannot have an equal pass through in place; only the others shuffle, on (hash, id), which no group of
    copies makes uneven. A null text is empty; a null id stays only where no equal text has an id. Of rows that repeat
    both id and text one stays. An empty table gives no rows.
    """
    sha, flag, keep_sha, keep_id = fresh(docs, "__sha", "__maybe", "__keep_sha", "__keep_id")
    own_id = F.col(f"`{doc_id}`")
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)))
    digests = materialize(hashed.select(F.col(sha).alias("sha"), own_id.alias("id")))
    bits = filter_bits(digests.count())
    words = materialize(repeated_bits(digests, "sha", bits))
    keepers = (
        maybe_repeated(digests, "sha", words, bits, "maybe").filter("maybe").groupBy("sha")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("keep"))
        .select(F.col("sha").alias(keep_sha), F.col("keep.id").alias(keep_id))
    )
    flagged = maybe_repeated(hashed, sha, words, bits, flag)
    suspects = flagged.filter(F.col(flag)).join(keepers, (F.col(sha) == F.col(keep_sha)) & own_id.eqNullSafe(F.col(keep_id)), "left_semi").dropDuplicates([sha, doc_id])
    return flagged.filter(~F.col(flag)).unionByName(suspects).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
