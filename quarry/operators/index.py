"""The inverted index: postings in blocks, lengths, frequencies, and BM25 over them."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as t
from quarry.functions.vectors import encode
from quarry.operators.ordering import prefix_ranges, ranked

K1, B = 1.5, 0.75
#: Stored tokens that one query term expands to at most, in ascending order, and results before a re-rank.
EXPANSIONS, CANDIDATES = 64, 50
#: Terms of fewer characters are not expanded; symbols that one block of postings spans; rows of a page of stored blocks.
PREFIX, SPAN, PAGE_ROWS = 3, 8, 2000
#: Postings of rare tokens that are read for a query before anything else, for each hit wanted.
RARE_POSTINGS = 8
#: Symbols whose tokens a task counts at once.
STEP = 1000
#: Symbols and queries that meet in one cell of search_table() at most, about; symbols of a cell where tasks would lack work.
SYMBOLS, QUERIES, FEW = 1 << 15, 1 << 17, 1 << 12
#: Scores are rounded to so many digits; bounds that are nearer than that decide nothing.
DIGITS, NEAR = 6, 2e-6


def with_tokens(symbols: DataFrame) -> DataFrame:
    """(id, tokens) with each symbol's postings in one array, so lengths need no explode and no shuffle."""
    return symbols.select("id", t.symbol_tokens(F.col("name"), F.col("qualname"), F.col("docstring"), F.col("snippet")).alias("tokens"))


def postings(symbols: DataFrame) -> DataFrame:
    """(symbol_id, token, field, weight), one row per posting."""
    return with_tokens(symbols).select(F.col("id").alias("symbol_id"), F.inline("tokens"))


def corpus_stats(symbols: DataFrame) -> DataFrame:
    """One row: n symbols, avg_len postings over the symbols that have any (0 where none has)."""
    size = F.col("doc_len")
    return _sizes(symbols).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(size > 0, size)), F.lit(0.0)).alias("avg_len"))


def doc_len(symbols: DataFrame) -> DataFrame:
    return _sizes(symbols).filter("doc_len > 0")


def _sizes(symbols: DataFrame) -> DataFrame:
    lists = t.token_lists(F.col("name"), F.col("qualname"), F.col("docstring"), F.col("snippet"))
    return symbols.select(F.col("id").alias("symbol_id"), sum(F.size(x) for x in lists.values()).cast("long").alias("doc_len"))


def doc_freq(symbols: DataFrame, *by: str) -> DataFrame:
    """(token, df) for each value of ``by``: each symbol counts a token once, before anything is shuffled."""
    lists = t.token_lists(F.col("name"), F.col("qualname"), F.col("docstring"), F.col("snippet"))
    return symbols.select(*by, F.explode(F.array_distinct(F.concat(*lists.values()))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("df"))


def term_freq(symbols: DataFrame, *keep: str) -> DataFrame:
    """(symbol_id, length, token, tf) and kept columns: summed weights to the nearest whole, halves up, at least 1.

    Counted inside each row, without a shuffle: every token stands in a sorted list as often as its weight has halves,
    and runs of equal tokens are measured by where they start.
    """
    lists = t.token_lists(F.col("name"), F.col("qualname"), F.col("docstring"), F.col("snippet"))
    copies = [tokens for field, tokens in lists.items() for _ in range(int(2 * t.WEIGHTS[field]))]
    listed = symbols.select(F.col("id").alias("symbol_id"), *keep, sum(F.size(x) for x in lists.values()).alias("length"), F.sort_array(F.concat(*copies)).alias("s"))
    starts = listed.filter("size(s) > 0").withColumn("at", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[i - 1])"))
    runs = F.expr("transform(at, (p, k) -> named_struct('token', s[p], 'tf', greatest(bigint((coalesce(get(at, k + 1), size(s)) - p + 1) div 2), 1L)))")
    return starts.select("symbol_id", *keep, "length", F.inline(runs))


def score(tf: Column, df: Column, length: Column, n: Column, average: Column) -> Column:
    """BM25 of one term; 0 for an empty corpus."""
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    value = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    return F.when((n <= 0) | (average <= 0), F.lit(0.0)).otherwise(value)


class Index(NamedTuple):
    """A stored index: symbols in order of files, postings and tokens in order of tokens, and the corpus figures.

    SPAN symbols that are neighbours have one block number (column block). postings is (token, block, symbol_id, tf,
    length); those of a token and a block score at most what its greatest frequency and least length give, and neighbours,
    which are of one file or folder, have tokens in common. tokens is (token, rank, df, top_tf, least_length). Postings of
    dead (block, id), if given, do not count.
    """

    symbols: DataFrame
    stored: DataFrame
    tokens: DataFrame
    n: int
    average: float
    dead: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(token, symbol_id, tf, length)"""
        return self.alive(self.stored).drop("block")

    @property
    def blocks(self) -> DataFrame:
        """(token, block, n, top_tf, least_length)"""
        return self.stored.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("tf").alias("top_tf"), F.min("length").alias("least_length"))

    def alive(self, rows: DataFrame, id_: str = "symbol_id") -> DataFrame:
        """rows (block, id ...) without those of dead symbols."""
        return rows if self.dead is None else rows.join(self.dead.withColumnRenamed("id", id_), ["block", id_], "left_anti")


def numbered(symbols: DataFrame) -> DataFrame:
    """symbols in order of files, with the number of their block; to be written, as numbers follow partitions."""
    by = ["file", "line_start", "id"]
    place = F.monotonically_increasing_id()
    block = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.floor(place.bitwiseAND((1 << 33) - 1) / SPAN)
    return symbols.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("block", block)


POSTING = "token string, block long, symbol_id long, tf long, length long"


def write_postings(symbols: DataFrame, folder: str) -> tuple[int, int]:
    """Write the postings of stored symbols (see numbered()) in order of tokens; symbols that have any, and fields' tokens.

    Texts are split once, and tasks count what they split; the counts are held on disk until the postings are written, so
    that the shuffle by ranges neither counts anew to find its borders nor carries texts.
    """
    lists = t.token_lists(F.col("name"), F.col("qualname"), F.col("docstring"), F.col("snippet"))
    texts = {field: t.text_runs(F.col(field)) for field in ("docstring", "snippet")}
    counted = symbols.select("id", "block", *[x.alias(field) for field, x in (lists | texts).items()]).mapInArrow(_counted, POSTING).persist(StorageLevel.DISK_ONLY)
    try:
        paged(counted.filter("token is not null").repartitionByRange("token", "block").sortWithinPartitions("token", "block", "symbol_id"), folder)
        return counted.filter("token is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    finally:
        counted.unpersist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols (id, block and tokens by field) as POSTING; a row without a token sums up STEP symbols for write_postings()."""
    for batch in batches:
        for low in range(0, batch.num_rows, STEP):
            yield _postings(batch.slice(low, STEP))


def _postings(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Tokens become numbers, and one sort brings (symbol, token, weight) together."""
    ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
    values, holds, halves, whole = [], [], [], []
    for field, weight in t.WEIGHTS.items():
        lists = rows.column(field)
        values.append(lists.flatten())
        holds.append(np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False)))
        halves.append(np.full(len(values[-1]), int(2 * weight), np.int64))
        whole.append(np.full(len(values[-1]), field in ("name", "qualname")))
    coded = pa.concat_arrays(values).dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + 1
    kept = np.concatenate(whole) | (pc.utf8_length(coded.dictionary).to_numpy() >= 2)[code]
    held = np.concatenate(holds)[kept]
    length = np.bincount(held, minlength=len(ids))
    key = np.sort((held * size + code[kept]) * 16 + np.concatenate(halves)[kept])
    at = np.flatnonzero(np.diff(key >> 4, prepend=-1))
    tf = np.maximum((np.add.reduceat(key & 15, at) + 1) // 2, 1) if len(at) else key
    row, token = np.divmod(key[at] >> 4, size)
    tokens = coded.dictionary.take(pa.array(token))
    ends = [(block[row], -1), (ids[row], -1), (tf, np.count_nonzero(length)), (length[row], length.sum())]
    columns = [pa.concat_arrays([tokens, pa.nulls(1, tokens.type)]), *[pa.array(np.append(x, last).astype(np.int64)) for x, last in ends]]
    return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in POSTING.split(", ")])


def paged(df: DataFrame, folder: str) -> None:
    """Write df in small pages, so that a filter on its order reads few rows."""
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(folder)


def build(symbols: DataFrame, folder: str) -> Index:
    """Write the index of symbols (distinct ids) into folder, and load it.

    Postings lie in order of tokens, and those of a frequent token spread over many pages, so a search reads only the pages
    of its tokens.
    """
    spark = symbols.sparkSession
    paged(numbered(symbols), f"{folder}/symbols")
    stored = spark.read.parquet(f"{folder}/symbols")
    holders, length = write_postings(stored, f"{folder}/postings")
    held = spark.read.parquet(f"{folder}/postings")
    totals = held.groupBy("token").agg(F.count("*").alias("df"), F.max("tf").alias("top_tf"), F.min("length").alias("least_length"))
    paged(ranked(totals, f"{folder}/ranks", "token"), f"{folder}/tokens")
    stored.agg(F.count("*").alias("n")).withColumn("average", F.lit(length / holders if holders else 0.0)).write.mode("overwrite").parquet(f"{folder}/figures")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Index:
    n, average = spark.read.parquet(f"{folder}/figures").select("n", "average").first()
    return Index(*(spark.read.parquet(f"{folder}/{x}") for x in ("symbols", "postings", "tokens")), n, average)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The query is one string, tokenized by the same built-in functions as the symbols; no job is needed."""
    return _local(spark, q=[query]).select(t.tokenize_query(F.col("q"))).collect()[0][0]


def _local(spark: SparkSession, **columns: list) -> DataFrame:
    """A few rows that the plan itself holds."""
    return spark.createDataFrame(pa.table(columns))


def _any(filters: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, filters, F.lit(False))


def _within(column: str, low: str, high: str | None = None) -> Column:
    return F.col(column).between(low, high or low)


def expansions(tokens: DataFrame, terms: list[str], limit: int = EXPANSIONS, expanded: bool = True) -> DataFrame:
    """(term, token, df): stored tokens that each term stands for, in one pass over the ranges that terms begin.

    A term stands for itself and, from PREFIX characters on, for the first ``limit`` tokens that it begins, itself
    included where it is stored. Every task keeps the first tokens of a term only.
    """
    grown = [x for x in dict.fromkeys(terms) if expanded and len(x) >= PREFIX]
    wanted = _any([F.col("token").startswith(x) for x in grown] + [F.col("token") == x for x in dict.fromkeys(terms) if x not in grown])
    begun = F.array(*[F.when(F.col("token").startswith(x), F.lit(x)) for x in grown], *[F.when(F.col("token") == x, F.lit(x)) for x in dict.fromkeys(terms) if x not in grown])
    found = tokens.filter(wanted).select("token", "df", F.explode(F.array_compact(begun)).alias("term"))
    place = F.row_number().over(Window.partitionBy("term").orderBy("token"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("term", "token", "df")


def expand(tokens: DataFrame, terms: list[str], limit: int = EXPANSIONS) -> DataFrame:
    """Distinct tokens (token): the terms themselves, stored or not, and their expansions."""
    given = tokens.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(terms)], "token string")
    return given.union(expansions(tokens, terms, limit).select("token")).distinct()


def search(index: Index, query: str, top: int = 10, where: Column | None = None, expanded: bool = True) -> DataFrame:
    """BM25 hits (symbol columns, score and rank from 1 on), best first, ties by id; at most CANDIDATES.

    Lengths, frequencies and the number of symbols are those of the whole corpus; ``where`` filters hits only. A term's
    tokens lie side by side, so a query reads one range of postings for each of its terms, then the rows of its hits.
    Without an index for it, see build(); for many queries at once, search_many().
    """
    spark = index.symbols.sparkSession
    top = min(top if top > 0 else 10, CANDIDATES)
    none = index.symbols.drop("block").limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    terms = query_terms(spark, query)
    if not terms:
        return none
    spans: dict[str, list[str]] = {}
    known: dict[str, int] = {}
    for term, token, df in sorted(map(tuple, expansions(index.tokens, terms, expanded=expanded).collect())):
        spans.setdefault(term, []).append(token)
        known[token] = df
    if not known:
        return none
    read = index.stored.filter(_any([_within("token", x[0], x[-1]) for x in spans.values()]))
    freq = _local(spark, token=list(known), df=list(known.values()))
    hits = index.alive(read.join(F.broadcast(freq), "token"))
    part = score(F.col("tf"), F.col("df"), F.col("length"), F.lit(index.n), F.lit(index.average))
    scored = hits.groupBy("block", F.col("symbol_id").alias("id")).agg(F.round(F.sum(part), DIGITS).alias("score"))
    if where is not None:
        scored = scored.join(index.symbols.filter(where).select("block", "id"), ["block", "id"], "left_semi")
    order = [F.desc("score"), F.asc("id")]
    best = scored.orderBy(*order).limit(top).collect()
    if not best:
        return none
    ids = [r["id"] for r in best]
    placed = _local(spark, id=ids, score=[r["score"] for r in best], rank=pa.array(range(1, len(ids) + 1), pa.int32()))
    rows = index.symbols.filter(_any([F.col("block") == b for b in {r["block"] for r in best}])).drop("block")
    return rows.join(F.broadcast(placed), "id").orderBy("rank")


def query_tokens(index: Index, queries: DataFrame, folder: str, expanded: bool = True) -> DataFrame:
    """(query_id, token, df, top): the stored tokens of each query (query_id, text), and the most that one can score.

    Prefixes are ranges of ranks, so no term needs a pass of its own.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(t.tokenize_query(F.col("text")))).alias("term"))
    own = terms.select("query_id", F.col("term").alias("token"))
    if expanded:
        stored = index.tokens if "rank" in index.tokens.columns else ranked(index.tokens, f"{folder}/ranks", "token")
        grown = prefix_tokens(stored, terms.select("term").distinct(), folder)
        own = own.unionByName(terms.join(grown, "term").select("query_id", "token")).distinct()
    top = score(F.col("top_tf"), F.col("df"), F.col("least_length"), F.lit(index.n), F.lit(index.average))
    return own.join(index.tokens, "token").select("query_id", "token", "df", top.alias("top"))


def prefix_tokens(tokens: DataFrame, terms: DataFrame, folder: str, limit: int = EXPANSIONS) -> DataFrame:
    """(term, token): the first ``limit`` of the tokens (token, rank) that each distinct term of PREFIX characters begins."""
    spans = prefix_ranges(tokens, terms.filter(F.length("term") >= PREFIX), f"{folder}/prefixes")
    ranks = spans.select("term", F.explode(F.expr(f"sequence(low, least(high, low + {limit}) - 1)")).alias("rank"))
    return ranks.join(tokens.select("rank", "token"), "rank").select("term", "token")


class Hits(NamedTuple):
    """(query_id, id, score, rank) and one row of figures (blocks, read): blocks of the queries' tokens, and those read."""

    rows: DataFrame
    figures: DataFrame


def search_many(index: Index, queries: DataFrame, folder: str, top: int = CANDIDATES, expanded: bool = True) -> Hits:
    """The best ``top`` symbols of every query (query_id, text), as search() finds them; folder takes tables in between.

    1. A query's rarest tokens, of RARE_POSTINGS postings for each hit wanted, score all symbols that hold them. The best
       of these, twice as many as hits wanted, are scored in full: what cannot reach the last hit among them is none.
    2. Frequent tokens that together cannot reach it are optional, the most frequent ones first. A span of symbols can
       reach the best that its rare tokens gave and the bounds of the blocks that frequent tokens have there; bounds are
       read without postings, and those of optional tokens only in spans that hold any other token of the query.
    3. Blocks of frequent tokens are read in spans that can reach the last hit, and nowhere else.

    Only the best ``top`` symbols of a query leave a task. Blocks of a hub token are spread over its spans.
    """
    spark = index.symbols.sparkSession
    keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    by_query, span = Window.partitionBy("query_id"), ["query_id", "block"]
    n, average = F.lit(index.n), F.lit(index.average)
    wanted = query_tokens(index, queries, folder, expanded)
    before = F.coalesce(F.sum("df").over(by_query.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = keep(wanted.withColumn("rare", before < RARE_POSTINGS * top), "wanted")
    tokens = wanted.filter("rare").select("query_id", "token", "df")

    def scored(met: DataFrame) -> DataFrame:
        """(query_id, block, id, part): sums over postings (query_id, df, block, symbol_id, tf, length)."""
        parts = index.alive(met.withColumnRenamed("symbol_id", "id"), "id").select(*span, "id", score(F.col("tf"), F.col("df"), F.col("length"), n, average).alias("part"))
        return parts.groupBy(*span, "id").agg(F.sum("part").alias("part"))

    def best(rows: DataFrame, by: str, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc(by), "id"))).filter(F.col("rank") <= k)

    def summed(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy(*span, "id").agg(F.sum("part").alias("part"))

    rare = keep(scored(tokens.join(index.stored, "token")), "rare")
    bounds = keep(index.blocks.select("token", "block", "top_tf", "least_length"), "bounds")
    often = wanted.filter("not rare").select("query_id", "token", "df", "top")
    leaders = keep(best(rare, "part", 2 * top).drop("rank"), "leaders")
    led = often.join(leaders.select(*span).distinct(), "query_id").join(bounds.select("token", "block"), ["token", "block"]).select("query_id", "token", "df", "block")
    full = summed(leaders, scored(led.join(index.stored, ["token", "block"])).join(leaders.select(*span, "id"), [*span, "id"], "left_semi"))
    last = best(full, "part", top).groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("part") - NEAR).alias("last"))
    bar = keep(wanted.select("query_id").distinct().join(last, "query_id", "left").select("query_id", F.coalesce("last", F.lit(0.0)).alias("bar")), "bar")
    together = F.sum("top").over(by_query.orderBy(F.desc("df"), "token"))
    judged = keep(often.join(bar, "query_id").withColumn("optional", together < F.col("bar")).select("query_id", "token", "df", "optional"), "judged")
    main = judged.filter("not optional").drop("optional").join(bounds, "token")
    near = rare.select(*span).unionByName(main.select(*span)).distinct()
    side = judged.filter("optional").drop("optional").join(near, "query_id").join(bounds, ["token", "block"])
    often = keep(main.unionByName(side.select(*main.columns)), "often")
    bound = score(F.col("top_tf"), F.col("df"), F.col("least_length"), n, average)
    reach = often.select(*span, bound.alias("more"), F.lit(0.0).alias("most")).unionByName(rare.select(*span, F.lit(0.0).alias("more"), F.col("part").alias("most")))
    reach = reach.groupBy(*span).agg((F.sum("more") + F.max("most")).alias("reach")).join(bar, "query_id").filter("reach >= bar").select(*span)
    needed = keep(often.join(reach, span, "left_semi").select("query_id", "token", "df", "block"), "needed")
    total = summed(rare, scored(needed.join(index.stored, ["token", "block"]))).withColumn("score", F.round("part", DIGITS))
    rows = keep(best(total, "score", top).select("query_id", "id", "score", "rank"), "hits")
    one = ["query_id", "token", "block"]
    held = wanted.join(bounds.groupBy("token").agg(F.count("*").alias("k")), "token").agg(F.sum("k").alias("blocks"))
    first = tokens.join(bounds.select("token", "block"), "token").agg(F.count("*").alias("first"))
    later = led.select(*one).unionByName(needed.select(*one)).distinct().agg(F.count("*").alias("later"))
    figures = held.join(first).join(later).select("blocks", (F.col("first") + F.col("later")).alias("read"))
    return Hits(rows, figures)


def query_ranges(index: Index, queries: DataFrame, folder: str, expanded: bool = True) -> DataFrame:
    """(query_id, spans): the ranks of the stored tokens of each query (query_id, text) that has any, as sorted (low, high), high excluded.

    Spans of one query may overlap. A term of PREFIX characters stands for at most EXPANSIONS tokens, see prefix_tokens().
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(t.tokenize_query(F.col("text")))).alias("term"))
    stored = index.tokens if "rank" in index.tokens.columns else ranked(index.tokens, f"{folder}/ranks", "token")
    asked = terms.select("term").distinct()
    spans = asked.join(stored, asked["term"] == stored["token"]).select("term", F.col("rank").alias("low"), (F.col("rank") + 1).alias("high"))
    if expanded:
        grown = prefix_ranges(stored, asked.filter(F.length("term") >= PREFIX), f"{folder}/prefixes")
        spans = spans.filter(F.length("term") < PREFIX).unionByName(grown.select("term", "low", F.least("high", F.col("low") + EXPANSIONS).alias("high")))
    return terms.join(spans, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))


def search_table(index: Index, queries: DataFrame, folder: str, top: int = CANDIDATES, expanded: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the best ``top`` symbols of every query, as search_many() finds them, for as many queries as symbols.

    Every query meets every symbol that holds one of its tokens, so the work grows with the product of both tables. Both are
    cut, symbols by a hash of their ids and queries likewise, and a task takes one part of each: postings in order of
    ranks, of which a query adds up a few ranges. Only the best ``top`` of a query leave a cell, ties by id.
    """
    spark = index.symbols.sparkSession
    keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    stored = index.tokens if "rank" in index.tokens.columns else keep(ranked(index.tokens, f"{folder}/ranks", "token"), "ranked")
    asked = keep(query_ranges(index._replace(tokens=stored), queries, folder, expanded), "asked")
    parts = max(-(-index.n // SYMBOLS), min(2 * spark.sparkContext.defaultParallelism, -(-index.n // FEW)), 1)
    groups = max(-(-asked.count() // QUERIES), 1)
    cell = lambda part, group: (part * groups + group).cast("int").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    left = asked.withColumn("_part", every(parts)).select(cell(F.col("_part"), of("query_id", groups)), "query_id", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))
    # Tokens that no query means are left out; small whole numbers take less of a shuffle than scores.
    meant = asked.select(F.explode("spans").alias("s")).distinct().select(F.explode(F.expr("sequence(s.low, s.high - 1)")).alias("rank")).distinct()
    held = index.alive(index.stored).join(stored.join(meant, "rank", "left_semi").select("token", "rank", "df"), "token")
    right = held.withColumn("_group", every(groups)).select(cell(of("symbol_id", parts), F.col("_group")), "rank", "df", F.col("symbol_id").alias("id"), (F.shiftleft("tf", 32) + F.col("length")).alias("tf_length"))
    n, average = index.n, index.average
    meet = lambda a, b: _best(a, b, n, average, top)
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, "query_id long, id long, part double")
    scored = found.select("query_id", "id", F.round("part", DIGITS).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return keep(scored.withColumn("rank", place).filter(F.col("rank") <= top), "hits")


def _best(asked: pa.Table, held: pa.Table, n: int, average: float, top: int) -> pa.Table:
    """(query_id, id, part): the best symbols of each query of a cell by rounded sums, ties by id."""
    out = [], [], []
    ids, doc = np.unique(held.column("id").to_numpy(), return_inverse=True)
    rank = held.column("rank").to_numpy()
    order = np.argsort(rank, kind="stable")
    df, both = held.column("df").to_numpy(), held.column("tf_length").to_numpy()
    tf, length = both >> 32, both & 0xFFFFFFFF
    # As score() has it; a corpus with postings is not empty.
    value = np.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    rank, doc, part = rank[order], doc[order], value[order]
    width = -(-max(len(ids), 1) // 64) * 64
    for batch in asked.to_batches():
        lows = np.searchsorted(rank, batch.column("low").flatten().to_numpy()).tolist()
        highs = np.searchsorted(rank, batch.column("high").flatten().to_numpy()).tolist()
        last = np.cumsum(batch.column("low").value_lengths().to_numpy()).tolist()
        first = 0
        for query, end in zip(batch.column("query_id").to_pylist(), last):
            taken, pieces = 0, []
            for low, high in zip(lows[first:end], highs[first:end]):
                low = max(low, taken)
                if low < high:
                    pieces.append(slice(low, high))
                    taken = high
            first = end
            if not pieces:
                continue
            sums = np.bincount(np.concatenate([doc[x] for x in pieces]), np.concatenate([part[x] for x in pieces]), width)
            # At least ``top`` symbols reach the ``top``-th greatest of the maxima of rows.
            most = sums.reshape(-1, 64).max(1)
            bar = np.partition(most, len(most) - top)[len(most) - top] if len(most) > top else 0.0
            some = np.flatnonzero(sums >= bar - NEAR) if bar > NEAR else np.flatnonzero(sums)
            if len(some) > top:
                values = sums[some]
                some = some[values >= np.partition(values, len(values) - top)[len(values) - top] - NEAR]
                some = some[np.lexsort((some, -_rounded(sums[some])))[:top]]
            out[0].append(np.full(len(some), query))
            out[1].append(ids[some])
            out[2].append(sums[some])
    kinds = pa.int64(), pa.int64(), pa.float64()
    return pa.table([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(out, kinds)], ["query_id", "id", "part"])


def _rounded(values: np.ndarray) -> np.ndarray:
    """Values at DIGITS digits as whole numbers, halves up; where a double comes near a half, by its decimal digits."""
    scaled = values * 10.0**DIGITS + 0.5
    out = np.floor(scaled)
    for i in np.flatnonzero(np.abs(scaled - np.rint(scaled)) < 1e-3):
        out[i] = float(Decimal(repr(float(values[i]))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def hydrated(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits with the time at which their file (path, indexed_at) was indexed, null for files that are not known.

    At most CANDIDATES hits; where files are stored in order of path, only the pages of their paths are read.
    """
    paths = [r[0] for r in hits.select("file").distinct().collect()]
    at = files.filter(_any([F.col("path") == p for p in paths])).select(F.col("path").alias("file"), "indexed_at")
    return hits.join(F.broadcast(at), "file", "left").orderBy("rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; the product runs over the shorter length, and a zero norm gives 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def rerank(hits: DataFrame, vector: str, query: list[float] | None, top: int) -> DataFrame:
    """The best ``top`` of hits by the cosine of a vector column with the query vector, ties by rank.

    A hit without a vector scores 0. Without a query vector, or with one of zero norm, hits keep their scores and order.
    """
    if not query or not any(query):
        return hits.orderBy("rank").limit(top)
    q = F.array(*[F.lit(float(x)) for x in query])
    return hits.withColumn("score", F.round(F.coalesce(cosine(F.col(vector), q), F.lit(0.0)), 6)).orderBy(F.desc("score"), "rank").limit(top)


def rerank_text(hits: DataFrame, query: str, top: int, encoder=encode) -> DataFrame:
    """The best ``top`` of hits by the cosine of the vectors that an encoder gives for their snippets and for a query.

    ``encoder`` maps a text column to a vector column; without one, hits keep their scores and order, as they do where
    the query's vector is zero. Ties by rank.
    """
    if encoder is None:
        return rerank(hits, "", None, top)
    wanted = _local(hits.sparkSession, q=[query]).select(encoder(F.col("q"))).collect()[0][0]
    return rerank(hits.withColumn("_vector", encoder(F.col("snippet"))), "_vector", wanted, top).drop("_vector")
