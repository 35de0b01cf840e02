"""Personal data, with built-in functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for addresses,
digit counts for phones), and context words nearby adjust the score. Base kinds (email, ip, card, phone) stay whatever
their score; further kinds (iban, ssn) stay from THRESHOLD on.

Spans count code points, end exclusive; within a kind they are the leftmost non-overlapping ones. Every pattern
starts only where a run of its characters starts or where the match before ended, and takes the run without giving
back, so that very long runs cost linear time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound, fresh, in_chunks, or_empty, read, running, table


class Kind(NamedTuple):
    name: str
    pattern: str
    #: A cheap condition on the text ``t`` that holds wherever the pattern can match.
    gate: str
    #: A condition on the matched string ``m``.
    valid: str
    #: The score with no context word near.
    score: float
    base: bool = True


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn: from the right, every second digit doubled.
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN int(substr({_DIGITS}, i, 1)) "
    f"ELSE 2 * int(substr({_DIGITS}, i, 1)) - CASE WHEN int(substr({_DIGITS}, i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0"
)
_ACCOUNT = "regexp_replace(m, ' ', '')"
#: The first four characters at the end, letters as 10 to 35, modulo 97.
_MOD97 = (
    f"length({_ACCOUNT}) BETWEEN 15 AND 34 AND aggregate(split(concat(substr({_ACCOUNT}, 5), substr({_ACCOUNT}, 1, 4)), ''), 0, (a, c) -> "
    "CASE WHEN c = '' THEN a WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + int(c)) % 97 END) = 1"
)

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t rlike r'[0-9]\.[0-9]'", f"m rlike r'^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$'", 0.6),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", r"t rlike r'[0-9][ -]?[0-9]'", _LUHN, 0.8),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"t rlike r'\+[0-9]'", f"length({_DIGITS}) BETWEEN 8 AND 15", 0.6),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"t rlike r'[A-Z]{2}[0-9]{2}'", _MOD97, 0.8, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"t rlike r'[0-9]-[0-9]'", r"m rlike r'^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)'", 0.4, False),
)
#: Words that make a kind likelier within CONTEXT code points before the span (fixed values).
WORDS = {
    "email": "e-?mail|contact|write|mailto",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|tax",
}
CONTEXT = 40
BOOST = 0.2
THRESHOLD = 0.5
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(kind: Kind, t: str) -> str:
    """SQL for the confirmed spans of one kind in the text column t.

    split() gives the gaps between the matches and regexp_extract_all() the matches; running sums of their lengths
    are the positions. All of it takes time in proportion to the text.
    """
    gaps, hits = f"split({t}, r'{kind.pattern}', -1)", f"regexp_extract_all({t}, r'{kind.pattern}', 0)"
    ends = running("transform(arrays_zip(hits, gaps), z -> cast(length(z.gaps) + length(z.hits) AS bigint))", "a + x", "0L")
    placed = f"zip_with(hits, {ends}, (m, e) -> named_struct('start', int(e) - length(m), 'end', int(e), 'm', m))"
    placed = bound("hits", hits, bound("gaps", f"slice({gaps}, 1, size(hits))", placed))
    confirmed = f"filter({placed}, s -> transform(array(s.m), m -> {kind.valid})[0])"
    near = f"{read('chunks', f'greatest(s.start - {CONTEXT}, 0)', 's.start')} rlike r'(?i)\\b(?:{WORDS[kind.name]})\\b'"
    scored = f"transform(c, s -> named_struct('kind', '{kind.name}', 'start', s.start, 'end', s.end, 'score', {kind.score}D + CASE WHEN {near} THEN {BOOST}D ELSE 0D END))"
    if not kind.base:
        scored = f"filter({scored}, s -> s.score >= {THRESHOLD}D)"
    scored = bound("c", confirmed, f"CASE WHEN size(c) = 0 THEN cast(array() as {SPAN}) ELSE {bound('chunks', in_chunks(t), scored)} END")
    return f"CASE WHEN {kind.gate.replace('t ', f'{t} ').replace('(t,', f'({t},')} AND {t} rlike r'{kind.pattern}' THEN {scored} ELSE cast(array() as {SPAN}) END"


def span_columns(docs: DataFrame) -> list[str]:
    """The columns that find_spans() adds, in the order of KINDS."""
    return fresh(docs, *[f"pii_{k.name}" for k in KINDS])


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one array of (kind, start, end, score) per kind, in columns ``pii_KIND``.

    A null or empty text has no spans. Repeated rows and all other columns stay as they are; where docs has a column
    of such a name, the new one has underscores in front, see span_columns(). An empty table gives no rows.
    """
    (t,) = fresh(docs, "__t")
    out = docs.withColumn(t, or_empty(F.col(f"`{text}`")))
    return out.withColumns({c: F.expr(_spans(k, t)) for c, k in zip(span_columns(docs), KINDS)}).drop(t)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; columns as given.

    Of overlapping spans the first one, on a tie the longest, gives the tag, and all of their characters go. A null
    text stays null, repeated rows stay, and an empty table gives no rows.
    """
    everything = F.array_sort(F.concat(*[F.col(c) for c in span_columns(docs)]), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    found = find_spans(docs, text)
    (spans,) = fresh(found, "__spans")
    t = f"`{text}`"
    done = "CASE WHEN i = 0 THEN 0L ELSE upto[i - 1] END"  # where the spans before end
    piece = f"CASE WHEN s.start >= {done} THEN concat({read('chunks', done, 's.start')}, '<', upper(s.kind), '>') ELSE '' END"
    cut = f"concat(array_join(transform({spans}, (s, i) -> {piece}), ''), {read('chunks', 'upto[size(upto) - 1]', f'length({t})')})"
    cut = bound("chunks", in_chunks(t), bound("upto", running(f"transform({spans}, s -> cast(s.end AS bigint))", "greatest(a, x)", "0L"), cut))
    out = found.withColumn(spans, everything).withColumn(text, F.expr(f"CASE WHEN size({spans}) = 0 THEN {t} ELSE {cut} END"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_pii(spark, sf_dir):
    """Every document: counts and digests of its spans."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [k.name for k in KINDS if k.base]
    listed = {k.name: F.transform(F.col(f"pii_{k.name}"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in KINDS}
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(F.concat(*[listed[k] for k in base]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*listed.values()), ",").alias("spans"),
    )
