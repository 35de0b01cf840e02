"""Chat formatting with built-in functions only.

Layouts are told apart by a fingerprint, the hash of a record's nested field paths, at any depth and over all elements
of its arrays. Each fingerprint selects a declarative mapping, SQL expressions that give canonical turns, an array of
(role, text). Records of unknown layout get null turns and keep their fingerprint, so that they can be found.

The template writes each turn as ``<|im_start|>ROLE\nTEXT<|im_end|>\n``. Control strings inside roles and texts are
escaped with backslashes: each backslash is doubled, and one is put after the first character of each control string.
Taking the backslashes out again gives the text back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, in_chunks, or_empty, read, running, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates, by their first character and the rest; each is broken up inside texts.
CONTROL = r"(<)(\|)|(<)(/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)"
TURNS = "array<struct<role:string,text:string>>"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _messages(path: str, role: str, text: str, kind: str = "string", turn: str = "x.{text}") -> str:
    item = f"array<struct<`{role}`:string,`{text}`:{kind}>>"
    return f"transform(from_json(get_json_object({{record}}, '$.{path}'), '{item}'), x -> {_turn(f'x.`{role}`', turn.format(text=f'`{text}`'))})"


def _field(name: str) -> str:
    return f"get_json_object({{record}}, '$.{name}')"


_PARTS = "array_join(transform(x.{text}, y -> coalesce(y.text, '')), '')"
#: Layouts by their nested field paths (``[]``: in the elements of an array); the value gives the turns of {record}.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): _messages("messages", "role", "content"),
    ("messages[].role", "messages[].text"): _messages("messages", "role", "text"),
    ("messages[].content[].text", "messages[].content[].type", "messages[].role"): _messages("messages", "role", "content", "array<struct<text:string>>", _PARTS),
    ("conversations[].from", "conversations[].value"): "transform("
    + _messages("conversations", "from", "value")
    + ", t -> named_struct('role', CASE t.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE t.role END, 'text', t.text))",
    ("data.turns[].speaker", "data.turns[].utterance"): _messages("data.turns", "speaker", "utterance"),
    ("messages[]",): f"cast(array() as {TURNS})",
    ("prompt", "response"): f"array({_turn(repr('user'), _field('prompt'))}, {_turn(repr('assistant'), _field('response'))})",
    ("prompt", "completion"): f"array({_turn(repr('user'), _field('prompt'))}, {_turn(repr('assistant'), _field('completion'))})",
    ("instruction", "output"): f"array({_turn(repr('user'), _field('instruction'))}, {_turn(repr('assistant'), _field('output'))})",
    ("input", "instruction", "output"): f"array({_turn(repr('user'), 'concat_ws(chr(10), ' + _field('instruction') + ', nullif(' + _field('input') + ', ' + repr('') + '))')}, {_turn(repr('assistant'), _field('output'))})",
}


def shape(paths: tuple[str, ...]) -> str:
    """How shape_of() writes a record with the given field paths."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})

    def written(node: dict) -> str:
        if not node:
            return "*"
        if "[]" in node:
            return f"ARRAY<{written(node['[]']) if node['[]'] else ''}>"
        return "OBJECT<" + ", ".join(f"{k}: {written(node[k])}" for k in sorted(node)) + ">"

    return written(tree)


def shape_of(record: Column) -> Column:
    """The nested field paths of a JSON object, of all elements of its arrays; null for anything else."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    schema = F.regexp_replace(schema, r"ARRAY<VOID>", "ARRAY<>")
    return F.regexp_replace(schema, r"(?<=: )(?:[A-Z_]+(?:\([0-9, ]*\))?)(?=[,>])", "*")


def fingerprint(shape: Column) -> Column:
    return F.sha2(shape, 256)


def canonical_turns(records: DataFrame, record: str = "record", layouts: Mapping[tuple[str, ...], str] = LAYOUTS) -> DataFrame:
    """records with ``fingerprint`` and ``turns``; record holds a JSON object in any of the layouts.

    Null, malformed or unknown records get null turns, and so do records beyond the size of Spark's variants (128 MiB);
    missing texts are empty; an empty array gives no turns. All other columns stay; where records has a column named
    fingerprint or turns, the new one has underscores in front. An empty table gives no rows.
    """
    mark, name = fresh(records, "fingerprint", "turns")
    turns = F.lit(None).cast(TURNS)
    for paths, mapping in layouts.items():
        turns = F.when(F.col(f"`{mark}`") == fingerprint(F.lit(shape(paths))), F.expr(mapping.replace("{record}", f"`{record}`")).cast(TURNS)).otherwise(turns)
    return records.withColumn(mark, fingerprint(shape_of(F.col(f"`{record}`")))).withColumn(name, turns)


def gathered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of one turn each as conversations (conv_id, turns), turns in order.

    Turns with equal numbers follow by role, then text; repeated rows stay; null role and text are empty. A null id is
    a conversation of its own. A conversation is one row, so one task holds it.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), or_empty(F.col(role)).alias("role"), or_empty(F.col(text)).alias("text"))))
    by = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("turns"))
    return by.select("conv_id", F.expr("transform(turns, t -> named_struct('role', t.role, 'text', t.text))").alias("turns"))


def as_records(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) as JSON records (conv_id, record) in several layouts, dealt out by id.

    An exchange of one question and answer may be a prompt and response; roles that a layout renames keep out of it.
    """
    each = lambda fields: F.expr(f"transform(turns, t -> named_struct({fields}))")
    json = lambda name, column: F.to_json(F.struct(column.alias(name)))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    pair = F.expr("size(turns) = 2 AND turns[0].role = 'user' AND turns[1].role = 'assistant'")
    renamed = F.expr("exists(turns, t -> t.role IN ('human', 'gpt'))")
    record = (
        F.when(kind == 1, json("messages", each("'role', t.role, 'text', t.text")))
        .when(kind == 2, json("messages", each("'role', t.role, 'content', array(named_struct('type', 'text', 'text', t.text))")))
        .when((kind == 3) & ~renamed, json("conversations", each("'from', CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE t.role END, 'value', t.text")))
        .when(kind == 4, json("data", F.struct(each("'speaker', t.role, 'utterance', t.text").alias("turns"))))
        .when((kind == 5) & pair, F.to_json(F.struct(F.expr("turns[0].text").alias("prompt"), F.expr("turns[1].text").alias("response"))))
        .otherwise(json("messages", each("'role', t.role, 'content', t.text")))
    )
    return conversations.select("conv_id", record.alias("record"))


def escaped(text: Column) -> Column:
    """text with doubled backslashes and broken control strings."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3$5$7\\$2$4$6$8")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with ``formatted`` and ``loss_spans``, the code points [start, end) of each assistant text in formatted.

    Null turns give null; no turns an empty text. All other columns stay; where df has a column of such a name, the new
    one has underscores in front. An empty table gives no rows.
    """
    formatted, spans, pieces, ends = fresh(df, "formatted", "loss_spans", "__pieces", "__ends")
    parts = F.transform(
        F.col(f"`{turns}`"),
        lambda t: F.struct(
            F.concat(F.lit(START), F.regexp_replace(escaped(or_empty(t["role"])), "\n", "\\\\\n"), F.lit("\n")).alias("head"),
            escaped(or_empty(t["text"])).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    # The end of each turn; then its text ends len(END) before, and starts its own length before that.
    sizes = f"transform(`{pieces}`, p -> cast(length(p.head) + length(p.body) + {len(END)} AS bigint))"
    placed = f"zip_with(`{pieces}`, `{ends}`, (p, e) -> named_struct('loss', p.loss, 'start', e - {len(END)} - length(p.body), 'end', e - {len(END)}))"
    out = df.withColumn(pieces, parts).withColumn(ends, F.expr(running(sizes, "a + x", "0L")))
    out = out.withColumn(formatted, F.expr(f"array_join(transform(`{pieces}`, p -> concat(p.head, p.body, '<|im_end|>\\n')), '')"))
    out = out.withColumn(spans, F.expr(f"transform(filter({placed}, x -> x.loss), x -> named_struct('start', x.start, 'end', x.end))"))
    return out.drop(pieces, ends)


def parsed(formatted: str = "formatted") -> Column:
    """The turns read back from a formatted text."""
    items = F.expr(rf"filter(split({formatted}, r'<\|im_end\|>\n', -1), x -> x <> '')")
    head = len(START)
    # The role ends at the first line feed that no backslash escapes.
    def one(item: Column) -> Column:
        rest = F.substr(item, F.lit(head + 1))
        role = F.regexp_extract(rest, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(rest, F.length(role) + 2)).alias("text"))

    return F.transform(items, one)


def op9_chat_format(spark, sf_dir):
    """All conversations, and conversation -1 whose texts hold control strings; digests of what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("r"),
    ).select("conv_id", "r.turn", "r.role", "r.text")
    out = format_turns(canonical_turns(as_records(gathered(rows.unionByName(own)))))
    back = out.select("conv_id", "loss_spans", "formatted", parsed().alias("back"), F.expr(in_chunks("formatted")).alias("chunks"))
    loss = unescaped(F.expr(f"array_join(transform(loss_spans, s -> {read('chunks', 's.start', 's.end')}), '')"))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(back, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(\|)|(<)(/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)', '\1\3\5\7\\\2\4\6\8', 'g'))
         + length(replace(regexp_replace(replace(role, '\', '\\'), '(<)(\|)|(<)(/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)', '\1\3\5\7\\\2\4\6\8', 'g'), chr(10), '\' || chr(10)))
         + 12 + 1 + 11 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
