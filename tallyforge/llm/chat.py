"""Chat formatting with DataFrame and SQL functions only.

Records come as JSON text in any of several layouts. The nested field paths of a record are hashed
(from its skeleton, so that long texts and many turns may be in it), and the hash selects a declarative
mapping to canonical turns (role, text). Turns are written with a template whose control strings cannot
occur in texts: inside a text, each of them has a backslash put after its first character, and one
that had backslashes there gets one more, which is reversible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

TURNS = "array<struct<role:string,text:string>>"
#: All fields that a layout may read.
RECORD = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
    "prompt string, completion string, response string, instruction string, input string, output string, system string"
)


@dataclass(frozen=True)
class Layout:
    """A mapping: an example record whose field paths select it, and turns as SQL over the parsed record r."""

    name: str
    example: str
    turns: str


def _turn(role: str, field: str) -> str:
    return f"struct('{role}' as role, coalesce(r.{field}, '') as text)"


_NAMES = "case {0} when 'human' then 'user' when 'gpt' then 'assistant' else coalesce({0}, '') end"
LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"a","content":"b"}]}', "transform(r.messages, m -> struct(coalesce(m.role, '') as role, coalesce(m.content, '') as text))"),
    Layout("exchange", '{"conversations":[{"from":"a","value":"b"}]}', f"transform(r.conversations, m -> struct({_NAMES.format('m.from')} as role, coalesce(m.value, '') as text))"),
    Layout("prompt", '{"prompt":"a","completion":"b"}', f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    Layout("response", '{"prompt":"a","response":"b"}', f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Layout("instruction", '{"instruction":"a","input":"b","output":"c"}', f"array({_turn('system', 'instruction')}, {_turn('user', 'input')}, {_turn('assistant', 'output')})"),
    Layout("instruction_only", '{"instruction":"a","output":"c"}', f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    Layout("system_prompt", '{"system":"a","prompt":"b","completion":"c"}', f"array({_turn('system', 'system')}, {_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
)
#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_REST = r"(/?(?:s>|INST\]|SYS>|ROLE\]))"


def skeleton(record: str) -> Column:
    """A JSON text with all string values emptied, and of equal flat objects in a row only the last.

    It has the field paths of the record, but its size depends neither on the length of texts nor on the number
    of like turns; a variant holds at most 128 MB and a string of 20 million characters.
    """
    plain = F.replace(F.replace(F.col(record), F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    emptied = F.regexp_replace(plain, r'"(?:([^"]*+"\s*+:)|[^"]*+("))', '"$1$2')
    return F.regexp_replace(emptied, r"(\{[^{}]*+\})\s*+,(?=\s*+\1)", "")


def paths(record: str) -> Column:
    """The nested field paths of a JSON text, in order of names, without value types; null if its skeleton is no JSON."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(skeleton(record))), r"(?<=[:<] ?)(?!OBJECT|ARRAY)[A-Z][A-Z0-9_(),]*", "")


def fingerprint(record: str) -> Column:
    return F.xxhash64(paths(record))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout (the mapping's name, 'unknown' if no mapping has the record's paths) and turns (null then).

    Null records are unknown; rows are independent, and an empty table stays empty. Columns of any name may be there: one named layout or turns stays, and the new one gets an underscore.
    """
    spark = records.sparkSession
    known = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(x.name).alias("layout"), F.lit(x.example).alias("_e")) for x in layouts))))
    known = known.select("layout", fingerprint("_e").alias("_print"))
    rows = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("_row"), F.col(f"`{record}`").alias("_record"))
    marked = rows.withColumn("_print", fingerprint("_record")).join(F.broadcast(known), "_print", "left")  # one row a layout
    # What the skeleton leaves out may still be no JSON: such records are unknown.
    parsed = marked.withColumn("r", F.from_json("_record", f"{RECORD}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxStringLen": str(2**31 - 1)}))
    parsed = parsed.withColumn("layout", F.when(F.col("r._bad").isNull(), F.col("layout")))
    turns = F.expr("case layout " + " ".join(f"when '{x.name}' then {x.turns}" for x in layouts) + " end")
    own = (F.col("_row").getField(c).alias(c) for c in records.columns)
    return parsed.select(*own, F.coalesce("layout", F.lit("unknown")).alias(fresh("layout", records.columns)), turns.alias(fresh("turns", records.columns)))


def formatted(turned: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds segments, an array of (text, loss) whose texts joined are the formatted conversation, and formatted.

    The loss mask covers assistant texts only. Null turns give nulls; no turns the empty string. Where columns have these names already, the new ones get an underscore.
    """

    def one(t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("")), escape(F.coalesce(t["text"], F.lit("")))
        before = F.when(role == "user", "<s>[INST] ").when(role == "system", "<s><<SYS>>\n").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]")))
        after = F.when(role == "user", " [/INST]</s>").when(role == "system", "\n<</SYS>></s>").otherwise("</s>")
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(text.alias("text"), (role == "assistant").alias("loss")), F.struct(after.alias("text"), F.lit(False).alias("loss"))
        )

    segments = fresh("segments", turned.columns)
    made = turned.withColumn(segments, F.flatten(F.transform(F.col(turns), one)))
    return made.withColumn(fresh("formatted", turned.columns), F.array_join(F.transform(segments, lambda s: s["text"]), ""))


_PARSE = r"""transform(slice(split(formatted, '</s>'), 1, size(split(formatted, '</s>')) - 1), p -> case
  when substring(p, 4, 7) = '[INST] ' then struct('user' as role, {0} as text)
  when substring(p, 4, 8) = '<<SYS>>\n' then struct('system' as role, {1} as text)
  when substring(p, 4, 6) = '[ROLE]' then struct({2} as role, {3} as text)
  else struct('assistant' as role, {4} as text) end)"""


def parsed() -> Column:
    """The turns (role, text) read back from the column formatted."""

    def back(x: str) -> str:
        return rf"regexp_replace({x}, r'([<\[])\\(\\*){_REST}', '$1$2$3')"

    bodies = (
        "substring(p, 11, length(p) - 18)",
        "substring(p, 12, length(p) - 20)",
        "substring(p, 10, instr(p, '[/ROLE]') - 10)",
        "substring(p, instr(p, '[/ROLE]') + 7)",
        "substring(p, 4)",
    )
    return F.expr(_PARSE.format(*map(back, bodies)))


def loss_text(column: str = "segments") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(column, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation in order of turn (then role and text) as JSON in the plainest layout that holds them.

    The text of a conversation must be in one row for its digest, so a conversation's rows meet in one group.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = "transform(t, x -> x.role)"
    record = f"""case
      when {roles} = array('user', 'assistant') then to_json(named_struct('prompt', t[0].text, 'completion', t[1].text))
      when {roles} = array('system', 'user', 'assistant') then to_json(named_struct('instruction', t[0].text, 'input', t[1].text, 'output', t[2].text))
      when conv_id % 2 = 0 and forall(t, x -> x.role in ('user', 'assistant', 'system')) then to_json(named_struct('conversations', transform(t, x -> named_struct('from', case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end, 'value', x.text))))
      else to_json(named_struct('messages', transform(t, x -> named_struct('role', x.role, 'content', x.text)))) end"""
    return grouped.select("conv_id", F.expr(record).alias("record"))


def extra(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"select -7L as conv_id, * from values (0L, 'user', '{said}'), (1L, 'assistant', '{said}') as t(turn, role, text)")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: turns, their digest, and the digest of the text under the loss mask.

    Null roles and texts are empty, repeated rows are turns of their own, and only conv_id, turn, role and text are read; an empty table gives no rows.
    """
    out = formatted(canonical(records(conversations))).select("conv_id", "formatted", "segments").withColumn("back", parsed())
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), told.alias("told"), loss_text().alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("told", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


DIGESTS_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(text) + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS>|ROLE\]))', '\1\\\2\3', 'g')) - length(text)
    + case role when 'user' then 22 when 'system' then 24 when 'assistant' then 7 else 20 + length(role) end as chars from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""
