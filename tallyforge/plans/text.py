"""Queries of the claim checks and lenient readers, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import claims as C
from ..sources import views as V
from .registry import query

def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


NUMS = f"nm as (select doc_id, source, coalesce(try_cast(regexp_replace(x, {lit('[' + C.SEPARATORS + ']')}, '', 'g') as int), 2147483647)::bigint as n from (select doc_id, source, unnest(regexp_extract_all(text, {lit(C.NUMBER)})) as x from documents)),\nkn as (select distinct coalesce(try_cast(regexp_replace(x, {lit('[' + C.SEPARATORS + ']')}, '', 'g') as int), 2147483647)::bigint as n from (select unnest(regexp_extract_all(text, {lit(C.NUMBER)})) as x from benchmark))"
SCORES = """select distinct doc_id, least(a::int, b::int) || ':' || greatest(a::int, b::int) as line from (select doc_id, unnest(regexp_extract_all(m, {s}, 1)) as a, unnest(regexp_extract_all(m, {s}, 2)) as b from (select {i} as doc_id, regexp_replace(text, {k}, ' ', 'g') as m from {t}))"""


def kda_sql(i: str, t: str) -> str:
    return f"select distinct {i} as doc_id, regexp_replace(regexp_replace(x, '\\s', '', 'g'), {lit('[' + C.DASHES + '/]')}, '/', 'g') as line from (select {i}, unnest(regexp_extract_all(text, {lit(C.KDA)})) as x from {t})"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents")


def doc_numbers(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "source", F.explode(C.numbers(F.col("text"))).alias("n"))


def known_numbers(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "benchmark").select(F.explode(C.numbers(F.col("text"))).alias("n")).distinct()


@query(f"with {NUMS} select doc_id, count(*) as numbers, sum(n)::bigint as total from nm group by all")
def t1_numbers(spark: SparkSession, d: str) -> DataFrame:
    return doc_numbers(spark, d).groupBy("doc_id").agg(F.count("*").alias("numbers"), F.sum("n").alias("total"))


_SCORE_ARGS = {"s": lit(C.SCORE), "k": lit(C.KDA)}


@query(f"select doc_id, line from ({SCORES.format(i='doc_id', t='documents', **_SCORE_ARGS)}) where line not in (select line from ({SCORES.format(i='item_id', t='benchmark', **_SCORE_ARGS)}))")
def t2_score_lines(spark: SparkSession, d: str) -> DataFrame:
    known = V.read(spark, d, "benchmark").select(F.explode(C.score_lines(F.col("text"))).alias("line"))
    return C.unknown(docs(spark, d).select("doc_id", F.explode(C.score_lines(F.col("text"))).alias("line")), known, ["line"]).select("doc_id", "line")


@query(f"select doc_id, line from ({kda_sql('doc_id', 'documents')}) where line not in (select line from ({kda_sql('item_id', 'benchmark')}))")
def t3_kda_lines(spark: SparkSession, d: str) -> DataFrame:
    known = V.read(spark, d, "benchmark").select(F.explode(C.kda_lines(F.col("text"))).alias("line"))
    return C.unknown(docs(spark, d).select("doc_id", F.explode(C.kda_lines(F.col("text"))).alias("line")), known, ["line"]).select("doc_id", "line")


@query(f"with {NUMS} select distinct doc_id, n from nm join documents using (doc_id) where n not in (select n from kn) and n <> n_chars")
def t4_unknown_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that neither the facts nor the document's own length explain, once a document."""
    n = docs(spark, d).select("doc_id", "n_chars", F.explode(C.numbers(F.col("text"))).alias("n")).where("n <> n_chars").select("doc_id", "n")
    return C.unknown(n, known_numbers(spark, d), ["n"]).select("doc_id", "n")


def names(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary: entities are items of benchmark, each named by the words of at least four characters that no earlier item has, and by its first two words together. Even items are of the first kind."""
    b = V.read(spark, d, "benchmark").select("item_id", "text")
    runs = f"regexp_extract_all(text, '[{C.WORD_CHAR}]+|[^{C.WORD_CHAR}]+', 0)"
    word = b.select("item_id", F.explode(F.expr(f"filter({runs}, x -> x rlike '^[{C.WORD_CHAR}]' and length(x) >= 4)")).alias("name")).groupBy("name").agg(F.min("item_id").alias("entity"))
    two = b.select(F.col("item_id").alias("entity"), F.regexp_extract("text", f"[{C.WORD_CHAR}]+[^{C.WORD_CHAR}]+[{C.WORD_CHAR}]+", 0).alias("name"))
    return word.unionByName(two).where("name <> ''").withColumn("kind", F.when(F.col("entity") % 2 == 0, "first").otherwise("second"))


_WHOLE, _RUN = f"[{C.WORD_CHAR}]+", lit(f"[{C.WORD_CHAR}]+|[^{C.WORD_CHAR}]+")


def _said(i: str, text: str, table: str) -> str:
    """SQL: the distinct entities that each text mentions, by its words and its neighbouring words."""
    return f"""
    said_r as (select {i}, {text} as t, regexp_extract_all({text}, {_RUN}) as r from {table}),
    said_w as (select {i}, r, unnest(generate_series(1, len(r))) as k from said_r),
    said_g as (select {i}, r[k] as name from said_w where regexp_matches(r[k], {lit("^" + _WHOLE)}) union all select {i}, r[k] || r[k + 1] || r[k + 2] from said_w where k + 2 <= len(r) and regexp_matches(r[k], {lit("^" + _WHOLE)})),
    said as (select distinct {i}, entity from said_g join names using (name))"""


_NAMES = f"""names as (select name, min(item_id) as entity from (select item_id, unnest(regexp_extract_all(text, {lit(_WHOLE)})) as name from benchmark) where length(name) >= 4 group by name
  union all select name, entity from (select item_id as entity, regexp_extract(text, {lit(f"{_WHOLE}[^{C.WORD_CHAR}]+{_WHOLE}")}) as name from benchmark) where name <> '')"""
_MENTIONS = f"with {_NAMES}, {_said('doc_id', 'text', 'documents')}"


def mentioned(spark: SparkSession, d: str) -> DataFrame:
    return C.mentioned(docs(spark, d), names(spark, d), ["doc_id"])


@query(f"{_MENTIONS} select entity, count(*) as documents from said group by all")
def t5_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentioned(spark, d).groupBy("entity").agg(F.count("*").alias("documents"))


#: Each document's facts: an entity took part, was banned, or has no part in it.
_VERDICT = "case (entity + doc_id) % 3 when 0 then 'fine' when 1 then 'unverified' else 'contradiction' end"


@query(f"{_MENTIONS} select doc_id, entity, {_VERDICT} as verdict from said where (entity + doc_id) % 3 <> 0")
def t6_entity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What a document says of entities that took no part: of banned ones unverified, of others a contradiction."""
    return mentioned(spark, d).withColumn("verdict", F.expr(_VERDICT)).where("verdict <> 'fine'")


_SENT = r"(select doc_id, s, row_number() over () as no from (select doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) as s from documents))"


@query(f"""with {_NAMES}, {_said('doc_id, no', 's', _SENT)}
select doc_id, count(*) filter (a = 1 and b = 1 and (x * 7 + y) % 4 <> 0) as mismatched, count(*) filter (a > 1 or b > 1) as ambiguous
from (select doc_id, no, count(*) filter (entity % 2 = 0) as a, count(*) filter (entity % 2 = 1) as b, min(entity) filter (entity % 2 = 0) as x, min(entity) filter (entity % 2 = 1) as y from said group by all) where a > 0 and b > 0 group by all""")
def t7_sentence_relations(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that name one entity of each kind but not a pair that belongs together, and sentences that name several."""
    n = names(spark, d)
    first, second = (n.where(F.col("kind") == k).select(F.col("entity").alias(k), (F.pmod(F.col("entity") * m, F.lit(4))).alias("rest")).distinct() for k, m in (("first", 7), ("second", 3)))
    return C.related(docs(spark, d), n, first.join(second, "rest"), ["doc_id"])


@query(f"with {NUMS} select distinct doc_id, n from nm where (source, n) not in (select source, n_chars from documents)")
def t8_round_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a document that no fact of its group has."""
    known = docs(spark, d).select("source", F.col("n_chars").cast("bigint").alias("n"))
    return C.unknown(doc_numbers(spark, d), known, ["source", "n"]).select("doc_id", "n").distinct()


@query(f"{_MENTIONS} select doc_id, case max(case {_VERDICT} when 'contradiction' then 2 when 'unverified' then 1 else 0 end) when 2 then 'CONTRADICTED' when 1 then 'UNVERIFIED' else 'FINE' end as status from said group by all")
def t9_status(spark: SparkSession, d: str) -> DataFrame:
    level = F.expr(f"case {_VERDICT} when 'contradiction' then 2 when 'unverified' then 1 else 0 end")
    m = mentioned(spark, d).groupBy("doc_id").agg(F.max(level).alias("level"))
    return m.select("doc_id", F.expr("case level when 2 then 'CONTRADICTED' when 1 then 'UNVERIFIED' else 'FINE' end").alias("status"))


POST = "array<struct<author:string,content:string>>"


def cut_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation a JSON array of its rows in a sentence, in two of three cut by a length that depends on the id, within its last object at most."""
    c = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("author"), F.col("text").alias("content")))).alias("t"))
    whole = c.select("conv_id", F.concat(F.lit("Here: "), F.to_json(F.transform("t", lambda x: F.struct(x["author"].alias("author"), x["content"].alias("content")))), F.lit(" done")).alias("raw"))
    return whole.withColumn("raw", F.expr("case conv_id % 3 when 0 then raw when 1 then substring(raw, 1, length(raw) - 6) else substring(raw, 1, length(raw) - 7 - cast(conv_id % 12 as int)) end"))


@query("select conv_id, case when conv_id % 3 = 2 then count(*) - 1 else count(*) end as items from conversations group by conv_id")
def t10_lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects saved from whole, unclosed and truncated arrays; a truncated one loses its last object."""
    items = C.lenient_array(cut_arrays(spark, d), "raw", POST)
    return items.select("conv_id", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("items")).withColumn("items", F.greatest("items", F.lit(0).cast("bigint")))


@query("select p_partkey, trim(coalesce(case when p_partkey % 4 = 0 then null else '  ' || p_name || ' ' end, '')) as name, case p_partkey % 3 when 0 then p_size::bigint when 1 then p_size::bigint else null end as size from part")
def t11_field_readers(spark: SparkSession, d: str) -> DataFrame:
    p = V.read(spark, d, "part").selectExpr("p_partkey", "if(p_partkey % 4 = 0, null, concat('  ', p_name, ' ')) as name", "case p_partkey % 3 when 0 then cast(p_size as string) when 1 then concat(' ', p_size, ' ') else concat(p_size, ' pieces') end as size")
    return p.select("p_partkey", C.text_field(F.col("name")).alias("name"), C.int_field(F.col("size")).cast("bigint").alias("size"))


THREADS = "cm as (select *, row_number() over (partition by conv_id order by turn) as ordinal, sum((role = 'user')::int) over (partition by conv_id order by turn) as root from conversations where trim(text) <> ''),\nth as (select *, row_number() over (partition by conv_id, root, role = 'user' order by ordinal) as reply from cm where root > 0)"


def comments(spark: SparkSession, d: str) -> DataFrame:
    """Rows of conversations as comments: each user row is a root, others reply to the last root; windows are bounded by a conversation."""
    c = V.read(spark, d, "conversations").where(F.trim("text") != "")
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.col("role") == "user"
    rows = c.withColumn("ordinal", F.row_number().over(w)).withColumn("root", F.sum(user.cast("int")).over(w)).where("root > 0").withColumn("user", user)
    return rows.withColumn("reply", F.row_number().over(Window.partitionBy("conv_id", "root", "user").orderBy("ordinal")))


@query(f"with {THREADS} select conv_id, root::bigint as root, count(*) filter (role <> 'user' and reply <= 3) as replies, sum(length(text)) filter (role = 'user')::bigint as root_chars from th group by all")
def t12_comment_threads(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d)
    return c.groupBy("conv_id", "root").agg(F.count_if(~F.col("user") & (F.col("reply") <= C.REPLIES)).alias("replies"), F.sum(F.when(F.col("user"), F.length("text"))).alias("root_chars"))


@query("select conv_id, kind, count(*) as posts from (select conv_id, case when role in ('user', 'assistant') then role else 'user' end as kind, row_number() over (partition by conv_id order by turn) as rn from conversations where trim(text) <> '' and role is not null) where rn <= 40 group by all")
def t13_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts need content; an unknown kind becomes the commonest; at most forty a page."""
    c = V.read(spark, d, "conversations").where((F.trim("text") != "") & F.col("role").isNotNull())
    n = c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rn <= 40")
    return n.groupBy("conv_id", F.expr("if(role in ('user', 'assistant'), role, 'user')").alias("kind")).agg(F.count("*").alias("posts"))


@query("select event_type, count(*) filter (value > 90 or coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) as int), 0) >= 30) as concepts from events group by all")
def t14_concept_flag(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    likes = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    return e.groupBy("event_type").agg(F.count_if(C.concept(F.col("value") > 90, likes)).alias("concepts"))


@query("select conv_id, ordinal, case when parent >= 1 and parent < ordinal then parent end as parent from (select conv_id, row_number() over (partition by conv_id order by turn) as ordinal, case when turn % 4 <> 3 then turn - conv_id % 3 end as parent from conversations)")
def t15_parents(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = V.read(spark, d, "conversations").select("conv_id", F.row_number().over(w).cast("bigint").alias("ordinal"), F.expr("if(turn % 4 <> 3, turn - conv_id % 3, null)").alias("parent"))
    return c.select("conv_id", "ordinal", C.valid_parent(F.col("parent"), F.col("ordinal")).alias("parent"))


@query(f"with {THREADS} select conv_id, root::bigint as root, string_agg(ordinal || ':' || length(text), ',' order by ordinal) as thread from th group by all")
def t16_thread_assembly(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d)
    line = F.struct("ordinal", F.concat_ws(":", "ordinal", F.length("text")).alias("l"))
    return c.groupBy("conv_id", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), ",").alias("thread"))


@query("select doc_id, headline from (select doc_id, trim(split_part(text, chr(10), 1), ' ') as headline, trim(substr(text, length(split_part(text, chr(10), 1)) + 2), ' ') as body from documents) where length(headline) between 1 and 40 and length(body) > 0")
def t17_headlines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", C.headline(F.col("text")).alias("headline")).where("headline is not null")


KINDS = ("FUN", "DATA", "DAILY")
ROLE_KIND = {"user": "FUN", "assistant": "DATA", "system": "DAILY"}
_ROW = "conv_id div 32 as page, conv_id div 16 as post, conv_id div 2 as thread, conv_id, turn, role, text"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Answers (page, raw): a page is 32 conversations, a post 16 and a comment with replies two of them; some posts have no title or kind, some comments no content, and some pages are cut."""
    c = V.read(spark, d, "conversations").selectExpr(*_ROW.split(", "))
    order = F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text")))
    threads = c.groupBy("page", "post", "thread").agg(order.alias("t"))
    tree = threads.selectExpr(
        "page", "post", "thread", "t[0].text as opening",
        """struct(t[0].role as author, if(thread % 5 = 0, '  ', t[0].text) as content,
            transform(slice(t, 2, size(t)), x -> struct(x.role as author, if(x.turn = 3, '', x.text) as content)) as sub_comments) as c""",
    )
    each = tree.groupBy("page", "post").agg(F.array_sort(F.collect_list(F.struct("thread", "opening", "c"))).alias("t"))
    post = each.selectExpr("page", "post", """struct(if(post % 7 = 3, ' ', left(t[0].opening, 20)) as title, t[0].opening as content,
        case post % 4 when 0 then ' fun ' when 1 then 'DATA' when 2 then 'unheard' end as kind, concat(' ', post % 60, ' ') as likes, transform(t, x -> x.c) as comments) as p""")
    whole = post.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("post", "p"))).alias("x")).select("page", F.concat(F.lit("Here: "), F.to_json(F.transform("x", lambda x: x["p"])), F.lit(" done")).alias("raw"))
    return whole.withColumn("raw", F.expr("case page % 3 when 0 then raw when 1 then substring(raw, 1, length(raw) - 6) else substring(raw, 1, length(raw) - 10 - cast(page % 40 as int)) end"))


PAGES = f"""
cw as (select {_ROW.replace(' div ', ' // ')}, row_number() over (partition by conv_id // 2 order by conv_id, turn) as rn from conversations),
ck as (select *, row_number() over (partition by thread, rn = 1 order by rn) as reply from cw where trim(text) <> '' and case when rn = 1 then thread % 5 <> 0 else turn <> 3 end),
cx as (select ck.*, row_number() over (partition by post order by thread, rn) as ordinal from ck where thread in (select thread from ck where rn = 1) and (rn = 1 or reply <= 7)),
cf as (select *, max(case when rn = 1 then ordinal end) over (partition by thread) as root from cx where ordinal <= 40),
po as (select page, post, first(text order by thread, rn) as opening, max(post) over (partition by page) as last from cw group by page, post),
qu as (select page, arg_max(kind, amount * 10 - place) as fallback from (select page, case role when 'user' then 'FUN' when 'assistant' then 'DATA' when 'system' then 'DAILY' end as kind, case role when 'user' then 1 when 'assistant' then 2 else 3 end as place, count(*) as amount from cw where role in ('user', 'assistant', 'system') group by all) group by page),
pk as (select *, row_number() over (partition by page order by post) as ordinal from po where post % 7 <> 3 and trim(left(opening, 20)) <> '' and not (page % 3 = 2 and post = last))"""


@query(f"""with {PAGES} select page, pk.ordinal, case post % 4 when 0 then 'FUN' when 1 then 'DATA' else fallback end as kind, post % 60 >= 30 as concept, length(trim(left(opening, 20))) as title_chars, coalesce(n, 0)::int as comments, coalesce(replies, 0)::int as replies, coalesce(parents, 0)::bigint as parents, coalesce(chars, 0)::bigint as chars
from pk join qu using (page) left join (select post, count(*) as n, count(*) filter (rn > 1) as replies, sum(root) filter (rn > 1) as parents, sum(ordinal * length(text)) as chars from cf group by post) using (post)""")
def t13_parsed_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts with their two levels of comments, read from whole and cut answers."""
    asked = V.read(spark, d, "conversations").selectExpr(*_ROW.split(", ")).withColumn("kind", F.create_map(*(F.lit(x) for kv in ROLE_KIND.items() for x in kv))[F.col("role")])
    quota = asked.where("kind is not null").groupBy("page", "kind").agg(F.count("*").alias("amount"))
    p = C.parsed_posts(pages(spark, d), "raw", quota, ["page"], KINDS)
    parents = F.filter("comments", lambda c: c["parent"].isNotNull())
    return p.select(
        "page", "ordinal", "kind", "concept", F.length("title").alias("title_chars"), F.size("comments").alias("comments"), F.size(parents).alias("replies"),
        F.aggregate(parents, F.lit(0).cast("bigint"), lambda a, c: a + c["parent"]).alias("parents"), F.expr("aggregate(transform(comments, (c, i) -> (i + 1) * length(c.content)), 0L, (a, x) -> a + x)").alias("chars"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers (thread, raw) of two conversations each: a JSON array of comments, in every third thread lines with bullets and quotes instead."""
    c = V.read(spark, d, "conversations").selectExpr(*_ROW.split(", "))
    t = c.groupBy("thread", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("conv_id", "t"))).alias("x"))
    array = "to_json(transform(x, y -> struct(y.t[0].role as author, if(y.conv_id % 5 = 0, '', y.t[0].text) as content, transform(slice(y.t, 2, size(y.t)), z -> struct(z.role as author, if(z.turn = 3, ' ', z.text) as content)) as sub_comments)))"
    lines = """array_join(transform(flatten(transform(x, y -> y.t)), (z, i) -> concat(case i % 4 when 0 then '- ' when 1 then concat(i, ') ') when 2 then '  ' else '' end, if(i % 3 = 0, '"', ''), replace(z.text, '\\n', ' '), if(i % 3 = 0, '"', ''))), '\\n\\n')"""
    return t.selectExpr("thread", f"if(thread % 3 = 0, {lines}, {array}) as raw")


@query("""with aw as (select conv_id // 2 as thread, conv_id, turn, text, row_number() over (partition by conv_id order by turn) as rn from conversations),
ak as (select *, row_number() over (partition by conv_id, rn = 1 order by rn) as reply from aw where trim(text) <> '' and case when rn = 1 then conv_id % 5 <> 0 else turn <> 3 end),
ax as (select ak.*, row_number() over (partition by thread order by conv_id, rn) as ordinal from ak where conv_id in (select conv_id from ak where rn = 1) and (rn = 1 or reply <= 3)),
af as (select *, max(case when rn = 1 then ordinal end) over (partition by conv_id) as root from ax),
al as (select thread, count(*) as n, sum(length(trim(text)))::bigint as chars from aw where trim(text) <> '' group by thread)
select thread, count(*) filter (rn = 1) as roots, count(*) filter (rn > 1) as replies, coalesce(sum(root) filter (rn > 1), 0)::bigint as parents, sum(length(text))::bigint as chars from af where thread % 3 <> 0 group by all
union all select thread, n, 0, 0, chars from al where thread % 3 = 0""")
def t12_parsed_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments with parents from JSON answers, or one a line from others."""
    c = C.parsed_comments(answers(spark, d), "raw").select("thread", F.explode("comments").alias("c"))
    return c.groupBy("thread").agg(F.count_if(F.col("c.parent").isNull()).alias("roots"), F.count_if(F.col("c.parent").isNotNull()).alias("replies"), F.coalesce(F.sum("c.parent"), F.lit(0)).alias("parents"), F.sum(F.length("c.content")).cast("bigint").alias("chars"))
