"""Checks of text against recorded facts, and lenient readers of structured text. Expressions only, but for one truncation helper."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns: thousands separators are blank, comma and the narrow blanks; dashes are all that texts use.
SEPARATORS = " ,    "
DASHES = "-‐‑‒–—―−"
NUMBER = f"\\d{{1,3}}(?:[{SEPARATORS}]\\d{{3}})+|\\d+"
KDA = f"\\d{{1,3}}\\s*[{DASHES}/]\\s*\\d{{1,3}}\\s*[{DASHES}/]\\s*\\d{{1,3}}"
SCORE = f"(\\d{{1,3}})\\s*(?:[{DASHES}:]|대)\\s*(\\d{{1,3}})"
#: A letter or digit below U+1100 next to a word makes it part of a longer one.
WORD_CHAR = "0-9A-Za-zªµºÀ-ÖØ-öø-ჿ"
MAX_INT = 2147483647
HEADLINE = 40
REPLIES = 3
CONCEPT_LIKES = 30


def numbers(text: Column) -> Column:
    """All integers of a text; those beyond 32 bits become the largest."""
    raw = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(raw, lambda r: F.coalesce(F.regexp_replace(r, f"[{SEPARATORS}]", "").try_cast("int"), F.lit(MAX_INT)).cast("bigint"))


def kda_lines(text: Column) -> Column:
    """Distinct kill/death/assist lines as k/d/a."""
    found = F.regexp_extract_all(text, F.lit(KDA), F.lit(0))
    return F.array_distinct(F.transform(found, lambda r: F.regexp_replace(F.regexp_replace(r, r"\s", ""), f"[{DASHES}/]", "/")))


def score_lines(text: Column) -> Column:
    """Distinct score lines as a:b, smaller side first; kill/death/assist lines are blanked before."""
    masked = F.regexp_replace(text, KDA, " ")
    a, b = (F.regexp_extract_all(masked, F.lit(SCORE), F.lit(g)) for g in (1, 2))
    pair = F.zip_with(a, b, lambda x, y: F.concat_ws(":", F.least(x.cast("int"), y.cast("int")), F.greatest(x.cast("int"), y.cast("int"))))
    return F.array_distinct(pair)


def unknown(claims: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Distinct claims that are not known; known facts may be many, so this is an anti join, not a set in memory."""
    return claims.distinct().join(known.select(*by).distinct(), by, "left_anti")


def _runs(text: str) -> str:
    """SQL: a text as its runs of word characters and of all others, in turn."""
    return f"regexp_extract_all({text}, '[{WORD_CHAR}]+|[^{WORD_CHAR}]+', 0)"


def mentioned(texts: DataFrame, names: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Distinct (ids, entity) of the entities that a text mentions by one of their names; names (entity, name) is a table of any size.

    A name counts where no word character stands next to it. One that begins and ends with word characters then lies between whole runs of them, so
    runs of a text, joined with what stands between as many as the name has, are matched with names by an equi-join. Other names (of
    scripts whose characters are boundaries themselves) are matched with the windows of their lengths, whose neighbours are looked at. Empty and null names match nothing.
    """
    word = f"[{WORD_CHAR}]"
    known = names.select("entity", "name").where("name <> ''").distinct()
    whole = F.col("name").rlike(f"(?s)^{word}(.*{word})?$")
    aligned = known.where(whole).withColumn("n", F.size(F.regexp_extract_all("name", F.lit(f"{word}+"), F.lit(0))))
    odd = known.where(~whole).withColumn("n", F.length("name"))
    # No more numbers than the longest name has words, or characters.
    words, lengths = (sorted(r[0] for r in x.select("n").distinct().collect()) for x in (aligned, odd))
    keys = [F.col(c) for c in ids]
    found = []
    if words:
        runs = texts.select(*keys, F.expr(_runs(text)).alias("_r")).withColumn("_s", F.when(F.element_at("_r", 1).rlike(f"^{word}"), 0).otherwise(1)).where("size(_r) > 0")
        count = "((size(_r) - _s + 1) div 2)"
        grams = [f"if({count} >= {n}, transform(sequence(0, cast({count} - {n} as int)), i -> array_join(slice(_r, _s + 2 * i + 1, {2 * n - 1}), '')), array())" for n in words]
        each = runs.select(*keys, F.explode(F.expr(f"array_distinct(concat({', '.join(grams)}))")).alias("name"))
        found.append(each.join(aligned.select("entity", "name"), "name").select(*keys, "entity"))
    if lengths:
        places = [f"transform(sequence(1, length({text}) - {n} + 1), i -> struct(substring({text}, i, {n}) as name, concat(substring({text}, i - 1, if(i > 1, 1, 0)), substring({text}, i + {n}, 1)) as near))" for n in lengths]
        windows = ", ".join(f"if(length({text}) >= {n}, {x}, array())" for n, x in zip(lengths, places, strict=True))
        each = texts.select(*keys, F.explode(F.expr(f"concat({windows})")).alias("_w")).where(~F.col("_w.near").rlike(word)).select(*keys, F.col("_w.name").alias("name")).distinct()
        found.append(each.join(odd.select("entity", "name"), "name").select(*keys, "entity"))
    return reduce(DataFrame.unionByName, found).distinct() if found else texts.join(known, F.lit(False)).select(*keys, "entity")


def related(texts: DataFrame, names: DataFrame, relation: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, mismatched, ambiguous) of the sentences that name entities of both kinds (names: entity, kind 'first' or 'second', name): how many name one of each that relation
    (first, second) does not hold, and how many name several of a kind."""
    sentence = texts.select(*ids, F.posexplode(sentences(F.col(text))).alias("_no", "_s"))
    said = mentioned(sentence, names, [*ids, "_no"], "_s").join(names.select("entity", "kind").distinct(), "entity")
    per = said.groupBy(*ids, "_no").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("first", "second")), *(F.min(F.when(F.col("kind") == k, F.col("entity"))).alias(k) for k in ("first", "second")))
    both = per.where("n_first > 0 and n_second > 0")
    judged = both.join(relation.select("first", "second").distinct().withColumn("_fits", F.lit(True)), ["first", "second"], "left")
    one = (F.col("n_first") == 1) & (F.col("n_second") == 1)
    return judged.groupBy(*ids).agg(F.count_if(one & F.col("_fits").isNull()).alias("mismatched"), F.count_if(~one).alias("ambiguous"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s) != "")


def headline(text: Column) -> Column:
    """The first line if it is short and a body remains."""
    first = F.trim(F.substring_index(text, "\n", 1))
    body = F.trim(F.substring(text, F.length(F.substring_index(text, "\n", 1)) + 2, 1 << 30))
    return F.when((F.length(first) > 0) & (F.length(first) <= HEADLINE) & (F.length(body) > 0), first)


@F.pandas_udf(T.StringType())
def truncated(texts: pd.Series) -> pd.Series:
    """A cut JSON array up to its last complete object, closed with a bracket; null if none is complete."""

    def one(s: str | None) -> str | None:
        depth, end, quoted, skip = 0, -1, False, False
        for i, ch in enumerate(s or ""):
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch == "{":
                depth += 1
            elif not quoted and ch == "}":
                depth -= 1
                if depth == 0:
                    end = i
        return None if end < 0 else s[: end + 1] + "]"

    return texts.map(one)


def lenient_array(df: DataFrame, text: str, schema: str, out: str = "items") -> DataFrame:
    """Adds ``out``: the JSON array in a text, from its first [ to its last ], else to the end, else up to the last complete object."""
    t = F.col(text)
    start = F.instr(t, "[")
    to_end = F.when(start > 0, F.substring(t, start, 1 << 30))
    last = F.length(to_end) - F.instr(F.reverse(to_end), "]") + 1
    to_last = F.when(F.instr(to_end, "]") > 1, F.substring(to_end, 1, last))
    d = df.withColumns({"_a": to_last, "_b": to_end})
    read = [F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)) for c in ("_a", "_b")]
    d = d.withColumn("_d", F.coalesce(*read))
    # Only texts that neither reading took go to Python.
    d = d.withColumn("_c", truncated(F.when(F.col("_d").isNull(), F.col("_b"))))
    return d.withColumn(out, F.coalesce("_d", F.when(F.try_parse_json("_c").isNotNull(), F.from_json("_c", schema)))).drop("_a", "_b", "_c", "_d")


COMMENT = "array<struct<author:string,content:string,date:string,sub_comments:array<struct<author:string,content:string,date:string>>>>"
POSTS = f"array<struct<title:string,content:string,kind:string,author:string,views:string,likes:string,is_concept:boolean,image_desc:string,date:string,comments:{COMMENT}>>"
#: Limits of a post: comments with their replies, and replies of one comment.
POST_COMMENTS, POST_REPLIES = 40, 7


def flat_comments(comments: Column, replies: int, limit: int | None = None) -> Column:
    """A two-level tree as a flat array (author, content, parent) in order: roots without content go with their replies, blank replies go alone; a root has at
    most ``replies`` replies, and ``limit`` ends the whole. ``parent`` is the root's place from 1."""
    said = F.filter(F.coalesce(comments, F.array().cast(COMMENT)), lambda c: text_field(c["content"]) != "")
    roots = said if limit is None else F.slice(said, 1, limit)
    none = F.array().cast("array<struct<author:string,content:string,parent:int>>")

    def line(c: Column, parent: Column) -> Column:
        return F.struct(text_field(c["author"]).alias("author"), text_field(c["content"]).alias("content"), parent.cast("int").alias("parent"))

    def with_replies(acc: Column, c: Column) -> Column:
        under = F.slice(F.filter(F.coalesce(c["sub_comments"], F.array().cast(COMMENT_REPLIES)), lambda r: text_field(r["content"]) != ""), 1, replies)
        return F.concat(acc, F.array(line(c, F.lit(None))), F.transform(under, lambda r: line(r, F.size(acc) + 1)))

    flat = F.aggregate(roots, none, with_replies)
    return flat if limit is None else F.slice(flat, 1, limit)


COMMENT_REPLIES = "array<struct<author:string,content:string,date:string>>"


def comment_lines(raw: Column) -> Column:
    """Lines of a text as comments without author: bullets, numbers and a pair of quotes around a line are taken off."""
    lines = F.transform(F.split(raw, r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^(?:[-*•]|\d+[.)])\s*", ""))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r'(?s)^"(.*)"$', "$1"), r"^\s+|\s+$", ""))
    return F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.struct(F.lit(None).cast("string").alias("author"), x.alias("content"), F.lit(None).cast("int").alias("parent")))


def parsed_comments(df: DataFrame, raw: str, out: str = "comments") -> DataFrame:
    """Adds ``out``: the comments of an answer, from its JSON array if one can be saved and has any, else from its lines."""
    read = lenient_array(df, raw, COMMENT, "_tree")
    flat = read.withColumn("_flat", F.when(F.col("_tree").isNotNull(), flat_comments(F.col("_tree"), REPLIES)))
    return flat.withColumn(out, F.when(F.size("_flat") > 0, F.col("_flat")).otherwise(comment_lines(F.coalesce(F.col(raw), F.lit(""))))).drop("_tree", "_flat")


def parsed_posts(df: DataFrame, raw: str, quota: DataFrame, by: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """(by, ordinal, kind, title, author, content, views, likes, concept, image_desc, date, comments) of the posts of each answer that have a title and content.

    A kind that is none of ``kinds`` (in either case, blanks around it) becomes the one that the answer was asked for most: quota (by, kind, amount), the first in the order of ``kinds`` if equal.
    """
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    most = quota.where(place > 0).groupBy(*by).agg(F.max_by("kind", F.struct("amount", -place)).alias("_fallback"))
    read = lenient_array(df, raw, POSTS, "_posts").select(*by, F.posexplode("_posts").alias("_at", "_p"))
    kept = read.where((text_field(F.col("_p.title")) != "") & (text_field(F.col("_p.content")) != "")).join(most, by, "left")
    kind = F.upper(text_field(F.col("_p.kind")))
    return kept.select(
        *by, F.row_number().over(Window.partitionBy(*by).orderBy("_at")).alias("ordinal"), F.when(kind.isin(*kinds), kind).otherwise(F.col("_fallback")).alias("kind"), text_field(F.col("_p.title")).alias("title"),
        text_field(F.col("_p.author")).alias("author"), text_field(F.col("_p.content")).alias("content"), int_field(F.col("_p.views")).alias("views"), int_field(F.col("_p.likes")).alias("likes"),
        concept(F.col("_p.is_concept"), int_field(F.col("_p.likes"))).alias("concept"), text_field(F.col("_p.image_desc")).alias("image_desc"), text_field(F.col("_p.date")).alias("date"),
        flat_comments(F.col("_p.comments"), POST_REPLIES, POST_COMMENTS).alias("comments"),
    )


def text_field(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def int_field(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def valid_parent(parent: Column, ordinal: Column) -> Column:
    """A parent's ordinal, null if it is missing, below 1 or not before its own."""
    return F.when((parent >= 1) & (parent < ordinal), parent)


def concept(declared: Column, likes: Column) -> Column:
    return F.coalesce(declared, F.lit(False)) | (F.coalesce(likes, F.lit(0)) >= CONCEPT_LIKES)
