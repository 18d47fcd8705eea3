"""Fuzzy line deduplication by MinHash, with DataFrame and SQL functions only.

Equal lines become one row first. All character shingles of a line are hashed, whatever its length; they are cut
from its UTF-32 form, where a shingle is a byte range. One hash a shingle serves the whole signature: it
falls into one of BINS bins, and the minimum of each bin is a part of the signature; an empty bin takes
the minimum of the next one that is not, so equal sets of shingles sign equally however few they are.
Bands of minima give the candidates, which are compared by exact Jaccard similarity of all shingles as
long as they are not yet connected (see ``common.clusters``). Each component keeps its first line: the smallest
(document id, digest of the text, line number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clusters, delete, joined, release, stored

SHINGLE = 6
SIMILARITY = 0.8
ROWS, BANDS = 5, 12
BINS = ROWS * BANDS
#: 64-bit words of the mask by which unlike lines are told apart before their texts are compared.
WORDS = 32


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, line_no, k, k2, line) of every line that is not blank.

    ``digest`` is a hash of the whole text, which tells apart rows that share an id; (k, k2) is a 128-bit
    hash of the line, of which k alone names it in bands and links.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(r"line rlike '[^\\x20\\x09-\\x0D]'").select("doc_id", "digest", "line_no", F.xxhash64("line").alias("k"), F.xxhash64(F.lit("second"), "line").alias("k2"), "line")


def hashed(distinct: DataFrame) -> DataFrame:
    """(k, h): a 64-bit hash of every shingle of distinct lines (k, line). A line shorter than a shingle is one shingle."""
    n = SHINGLE
    wide = distinct.selectExpr("k", "encode(line, 'UTF-32') as u")
    at = wide.selectExpr("k", "u", f"explode(sequence(0, greatest(0, cast(octet_length(u) div 4 as int) - {n}))) as i")
    return at.selectExpr("k", f"xxhash64(substring(u, 4 * i + 1, {4 * n})) as h")


def signatures(distinct: DataFrame) -> DataFrame:
    """(k, m0, m1, ...): the minimum of each bin of the hashed shingles of distinct lines (k, line)."""
    h = hashed(distinct).selectExpr("k", "h", f"cast(pmod(h, {BINS}) as int) as bin")
    m = h.groupBy("k").agg(*(F.expr(f"min(h) filter (where bin = {j})").alias(f"m{j}") for j in range(BINS)))
    step = 1
    while step < BINS:  # after each step the nearest filled bin within twice the distance is known
        m = m.select("k", *(F.coalesce(f"m{j}", f"m{(j + step) % BINS}").alias(f"m{j}") for j in range(BINS)))
        step *= 2
    return m


def bands(distinct: DataFrame) -> DataFrame:
    """(k, bands) of distinct lines (k, line). The bins of a band lie apart, so that they rarely borrow from the same one."""
    keys = (F.xxhash64(F.lit(b), *(f"m{b + r * BANDS}" for r in range(ROWS))) for b in range(BANDS))
    return signatures(distinct).select("k", F.array(*keys).alias("bands"))


def _shingles(line: str) -> str:
    """SQL: the hashes of the distinct shingles of a line, as in ``hashed``."""
    n = SHINGLE
    cut = f"transform(sequence(0, greatest(0, cast(octet_length(u) div 4 as int) - {n})), i -> xxhash64(substring(u, 4 * i + 1, {4 * n})))"
    return f"transform(array(encode({line}, 'UTF-32')), u -> array_distinct({cut}))[0]"


def masks(distinct: DataFrame) -> DataFrame:
    """(k, shingles, mask): how many shingles a line has, repeats included, and WORDS words with the bit of each shingle set."""
    h = hashed(distinct).selectExpr("k", f"cast(pmod(shiftright(h, 6), {WORDS}) as int) as word", "shiftleft(1L, cast(h & 63 as int)) as bit")
    made = h.groupBy("k").agg(F.count("*").alias("shingles"), *(F.expr(f"bit_or(bit) filter (where word = {j})").alias(f"w{j}") for j in range(WORDS)))
    return made.select("k", "shingles", F.array(*(F.coalesce(f"w{j}", F.lit(0)) for j in range(WORDS))).alias("mask"))


def similar(pairs: DataFrame, texts: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose lines, by texts (k, line), have a Jaccard similarity of at least SIMILARITY over all shingles.

    Each bit in which two masks differ stands for a shingle of only one of the lines. Sets of that similarity differ in at most a
    fixed share of the smaller one, so pairs with more such bits are not similar, and their texts need not be read.
    """
    a, b = mask.selectExpr("k as a", "shingles as n_a", "mask as mask_a"), mask.selectExpr("k as b", "shingles as n_b", "mask as mask_b")
    differ = " + ".join(f"bit_count(mask_a[{j}] ^ mask_b[{j}])" for j in range(WORDS))
    close = joined(joined(pairs, a, "a"), b, "b").where(f"{differ} <= {1 / SIMILARITY - 1} * least(n_a, n_b)").select(*pairs.columns)
    a, b = texts.selectExpr("k as a", "line as line_a"), texts.selectExpr("k as b", "line as line_b")
    # inline() sees to it that the sets of a pair are made once.
    sets = joined(joined(close, a, "a"), b, "b").selectExpr(*pairs.columns, f"inline(array(struct({_shingles('line_a')} as x, {_shingles('line_b')} as y)))")
    counted = sets.selectExpr(*pairs.columns, "size(x) + size(y) as n", "inline(array(struct(size(array_intersect(x, y)) as both)))")
    return counted.where(f"both >= {SIMILARITY} * (n - both)").select(*pairs.columns)


#: Residue bands of a row: the least shingle of each of so many bins.
RESIDUE = 16


def residue(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, k) of the residue of rows (band, k, hub), by texts (k, line): each row's shingles that its hub lacks fall into bins, and the least of each bin names a band.

    So rows whose residues are small share a band with every row that has one of their shingles. A row that
    has next to nothing that its hub lacks is banded by what it lacks itself as well.
    """
    pairs = rows.select("k", "hub").distinct()
    keys = pairs.select("k").unionByName(pairs.select(F.col("hub").alias("k"))).distinct()
    sets = stored(hashed(joined(texts, keys, "k", "left_semi")).groupBy("k").agg(F.collect_set("h").alias("h")), "residue-shingles")
    both = joined(joined(pairs, sets, "k"), sets.select(F.col("k").alias("hub"), F.col("h").alias("hub_h")), "hub")
    parts = both.select("k", "hub", F.array_except("h", "hub_h").alias("own"), F.array_except("hub_h", "h").alias("lacks"))
    chosen = parts.select("k", "hub", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("own").alias("x")), F.struct(F.lit(-1).alias("sign"), F.when(F.size("own") * 8 < F.size("lacks"), F.col("lacks")).otherwise(F.array().cast("array<bigint>")).alias("x")))).alias("p"))
    least = F.expr(f"filter(transform(sequence(0, {RESIDUE - 1}), b -> array_min(filter(p.x, h -> pmod(shiftright(h, 8), {RESIDUE}) = b))), h -> h is not null)")
    # The sets of a row and its hub are read once, however many bands hold the two.
    each = stored(chosen.select("k", "hub", F.col("p.sign").alias("sign"), F.explode(least).alias("h")), "residue-least")
    return joined(rows, each, ["k", "hub"]).select(F.xxhash64("band", "hub", "sign", "h").alias("band"), "k")


def components_of_lines(docs: DataFrame) -> DataFrame:
    """(node, component, k2) of the hashes of distinct lines that are similar to another. Shuffle files of each step are given up before the next."""
    spark = docs.sparkSession
    distinct = lines(docs).groupBy("k").agg(F.min("line").alias("line"))
    every = stored(bands(distinct), "line-bands")
    release(spark)
    each = every.select("k", F.explode("bands").alias("band")).repartition("band")  # shuffled once, for counting and for the join
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stored(each.join(shared.hint("shuffle_hash"), "band"), "line-members")
    release(spark, every)
    keys = members.select("k").distinct().hint("shuffle_hash")
    texts = stored(lines(docs).select("k", "line").join(keys, "k", "left_semi").groupBy("k").agg(F.min("line").alias("line")), "band-lines")
    release(spark)
    mask = stored(masks(texts), "line-masks")
    found = clusters(members, lambda pairs: similar(pairs, texts, mask), lambda rows: residue(rows, texts))
    named = stored(joined(found, texts.select(F.col("k").alias("node"), F.xxhash64(F.lit("second"), "line").alias("k2")), "node"), "line-components")
    release(spark, texts, mask, members, found)
    return named


def doomed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, line_no) of lines that go: all but the first of each component of similar lines. Lines are equal if both their hashes are."""
    member = components_of_lines(docs)
    where = lines(docs).drop("line")
    placed = joined(where, member.withColumnRenamed("k2", "m2"), (where["k"] == member["node"]) & (where["k2"] == F.col("m2")), "left")
    classed = placed.select("doc_id", "digest", "line_no", F.coalesce("component", "k").alias("c"), F.when(F.col("component").isNull(), F.col("k2")).otherwise(0).alias("c2"))
    classed = stored(classed, "line-classes")
    first = stored(classed.groupBy("c", "c2").agg(F.min(F.struct("doc_id", "digest", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-lines")
    gone = stored(joined(classed, first, ["c", "c2"]).where("not (first <=> struct(doc_id, digest, line_no))").select("doc_id", "digest", "line_no"), "gone-lines")
    delete(docs.sparkSession, classed, first, member)
    return gone


def marked(docs: DataFrame) -> DataFrame:
    """(row, gone): each row of ``docs`` as a struct, and the sorted numbers of the lines that it loses, or null.

    Rows with a null id or text lose nothing. Blank lines stay. Rows with equal ids and different texts are documents of
    their own; rows with equal id and text are one document, and lose the same lines.
    """
    valid = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    gone = doomed(valid).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    on = (F.col("row.doc_id") == gone["doc_id"]) & (F.xxhash64("row.text") == gone["digest"])
    return rows.join(gone.hint("shuffle_hash"), on, "left").select("row", "gone")


def _kept(text: str) -> str:
    """SQL: the text without the lines ``gone``, as the runs of lines between them."""
    runs = f"""with_lines -> flatten(transform(sequence(0, size(gone)), j -> slice(with_lines,
        if(j = 0, 1, gone[j - 1] + 2), if(j = size(gone), size(with_lines), gone[j]) - if(j = 0, 0, gone[j - 1] + 1))))"""
    return f"if(gone is null, {text}, array_join(transform(array(split({text}, '\n')), {runs})[0], '\n'))"


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without doomed lines; documents left without a word go; n_chars, if there, is set anew. Columns unchanged, whatever their names."""
    kept = marked(docs).selectExpr("row", "gone", f"{_kept('row.text')} as kept").where(r"gone is null or kept rlike '[^\\x20\\x09-\\x0D]'")
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 (kept lines joined by a line break). A null text counts as empty; an empty table gives no rows."""
    m = marked(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return m.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split("row.text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.encode(F.expr(_kept("row.text")), "UTF-8"), 256).alias("kept_sha256"),
    )
