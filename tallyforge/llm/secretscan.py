"""Secret scans over an incremental ledger of blobs, with DataFrame and SQL functions only.

Every version of a file is addressed by the SHA-256 of its text (its blob). The ledger, a Parquet table, has one row for each pair of blob and rule version
that was scanned, with what was found, so a text is scanned once however many paths and versions hold it, and again
only for rules or rule versions that are new. Findings are then joined back to every path by blob.

What is found lies between gaps: ``split`` gives the texts between matches and ``regexp_extract_all`` the matches, and a window sums
their lengths to positions. So a text is never searched again for the place of a match, however many it has.

Nulls: a null text is empty; null path columns are passed on. Every row of ``versions`` gives one row, repeated rows too. A blob is pre-aggregated
before the shuffle, so that a text which a third of all rows hold is one row of each task. Columns of any name may be there; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, fresh, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` are spans, unless ``group`` of it is shorter than ``least``. A change of the pattern is a new version."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Fixed values of the contract: the kinds in their order, patterns and lengths. Runs of access and hex match only whole, so their least length may stand in the pattern.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Added to the base: headers of private keys, and bearer tokens of at least 20 characters.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", 1, r"[Bb]earer\x20+([A-Za-z0-9._~+/-]+)", 1, 20),
)
RULES = BASE + ADDED
HITS = "array<struct<gap: int, width: int, good: boolean>>"
LEDGER = "blob binary, rule string, version int, spans array<struct<start: bigint, stop: bigint>>"


def blob_of(text: str) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _hits(rule: Rule) -> Column:
    """Each match of the text: characters since the match before, its own, and whether it is long enough."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    widths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    inner = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    zipped = F.zip_with(F.zip_with(gaps, widths, lambda g, w: F.struct(g.alias("gap"), w.alias("width"))), inner, lambda s, v: F.struct(s["gap"].alias("gap"), s["width"].alias("width"), (v >= rule.least).alias("good")))
    return F.filter(zipped, lambda x: x["width"].isNotNull())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger)


def pending(versions: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): every distinct text with rule versions under which it was not scanned yet."""
    spark = versions.sparkSession
    every = F.array(*(F.lit(r.key) for r in rules))
    texts = versions.select(blob_of("text").alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not _exists(spark, ledger):
        return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
    digests = versions.select(blob_of("text").alias("blob")).distinct()
    open_ = digests.join(seen, "blob", "left").select("blob", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen")).alias("todo")).where(F.size("todo") > 0)
    # Texts that were scanned are left out before any text is grouped; Spark may split a blob with many rows here.
    return texts.join(open_, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at the path ``ledger`` has not seen of ``versions`` (text, ...) and appends it there. Returns the rows that were appended.

    A run that is repeated after a failure finds its blobs in the ledger or scans them again; rows that were appended twice are equal, and readers count them once.
    """
    spark = versions.sparkSession
    todo = pending(versions, ledger, rules)
    none = F.array().cast(HITS)
    found = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(F.col("text").rlike(r.pattern), _hits(r)).otherwise(none).alias("hits"))) for r in rules]
    one = todo.select("blob", F.explode(F.array_compact(F.array(*found))).alias("r")).select("blob", "r.rule", "r.version", F.posexplode_outer("r.hits").alias("i", "hit"))
    before = "partition by blob, rule, version order by i rows unbounded preceding"
    placed = one.select("blob", "rule", "version", F.col("hit.width").alias("width"), F.col("hit.good").alias("good"), F.expr(f"sum(cast(hit.gap + hit.width as bigint)) over ({before})").alias("stop"))
    span = F.when(F.col("good"), F.struct((F.col("stop") - F.col("width")).alias("start"), "stop"))
    rows = placed.groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    batch = stored(rows, "scanned")
    batch.write.mode("append").option("compression", "zstd").parquet(ledger)
    return batch


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with a column findings (array of rule, start, stop; start counts code points, stop is exclusive), sorted by start and the order of rules; empty if the ledger has none."""
    spark = versions.sparkSession
    number = {r.key: k for k, r in enumerate(rules)}
    order = F.create_map(*(F.lit(x) for kv in number.items() for x in kv))
    hits = read_ledger(spark, ledger).where(F.size("spans") > 0).withColumn("number", order[F.concat_ws("@", "rule", "version")]).where("number is not null")
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("number").alias("number"), s["stop"].alias("stop"), F.col("rule").alias("rule")))))).alias("found"))
    blob, name = fresh("blob", versions.columns), fresh("findings", versions.columns)
    found = stored(by_blob.withColumnsRenamed({"blob": blob, "found": name}), "findings")
    joined = versions.withColumn(blob, blob_of("text")).join(found, blob, "left")
    made = F.transform(F.coalesce(F.col(name), F.array().cast(found.schema[name].dataType)), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["stop"].alias("stop")))
    return joined.select(*(F.col(f"`{c}`") for c in versions.columns), made.alias(name))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"], x["stop"])), ",")


def _of_rule(rule: Rule) -> Column:
    return F.filter("findings", lambda x: x["rule"] == rule.name)


def report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. ``ledger``: path of a ledger to go on with; none starts one in the shared folder."""
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/ledgers/{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    delete(docs.sparkSession, scan(docs, ledger))
    # Only ids and blobs travel to the findings, not texts: the columns are chosen after the join.
    f = findings(docs, ledger)
    base = F.filter("findings", lambda x: x["rule"].isin([r.name for r in BASE]))
    counts = (F.size(_of_rule(r)).cast("long").alias(f"n_{r.name}") for r in BASE)
    return f.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("findings")).alias("spans"))


def _sql(rules: tuple[Rule, ...]) -> str:
    """The spans of the same rules, from gaps and matches, in DuckDB's dialect."""
    each = "\n union all ".join(
        f"""select doc_id, n, {k} as k, '{r.name}' as rule, {r.least} as least,
            unnest([length(x) for x in string_split_regex(t, $${r.pattern}$$)][1:len(regexp_extract_all(t, $${r.pattern}$$, 0))]) as gap,
            unnest([length(x) for x in regexp_extract_all(t, $${r.pattern}$$, 0)]) as width,
            unnest([length(x) for x in regexp_extract_all(t, $${r.pattern}$$, {r.group})]) as got,
            generate_subscripts(regexp_extract_all(t, $${r.pattern}$$, 0), 1) as i from d"""
        for k, r in enumerate(rules)
    )
    counts = ", ".join(f"count(*) filter (where rule = '{r.name}') as n_{r.name}" for r in BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as n from documents),
m as ({each}),
p as (select *, sum(gap + width) over (partition by n, k order by i) as stop from m),
g as (select n, k, rule, (stop - width)::bigint as start, rule || ':' || (stop - width)::bigint || ':' || stop::bigint as span from p where got >= least),
s as (select n, {counts}, string_agg(span, ',' order by start, k) filter (where k < {len(BASE)}) as base, string_agg(span, ',' order by start, k) as spans from g group by n)
select doc_id, {", ".join(f"coalesce(n_{r.name}, 0) as n_{r.name}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join s using (n)
"""


REPORT_SQL = _sql(RULES)
