"""Queries of the ingest and normalisation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import quality as Q
from ..sources import ledger as L
from ..sources import views as V
from ..streaming import ingest as streaming
from . import inputs as I
from .inputs import sql
from .registry import query


@query(sql("select match_id, side, pick_order, champion_id, kills, deaths, assists, dealing, tanking, healing from pr", V.SQL_RAW))
def a1_nested_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested records written as JSON, read with a declared schema, and turned into rows."""
    nested = L.json_round_trip(I.raw(spark, d).select("match_id", "stats"))
    return nested.selectExpr("match_id", "inline(stats)").drop("pos", "role")


@query(sql("select match_type, career_id, count(*) as contests from mt where match_id % 2 = 1 group by all", V.SQL_RAW))
def a4_new_contests_only(spark: SparkSession, d: str) -> DataFrame:
    rows = I.raw(spark, d).select("career_id", "match_type", "match_id")
    loaded = rows.where("match_id % 2 = 0")
    return N.new_only(rows, loaded, ["career_id", "match_type", "match_id"]).groupBy("match_type", "career_id").agg(F.count("*").alias("contests"))


@query(sql("select career_id, champion_id, last_seq, n_changes from (select career_id, champion_id, max(seq) as last_seq, count(*) as n_changes, from pe group by all)"))
def a8_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of earlier runs and of the last one; the last write of each null-safe key stays."""
    e = I.events(spark, d)
    runs = [e.where(F.col("seq") <= r).groupBy("career_id", "champion_id").agg(F.max("seq").cast("bigint").alias("last_seq"), F.count("*").alias("n_changes")).withColumn("run", F.lit(r)) for r in (2, 3, 4)]
    return L.upsert(runs[0].unionByName(runs[1]), runs[2], ["career_id", "champion_id"], "run").drop("run")


@query(sql("select match_type, count(*) as contests, sum(case when n = 8 then 1 else 0 end)::bigint as full_size, sum(nd)::bigint as champions, max(blue_score) as best, count(distinct day) as days from mt group by all", V.SQL_RAW))
def a13_profile(spark: SparkSession, d: str) -> DataFrame:
    ids = F.size(F.array_distinct(F.transform("stats", lambda s: s["champion_id"])))
    return I.raw(spark, d).groupBy("match_type").agg(
        F.count("*").alias("contests"), F.count_if(F.size("stats") == 8).alias("full_size"), F.sum(ids).alias("champions"), F.max("blue_score").alias("best"), F.count_distinct("day").alias("days")
    )


@query(sql("select match_type, match_id // 1024 as range, count(*) as rows, sha256(string_agg(match_id || ':' || blue_score || ':' || red_score, ',' order by match_id)) as digest from mt group by all", V.SQL_RAW))
def a12_canonical_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each range of a record set in canonical order."""
    return Q.canonical_digest(I.raw(spark, d), ["match_type"], "match_id", ["match_id", "blue_score", "red_score"])


@query(sql("""select 'bans' as what, match_type, n as value, count(*) as contests from (select mt.match_id, mt.match_type, count(bn.match_id) as n from mt left join bn using (match_id) group by all) group by all
  union all select 'size', match_type, n, count(*) from mt group by all union all select 'champions', match_type, nd, count(*) from mt group by all
  union all select 'version', match_type, patch_seq, count(*) from ct group by all"""))
def a13_distributions(spark: SparkSession, d: str) -> DataFrame:
    """How many contests have how many bans, participants and distinct champions, and belong to which version, by kind of contest."""
    raw = I.raw(spark, d)
    valid = I.contests(spark, d)
    bans = I.bans(spark, d).groupBy("match_id").agg(F.count("*").alias("n"))
    shown = lambda df, what, value: df.select(F.lit(what).alias("what"), "match_type", value.cast("bigint").alias("value"))
    parts = [
        shown(raw.join(bans, "match_id", "left"), "bans", F.coalesce("n", F.lit(0))),
        shown(raw, "size", F.size("stats")),
        shown(raw, "champions", F.size(F.array_distinct("stats.champion_id"))),
        shown(valid.select("match_id", "match_type").join(I.facts(spark, d).select("match_id", "patch_seq").distinct(), "match_id"), "version", F.col("patch_seq")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("what", "match_type", "value").agg(F.count("*").alias("contests"))


#: A manifest that was written before some ranges changed, came or went: ranges of 16 contests; unranked ones are the set without a name.
_DIGESTS = "dg as (select nullif(match_type, 'SCRIM') as kind, match_id // 16 as range, count(*) as rows, sha256(string_agg(match_id || ':' || blue_score || ':' || red_score, ',' order by match_id)) as digest from mt group by all)"
_MANIFEST = "mn as (select kind, case when range % 5 = 1 then range + 100000 else range end as range, case when range % 4 = 2 then rows + 1 else rows end as rows, case when range % 4 = 2 then 'x' || digest else digest end as digest from dg)"


@query(sql("select coalesce(a.kind, m.kind) as kind, coalesce(a.range, m.range) as range, case when a.rows is null then 'missing' when m.rows is null then 'extra' else 'changed' end as state, a.rows as rows, m.rows as expected_rows from dg a full outer join mn m on coalesce(a.kind, '~') = coalesce(m.kind, '~') and a.range = m.range where a.digest is distinct from m.digest", f"{V.SQL_RAW}, {_DIGESTS}, {_MANIFEST}"))
def a12_manifest_report(spark: SparkSession, d: str) -> DataFrame:
    """Record sets compared with a manifest: which are missing, extra or changed."""
    named = I.raw(spark, d).withColumn("kind", F.expr("nullif(match_type, 'SCRIM')"))
    actual = Q.canonical_digest(named, ["kind"], "match_id", ["match_id", "blue_score", "red_score"], 16)
    old = "range % 4 = 2"
    manifest = actual.selectExpr("kind", "if(range % 5 = 1, range + 100000, range) as range", f"if({old}, rows + 1, rows) as rows", f"if({old}, concat('x', digest), digest) as digest")
    return Q.reconciled(actual, manifest, ["kind", "range"])


@query(sql("select career_id, count(*) filter (n = 8 and nd = 8 and winner_side is not null) as kept, count(*) filter (not (n = 8 and nd = 8)) as bad_format, count(*) filter (n = 8 and nd = 8 and winner_side is null) as no_winner from mt group by all", V.SQL_RAW))
def b1_fixed_format(spark: SparkSession, d: str) -> DataFrame:
    return N.skipped(I.raw(spark, d))


@query(sql("select match_id, side, pick_order, champion_id, kills, deaths from pr join mt using (match_id) where n = 8 and nd = 8", V.SQL_RAW))
def b2_picks_to_stats(spark: SparkSession, d: str) -> DataFrame:
    return N.pick_matches(N.fixed_format(I.raw(spark, d))).select("match_id", "side", "pick_order", "champion_id", "kills", "deaths")


@query(sql("select career_id, count(*) as contests, count(*) filter (ids <> sorted) as mismatched from (select career_id, match_id, list(champion_id order by pos) as ids, list(champion_id order by champion_id) as sorted from pr join mt using (match_id) where n = 8 and nd = 8 group by all) group by all", V.SQL_RAW))
def b3_order_audit(spark: SparkSession, d: str) -> DataFrame:
    return N.order_audit(N.fixed_format(I.raw(spark, d)))


@query(sql("select match_id, winner_side from mt where n = 8 and nd = 8", V.SQL_RAW))
def b4_winner_side(spark: SparkSession, d: str) -> DataFrame:
    return N.with_winner(N.fixed_format(I.raw(spark, d))).select("match_id", "winner_side")


@query(sql("select pt.career_id, pt.seq::bigint as seq, season::bigint as season, day::bigint as day, count(pe.champion_id) as changed from pt left join pe on pe.career_id = pt.career_id and pe.seq = pt.seq group by all"))
def b5_patch_timeline(spark: SparkSession, d: str) -> DataFrame:
    feed = I.patches(spark).drop("seq")
    doubled = feed.unionByName(feed).unionByName(feed.limit(1).withColumn("day", F.lit(None).cast("int")))
    return N.patch_timeline(I.events(spark, d), doubled).select("career_id", *(F.col(c).cast("bigint").alias(c) for c in ("seq", "season", "day", "changed")))


@query(sql("select career_id, seq::bigint as seq, count(*) as changes, sum(attack)::bigint as attack from pe where attack <> 0 group by all"))
def b6_patch_news(spark: SparkSession, d: str) -> DataFrame:
    news = I.events(spark, d).where("attack <> 0").groupBy("career_id", F.col("seq").cast("bigint").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("champion_id", "attack"))).alias("changes"))
    return news.where("size(changes) > 0").selectExpr("career_id", "seq", "cast(size(changes) as bigint) as changes", "aggregate(changes, 0L, (a, c) -> a + c.attack) as attack")


@query(sql("select career_id, seq::bigint as seq, champion_id, attack from pe where champion_id <= 30"))
def b7_patch_events(spark: SparkSession, d: str) -> DataFrame:
    """News exploded and joined with the known champions; unknown names are skipped."""
    known = spark.range(1, 31).withColumnRenamed("id", "champion_id")
    return I.events(spark, d).join(known, "champion_id").select("career_id", F.col("seq").cast("bigint").alias("seq"), "champion_id", F.coalesce("attack", F.lit(0)).alias("attack"))


@query(sql("select match_id, patch_seq::bigint as patch_seq from ct"))
def b8_as_of_patch(spark: SparkSession, d: str) -> DataFrame:
    return N.with_patch(I.contests(spark, d), I.patches(spark)).select("match_id", F.col("patch_seq").cast("bigint").alias("patch_seq"))


@query(sql("select match_id, champion_id, change_count from pa"))
def b9_change_count(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("match_id", "champion_id", "change_count")


@query(sql("select career_id, champion_id, seq::bigint as seq, attack, row_number() over (partition by career_id, champion_id order by seq) as version from pe"))
def b10_version_history(spark: SparkSession, d: str) -> DataFrame:
    return N.version_history(I.events(spark, d)).select("career_id", "champion_id", F.col("seq").cast("bigint").alias("seq"), "attack", F.col("version").cast("bigint").alias("version"))


@query(sql("select match_id, max(pt.seq)::bigint as patch_seq, (select max(day) from mt)::bigint as day from mt left join pt on pt.career_id = mt.career_id and pt.day <= (select max(day) from mt) where match_type = 'SCRIM' group by match_id", V.SQL_RAW))
def b11_observed_time(spark: SparkSession, d: str) -> DataFrame:
    """Undated contests take the file's own date, then a version."""
    r = I.raw(spark, d)
    today = r.agg(F.max("season").alias("season"), F.max("day").alias("day"))
    undated = r.where("match_type = 'SCRIM'").drop("season", "day").join(F.broadcast(today), how="cross")  # one row
    return N.with_patch(undated, I.patches(spark)).select("match_id", F.col("patch_seq").cast("bigint").alias("patch_seq"), F.col("day").cast("bigint").alias("day"))


@query(sql("select champion_id, count(*) as rows from pa where champion_id > 35 group by all"))
def b12_unknown_entities(spark: SparkSession, d: str) -> DataFrame:
    return N.unknown_entities(I.facts(spark, d), spark.range(1, 36).withColumnRenamed("id", "champion_id"))


@query(sql("select career_id, team_id, row_number() over (partition by career_id order by team_id) as team_no from (select distinct career_id, team_id from (select career_id, blue_team_id as team_id from mt union all select career_id, red_team_id from mt) where team_id is not null)", V.SQL_RAW))
def b13_team_registry(spark: SparkSession, d: str) -> DataFrame:
    return N.team_registry(I.raw(spark, d)).withColumn("team_no", F.col("team_no").cast("bigint"))


@query(sql("select match_id, coalesce(blue_team_id, case when match_id % 2 = 0 then 77 end) as blue_team_id, coalesce(red_team_id, case when match_id % 2 = 0 then 78 end) as red_team_id from mt", V.SQL_RAW))
def b14_back_fill(spark: SparkSession, d: str) -> DataFrame:
    r = I.raw(spark, d)
    source = r.selectExpr("match_id", "if(match_id % 2 = 0, 77L, null) as blue", "if(match_id % 2 = 0, 78L, null) as red")
    return N.back_filled(r.select("match_id", "blue_team_id", "red_team_id"), source)


@query("select c_nationkey::bigint as team_id, case when c_nationkey % 3 = 0 then 'own ' || c_nationkey else n_name end as name from (select distinct c_nationkey from customer) join nation on n_nationkey = c_nationkey")
def b15_team_names(spark: SparkSession, d: str) -> DataFrame:
    teams = V.read(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("team_id")).distinct()
    old = teams.withColumn("name", F.expr("case when team_id % 3 = 0 then concat('own ', team_id) when team_id % 3 = 1 then '  ' end"))
    new = V.read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("team_id"), F.col("n_name").alias("name")).join(teams, "team_id", "left_semi")
    return N.team_names(old, new)


@query("select user_id, arg_min(event_type, event_id) filter (event_id >= 200) as kind, coalesce(arg_min(value, event_id) filter (event_id >= 200), arg_min(value, event_id)) as total from events group by user_id having count(*) filter (event_id >= 200) > 0")
def b16_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a first and a second file; the second overwrites, its first record of a key wins."""
    e = V.read(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("value").alias("total"), F.col("event_id").alias("ordinal"))
    new, first = e.where("ordinal >= 200"), e.where("ordinal < 200")
    old = first.groupBy("user_id").agg(F.min_by("kind", "ordinal").alias("kind"), F.min_by("total", "ordinal").alias("total"))
    out = N.latest_snapshot(old, new, "user_id", ["kind", "total"], ["total"])
    return out.join(new.select("user_id").distinct(), "user_id", "left_semi")


@query("select p_partkey, case when p_partkey % 3 = 0 then p_size end::bigint as reference from part")
def b17_name_reference(spark: SparkSession, d: str) -> DataFrame:
    named = V.read(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then concat('`', p_size) when 1 then concat('`', p_size, 'x') else p_name end as name")
    return named.select("p_partkey", N.name_reference().cast("bigint").alias("reference"))


@query(sql("select match_id, champion_id, is_winner::int as won from p0"))
def b18_participant_facts(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("match_id", "champion_id", F.col("is_winner").cast("int").alias("won"))


@query(
    sql(
        """select 'pick_order' as rule, count(*) filter (pick_order not between 1 and 4) as violations from pa
        union all select 'champion_known', count(*) filter (champion_id not between 1 and 40) from pa
        union all select 'official_dated', count(*) filter (match_type = 'OFFICIAL' and (season is null or day is null)) from pa
        union all select 'change_count', count(*) filter (change_count < 0) from pa
        union all select 'side_size', (select count(*) from (select match_id, side from pa group by all having count(*) <> 4))
        union all select 'champion_once', (select count(*) from (select match_id from pa group by all having count(distinct champion_id) <> count(*)))
        union all select 'ban_once', (select count(*) from (select match_id from bn group by all having count(distinct champion_id) <> 6))
        union all select 'healing_known', count(*) filter (healing is null) from pa"""
    )
)
def b19_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.report(I.facts(spark, d), I.bans(spark, d))


@query(sql("select career_id, count(*) as valid from (select career_id, match_id from pa group by all having count(*) filter (side = 'BLUE') > 0 and count(*) filter (side = 'RED') > 0 and count(distinct champion_id) = count(*) and min(change_count) >= 0) group by all"))
def b20_valid_observations(spark: SparkSession, d: str) -> DataFrame:
    return Q.valid_observations(I.facts(spark, d)).groupBy("career_id").agg(F.count("*").alias("valid"))


@query(sql("select career_id, match_type, count(*) as contests from mt group by all", V.SQL_RAW))
def a5_streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events arrive as files, the stream loads them once; a second run over the same files adds nothing."""
    target, state = L.work_dir(spark, "ingested"), L.work_dir(spark, "state")
    schema = V.read(spark, d, "events").schema
    for attempt in range(2):
        streaming.catch_up(spark, d, schema, target, f"{state}/{attempt}", ["event_id"], glob="events.parquet", part="event_id div 100000")
    loaded = spark.read.parquet(target).selectExpr("event_id div 8 as match_id").groupBy("match_id").agg(F.count("*").alias("n"))
    typed = loaded.selectExpr("if(match_id % 5 = 0, 2, 1) as career_id", "if(match_id % 3 = 0, 'SCRIM', 'OFFICIAL') as match_type")
    return typed.groupBy("career_id", "match_type").agg(F.count("*").alias("contests"))


@query(sql("select career_id, champion_id, count(*) as changes from pe where not (career_id = 2 and seq > 3) group by all"))
def a9_replace_partitions(spark: SparkSession, d: str) -> DataFrame:
    """All careers are written, then one again; only its partition is replaced."""
    path = L.work_dir(spark, "partitions")
    e = I.events(spark, d)
    counts = lambda rows: rows.groupBy("career_id", "champion_id").agg(F.count("*").alias("changes"))
    L.replace_partitions(counts(e), path, ["career_id"])
    L.replace_partitions(counts(e.where("career_id = 2 and seq <= 3")), path, ["career_id"])
    return spark.read.parquet(path).select("career_id", "champion_id", "changes")


@query("select o_orderkey as run_id, case when o_orderstatus = 'F' then left(repeat(o_orderpriority, 200), 1000) end as error, o_orderstatus <> 'F' as done from orders")
def a11_ingest_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows of runs; errors are cut."""
    runs = V.read(spark, d, "orders").selectExpr("o_orderkey as run_id", "if(o_orderstatus = 'F', repeat(o_orderpriority, 200), null) as error")
    return L.ledger_rows(runs).withColumn("done", F.col("error").isNull())


_FILES = "select concat(case when o_orderkey % 3 = 0 then 'backup_' else '' end, 'slot_', o_orderkey, case when o_orderkey % 5 = 0 then '.json.bak' else '.json' end) as file, o_orderkey from orders"


@query(f"select * from ({_FILES}) where file like 'slot_%' and file like '%.json'")
def a2_slot_files(spark: SparkSession, d: str) -> DataFrame:
    """Of file names like those of a save folder, the slot files; backups are not read."""
    names = V.read(spark, d, "orders").selectExpr("concat(if(o_orderkey % 3 = 0, 'backup_', ''), 'slot_', o_orderkey, if(o_orderkey % 5 = 0, '.json.bak', '.json')) as file", "o_orderkey")
    return L.slot_files(names)


def _hashes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files with the hash of their content, and a ledger of earlier runs, some of which failed or read other content."""
    h = V.read(spark, d, "documents").selectExpr("cast(doc_id as string) as file", "sha2(coalesce(text, ''), 256) as sha", "doc_id")
    ledger = h.where("doc_id % 3 <> 0").selectExpr("file", "if(doc_id % 7 = 0, 'other', sha) as sha", "if(doc_id % 5 = 0, 'broken', null) as error")
    return h.drop("doc_id"), ledger


@query("select doc_id::varchar as file, sha256(coalesce(text, '')) as sha from documents where doc_id % 3 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0")
def a3_skip_known_content(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content no successful run has read: new, changed, or failed before."""
    return L.to_ingest(*_hashes(spark, d))


@query("select doc_id::varchar as file, sha256(coalesce(text, '')) as sha, (doc_id % 3 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0)::int as needed from documents")
def a6_forced_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """A forced run reads every file, known or not; ``needed`` marks those that a run without force would read."""
    h, ledger = _hashes(spark, d)
    return L.to_ingest(h, ledger, force=True).join(L.to_ingest(h, ledger).withColumn("needed", F.lit(1)), ["file", "sha"], "left").select("file", "sha", F.coalesce("needed", F.lit(0)).alias("needed"))


@query("select 'region' as name, count(*) as rows, count(*) = 5 as complete from region union all select 'nation', count(*), count(*) = 25 from nation union all select 'supplier', count(*), count(*) = -1 from supplier")
def a7_seeded_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions with the number of rows that they are expected to have, one of them wrong on purpose."""
    return Q.row_counts({t: V.read(spark, d, t) for t in ("region", "nation", "supplier")}, {"region": 5, "nation": 25, "supplier": -1})


@query(sql("select 'tally' as name, 2::bigint as run_id, count(distinct (career_id, champion_id)) as rows, 9.0::double as k0, (select count(*) from pa) as games from pa"))
def a10_aggregation_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Two runs are written with their settings; a third breaks off before its ledger rows. The latest finished run is read."""
    root, rows = L.work_dir(spark, "runs"), I.facts(spark, d)
    tally = rows.groupBy("career_id", "champion_id").agg(F.count("*").alias("games"))
    L.record_run(root, 1, {"tally": tally.where("games > 1")}, {"k0": 8.0})
    L.record_run(root, 2, {"tally": tally}, {"k0": 9.0})
    tally.where("games > 2").write.parquet(f"{root}/runs/3/tally")
    games = L.run_table(spark, root, "tally").agg(F.sum("games")).first()[0]
    return spark.read.parquet(f"{root}/ledger").where("run_id = 2").select("name", "run_id", "rows", F.col("settings")["k0"].alias("k0"), F.lit(games).alias("games"))
