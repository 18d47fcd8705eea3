"""Normalising nested contest records into participant facts with versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDE_SIZE = 4


def with_winner(contests: DataFrame) -> DataFrame:
    """winner_side: the higher score; an official tie goes by the contest's number, a scrim's tie has none (quarantine)."""
    tie = F.when(F.col("match_type") == "OFFICIAL", F.when(F.col("match_id") % 2 == 0, "BLUE").otherwise("RED"))
    return contests.withColumn("winner_side", F.when(F.col("blue_score") > F.col("red_score"), "BLUE").when(F.col("red_score") > F.col("blue_score"), "RED").otherwise(tie))


def fixed_format(contests: DataFrame, size: int = 2 * SIDE_SIZE) -> DataFrame:
    """Contests with exactly ``size`` participants, all different."""
    ids = F.transform("stats", lambda s: s["champion_id"])
    return contests.where((F.size("stats") == size) & (F.size(F.array_distinct(ids)) == size))


def skipped(contests: DataFrame) -> DataFrame:
    """Per career: how many records the format and the winner rule keep and skip."""
    ids = F.transform("stats", lambda s: s["champion_id"])
    good = (F.size("stats") == 2 * SIDE_SIZE) & (F.size(F.array_distinct(ids)) == 2 * SIDE_SIZE)
    w = with_winner(contests).withColumn("good", good)
    return w.groupBy("career_id").agg(F.count_if(F.col("good") & F.col("winner_side").isNotNull()).alias("kept"), F.count_if(~F.col("good")).alias("bad_format"), F.count_if(F.col("good") & F.col("winner_side").isNull()).alias("no_winner"))


def timeline(patches: DataFrame) -> DataFrame:
    """One row a career: its boundaries as an array of (season, day, seq). Bounded by the number of versions."""
    return patches.groupBy("career_id").agg(F.array_sort(F.collect_list(F.struct("season", "day", "seq"))).alias("timeline"))


def with_patch(contests: DataFrame, patches: DataFrame) -> DataFrame:
    """patch_seq: the latest boundary at or before the contest's day, null if there is none; the fact is not shuffled."""
    at = F.struct("season", "day")
    past = F.filter("timeline", lambda p: F.struct(p["season"], p["day"]) <= at)
    return contests.join(timeline(patches), "career_id", "left").withColumn("patch_seq", F.array_max(F.transform(past, lambda p: p["seq"]))).drop("timeline")


def participants(contests: DataFrame) -> DataFrame:
    """One row a participant, with the contest's columns, its team and is_winner."""
    rows = contests.selectExpr(*(c for c in contests.columns if c != "stats"), "inline(stats)")
    return rows.withColumn("is_winner", F.col("side") == F.col("winner_side")).withColumn("team_id", F.when(F.col("side") == "BLUE", F.col("blue_team_id")).otherwise(F.col("red_team_id")))


def with_change_count(rows: DataFrame, events: DataFrame, name: str = "change_count") -> DataFrame:
    """The number of the champion's own changes up to the row's version; the events of a champion are one array."""
    own = events.groupBy("career_id", "champion_id").agg(F.collect_list("seq").alias("_seqs"))
    upto = F.size(F.filter("_seqs", lambda s: s <= F.col("patch_seq")))
    return rows.join(own, ["career_id", "champion_id"], "left").withColumn(name, F.when(F.col("_seqs").isNull() | F.col("patch_seq").isNull(), 0).otherwise(upto).cast("bigint")).drop("_seqs")


def facts(raw: DataFrame, patches: DataFrame, events: DataFrame) -> DataFrame:
    """Participant facts of valid contests, from raw nested records."""
    valid = with_winner(fixed_format(raw)).where("winner_side is not null")
    return with_change_count(participants(with_patch(valid, patches)), events)


def bans(contests: DataFrame) -> DataFrame:
    """(match_id, career_id, side, ban_order, champion_id) of official contests."""
    slots = F.explode(F.array(*map(F.lit, (0, 1, 2, 4, 5, 6)))).alias("slot")
    made = contests.where("match_type = 'OFFICIAL'").select("match_id", "career_id", slots)
    return made.selectExpr("match_id", "career_id", "if(slot < 4, 'BLUE', 'RED') as side", "slot % 4 + 1 as ban_order", "1 + (match_id * 11 + slot * 5) % 40 as champion_id")


def pick_matches(contests: DataFrame) -> DataFrame:
    """Picks joined to stats by champion, not by place: side, pick_order, champion_id, kills; a pick without a stat keeps nulls."""
    shuffled = contests.withColumn("by_champion", F.expr("array_sort(transform(stats, s -> struct(s.champion_id, s.kills, s.deaths)))"))
    picks = shuffled.select("match_id", F.expr("inline(transform(stats, s -> struct(s.side, s.pick_order, s.champion_id)))"))
    stats = shuffled.select("match_id", F.expr("inline(transform(by_champion, s -> struct(s.champion_id, s.kills, s.deaths)))"))
    return picks.join(stats, ["match_id", "champion_id"], "left")


def order_audit(contests: DataFrame) -> DataFrame:
    """Per career: contests, and those whose stats in champion order differ from the pick order."""
    ids = "transform(stats, s -> s.champion_id)"
    return contests.groupBy("career_id").agg(F.count("*").alias("contests"), F.count_if(F.expr(f"array_sort({ids}) <> {ids}")).alias("mismatched"))


def patch_timeline(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Boundaries in feed order: undated ones dropped, one per day, seq by arrival, with the number of champions changed."""
    dated = feed.where("season is not null and day is not null").dropDuplicates(["career_id", "season", "day"])
    w = Window.partitionBy("career_id").orderBy("season", "day")
    numbered = dated.select("career_id", "season", "day", F.row_number().over(w).alias("seq"))
    changed = events.groupBy("career_id", "seq").agg(F.count("*").alias("changed"))
    return numbered.join(changed, ["career_id", "seq"], "left").select("career_id", "seq", "season", "day", F.coalesce("changed", F.lit(0)).alias("changed"))


def version_history(events: DataFrame) -> DataFrame:
    """The running version of each champion over its own changes."""
    w = Window.partitionBy("career_id", "champion_id").orderBy("seq")
    return events.select("career_id", "champion_id", "seq", "attack", F.row_number().over(w).alias("version"))


def team_registry(contests: DataFrame) -> DataFrame:
    """Every team of a career with a number of its own; null ids get none."""
    teams = contests.select("career_id", F.explode(F.array("blue_team_id", "red_team_id")).alias("team_id")).where("team_id is not null").distinct()
    return teams.withColumn("team_no", F.row_number().over(Window.partitionBy("career_id").orderBy("team_id")))


def back_filled(facts: DataFrame, source: DataFrame) -> DataFrame:
    """Team ids from ``source`` (match_id, blue, red) where both are null and the source has one."""
    fill = F.col("blue_team_id").isNull() & F.col("red_team_id").isNull() & (F.col("blue").isNotNull() | F.col("red").isNotNull())
    return facts.join(source, "match_id", "left").select(
        "match_id", F.when(fill, F.col("blue")).otherwise(F.col("blue_team_id")).alias("blue_team_id"), F.when(fill, F.col("red")).otherwise(F.col("red_team_id")).alias("red_team_id")
    )


def unknown_entities(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Champions of facts that the dimension does not know, with their rows; must be empty in strict mode."""
    return facts.join(known.select("champion_id").distinct(), "champion_id", "left_anti").groupBy("champion_id").agg(F.count("*").alias("rows"))


def new_only(rows: DataFrame, loaded: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not loaded yet; null parts of a key equal each other."""
    other = loaded.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return rows.join(other, cond, "left_anti")


def name_reference(column: str = "name"):
    """`` `123`` names the entry 123 of a list; anything else is no reference."""
    digits = F.regexp_extract(F.col(column), "^`([0-9]+)$", 1)
    return F.when(digits != "", digits.try_cast("int"))


def team_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(team_id, name): a non-blank name is never overwritten."""
    o, n = old.select("team_id", F.col("name").alias("_o")), new.select("team_id", F.col("name").alias("_n"))
    return o.join(n, "team_id", "full_outer").select("team_id", F.coalesce(F.when(F.trim("_o") != "", F.col("_o")), F.col("_n")).alias("name"))


def latest_snapshot(old: DataFrame, new: DataFrame, key: str, values: list[str], keep_if_null: list[str]) -> DataFrame:
    """Snapshot rows overwritten by new ones, the first record of a key wins; ``keep_if_null`` columns stay where the new row has none.

    ``new`` needs a column ``ordinal`` that tells which record is first.
    """
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))).where("_rn = 1")
    a, b = old.select(key, *(F.col(v).alias(f"_o_{v}") for v in values), F.lit(True).alias("_old")), first.select(key, *(F.col(v).alias(f"_n_{v}") for v in values), F.lit(True).alias("_new"))
    pick = [(F.coalesce(f"_n_{v}", f"_o_{v}") if v in keep_if_null else F.when(F.col("_new"), F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}"))).alias(v) for v in values]
    return a.join(b, key, "full_outer").select(key, *pick)
