"""Season book of a schedule: standings, ranks, streaks, win chances and notability, each seen before a match.

Only earlier days of the same competition and season count. A team's days are added up by one
window on a spine of its competition's days, so no match is joined to all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["competition_id", "season"]
MIN_MATCHES, MIN_STREAK, MAX_TAGS = 5, 2, 4
#: Weights of notability: own team, close score, standings, upset, rivalry.
WEIGHTS = {"player": 0.35, "close": 0.20, "standings": 0.20, "upset": 0.15, "rivalry": 0.10}


def winner(matches: DataFrame) -> DataFrame:
    """Adds winner_id and loser_id (null on a draw or before the match), the order-free key, and sweep."""
    played = F.col("progress") >= 1
    blue, red = F.col("blue_score") > F.col("red_score"), F.col("red_score") > F.col("blue_score")
    return matches.withColumns(
        {
            "played": played,
            "winner_id": F.when(played & blue, F.col("blue_team_id")).when(played & red, F.col("red_team_id")),
            "loser_id": F.when(played & blue, F.col("red_team_id")).when(played & red, F.col("blue_team_id")),
            "team_a": F.least("blue_team_id", "red_team_id"),
            "team_b": F.greatest("blue_team_id", "red_team_id"),
            "sweep": played & (blue | red) & (F.least("blue_score", "red_score") == 0),
        }
    )


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows a match, one for each team: won (1, 0, or null on a draw), set_diff, kill_diff."""
    side = F.explode(F.array(F.lit("blue"), F.lit("red"))).alias("me")
    m = matches.select("*", side)
    blue = F.col("me") == "blue"
    team = F.when(blue, F.col("blue_team_id")).otherwise(F.col("red_team_id"))
    sets, kills = F.col("blue_score") - F.col("red_score"), F.col("blue_kill") - F.col("red_kill")
    return m.select("schedule_id", *GROUP, "day", "played", "winner_id", team.alias("team_id"), F.when(blue, sets).otherwise(-sets).alias("set_diff"), F.when(blue, kills).otherwise(-kills).alias("kill_diff")).withColumn(
        "won", F.when(F.col("winner_id").isNotNull(), (F.col("winner_id") == F.col("team_id")).cast("int"))
    )


def standings(matches: DataFrame) -> DataFrame:
    """(competition, season, day, team): played, wins, set_diff, kill_diff over earlier days, and the rank; teams enter with their first earlier match."""
    rows = team_rows(matches)
    daily = rows.where("played").groupBy(*GROUP, "team_id", "day").agg(F.count("*").alias("n"), F.coalesce(F.sum("won"), F.lit(0)).alias("w"), F.sum("set_diff").alias("s"), F.sum("kill_diff").alias("k"))
    days = matches.select(*GROUP, "day").distinct()
    spine = days.join(daily.select(*GROUP, "team_id").distinct(), GROUP)
    w = Window.partitionBy(*GROUP, "team_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    run = spine.join(daily, [*GROUP, "team_id", "day"], "left").select(*GROUP, "day", "team_id", *(F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(name) for c, name in (("n", "played"), ("w", "wins"), ("s", "set_diff"), ("k", "kill_diff"))))
    in_ = run.where("played > 0")
    order = Window.partitionBy(*GROUP, "day").orderBy(F.col("wins").desc(), F.col("set_diff").desc(), F.col("kill_diff").desc())
    return in_.withColumn("rank", F.rank().over(order).cast("bigint"))


def brackets(matches: DataFrame) -> DataFrame:
    """Per competition and season: matches, teams, and whether it is shaped like a bracket (one match less than teams)."""
    g = team_rows(matches).groupBy(*GROUP).agg(F.count_distinct("schedule_id").alias("matches"), F.count_distinct("team_id").alias("teams"))
    return g.withColumn("bracket", F.col("matches") == F.col("teams") - 1)


def before(matches: DataFrame) -> DataFrame:
    """Matches with the standing of both teams before them; no rank in a bracket."""
    s, b = standings(matches), brackets(matches).select(*GROUP, "bracket")
    out = matches.join(b, GROUP, "left")
    for side in ("blue", "red"):
        own = s.select(*GROUP, "day", F.col("team_id").alias(f"{side}_team_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("played", "wins", "set_diff", "kill_diff", "rank")))
        out = out.join(own.withColumnRenamed(f"{side}_set_diff", f"{side}_sets").withColumnRenamed(f"{side}_kill_diff", f"{side}_kills"), [*GROUP, "day", f"{side}_team_id"], "left")
    return out.withColumns({f"{x}_rank": F.when(~F.col("bracket"), F.col(f"{x}_rank")) for x in ("blue", "red")})


def after(matches: DataFrame) -> DataFrame:
    """(schedule_id, team_id, rank_before, rank_after) of both teams of a played match with a winner: the table is updated and ranked again."""
    m = winner(matches).where("winner_id is not null").select("schedule_id", *GROUP, "day", "blue_team_id", "red_team_id", "winner_id", (F.col("blue_score") - F.col("red_score")).alias("sets"), (F.col("blue_kill") - F.col("red_kill")).alias("kills"))
    table = m.join(standings(winner(matches)), [*GROUP, "day"])
    sign = F.when(F.col("team_id") == F.col("blue_team_id"), 1).when(F.col("team_id") == F.col("red_team_id"), -1).otherwise(0)
    new = table.withColumns({"w2": F.col("wins") + (F.col("team_id") == F.col("winner_id")).cast("int"), "s2": F.col("set_diff") + sign * F.col("sets"), "k2": F.col("kill_diff") + sign * F.col("kills")})
    w = Window.partitionBy("schedule_id").orderBy(F.col("w2").desc(), F.col("s2").desc(), F.col("k2").desc())
    both = F.array_contains(F.collect_set("team_id").over(Window.partitionBy("schedule_id")), F.col("blue_team_id")) & F.array_contains(F.collect_set("team_id").over(Window.partitionBy("schedule_id")), F.col("red_team_id"))
    ranked = new.withColumn("rank_after", F.rank().over(w).cast("bigint")).withColumn("both", both)
    return ranked.where("both and team_id in (blue_team_id, red_team_id)").select("schedule_id", "team_id", F.col("rank").alias("rank_before"), "rank_after")


def remaining(matches: DataFrame) -> DataFrame:
    """(schedule_id, remaining): other matches of the competition and season that are not played."""
    open_ = F.count_if(~F.col("played")).over(Window.partitionBy(*GROUP))
    return winner(matches).withColumn("open", open_).select("schedule_id", (F.col("open") - (~F.col("played")).cast("int")).cast("bigint").alias("remaining"))


def chances(matches: DataFrame) -> DataFrame:
    """(schedule_id, blue_rate, red_rate, chance): rates of teams with enough matches, and blue's chance by log5; one half where both always win or lose."""
    b = before(winner(matches))
    rate = {s: F.when(F.col(f"{s}_played") >= MIN_MATCHES, F.col(f"{s}_wins") / F.col(f"{s}_played")) for s in ("blue", "red")}
    b = b.withColumns({f"{s}_rate": r for s, r in rate.items()})
    up = F.col("blue_rate") * (1 - F.col("red_rate"))
    whole = up + F.col("red_rate") * (1 - F.col("blue_rate"))
    return b.select("schedule_id", "blue_rate", "red_rate", F.when(F.col("blue_rate").isNotNull() & F.col("red_rate").isNotNull(), F.when(whole <= 0, 0.5).otherwise(up / whole)).alias("chance"))


def streaks(matches: DataFrame) -> DataFrame:
    """(schedule_id, team_id, streak): signed run of equal results on earlier days; a draw ends it. Same-day results count together
    in order of schedule_id. Gaps and islands, then the last state of an earlier day."""
    rows = team_rows(winner(matches))
    key = [*GROUP, "team_id"]
    w = Window.partitionBy(*key).orderBy("day", F.col("schedule_id"))
    done = rows.where("played").withColumn("r", F.coalesce("won", F.lit(-1)))
    isles = done.withColumn("new", F.when(F.lag("r").over(w) == F.col("r"), 0).otherwise(1)).withColumn("isle", F.sum("new").over(w))
    count = isles.withColumn("run", F.row_number().over(Window.partitionBy(*key, "isle").orderBy("day", "schedule_id")))
    signed = count.withColumn("s", F.when(F.col("r") == 1, F.col("run")).when(F.col("r") == 0, -F.col("run")).otherwise(0))
    end = signed.groupBy(*key, "day").agg(F.max_by("s", "schedule_id").alias("s"))
    spine = rows.select(*key, "day").distinct().join(end, [*key, "day"], "left")
    prior = spine.withColumn("streak", F.last("s", ignorenulls=True).over(Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(prior.select(*key, "day", "streak"), [*key, "day"]).select("schedule_id", "team_id", F.coalesce("streak", F.lit(0)).cast("bigint").alias("streak"))


def met_before(matches: DataFrame) -> DataFrame:
    """(schedule_id, met): whether the pair has played in an earlier season."""
    m = winner(matches)
    first = m.where("played").groupBy("team_a", "team_b").agg(F.min("season").alias("first"))
    return m.join(first, ["team_a", "team_b"], "left").select("schedule_id", F.coalesce(F.col("first") < F.col("season"), F.lit(False)).cast("int").alias("met"))


def perspective(matches: DataFrame, team: int) -> DataFrame:
    """How a played match looks to ``team``: plays, outcome (1, 0, -1), and if it does not play, its wins minus the winner's after the match."""
    m = before(winner(matches)).where("played")
    own = standings(winner(matches)).where(F.col("team_id") == team).select(*GROUP, "day", F.col("wins").alias("my_wins"), F.col("rank").alias("my_rank"))
    j = m.join(own, [*GROUP, "day"], "left")
    plays = (F.col("blue_team_id") == team) | (F.col("red_team_id") == team)
    won = F.when(F.col("winner_id").isNull(), 0).when(F.col("winner_id") == team, 1).otherwise(-1)
    theirs = F.when(F.col("winner_id") == F.col("blue_team_id"), F.col("blue_wins")).otherwise(F.col("red_wins"))
    gap = F.when(~plays & ~F.col("bracket") & F.col("winner_id").isNotNull() & F.col("my_rank").isNotNull(), F.col("my_wins") - theirs - 1)
    return j.select("schedule_id", plays.cast("int").alias("plays"), F.when(plays, won).alias("outcome"), gap.cast("bigint").alias("gap"))


def tags(matches: DataFrame, team: int) -> DataFrame:
    """(schedule_id, tags): at most MAX_TAGS codes a played match, the team's own view first."""
    b = before(winner(matches)).where("played").select("schedule_id", "blue_rank", "red_rank", "blue_team_id", "red_team_id")
    st = streaks(matches)
    for side in ("blue", "red"):
        b = b.join(st.select("schedule_id", F.col("team_id").alias(f"{side}_team_id"), F.col("streak").alias(f"{side}_streak")), ["schedule_id", f"{side}_team_id"])
    j = b.join(met_before(matches), "schedule_id").join(perspective(matches, team), "schedule_id")
    run = lambda s: F.when(F.abs(F.col(f"{s}_streak")) >= MIN_STREAK, F.concat(F.lit(f"{s}:"), F.col(f"{s}_streak")))
    made = F.array(
        F.when(F.col("plays") == 1, F.concat(F.lit("own:"), F.col("outcome"))).otherwise("other"),
        F.when(F.col("blue_rank").isNotNull() & F.col("red_rank").isNotNull(), F.concat_ws(":", F.lit("rank"), "blue_rank", "red_rank")),
        run("blue"),
        run("red"),
        F.when(F.col("met") == 1, "met"),
    )
    return j.select("schedule_id", F.array_join(F.slice(F.filter(made, lambda t: t.isNotNull()), 1, MAX_TAGS), ",").alias("tags"))


def notability(matches: DataFrame, team: int | None) -> DataFrame:
    """(schedule_id, score, paragraphs, comments, reasons): the weighted mean of the terms that are known."""
    m = before(winner(matches)).where("played")
    teams = standings(winner(matches)).groupBy(*GROUP, "day").agg(F.count("*").alias("league"))
    j = m.join(teams, [*GROUP, "day"], "left").join(chances(matches).select("schedule_id", "chance"), "schedule_id").join(met_before(matches), "schedule_id")
    mine = F.lit(None).cast("double") if team is None else ((F.col("blue_team_id") == team) | (F.col("red_team_id") == team)).cast("double")
    close = F.least(F.lit(1.0), F.least("blue_score", "red_score") / F.greatest(F.lit(1), F.col("need_win") - 1))
    near = F.when(F.col("blue_rank").isNotNull() & F.col("red_rank").isNotNull() & (F.col("league") > 1), 1 - F.least(F.lit(1.0), F.abs(F.col("blue_rank") - F.col("red_rank")) / (F.col("league") - 1)))
    upset = F.when(F.col("chance").isNotNull() & F.col("winner_id").isNotNull(), F.when(F.col("winner_id") == F.col("blue_team_id"), 1 - F.col("chance")).otherwise(F.col("chance")))
    rival = F.when(F.col("met") == 1, 1.0)
    t = {"player": mine, "close": close, "standings": near, "upset": upset, "rivalry": rival}
    j = j.withColumns({f"t_{k}": v for k, v in t.items()})
    earned = sum((F.coalesce(F.col(f"t_{k}"), F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    known = sum((F.when(F.col(f"t_{k}").isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    why = F.array(F.when(F.col("t_player") == 1, "own"), F.when(F.col("t_close") > 0.7, "close"), F.when(F.col("t_standings") >= 0.7, "standings"), F.when(F.col("t_upset") >= 0.6, "upset"), F.when(F.col("t_rivalry") == 1, "rivalry"))
    s = j.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), earned / known)))
    return s.select("schedule_id", "score", (F.lit(3) + F.floor(F.col("score") * 3 + 0.5)).cast("bigint").alias("paragraphs"), (F.lit(6) + F.floor(F.col("score") * 9 + 0.5)).cast("bigint").alias("comments"), F.array_join(F.array_compact(why), ",").alias("reasons"))


def sides_of_match(sets: DataFrame, matches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sets seen from the sides of their match: where the teams sat the other way round, blue_x and red_x of each of ``columns`` and the winner's side are exchanged.

    matches: keys, blue_team_id, red_team_id. Adds ``swapped``. A set of other teams than its match's is an error, since a join that is wrong elsewhere would show only here.
    """
    m = matches.select(*keys, F.col("blue_team_id").alias("_blue"), F.col("red_team_id").alias("_red"))
    same = (F.col("blue_team_id") == F.col("_blue")) & (F.col("red_team_id") == F.col("_red"))
    turned = (F.col("blue_team_id") == F.col("_red")) & (F.col("red_team_id") == F.col("_blue"))
    foreign = F.raise_error(F.concat_ws(" ", F.lit("a set of teams"), "blue_team_id", "red_team_id", F.lit("in a match of"), "_blue", "_red")).cast("boolean")
    j = sets.join(m, keys).withColumn("swapped", F.when(same, F.lit(False)).when(turned, F.lit(True)).otherwise(foreign))
    flipped = {f"{x}_{c}": F.when(F.col("swapped"), F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")) for c in ["team_id", *columns] for x, y in (("blue", "red"), ("red", "blue"))}
    winner_side = F.when(F.col("swapped"), F.when(F.col("winner_side") == "BLUE", "RED").when(F.col("winner_side") == "RED", "BLUE")).otherwise(F.col("winner_side"))
    return j.withColumns(flipped | {"winner_side": winner_side}).drop("_blue", "_red")


def next_unwritten(candidates: DataFrame, written: DataFrame, keys: list[str], by: list[str], first: str | None = None) -> DataFrame:
    """The latest (season, day) row of each group that ``written`` (keys) does not hold; of equal ones the least ``first``. Keys may be null."""
    same = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
    open_ = candidates.join(written.select(*(F.col(k).alias(f"_w_{k}") for k in keys)).distinct(), same, "left_anti")
    order = F.struct("season", "day", *([-F.col(first)] if first else []))
    return open_.groupBy(*by).agg(F.max_by(F.struct(*(c for c in candidates.columns if c not in by)), order).alias("x")).select(*by, "x.*")


#: What a match of the timeline has: nothing yet, an article, a gallery.
STAGES = (0, 1, 2)


def timeline(contests: DataFrame, articles: DataFrame, batches: DataFrame, team: int) -> DataFrame:
    """Official contests as matches (career, season, day, unordered teams): sets, wins of the smaller id, whether ``team`` won, the article, the latest gallery
    batch and how many there are, and the stage that this makes. Articles (article_id) and batches (batch_id) name a match by its teams in either order."""
    keys = ["career_id", "season", "day", "team_a", "team_b"]

    def named(df: DataFrame) -> DataFrame:
        return df.withColumns({"team_a": F.least("blue_team_id", "red_team_id"), "team_b": F.greatest("blue_team_id", "red_team_id")})

    won = F.when(F.col("winner_side") == "BLUE", F.col("blue_team_id")).otherwise(F.col("red_team_id"))
    dated = contests.where("match_type = 'OFFICIAL' and season is not null and day is not null and blue_team_id is not null and red_team_id is not null")
    m = named(dated).groupBy(*keys).agg(F.count("*").alias("sets"), F.count_if(won == F.col("team_a")).alias("wins_a"), F.max("match_id").alias("last_set"))
    a = named(articles).groupBy(*keys).agg(F.max("article_id").alias("article_id"))
    b = named(batches).groupBy(*keys).agg(F.max("batch_id").alias("batch_id"), F.count("*").alias("batches"))
    j = m.join(a, keys, "left").join(b, keys, "left").withColumn("batches", F.coalesce("batches", F.lit(0)))
    own = F.when(F.col("team_a") == team, F.col("wins_a") * 2 > F.col("sets")).when(F.col("team_b") == team, F.col("wins_a") * 2 < F.col("sets"))
    return j.withColumn("own_won", own.cast("int")).withColumn("stage", F.when(F.col("batches") > 0, STAGES[2]).when(F.col("article_id").isNotNull(), STAGES[1]).otherwise(STAGES[0]))
