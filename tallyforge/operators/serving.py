"""Reading the aggregate tables: ranked tiers, pair pivots, buckets, coverage, line-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.estimates import SIGNAL

#: A champion's standing of a pair, from dealing d and deaths x; null effects never pass the threshold.
D, X, T = "coalesce(dealing, 0)", "coalesce(deaths, 0)", "tanking"
BUCKET = f"""case when dealing is null or deaths is null then 'NEUTRAL'
  when side = 'ALLY' and dealing < -{SIGNAL} and deaths > {SIGNAL} then 'ANTI_SYNERGY'
  when side = 'ALLY' and (deaths < -{SIGNAL} or dealing > {SIGNAL}) then 'DUO'
  when side = 'FOE' and deaths > {SIGNAL} then 'HARD_FOE'
  when side = 'FOE' and deaths < -{SIGNAL} then 'EASY_FOE' else 'NEUTRAL' end"""
RANK_VALUE = f"""case bucket when 'HARD_FOE' then {X} when 'EASY_FOE' then -{X} when 'DUO' then {D} - {X} when 'ANTI_SYNERGY' then {X} - {D}
  else greatest(abs({D}), abs({X})) end"""
LEAD_METRIC = f"case when bucket <> 'DUO' or -{X} >= {D} then 'deaths' else 'dealing' end"
AFFINITY = {"HARD_FOE": X, "EASY_FOE": f"-{X}", "DUO": f"greatest(-{X}, {D})", "ANTI_SYNERGY": f"least({X}, -{D})"}
SIDE_OF = {"HARD_FOE": "FOE", "EASY_FOE": "FOE", "DUO": "ALLY", "ANTI_SYNERGY": "ALLY"}
#: The cases and their order are fixed values: signatures have to agree with those that users know.
SIGNATURE = f"""case when dealing is null or deaths is null or tanking is null then null
  when side = 'ALLY' and dealing < -{SIGNAL} and deaths > {SIGNAL} then 'hinders'
  when side = 'ALLY' and deaths < -{SIGNAL} and tanking < -{SIGNAL} then 'draws_fire'
  when side = 'ALLY' and deaths < -{SIGNAL} and abs(tanking) <= {SIGNAL} then 'protects'
  when side = 'ALLY' and dealing > {SIGNAL} and deaths <= {SIGNAL} then 'opens_damage'
  when side = 'FOE' and dealing < -{SIGNAL} and deaths > {SIGNAL} and tanking > {SIGNAL} then 'indirect_counter'
  when side = 'FOE' and deaths > {SIGNAL} then 'presses'
  when side = 'FOE' and deaths < -{SIGNAL} then 'easy'
  when side = 'FOE' and dealing > {SIGNAL} then 'absorbs' end"""
TOP, SHOWN = 10, 5
DECK, DECK_ROLES = 4, 2
META_TARGETS, META_GAMES, TESTED = 6, 20, 20


def pair_pivot(effects: DataFrame) -> DataFrame:
    """One row for each (career, side, subject, other) with a column a metric; observations are those of dealing."""
    wide = effects.groupBy("career_id", "side", "subject", "other").pivot("metric", ["dealing", "tanking", "healing", "kills", "deaths", "assists"]).agg(F.first("effect"))
    n = effects.where("metric = 'dealing'").select("career_id", "side", "subject", "other", "observations")
    return wide.join(n, ["career_id", "side", "subject", "other"], "left")


def classified(pivot: DataFrame) -> DataFrame:
    """Adds bucket, rank_value, lead_metric, favourable and signature."""
    b = pivot.withColumn("bucket", F.expr(BUCKET))
    return b.withColumns({"rank_value": F.expr(RANK_VALUE), "lead_metric": F.expr(LEAD_METRIC), "favourable": F.expr("cast(bucket in ('EASY_FOE', 'DUO') as int)"), "signature": F.expr(SIGNATURE)})


def buckets(rows: DataFrame, top: int = TOP, shown: int = SHOWN) -> DataFrame:
    """Per subject and bucket its ``top`` rows by rank value, filled up to ``shown`` from neutral rows that lean that way; kind tells which is which."""
    lanes = F.explode(F.array(*(F.struct(F.lit(k).alias("lane"), F.lit(SIDE_OF[k]).alias("lane_side"), F.expr(v).alias("affinity")) for k, v in AFFINITY.items())))
    each = rows.withColumn("l", lanes).where("l.lane_side = side and (bucket = l.lane or (bucket = 'NEUTRAL' and l.affinity > 0))")
    flat = each.select("career_id", "subject", "other", "l.lane", "rank_value", "l.affinity", (F.col("bucket") == F.col("l.lane")).alias("hit"))
    keys = ["career_id", "subject", "lane"]
    order = Window.partitionBy(*keys, "hit").orderBy(F.when(F.col("hit"), F.col("rank_value")).otherwise(F.col("affinity")).desc(), "other")
    whole = Window.partitionBy(*keys)
    n = flat.withColumn("rn", F.row_number().over(order)).withColumn("hits", F.least(F.lit(top), F.count_if(F.col("hit")).over(whole)))
    kept = n.where(F.when(F.col("hit"), F.col("rn") <= top).otherwise(F.col("rn") <= F.greatest(F.lit(0), F.lit(shown) - F.col("hits"))))
    return kept.select(*keys, "other", F.when(F.col("hit"), "sure").otherwise("leans").alias("kind"), F.col("rn").cast("bigint").alias("rn"))


def lookup(catalogue: DataFrame, overall: DataFrame, in_role: DataFrame, keys: list[str]) -> DataFrame:
    """Each champion of ``catalogue`` (keys) with its rank within its role; without one its overall rank, and without that bare: (keys, found, rank, games, adjusted)."""
    r = in_role.select(*keys, F.col("rank").alias("_r"), F.lit(True).alias("_in_role"))
    o = overall.select(*keys, F.col("rank").alias("_o"), "games", "adjusted", F.lit(True).alias("_in_all"))
    j = catalogue.select(*keys).join(o, keys, "left").join(r, keys, "left")
    found = F.when(F.col("_in_all").isNull(), "bare").when(F.col("_in_role").isNull(), "overall").otherwise("role")
    return j.select(*keys, found.alias("found"), F.when(F.col("_in_all"), F.when(F.col("_in_role"), F.col("_r")).otherwise(F.col("_o"))).alias("rank"), F.coalesce("games", F.lit(0)).alias("games"), "adjusted")


def meta_targets(tiers: DataFrame, games: int = META_GAMES, top: int = META_TARGETS) -> DataFrame:
    """The best champions of each career in official contests with enough games."""
    w = Window.partitionBy("career_id").orderBy(F.col("adjusted").desc(), "champion_id")
    return tiers.where(~F.col("include_scrim") & (F.col("games") >= games)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("career_id", F.col("champion_id").alias("target"), "adjusted", F.col("place").cast("bigint").alias("place"))


def counter_candidates(effects: DataFrame, targets: DataFrame, tiers: DataFrame, signal: float = SIGNAL) -> DataFrame:
    """Champions against which a target dies more: (career, champion, target, effect, observations, games)."""
    e = effects.where(f"side = 'FOE' and metric = 'deaths' and effect > {signal}").select("career_id", F.col("subject").alias("target"), F.col("other").alias("champion_id"), "effect", "observations")
    games = tiers.where(~F.col("include_scrim")).select("career_id", "champion_id", "games")
    return e.join(targets.select("career_id", "target"), ["career_id", "target"]).join(games, ["career_id", "champion_id"], "left").withColumn("games", F.coalesce("games", F.lit(0)))


def best_counters(candidates: DataFrame) -> DataFrame:
    """One line a champion: the least observed, then the stronger, then the smaller target; whether it is worth testing."""
    w = Window.partitionBy("career_id", "champion_id").orderBy("observations", F.col("effect").desc(), "target")
    return candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("to_test", (F.col("observations") < TESTED).cast("int"))


def tried_pairs(rows: DataFrame, match_type: str) -> DataFrame:
    """Unordered pairs of champions on one side of a contest type, with how often; pairs come from a side's own array."""
    side = rows.where(F.col("match_type") == match_type).groupBy("career_id", "match_id", "side").agg(F.array_sort(F.collect_list("champion_id")).alias("c"))
    pairs = side.withColumn("a", F.explode("c")).withColumn("b", F.explode(F.expr("filter(c, x -> x > a)")))
    return pairs.groupBy("career_id", "a", "b").agg(F.count("*").alias("times"))


def unexplored(catalogue: DataFrame, known: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of each career's catalogue (career_id, champion_id) that are neither known nor tried. All pairs are asked for, so the result grows with the square of the catalogue, never with contests."""
    ids = catalogue.groupBy("career_id").agg(F.array_sort(F.collect_set("champion_id")).alias("ids"))
    pairs = ids.withColumn("a", F.explode("ids")).select("career_id", "a", F.explode(F.expr("filter(ids, x -> x > a)")).alias("b"))
    return pairs.join(known, ["career_id", "a", "b"], "left_anti").join(tried, ["career_id", "a", "b"], "left_anti")


def combos(rows: DataFrame, size: int) -> DataFrame:
    """Tallies of champion pairs or triples on one side, ids ascending."""
    side = rows.groupBy("career_id", "match_id", "side").agg(F.array_sort(F.collect_list("champion_id")).alias("c"), F.first("is_winner").alias("won"))
    out = side.withColumn("a", F.explode("c")).withColumn("b", F.explode(F.expr("filter(c, x -> x > a)")))
    keys = ["career_id", "a", "b"]
    if size == 3:
        out, keys = out.withColumn("c3", F.explode(F.expr("filter(c, x -> x > b)"))), [*keys, "c3"]
    return out.groupBy(*keys).agg(F.count("*").alias("games"), F.sum(F.col("won").cast("bigint")).alias("wins"))


def compositions(rows: DataFrame, k0: float = 24.0) -> DataFrame:
    """Role composition of a side as five counts, its games, wins and shrunk rate."""
    side = rows.groupBy("career_id", "match_id", "side").agg(*(F.count_if(F.col("role") == r).alias(f"r{r}") for r in range(5)), F.first("is_winner").alias("won"))
    key = F.concat_ws("-", *(f"r{r}" for r in range(5)))
    g = side.groupBy("career_id", key.alias("comp")).agg(F.count("*").alias("games"), F.sum(F.col("won").cast("bigint")).alias("wins"))
    return g.withColumn("adjusted", F.round((F.col("wins") + k0 * 0.5) / (F.col("games") + k0), 6))


def decks(counters: DataFrame, pool: DataFrame, pairs: DataFrame, count: int = 3) -> DataFrame:
    """Line-ups of four for each career, built greedily: (career_id, deck, slot, champion_id, target).

    counters: career_id, champion_id, target, observations, effect; pool: career_id, champion_id, role, games; pairs:
    career_id, a, b that are not explored. A career's input is bounded by its catalogue, careers run in parallel.
    """
    rows = counters.selectExpr("career_id", "'counter' as kind", "champion_id", "target as x", "observations as y", "cast(effect as double) as z")
    rows = rows.unionByName(pool.selectExpr("career_id", "'pool' as kind", "champion_id", "cast(role as bigint) as x", "cast(games as bigint) as y", "0.0D as z"))
    rows = rows.unionByName(pairs.selectExpr("career_id", "'pair' as kind", "a as champion_id", "b as x", "0L as y", "0.0D as z"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        pick = part[part["kind"] == "counter"].sort_values(["y", "z", "champion_id"], ascending=[True, False, True])
        fill = part[part["kind"] == "pool"].sort_values(["y", "champion_id"])
        role = dict(zip(fill["champion_id"], fill["x"], strict=True))
        open_pairs = {frozenset(p) for p in part[part["kind"] == "pair"][["champion_id", "x"]].itertuples(index=False)}
        used: set[int] = set()
        out = []
        for deck in range(count):
            members: dict[int, int | None] = {}
            for r in pick.itertuples():
                if len(members) < DECK and r.champion_id not in used and r.champion_id not in members and r.x not in members.values():
                    members[r.champion_id] = r.x
            if not members:
                break
            while len(members) < DECK:
                free = [f for f in fill["champion_id"] if f not in used and f not in members and not (len(members) == DECK - 1 and len({role.get(m) for m in [*members, f]}) < DECK_ROLES)]
                if not free:
                    members = {}
                    break
                members[max(free, key=lambda f: sum(frozenset((f, m)) in open_pairs for m in members))] = None
            if not members:
                break
            used |= members.keys()
            out += [(part["career_id"].iloc[0], deck, slot, m, t) for slot, (m, t) in enumerate(members.items())]
        return pd.DataFrame(out, columns=["career_id", "deck", "slot", "champion_id", "target"]).astype({"target": "Int64"})

    return rows.groupBy("career_id").applyInPandas(build, "career_id int, deck int, slot int, champion_id bigint, target bigint")


def deck_scores(decks: DataFrame, known: DataFrame, tried: DataFrame) -> DataFrame:
    """How many of a line-up's six pairs are known, only tried, or unexplored, and how many targets it has."""
    g = decks.groupBy("career_id", "deck").agg(F.array_sort(F.collect_list("champion_id")).alias("c"), F.count("target").alias("targets"))
    pairs = g.withColumn("a", F.explode("c")).withColumn("b", F.explode(F.expr("filter(c, x -> x > a)")))
    k, t = known.select("career_id", "a", "b", F.lit(1).alias("k")), tried.select("career_id", "a", "b", F.lit(1).alias("t"))
    j = pairs.join(k, ["career_id", "a", "b"], "left").join(t, ["career_id", "a", "b"], "left")
    return j.groupBy("career_id", "deck", "targets").agg(F.count_if(F.col("k").isNotNull()).alias("known"), F.count_if(F.col("k").isNull() & F.col("t").isNotNull()).alias("tried"), F.count_if(F.col("k").isNull() & F.col("t").isNull()).alias("unexplored"))
