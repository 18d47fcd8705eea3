"""Statistical experiments over contest facts. Random choices are integer hashes of ids and a seed, never a generator's stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 2147483647


def draw(ident: Column | str, seed: Column | int) -> Column:
    """A hash of an id and a seed in [0, MODULUS): two linear steps with a fold between them."""
    i = F.col(ident) if isinstance(ident, str) else ident
    i, s = i.cast("bigint"), (F.lit(seed) if isinstance(seed, int) else seed).cast("bigint")
    a = (i * 48271 + s * 16807 + 12345) % MODULUS
    return ((a + F.floor(a / 65536).cast("bigint") * 31) * 69621 + 7) % MODULUS


DRAW_SQL = "((((({i}) * 48271 + ({s}) * 16807 + 12345) % 2147483647) + (((({i}) * 48271 + ({s}) * 16807 + 12345) % 2147483647) // 65536) * 31) * 69621 + 7) % 2147483647"


def oriented(contests: DataFrame, seed: int) -> DataFrame:
    """Contests as left and right champions and teams, sides swapped by a hash; y is 1 if the left side won; margin is left minus right."""
    flip = draw("match_id", seed) % 2 == 1
    ids = lambda side: F.transform(F.filter("stats", lambda s: s["side"] == side), lambda s: s["champion_id"])
    c = contests.withColumns({"flip": flip, "_b": ids("BLUE"), "_r": ids("RED")})
    return c.select(
        "career_id", "match_id", "match_type",
        F.when(F.col("flip"), F.col("_r")).otherwise(F.col("_b")).alias("left"), F.when(F.col("flip"), F.col("_b")).otherwise(F.col("_r")).alias("right"),
        F.when(F.col("flip"), F.col("red_team_id")).otherwise(F.col("blue_team_id")).alias("left_team"), F.when(F.col("flip"), F.col("blue_team_id")).otherwise(F.col("red_team_id")).alias("right_team"),
        ((F.col("winner_side") == "BLUE") != F.col("flip")).cast("int").alias("y"),
        (F.when(F.col("flip"), -1).otherwise(1) * (F.col("blue_score") - F.col("red_score"))).cast("bigint").alias("margin"),
    )


def log_likelihood(p: Column, y: Column) -> Column:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def gram_by_fold(rows: DataFrame, keys: list[str], term: Column, target: str, weight: str) -> DataFrame:
    """Sums (keys, fold, j, k, v) of least squares: v is sum w x_j x_k, with k '' for sum w x_j y and j and k '' for sum w y y; a fold's training sums are the total less its own.

    ``term`` is an array of (f, m) of a row: distinct features with their values.
    """
    y, w = F.col(target), F.col(weight)
    t = rows.withColumn("_x", F.concat(F.array(F.struct(F.lit("").alias("f"), y.cast("double").alias("m"))), term))
    e = t.withColumn("_a", F.explode("_x")).withColumn("_b", F.explode(F.expr("filter(_x, z -> z.f <= _a.f)")))
    return e.groupBy(*keys, "fold", F.col("_a.f").alias("j"), F.col("_b.f").alias("k")).agg(F.sum(w * F.col("_a.m") * F.col("_b.m")).alias("v"), F.sum(F.when((F.col("_a.f") == "") & (F.col("_b.f") == ""), w)).alias("n"))


def nested_cv(gram: DataFrame, keys: list[str], models: dict[str, tuple[str, ...]], penalties: dict[str, float], key_schema: str) -> DataFrame:
    """(keys, model, fold, sse, zero, n): held-out squared error of each nested model, from the sums alone.

    A model is the prefixes of the features that it may use. Features that training has not seen are left at 0.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(part["j"])
        folds = np.unique(part["fold"])
        a, j, k = np.searchsorted(folds, part["fold"]), np.searchsorted(names, part["j"]), np.searchsorted(names, part["k"])
        v = part["v"].to_numpy()

        def dense(rows: np.ndarray) -> np.ndarray:
            g = np.zeros((len(names), len(names)))
            g[j[rows], k[rows]] = v[rows]
            g[k[rows], j[rows]] = v[rows]
            return g

        n = part[(part["j"] == "") & (part["k"] == "")].set_index("fold")["n"]
        total, out = np.zeros((len(names), len(names))), []
        for f in range(len(folds)):  # one fold's matrix at a time
            total += dense(a == f)
        kind = np.array([x.split(":")[0] for x in names])
        for i, f in enumerate(folds):
            own = dense(a == i)
            for model, kinds in models.items():
                use = np.flatnonzero(np.isin(kind, kinds))
                theta = np.zeros(len(names))
                if len(use):
                    train = total[np.ix_(use, use)]
                    train -= own[np.ix_(use, use)]
                    train[np.diag_indices(len(use))] += [penalties[x] for x in kind[use]]
                    theta[use] = np.linalg.solve(train, total[use, 0] - own[use, 0])
                sse = own[0, 0] - 2 * theta @ own[:, 0] + theta @ own @ theta
                out.append((*part[keys].iloc[0], model, int(f), float(sse), float(own[0, 0]), float(n[f])))
        return pd.DataFrame(out, columns=[*keys, "model", "fold", "sse", "zero", "n"])

    return gram.groupBy(*keys).applyInPandas(solve, f"{key_schema}, model string, fold int, sse double, zero double, n double")


def margin_terms() -> Column:
    """The signed champions of an oriented contest as (f, m)."""
    return F.expr("concat(transform(left, x -> struct(concat('champion:', x) as f, 1.0D as m)), transform(right, x -> struct(concat('champion:', x) as f, -1.0D as m)))")


def side_rates(rows: DataFrame, k: float = 24.0) -> DataFrame:
    """(match_id, side, champions, won, p): each side with the chance that the shrunk rates of its champions give."""
    r = rows.groupBy("champion_id").agg(((F.sum(F.col("is_winner").cast("int")) + k / 2) / (F.count("*") + k)).alias("r"))
    return rows.join(r, "champion_id").groupBy("match_id", "side").agg(F.array_sort(F.collect_list("champion_id")).alias("c"), F.max(F.col("is_winner").cast("int")).alias("won"), F.avg("r").alias("p"))


def combo_moments(sides: DataFrame, extra: list[str] | None = None, size: int = 2) -> DataFrame:
    """(a, b, n, wins, expected, noise) of pairs on a side, or (a, b, c3, ...) of triples: observed and expected wins and the sum of p (1 - p), the moments of a Poisson binomial."""
    combos = sides.withColumn("a", F.explode("c")).withColumn("b", F.explode(F.expr("filter(c, x -> x > a)")))
    keys = [*(extra or []), "a", "b"]
    if size == 3:
        combos, keys = combos.withColumn("c3", F.explode(F.expr("filter(c, x -> x > b)"))), [*keys, "c3"]
    return combos.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("won").alias("wins"), F.sum("p").alias("expected"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise"))


def decomposition(moments: DataFrame, least: int, by: list[str] | None = None) -> DataFrame:
    """Variance of observed rates, of expected rates, of their difference, and what chance alone gives."""
    m = moments.where(F.col("n") >= least)
    n = F.col("n")
    aggs = [F.count("*").alias("combos"), F.var_pop(F.col("wins") / n).alias("observed"), F.var_pop(F.col("expected") / n).alias("expected"), F.var_pop((F.col("wins") - F.col("expected")) / n).alias("residual"), F.avg(F.col("noise") / (n * n)).alias("noise")]
    return m.groupBy(*by).agg(*aggs) if by else m.agg(*aggs)


def shrunk_combos(moments: DataFrame, least: int, top: int) -> DataFrame:
    """The ``top`` combos by shrunk effect: observed less expected rate, pulled to 0 by v / (v + noise), where v is the variance beyond chance of all combos."""
    m = moments.where(F.col("n") >= least)
    v = m.agg(F.greatest(F.var_pop((F.col("wins") - F.col("expected")) / F.col("n")) - F.avg(F.col("noise") / (F.col("n") * F.col("n"))), F.lit(0.0)).alias("v"))
    each = m.join(F.broadcast(v), how="cross").withColumn("reliability", F.col("v") / (F.col("v") + F.col("noise") / (F.col("n") * F.col("n"))))  # one row
    each = each.withColumns({"observed": F.col("wins") / F.col("n"), "expected": F.col("expected") / F.col("n")}).withColumn("shrunk", (F.col("observed") - F.col("expected")) * F.col("reliability"))
    # To nine places, so that equal effects order by id.
    return each.orderBy(F.round(F.abs("shrunk"), 9).desc(), "a", "b").limit(top)


def half_life_grid(rows: DataFrame, lives: list[float], k: float = 24.0, by: list[str] | None = None) -> DataFrame:
    """(half_life, by, champion, rate, kept, ess): shrunk rates under each half-life of elapsed boundaries; 0 means no decay. Rows are counted by distance before they meet the grid."""
    keys = [*(by or []), "champion_id"]
    sums = rows.groupBy(*keys, "elapsed").agg(F.count("*").alias("c"), F.sum(F.col("is_winner").cast("int")).alias("v"))
    g = sums.withColumn("half_life", F.explode(F.array(*map(F.lit, lives))))
    w = F.when(F.col("half_life") == 0, 1.0).otherwise(F.pow(F.lit(0.5), F.col("elapsed") / F.when(F.col("half_life") > 0, F.col("half_life"))))
    t = g.withColumn("_w", w).groupBy("half_life", *keys).agg(F.sum("c").alias("n"), F.sum(F.col("_w") * F.col("c")).alias("sw"), F.sum(F.col("_w") * F.col("v")).alias("sv"), F.sum(F.col("_w") * F.col("_w") * F.col("c")).alias("sq"))
    return t.select("half_life", *keys, ((F.col("sv") + k / 2) / (F.col("sw") + k)).alias("rate"), "n", "sw", (F.col("sw") * F.col("sw") / F.col("sq")).alias("ess"))


def grid_summary(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per half-life: kept share of weight, entities with ess of at least 10, rank correlation with no decay, largest and mean shift, largest rank move."""
    by = by or []
    w = Window.partitionBy(*by, "half_life").orderBy(F.col("rate").desc(), "champion_id")
    r = grid.withColumn("place", F.row_number().over(w))
    base = r.where("half_life = 0").select(*by, "champion_id", F.col("rate").alias("r0"), F.col("place").alias("p0"))
    j = r.join(base, [*by, "champion_id"])
    shift, move = F.abs(F.col("rate") - F.col("r0")), F.abs(F.col("place") - F.col("p0"))
    return j.groupBy(*by, "half_life").agg(
        (F.sum("sw") / F.sum("n")).alias("kept"), F.count_if(F.col("ess") >= 10).alias("solid"), F.coalesce(F.corr("place", "p0"), F.lit(1.0)).alias("spearman"), F.max(shift).alias("max_shift"), F.avg(shift).alias("mean_shift"), F.max(move).cast("bigint").alias("max_move")
    )


#: Self half-lives of the grid that stand for no decay, and for dropping all that precedes a champion's last change.
NO_DECAY, HARD_CUT = 1e9, 0.0


def decay_grid(rows: DataFrame, self_lives: list[float], lives: list[float], k: float = 24.0) -> DataFrame:
    """(self_life, life, changed, kept, mean_shift, max_shift, max_move): what each pair of half-lives, of a champion's own changes and of boundaries passed, does to shrunk
    rates. Shares and shifts are of champions that changed within the data, rank moves of all, each against no decay on either axis.

    Observations are counted by champion and distances before they meet the grid, so its cells multiply a few sums and not the rows.
    """
    sums = rows.groupBy("champion_id", "elapsed", "self_d").agg(F.count("*").alias("n"), F.sum(F.col("is_winner").cast("int")).alias("v"))
    changed = sums.groupBy("champion_id").agg(F.max(F.col("self_d") > 0).alias("changed"))
    cell = F.explode(F.array(*(F.struct(F.lit(s).alias("self_life"), F.lit(x).alias("life")) for s in self_lives for x in lives)))
    by_self = F.when(F.col("g.self_life") == HARD_CUT, (F.col("self_d") == 0).cast("double")).otherwise(F.pow(F.lit(0.5), F.col("self_d") / F.col("g.self_life")))
    weight = by_self * F.pow(F.lit(0.5), F.col("elapsed") / F.col("g.life"))
    each = sums.withColumn("g", cell).withColumn("w", weight).groupBy("g.self_life", "g.life", "champion_id").agg(F.sum(F.col("w") * F.col("n")).alias("sw"), F.sum(F.col("w") * F.col("v")).alias("sv"))
    # To nine places, so that rates which are equal rank by id whatever the order of sums.
    rated = each.withColumn("rate", F.round((F.col("sv") + k / 2) / (F.col("sw") + k), 9))
    placed = rated.withColumn("place", F.row_number().over(Window.partitionBy("self_life", "life").orderBy("rate", "champion_id"))).join(changed, "champion_id")
    base = placed.where((F.col("self_life") == NO_DECAY) & (F.col("life") == NO_DECAY)).select("champion_id", F.col("rate").alias("r0"), F.col("sw").alias("w0"), F.col("place").alias("p0"))
    of = lambda c: F.when(F.col("changed"), c)
    shift = F.abs(F.col("rate") - F.col("r0"))
    return placed.join(base, "champion_id").groupBy("self_life", "life").agg(
        F.count_if("changed").alias("changed"), (F.sum(of(F.col("sw"))) / F.sum(of(F.col("w0")))).alias("kept"), F.avg(of(shift)).alias("mean_shift"), F.max(of(shift)).alias("max_shift"), F.max(F.abs(F.col("place") - F.col("p0"))).cast("bigint").alias("max_move")
    )


def ranked_by_draw(df: DataFrame, by: list[str], ident: str, seed: int, buckets: int = 1024) -> DataFrame:
    """Adds ``place``, from 0, in the order of a hash of ``ident`` within ``by``. Rows are numbered within ranges of the hash and the ranges' counts are added up, so no task sorts a whole group."""
    d = df.withColumn("_draw", draw(ident, seed)).withColumn("_bucket", F.floor(F.col("_draw") / (MODULUS // buckets + 1)).cast("int"))
    sizes = d.groupBy(*by, "_bucket").count()
    first = sizes.withColumn("_first", F.sum("count").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("count")).drop("count")  # as many rows as buckets
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_draw", ident)) - 1
    return d.withColumn("_within", within).join(first, [*by, "_bucket"]).withColumn("place", F.col("_first") + F.col("_within")).drop("_draw", "_bucket", "_within", "_first")


def elements(df: DataFrame, value: str, by: list[str], places: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """(by, n, places): elements of the sorted values in [0, 1] of each group; ``places`` are expressions of n, from 0. Exact: a histogram tells which narrow range has each place, and only that is sorted."""
    d = df.select(*by, value).withColumn("_bucket", F.least(F.floor(F.col(value) * buckets), F.lit(buckets - 1)).cast("int"))
    w = Window.partitionBy(*by)
    hist = d.groupBy(*by, "_bucket").agg(F.count("*").alias("_c")).withColumn("n", F.sum("_c").over(w)).withColumn("_first", F.sum("_c").over(w.orderBy("_bucket")) - F.col("_c"))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), p.cast("bigint").alias("place")) for k, p in places.items()))
    where = hist.withColumn("_p", F.explode(wanted)).where("_p.place >= _first and _p.place < _first + _c").select(*by, "_bucket", "n", "_p", "_first")
    # Numbered once a range, however many places lie in it.
    ranges = where.groupBy(*by, "_bucket", "n", "_first").agg(F.collect_list("_p").alias("_ps"))
    sorted_ = d.join(ranges, [*by, "_bucket"]).withColumn("_at", F.col("_first") + F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(value)) - 1)
    hit = sorted_.withColumn("_p", F.explode("_ps")).where("_p.place = _at")
    return hit.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_p.name") == k, F.col(value))).alias(k) for k in places))


def split_deviation(rows: DataFrame, seed: int, k0: float = 24.0, k1: float = 15.0) -> DataFrame:
    """(split, champion, n, dev): how far each champion's rate in a version's contests, shrunk to its whole rate, lies from it; split 'version', and 'random' for
    as many contests dealt by a hash into windows of the same sizes."""
    contests = rows.where("patch_seq is not null").select("career_id", "match_id", "patch_seq").distinct()
    sizes = contests.groupBy("career_id", "patch_seq").count()
    edges = sizes.groupBy("career_id").agg(F.array_sort(F.collect_list(F.struct("patch_seq", "count"))).alias("s"))  # a career's versions
    edges = edges.withColumn("ends", F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y["count"])))
    dealt = ranked_by_draw(contests, ["career_id"], "match_id", seed).join(edges, "career_id").select("match_id", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("_window"))
    won = F.col("is_winner").cast("int")
    whole = rows.groupBy("career_id", "champion_id").agg(((F.sum(won) + k0 / 2) / (F.count("*") + k0)).alias("t"))
    both = rows.join(dealt, "match_id").withColumn("x", F.explode(F.array(F.struct(F.lit("version").alias("split"), F.col("patch_seq").cast("int").alias("win")), F.struct(F.lit("random").alias("split"), F.col("_window").alias("win")))))
    each = both.groupBy("x.split", "career_id", "champion_id", "x.win").agg(F.count("*").alias("n"), F.sum(won).alias("v"))
    return each.join(whole, ["career_id", "champion_id"]).select("split", "champion_id", "n", F.abs((F.col("v") + k1 * F.col("t")) / (F.col("n") + k1) - F.col("t")).alias("dev"))


def windows(rows: DataFrame, events: DataFrame) -> DataFrame:
    """(career, champion, seq, n0, r0, n1, r1, touched, direction): win rates in the windows before and from each boundary, and what it did to the champion."""
    each = rows.withColumn("win", F.coalesce("patch_seq", F.lit(0))).groupBy("career_id", "champion_id", "win").agg(F.count("*").alias("n"), F.avg(F.col("is_winner").cast("double")).alias("r"))
    a, b = each.select("career_id", "champion_id", (F.col("win") + 1).alias("seq"), F.col("n").alias("n0"), F.col("r").alias("r0")), each.select("career_id", "champion_id", F.col("win").alias("seq"), F.col("n").alias("n1"), F.col("r").alias("r1"))
    e = events.select("career_id", "champion_id", "seq", F.signum("attack").cast("int").alias("direction"), F.lit(1).alias("touched"))
    j = a.join(b, ["career_id", "champion_id", "seq"]).join(e, ["career_id", "champion_id", "seq"], "left")
    return j.select("career_id", "champion_id", "seq", "n0", "r0", "n1", "r1", F.coalesce("touched", F.lit(0)).alias("touched"), F.coalesce("direction", F.lit(0)).alias("direction"))
