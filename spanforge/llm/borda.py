"""One ranking from several differently scaled scores, by Borda count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.runtime import cut

#: Scores of one question and scorer that one task ranks; larger groups are cut at their quantiles.
GROUP_ROWS = 20_000
SALTS = 16  # over which the candidates of one question are dealt where they meet its totals


def candidate_scores(scores: DataFrame, scorers: DataFrame) -> DataFrame:
    """question_id, chunk_id, scorer, goodness (larger is better): the latest usable (neither
    null nor NaN) score of each; null where there is none, so that every candidate has a row.
    Of equally late ones the largest score counts; repeated rows count once."""
    rows = scores.select("question_id", "scorer", "chunk_id", "score", "scored_at").where("question_id is not null and chunk_id is not null")
    usable = F.col("score").isNotNull() & ~F.isnan("score") & F.col("scorer").isNotNull()
    last = F.max(F.when(usable, F.struct("scored_at", "score")))
    way = scorers.groupBy("scorer").agg(F.coalesce(F.max("higher_is_better"), F.lit(True)).alias("_up"))
    one = rows.groupBy("question_id", "chunk_id", "scorer").agg(last.alias("_l")).join(way, "scorer", "left")
    score = F.col("_l.score")
    return one.select("question_id", "chunk_id", "scorer", F.when(F.coalesce("_up", F.lit(True)), score).otherwise(-score).alias("goodness"))


def _ranked_together(scores: DataFrame) -> DataFrame:
    """competition_ranks of groups that one task ranks."""
    group = Window.partitionBy("question_id", "scorer")
    rank = F.rank().over(group.orderBy(F.desc("goodness")))
    ties = F.count("*").over(Window.partitionBy("question_id", "scorer", "goodness"))
    return scores.select("question_id", "scorer", "chunk_id", (rank + (ties - 1) / 2).alias("place"), F.count("*").over(group).alias("scored"))


def _ranked_in_parts(scores: DataFrame, group_rows: int) -> DataFrame:
    """competition_ranks of large groups. Equal scores are counted first; the different ones are
    cut at their quantiles, and each part is ranked by itself and moved by the counts of the
    parts above it. There are at most rows / group_rows such groups, so what is known of each is
    broadcast; scores equal to more than ``group_rows`` others get their place that way too."""
    key = ["question_id", "scorer"]
    values = cut(scores.groupBy(*key, "goodness").agg(F.count("*").alias("ties")), "score-values")
    cuts = F.array_distinct(F.percentile_approx("goodness", [i / 64 for i in range(1, 64)], 1000))
    marks = values.groupBy(*key).agg(F.sum("ties").alias("scored"), cuts.alias("_cuts"))
    parts = values.join(F.broadcast(marks), key).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("goodness")))).drop("_cuts")
    above = parts.groupBy(*key, "_part").agg(F.sum("ties").alias("_ties"))
    down = Window.partitionBy(*key).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(*key, "_part", F.coalesce(F.sum("_ties").over(down), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*key, "_part").orderBy(F.desc("goodness")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_above") + F.coalesce(F.sum("ties").over(inside), F.lit(0)) + (F.col("ties") + 1) / 2
    places = cut(parts.join(F.broadcast(above), [*key, "_part"]).select(*key, "goodness", "ties", "scored", place.alias("place")), "score-places")
    crowded = places.where(F.col("ties") > group_rows)
    found = [scores.join(F.broadcast(crowded), [*key, "goodness"]), scores.join(F.broadcast(crowded), [*key, "goodness"], "left_anti").join(places, [*key, "goodness"])]
    return found[0].unionByName(found[1]).select(*key, "chunk_id", "place", "scored")


def competition_ranks(scores: DataFrame, totals: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """question_id, scorer, chunk_id, place, scored: the place of each score in its question
    and scorer, 1 is best, equal scores sharing the mean of their places, and how many scores
    there are.

    ``scores`` has question_id, scorer, chunk_id and goodness, ``totals`` the number ``scored``
    of each question and scorer. No task ranks more than about ``group_rows`` scores.
    """
    large = totals.where(F.col("scored") > group_rows).select("question_id", "scorer")
    if large.isEmpty():
        return _ranked_together(scores)
    few = F.broadcast(large)  # at most rows / group_rows
    small = _ranked_together(scores.join(few, ["question_id", "scorer"], "left_anti"))
    return small.unionByName(_ranked_in_parts(scores.join(few, ["question_id", "scorer"], "left_semi"), group_rows))


def borda(scores: DataFrame, scorers: DataFrame, weights: dict[str, float] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """question_id, chunk_id, points: Borda points of each candidate chunk of each question.

    A candidate is every chunk with any row of its question; rows with a null question_id or
    chunk_id are dropped. With n candidates, place r gives n - r points. A candidate without a
    usable score of a scorer is last for it: such candidates share the places after the scored
    ones by their mean (of the mid-rank rule this keeps the averaging, and places them last as
    the data's rule demands). ``scorers.higher_is_better`` gives the direction; null or unknown
    counts as true, and a repeated scorer counts once. Infinite scores rank as extremes.
    ``weights`` multiplies a scorer's points, 1 by default. Empty tables give no rows.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("scorer") == name, F.lit(float(w))).otherwise(weight)
    candidates = cut(candidate_scores(scores, scorers), "candidate-scores")
    good = candidates.where("goodness is not null")
    totals = cut(good.groupBy("question_id", "scorer").agg(F.count("*").alias("scored")), "score-totals")
    ranks = competition_ranks(good, totals, group_rows)
    # the points of a scored candidate beyond those of an unscored one: w * ((scored + 1 + n) / 2 - place)
    scored = ranks.select("question_id", "chunk_id", (weight * ((F.col("scored") + 1) / 2 - F.col("place"))).alias("_fixed"), weight.alias("_half"))
    others = candidates.where("goodness is null").select("question_id", "chunk_id", F.lit(0.0).alias("_fixed"), F.lit(0.0).alias("_half"))
    mine = cut(scored.unionByName(others).groupBy("question_id", "chunk_id").agg(F.sum("_fixed").alias("_fixed"), F.sum("_half").alias("_half")), "candidate-points")
    # every scorer as if a candidate were unscored: w * (n - (scored + 1 + n) / 2) = w * (n - 1 - scored) / 2
    facts = mine.select("question_id", F.lit(1).alias("n"), F.lit(0.0).alias("_lost"), F.lit(0.0).alias("_all"))
    facts = facts.unionByName(totals.select("question_id", F.lit(0).alias("n"), (weight * F.col("scored")).alias("_lost"), weight.alias("_all")))
    facts = facts.groupBy("question_id").agg(*(F.sum(c).alias(c) for c in ("n", "_lost", "_all")))
    facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = mine.withColumn("_salt", F.pmod(F.hash("chunk_id"), F.lit(SALTS)))
    points = (F.col("_all") * (F.col("n") - 1) - F.col("_lost")) / 2 + F.col("_fixed") + F.col("_half") * F.col("n") / 2
    return salted.join(facts, ["question_id", "_salt"]).select("question_id", "chunk_id", F.round(points, 6).alias("points"))


def leading(ranked: DataFrame, k: int) -> DataFrame:
    """The k first of each question by points, then chunk_id, with their 1-based position."""
    w = Window.partitionBy("question_id").orderBy(F.desc("points"), "chunk_id")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
