"""Knockout bracket: standings, positions, fixtures, winners round by round."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import probability as pr
from touchline.operators import competition as cp
from touchline.operators.joins import unordered_pair
from touchline.session import durable


def fixtures_from_slots(slots: DataFrame, positions: DataFrame) -> DataFrame:
    """Fixtures whose sides are slots like '1A': event_id, home, away (null where no team holds the slot).

    ``slots``: event_id, slot_home, slot_away.
    """
    table = slots
    for side in ("home", "away"):
        dim = positions.select(F.col("position").alias(f"slot_{side}"), F.col("team").alias(side))
        table = table.join(dim, f"slot_{side}", "left")
    return table.select("event_id", "home", "away")


def group_slots(groups: DataFrame) -> DataFrame:
    """Slots of the first round: first and second of a group against fourth and third of the next group.

    ``groups``: grp, ordinal (0, 1, ... without gaps); the last group meets the first.
    """
    n = groups.agg(F.count("*")).first()[0]
    rival = groups.select(F.pmod(F.col("ordinal") - 1, F.lit(max(1, n))).alias("ordinal"), F.col("grp").alias("rival"))
    pair = lambda k, a, b: F.struct((2 * F.col("ordinal") + k).cast("long").alias("event_id"), F.concat(F.lit(a), "grp").alias("slot_home"), F.concat(F.lit(b), "rival").alias("slot_away"))
    return groups.join(rival, "ordinal").select(F.explode(F.array(pair(1, "1", "4"), pair(2, "2", "3"))).alias("s")).select("s.*")


def ladder(first: DataFrame) -> DataFrame:
    """Edges event_id, from_a, from_b of all rounds after ``first``, whose event ids are 1, 2, ... without gaps.

    Winners of neighbours meet; an odd one out has no rival and passes. Only the number of fixtures is read here.
    """
    size, offset = first.count(), 0
    spans = []
    while size > 1:
        spans.append((offset, size))
        offset, size = offset + size, (size + 1) // 2
    spark = first.sparkSession
    edges = spark.createDataFrame([], "event_id long, from_a long, from_b long")
    for offset, size in spans:
        j = F.col("id")
        b = F.when(2 * j + 2 <= size, offset + 2 * j + 2)
        edges = edges.union(spark.range((size + 1) // 2).select((offset + size + 1 + j).alias("event_id"), (offset + 2 * j + 1).alias("from_a"), b.alias("from_b")))
    return edges


def decide(fixtures: DataFrame, strengths: DataFrame, form: DataFrame, results: DataFrame, hosts: list[str], max_goals: int = 7) -> DataFrame:
    """Lambdas, win probabilities and winner of each fixture of one round.

    ``results``: pair (home|away sorted), res_home, res_away, res_score_home, res_score_away, pens.
    A played pair is decided by its result, any other by the model's favourite.
    """
    f = cp.knockout_lambdas(fixtures, strengths, form, hosts)
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    f = f.withColumns({
        "p_home": F.round(pr.p_home_win(lh, la, max_goals, 0.0), 3), "p_away": F.round(pr.p_away_win(lh, la, max_goals, 0.0), 3),
        "pair": unordered_pair(F.col("home"), F.col("away")),
    })
    f = f.join(results, "pair", "left")
    same = F.col("res_home") == F.col("home")
    sh = F.when(same, F.col("res_score_home")).otherwise(F.col("res_score_away"))
    sa = F.when(same, F.col("res_score_away")).otherwise(F.col("res_score_home"))
    pens = F.when(same | F.col("pens").isNull(), F.col("pens")).otherwise(F.when(F.col("pens") == "home", "away").otherwise("home"))
    side = cp.winner_side(sh, sa, pens, F.col("p_home"), F.col("p_away"))
    winner = F.when(F.col("home").isNull(), F.col("away")).when(F.col("away").isNull(), F.col("home")).otherwise(
        F.when(side == "home", F.col("home")).otherwise(F.col("away"))
    )
    return f.select("event_id", "home", "away", "lambda_home", "lambda_away", "p_home", "p_away", winner.alias("winner"), sh.isNotNull().alias("confirmed"))


def project_bracket(first_round: DataFrame, edges: DataFrame, strengths: DataFrame, form: DataFrame, results: DataFrame, hosts: list[str]) -> DataFrame:
    """All fixtures of a bracket of any depth, with the round in which they can be played.

    ``edges``: event_id, from_a, from_b: the fixtures whose winners meet (null: no rival, the other side passes). Rounds
    are found on the way: a fixture is decided once all it comes from are, whatever lies between. Each round reads the
    ones before from the files it wrote. Edges that go in a circle or name no fixture raise an error.
    """
    done = durable(decide(first_round, strengths, form, results, hosts).withColumn("round", F.lit(1)))
    waiting, level = durable(edges), 1
    left = waiting.count()
    while left:
        level += 1
        known = done.select("event_id", "winner")
        came = [known.select(F.col("event_id").alias(f"from_{x}"), F.col("winner").alias(side), F.lit(True).alias(f"has_{x}")) for x, side in (("a", "home"), ("b", "away"))]
        both = waiting.join(came[0], "from_a", "left").join(came[1], "from_b", "left")
        ready = (F.col("from_a").isNull() | F.col("has_a").isNotNull()) & (F.col("from_b").isNull() | F.col("has_b").isNotNull())
        played = durable(decide(both.where(ready).select("event_id", "home", "away"), strengths, form, results, hosts).withColumn("round", F.lit(level)))
        waiting = durable(waiting.join(played, "event_id", "left_anti"))
        before, left = left, waiting.count()
        if left == before:
            raise ValueError(f"{left} fixtures wait for each other or for none of the table")
        done = done.unionByName(played)
    return done
