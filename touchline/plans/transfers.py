"""Squad planning: every formation and every set of kept players, best buy under the budget."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import zip_ranked
from touchline.operators.models import best_plan

# Allowed formations (defenders, midfielders, forwards).
FORMATIONS = [(3, 4, 3), (3, 5, 2), (4, 3, 3), (4, 4, 2), (4, 5, 1), (5, 3, 2), (5, 4, 1), (5, 2, 3)]
POSITIONS = ["G", "D", "M", "F"]


def formation_plans(managers: DataFrame, formations=FORMATIONS) -> DataFrame:
    """One plan per manager and formation, nothing kept. ``managers`` has manager_id, budget."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("formation"), F.lit(1).alias("need_G"), F.lit(d).alias("need_D"), F.lit(m).alias("need_M"), F.lit(f).alias("need_F"))
        for i, (d, m, f) in enumerate(formations)
    ])
    return managers.select("manager_id", "budget", F.lit(0.0).alias("keep_points"), F.explode(rows).alias("_f")).select(
        "manager_id", "budget", "keep_points", "_f.*"
    )


def _at(position: str):
    return lambda s: s["pos"] == position


def keep_plans(squads: DataFrame, keep: int = 5, formations=FORMATIONS, carry: tuple[str, ...] = ()) -> DataFrame:
    """All plans of each manager: formations x keep-sets of the squad's kept-able slots. Columns named in ``carry`` go along.

    ``squads``: manager_id, bank, slots array<struct<pos, xpts, price, must_sell>>. A keep-set is a
    number whose bits are the kept slots of the squad, however many it has; plans whose kept players do not fit the formation are dropped.
    """
    shapes = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(1).alias("G"), F.lit(d).alias("D"), F.lit(m).alias("M"), F.lit(f).alias("F")) for i, (d, m, f) in enumerate(formations)])
    sets = F.filter(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("slots")) - 1), lambda m: F.bit_count(m) == keep)
    p = squads.select("*", F.explode(sets).alias("keep_set"))
    p = p.withColumn("_kept", F.filter("slots", lambda s, i: F.getbit("keep_set", i) == 1))
    p = p.where(~F.exists("_kept", lambda s: s.isNull() | s["must_sell"]))
    add = lambda arr, f: F.aggregate(F.transform(arr, lambda s: s[f].cast("double")), F.lit(0.0), lambda a, b: a + b)
    p = p.withColumns({
        "keep_points": add(F.col("_kept"), "xpts"), "budget": F.col("bank") + add(F.col("slots"), "price") - add(F.col("_kept"), "price"),
        **{f"_k{q}": F.size(F.filter("_kept", _at(q))) for q in POSITIONS},
    })
    p = p.select("manager_id", "keep_set", "keep_points", "budget", *carry, *[f"_k{q}" for q in POSITIONS], F.explode(shapes).alias("_f"))
    p = p.select("manager_id", "keep_set", "keep_points", "budget", *carry, F.col("_f.id").alias("formation"), *[(F.col(f"_f.{q}") - F.col(f"_k{q}")).alias(f"need_{q}") for q in POSITIONS])
    ok = F.lit(True)
    for q in POSITIONS:
        ok = ok & (F.col(f"need_{q}") >= 0)
    return p.where(ok)


def best_transfers(plans: DataFrame, candidates: DataFrame, plan_keys: list[str]) -> DataFrame:
    """Best plan per manager."""
    return best_plan(plans, plan_keys, ["manager_id"], candidates, POSITIONS)


def _place(position: str):
    """Order of a position on the pitch; unknown ones come last."""
    order = F.lit(9)
    for i, p in enumerate(POSITIONS):
        order = F.when(F.col(position) == p, i).otherwise(order)
    return order


def swaps(sold: DataFrame, bought: DataFrame, keys: list[str]) -> DataFrame:
    """Pair sold and bought players by position (goalkeeper to forward), with points gained over the one replaced.

    ``sold``: keys, pos, ordinal (place in the squad), id, xpts; ``bought``: the same with the order of purchase. Within a
    position each side keeps its ordinals; a side may cross positions where the formation changes.
    """
    sides = []
    for df, side in ((sold, "sold"), (bought, "bought")):
        sides.append(df.select(*keys, F.col("id").alias(side), F.col("pos").alias(f"{side}_pos"), F.col("xpts").alias(f"{side}_xpts"), F.col("ordinal").alias(f"_{side}_ord")))
    out = zip_ranked(*sides, keys, [_place("sold_pos"), F.col("_sold_ord")], [_place("bought_pos"), F.col("_bought_ord")])
    return out.withColumn("over_replaced", F.round(F.col("bought_xpts") - F.col("sold_xpts"), 2)).drop("_sold_ord", "_bought_ord")


def planned_swaps(squads: DataFrame, best: DataFrame) -> DataFrame:
    """The swaps of each manager's best plan: the slots that its keep-set leaves out against what it buys.

    ``squads`` as for ``keep_plans``, with an ``id`` in every slot; ``best`` has manager_id, keep_set and chosen.
    """
    # lists are many times their size in files, by which Spark would take a side for small enough to go through the driver
    both = squads.join(best.where(F.col("total").isNotNull()).hint("merge"), "manager_id")
    slot = both.select("manager_id", "keep_set", F.posexplode("slots").alias("ordinal", "_s")).where(F.getbit("keep_set", F.col("ordinal")) == 0)
    sold = slot.select("manager_id", "ordinal", F.col("_s.id").alias("id"), F.col("_s.pos").alias("pos"), F.col("_s.xpts").alias("xpts"))
    buy = both.select("manager_id", F.posexplode("chosen").alias("ordinal", "_s"))
    bought = buy.select("manager_id", "ordinal", F.col("_s.id").alias("id"), F.col("_s.position").alias("pos"), F.col("_s.xpts").alias("xpts"))
    return swaps(sold, bought, ["manager_id"])
